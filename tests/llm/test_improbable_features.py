import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from blockscope.llm import improbable_features as features
from blockscope.llm import queries

SF = "/root/testdata/sf0.001"


def entropy_class(window):
    spread = sum(round(c * math.log2(c) * 65536) for c in Counter(window).values())
    most = round(32 * 5 * 65536)
    return (most - spread) * 1000 // most


def brute(text, ranks):
    """The filters of a text, window by window, stretch by stretch, bit by bit."""
    n = len(text) - 31
    if n < 1:
        chosen = [text] if text else []
    else:
        rank = [int(ranks[entropy_class(text[i : i + 32])]) for i in range(n)]
        stretch = min(64, max(1, n // 8))
        wins = Counter(min(range(s, s + stretch), key=lambda i: (rank[i], i)) for s in range(n - stretch + 1))
        strong = {i: w for i, w in wins.items() if rank[i] < 1001 - 100}
        places = sorted(i for i, w in strong.items() if w * 4 >= stretch)
        if not places:
            some = strong or wins
            places = [min(some, key=lambda i: (-some[i], i))]
        chosen = [*dict.fromkeys(text[i : i + 32] for i in places)]
    out = []
    for at in range(0, len(chosen), 160):
        bits = np.zeros(2048, dtype=bool)
        for f in chosen[at : at + 160]:
            digest = hashlib.sha1(f).digest()
            for k in range(5):
                bits[int.from_bytes(digest[4 * k : 4 * k + 4], "big") % 2048] = True
        out.append(np.packbits(bits))
    return np.array(out, dtype=np.uint8).reshape(-1, 256)


def texts_of_kinds():
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    prose = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 3, 5, 8, 12, 20, 70, 90, 130, 400, 900)]
    odd = ["", "a", "a" * 31, "a" * 32, "a" * 900, "ab" * 300, "é中😀" * 60, "\n" * 200 + prose[7], prose[8] * 2]
    return [t.encode() for t in prose + odd]


def test_fingerprints_equal_brute_force():
    texts = texts_of_kinds()
    ranks = features.ranks_of(features.class_counts(texts))
    counted = np.bincount([entropy_class(t[i : i + 32]) for t in texts for i in range(len(t) - 31)], minlength=1001)
    assert (features.class_counts(texts) == counted).all()
    for some in (texts, texts[::-1]):  # texts joined for counting do not meet
        for text, filters in zip(some, features.digests_of(some, ranks)):
            assert filters.tolist() == brute(text, ranks).tolist(), text[:40]


def test_windows_are_measured_alike_in_pieces(monkeypatch):
    data = np.frombuffer(texts_of_kinds()[9], dtype=np.uint8)
    whole = features.entropy_classes(data)
    monkeypatch.setattr(features, "_CHUNK", 100)
    assert (features.entropy_classes(data) == whole).all()


def test_likeness():
    rng = random.Random(4)
    text = lambda n: " ".join(f"{rng.getrandbits(40):x}" for _ in range(n)).encode()
    ranks = features.ranks_of(features.class_counts([text(3000)]))
    a, b = text(800), text(800)
    changed = a[: len(a) // 2] + b[: len(a) // 2]
    f, g, h, none = features.digests_of([a, b, changed, b""], ranks)
    assert features.likeness(f, f) == 1 and features.likeness(none, none) == 1
    assert features.likeness(f, none) == features.likeness(none, f) == 0
    assert features.likeness(f, g) < 0.05 and 0.25 < features.likeness(f, h) < 0.8
    assert features.likeness(f, h) == features.likeness(h, f)
    assert (features.as_filters(features.as_text(f)) == f).all() and features.as_text(none) == ""


def test_columns_of_fingerprints(spark):
    rows = [(1, "one two three " * 20), (2, None), (3, ""), (4, "one two three " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ranks = features.learn_ranks(df)
    from blockscope.llm.common import utf8

    out = df.select("doc_id", features.fingerprint_of(utf8("text"), ranks).alias("f"))
    f = {r.doc_id: r.f for r in out.collect()}
    assert f[1] == f[4] and f[2] == f[3] == ""
    near = out.select(features.likeness_of(out.f, out.f).alias("x")).collect()
    assert [r.x for r in near] == [1.0] * 4


def expected(rows):
    """(id, text) in order to the query's rows."""
    data = [(t or "") for _, t in rows]
    ranks = features.ranks_of(features.class_counts([t.encode() for t in data]))
    filters = [brute(t.encode(), ranks) for t in data]
    out = []
    for k, (doc_id, _) in enumerate(rows):
        follows = (k + 1) % len(rows)
        half = len(data[k]) // 2
        edited = data[k][: len(data[k]) - half] + data[follows][:half]
        changed = brute(edited.encode(), ranks)
        out.append((
            doc_id, len(data[k]), hashlib.sha256(edited.encode()).hexdigest(), features.as_text(filters[k]),
            features.as_text(changed), features.likeness(filters[k], changed),
            features.likeness(filters[k], filters[follows]),
        ))
    return out


@pytest.mark.parametrize("size", [features.SLICE_BYTES, 3000])
def test_query_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(features, "SLICE_BYTES", size)
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = expected([tuple(r) for r in rows])
    got = queries.op13_improbable_features(spark, SF).orderBy("doc_id").collect()
    assert [tuple(r)[:5] for r in got] == [w[:5] for w in want]
    assert np.allclose([r[5:] for r in map(tuple, got)], [w[5:] for w in want])


EDGE = [(3, None), (1, ""), (2, "short"), (7, "a word or two of text " * 30), (5, "a word or two of text " * 30),
        (5, "another"), (-4, "é" * 70_000), (None, "no id, but a text that is long enough to have a window")]


def test_edge_rows(spark):
    kind = "doc_id long, text string, id int, place string, part int, n_chars string"
    df = spark.createDataFrame([(i, t, 0, "x", 0, "x") for i, t in EDGE], kind).coalesce(1)
    ranks = features.learn_ranks(df)
    compare = lambda d: features.compare_with_next(d, ranks, queries.with_other_half)
    order = sorted(range(len(EDGE)), key=lambda k: (EDGE[k][0] is not None, EDGE[k][0] or 0, k))
    want = expected([EDGE[k] for k in order])
    got = [tuple(r) for r in compare(df).select(
        "doc_id", "n_chars", "variant_sha256", "fingerprint", "variant_fingerprint", "near_variant", "near_next").collect()]
    key = lambda r: (str(r[0]), r[2])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:])
    assert len(got) == len(want)
    assert compare(df.limit(0)).count() == 0
    one = compare(df.where("doc_id = 7")).first()
    assert one.near_next == 1 and one.n_chars == len(EDGE[3][1])
