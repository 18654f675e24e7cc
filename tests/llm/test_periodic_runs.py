import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from blockscope.llm import periodic_runs, queries
from blockscope.llm.periodic_runs import runs_of_texts

SF = "/root/testdata/sf0.001"


def brute(words, least=6, exponent=4):
    """All maximal stretches of each period; a stretch has the least period it is found with."""
    found, n = {}, len(words)
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i >= 2 * p:
                found.setdefault((i, j - i + p), p)
            i = j + 1
    runs = [(s, n, p) for (s, n), p in found.items() if n >= max(least, exponent * p)]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def made(rng):
    kinds = rng.choice([1, 2, 3, 10, 1000])
    words = [b"%d" % rng.randrange(kinds) for _ in range(rng.randrange(200))]
    for _ in range(rng.randrange(4)):
        few = rng.choice([1, 2, 3, 50])
        block = [b"%d" % rng.randrange(few) for _ in range(rng.randrange(1, 60))]
        at = rng.randrange(len(words) + 1)
        words[at:at] = (block * rng.randrange(2, 9))[: rng.randrange(2 * len(block), 9 * len(block))]
    if rng.random() < 0.3:  # runs of runs
        words += (words[: rng.randrange(1, 30)] + [b"1"] * rng.randrange(20)) * rng.randrange(3, 7)
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(25):
        texts = [made(rng) for _ in range(rng.randrange(1, 12))]
        assert runs_of_texts(texts) == [brute(t) for t in texts]


def test_three_periods_are_enough_to_be_found():
    rng = random.Random(9)
    for _ in range(40):
        words = made(rng)
        assert runs_of_texts([words], 3, 3) == [brute(words, 3, 3)]


def test_every_period_is_found_at_its_scale():
    rng = random.Random(2)
    for p in range(1, 200):
        block = [b"%d" % rng.randrange(1 << 30) for _ in range(p)]
        size = max(6, 4 * p)
        words = [b"a", b"b"] + (block * 6)[:size] + [b"c"]
        assert runs_of_texts([words]) == [[(2, size, p)]]
        assert runs_of_texts([words[:-2] + [b"c"]]) == [[]]


def test_long_texts():
    cycle = [b"%d" % k for k in range(70_001)]
    assert runs_of_texts([cycle * 5]) == [[(0, 350_005, 70_001)]]
    assert runs_of_texts([[b"x"] * 500_000]) == [[(0, 500_000, 1)]]
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 100_000:  # many repeats, but none of four periods
        a, b = b, b + a
    assert runs_of_texts([b]) == [[]]


def edited(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = edited(doc_id, (text or "").encode().split())
    runs = brute(words)
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    left = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    milli = 1000 * best[1] // best[2] if runs else None
    digests = (hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())
    return (doc_id, len(runs), *best, milli, *digests)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    short = docs.where(F.length("text") < 12_000)
    want = {expected(*r) for r in short.collect()}
    got = queries.op11_periodic_runs(spark, SF).join(short.select("doc_id"), "doc_id").collect()
    assert {tuple(r) for r in got} == want and len(got) == short.count()
    assert sum(r.n_runs for r in got) > 0


ROWS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "a a a a a a"), (5, "a a a a a a"), (None, "b c " * 9),
    (6, "x\x0by\x0cx y x y x y"), (7, "é é é é " * 6), (8, "w " * 200_000),
]


def test_edge_rows(spark):
    kind = "doc_id long, text string, id int, runs string, n_words int, start int"
    df = spark.createDataFrame([(i, t, 0, "x", 0, 0) for i, t in ROWS], kind)
    got = periodic_runs.find_runs(df).collect()
    assert got[0].asDict().keys() == {"doc_id", "n_words", "runs", "collapsed"}
    found = sorted((str(r.doc_id), r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in got)
    want = []
    for i, t in ROWS:
        words = (t or "").encode().split()
        runs = brute(words) if len(words) < 1000 else [(0, 200_000, 1)]
        left = [w for k, w in enumerate(words) if not any(s + p <= k < s + n for s, n, p in runs)]
        want.append((str(i), len(words), tuple(runs), b" ".join(left).decode()))
    assert found == sorted(want)
    assert periodic_runs.find_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(df, least_exponent=2)


def test_planted_runs_follow_the_id(spark):
    rows = [(i, f" p{i}\tq{i}  r{i} s{i}\nt{i} " * 3) for i in range(400)] + [(i, None) for i in range(40)] + [(None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), tuple((r.text or "").split())) for r in queries.with_planted_runs(df).collect())
    assert got == sorted((str(i), tuple(edited(i, (t or "").split()))) for i, t in rows)
