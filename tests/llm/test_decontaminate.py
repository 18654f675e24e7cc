import random
import re
from collections import Counter

import pytest

from blockscope.llm import decontaminate as d
from blockscope.llm import oracle

WORDS = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)]


def words(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def similarity(a, b, k):
    x = Counter(tuple(a[i : i + min(k, len(a))]) for i in range(len(a) - min(k, len(a)) + 1))
    y = Counter(tuple(b[i : i + k]) for i in range(len(b) - k + 1))
    return sum((x & y).values()) / sum((x | y).values())


def brute(docs, items):
    """Best window of every document for every item, all windows of the item's size tried."""
    out = {}
    for doc_id, text in docs:
        w = tokens(text)
        for item_id, item in items:
            v = tokens(item)
            if not v or not w:
                continue
            k = min(5, len(v))
            starts = range(max(1, len(w) - len(v) + 1))
            best = max((similarity(w[s : s + len(v)], v, k), -s) for s in starts)
            if best[0] >= 0.8:
                found = (best[0], -best[1])
                out[doc_id, item_id] = max(out.get((doc_id, item_id), (0, 0)), found, key=lambda f: (f[0], -f[1]))
    return out


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, words int, size string"),
        spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc string"),
    )


def found(df):
    return {(r.doc_id, r.item_id): (pytest.approx(r.similarity), r.start_word) for r in df.collect()}


def test_copies_are_found_and_clean_documents_left(spark):
    rng = random.Random(3)
    items = [(k, " ".join(words(rng, n))) for k, n in enumerate([5, 8, 16, 20, 40, 59, 120, 3, 1])]
    docs = [(k, " ".join(words(rng, rng.randint(1, 200)))) for k in range(60)]
    for k, (_, item) in enumerate(items[:7]):
        v = item.split()
        docs.append((100 + k, " ".join(words(rng, 30) + v + words(rng, 9))))
        docs.append((200 + k, " ".join(words(rng, 3)) + "!\n" + ",  ".join(x.upper() for x in v)))
        docs.append((300 + k, item))
        docs.append((400 + k, " ".join(words(rng, 9) + v[:-1] + words(rng, 9))))  # last word changed
        docs.append((500 + k, " ".join(v[: len(v) // 2])))  # half is no copy
    expected = brute(docs, items)
    got = found(d.leaks(*frames(spark, docs, items)))
    assert {k: s for k, (s, _) in got.items()} == {k: s for k, (s, _) in expected.items()}
    # aligned windows: of equally similar ones next to each other the aligned one is named
    assert all(abs(got[k][1] - at) <= 4 for k, (_, at) in expected.items() if k[1] < 7)
    assert {(100 + k, k) for k in range(7)} | {(200 + k, k) for k in range(7)} <= set(got)


def test_many_anchors_give_the_windows_that_few_give(spark):
    """Items of one to nine words, documents without ids and repeated ones, words met again by a row's number."""
    rng = random.Random(8)
    items = [(k, " ".join(words(rng, n))) for k, n in enumerate([1, 2, 3, 4, 5, 9, 30])]
    docs = [(k % 30 or None, " ".join(words(rng, 20)) + " " + items[k % 7][1] + " " + " ".join(words(rng, k))) for k in range(40)]
    docs, items = frames(spark, docs + [(3, None), (4, "")], items)
    anchors = d.anchors_of(d.items_of(items, "item_id", "text", 5), 0.8).cache()

    def windows(most):
        return sorted(map(tuple, d.windows_of(docs, anchors, [1, 2, 3, 4, 5], "doc_id", "text", most).collect()), key=str)

    assert len(windows(0)) >= 40 and windows(0) == windows(d.MOST_ANCHORS)


def test_radius_misses_nothing_within_it(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(63) for _ in range(40)]
    near = [p ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 24))) for p in prints * 4]
    items = spark.createDataFrame([(k, 7, p) for k, p in enumerate(prints)], "item long, size int, fingerprint long")
    windows = spark.createDataFrame([(str(k), 7, p) for k, p in enumerate(near)], "window string, size int, fingerprint long")
    got = {(int(r.window), r.item) for r in d.within_radius(windows, items, d.RADIUS, d.BLOCKS).collect()}
    assert got == {
        (a, b) for a, p in enumerate(near) for b, q in enumerate(prints) if (p ^ q).bit_count() <= d.RADIUS
    }


def test_simhash_is_the_majority_of_word_hashes(spark):
    from pyspark.sql import functions as F

    texts = ["a b c", "a a b", "x", " ".join(["q"] * 40_000 + ["r"] * 39_999)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("w", F.split("t", " "))
    got = {r.t: r.fingerprint & (1 << 64) - 1 for r in d.simhash(df, "w", "t").collect()}
    import xxhash

    for t in texts:
        hashes = [xxhash.xxh64_intdigest(w, 42) for w in t.split()]
        n = len(hashes)
        assert got[t] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def test_edge_rows(spark):
    item = "one two three four five six seven"
    docs = [(1, None), (2, ""), (3, "!?"), (None, item), (4, item), (4, item), (5, item + " " + item), (6, "x " * 50_000 + item)]
    items = [(1, item), (1, item), (2, item), (3, None), (4, ""), (5, " - ")]
    got = found(d.leaks(*frames(spark, docs, items)))
    assert got == {(i, j): (1.0, 50_000 if i == 6 else 0) for i in (None, 4, 5, 6) for j in (1, 2)}
    left = d.keep_clean(*frames(spark, docs, items))
    assert left.columns == ["doc_id", "text", "words", "size"]
    assert sorted((r.doc_id for r in left.collect()), key=str) == [1, 2, 3, None]


def test_rows_without_an_id_are_judged_by_their_text(spark):
    item = "one two three four five six seven"
    docs = [(None, item), (None, item), (None, "x " * 9 + item), (None, "clean words of its own"), (None, None), (None, ""), (4, item), (5, "clean")]
    docs, items = frames(spark, docs, [(1, item)])
    left = d.keep_clean(docs.withColumnRenamed("words", "_key"), items, judge_null_ids=True)
    assert left.columns == ["doc_id", "text", "_key", "size"]
    kept = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert kept == sorted([(5, "clean"), (None, ""), (None, "clean words of its own"), (None, None)], key=str)


def test_stage_takes_out_copies_without_an_id(spark):
    import corpus_pipeline

    home = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{home}/benchmark.parquet").first().text
    docs = spark.createDataFrame([(None, item), (None, "clean words of its own")], "doc_id long, text string")
    assert [r.text for r in corpus_pipeline.decontamination(spark, docs, home).collect()] == ["clean words of its own"]


def test_empty_tables(spark):
    full = [(1, "one two three four five")]
    for docs, items in (([], full), (full, []), ([], [])):
        out = d.leaks(*frames(spark, docs, items))
        assert out.columns == ["doc_id", "item_id", "start_word", "similarity"] and out.count() == 0


def test_no_python_in_the_plan(spark):
    from blockscope.llm import queries

    plan = queries.op4_benchmark_leaks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    import check_queries

    home = "/root/testdata/sf0.01"
    assert check_queries.compare(spark, check_queries.oracle(home), name, home) == ""
