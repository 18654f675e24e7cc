import math
import random
import re
from collections import Counter

import duckdb
import pytest

from blockscope.llm import queries, ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, best=10):
    split = [(i, Counter(terms(t))) for i, t in docs]
    split = [(i, c) for i, c in split if c]
    n, total = len(split), sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc_id, count in split:
            m = 25 + 75 * sum(count.values()) * n // total
            score = 0
            for t in terms(text):
                if t in count:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * count[t] // (1000 * count[t] + 8 * m))
            if score:
                scored.append((-score, doc_id is None, doc_id))
        for rank, (score, _, doc_id) in enumerate(sorted(scored)[:best], 1):
            out.append((item, rank, doc_id, -score))
    return sorted(out, key=str)


def test_terms_are_those_of_the_pattern():
    texts = ["A-b_c d9é İß x", "", None, "\x7f~`{|}@[\\]^", "中文 one,TWO;three four", "Ä̈́é́Z"]
    for t in texts:
        assert [b.decode() for b in ranked_search.terms_of(t and t.encode())] == terms(t)


def made(spark, docs, items, parts=3):
    kind = "doc_id long, text string, item_id string, row int, bundle int, block int, score int"
    d = spark.createDataFrame([(i, t, "x", 0, 0, 0, 0) for i, t in docs], kind).repartition(parts)
    kind = "item_id long, text string, doc_id string, row int, slot int, term int"
    return d, spark.createDataFrame([(i, t, "x", 0, 0, 0) for i, t in items], kind)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed, n=300, most=60):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 900}"  # noqa: E731  few words are most of the text
    return [(i, " ".join(word() for _ in range(rng.randrange(most)))) for i in range(n)], word, rng


@pytest.mark.parametrize("limits", [{}, {"BLOCK_ROWS": 7}, {"MOST_TERMS": 0}, {"MOST_ITEM_TERMS": 0, "MOST_BUNDLES": 0, "BLOCK_BYTES": 900}])
def test_results_equal_brute_force(spark, monkeypatch, limits):
    """Also with small blocks, and with the ways for vocabularies and items too large to send."""
    for name, value in limits.items():
        monkeypatch.setattr(ranked_search, name, value)
    docs, word, rng = corpus(5)
    docs += [(900 + k, docs[3][1]) for k in range(30)]  # equal scores
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 30)))) for k in range(25)]
    items += [(40, docs[3][1]), (41, "w1 w1 w1 w2"), (41, "w5"), (42, "nowhere"), (43, ""), (44, None)]
    d, i = made(spark, docs, items)
    assert rows(ranked_search.search(d, i)) == brute(docs, items)


def test_more_items_than_a_bundle(spark):
    docs, word, _ = corpus(8, 60)
    items = [(k, f"{word()} {word()} {word()}") for k in range(600)]
    d, i = made(spark, docs, items)
    assert rows(ranked_search.search(d, i.coalesce(1), best=3)) == brute(docs, items, 3)


def test_contenders_keep_whatever_may_still_win():
    import numpy as np

    scores = np.array([[0, 5_000_000, 4_000_000, 1_000_000, 4_000_001]])
    assert ranked_search.contenders(scores, np.array([0]), 2).tolist() == [[False, True, False, False, True]]
    assert ranked_search.contenders(scores, np.array([1]), 2).tolist() == [[False, True, True, False, True]]
    assert ranked_search.contenders(scores, np.array([0]), 9).tolist() == [[False, True, True, True, True]]


EDGE = [(1, None), (2, ""), (3, "..."), (4, "One two"), (4, "one TWO"), (None, "two"), (5, "two " * 100_000), (6, "three")]


def test_edge_rows(spark):
    items = [(1, "two one"), (None, "three"), (2, "TWO"), (2, "TWO")]
    d, i = made(spark, EDGE, items)
    assert rows(ranked_search.search(d, i)) == brute(EDGE, items)
    assert rows(ranked_search.search(d.limit(0), i)) == []
    assert rows(ranked_search.search(d, i.limit(0))) == []
    named = d.withColumn("doc_id", d.doc_id.cast("string"))
    assert rows(ranked_search.search(named, i)) == brute([(i and str(i), t) for i, t in EDGE], items)


def test_brute_force_agrees_with_the_oracle(tmp_path):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    want = brute(
        db.sql("select doc_id, text from documents").fetchall(), db.sql("select item_id, text from benchmark").fetchall()
    )
    assert sorted(db.sql(queries.oracle_sql()["op12_ranked_search"]).fetchall(), key=str) == want
