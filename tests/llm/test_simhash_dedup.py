import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from blockscope.llm import simhash_dedup as s
from blockscope.llm.components import components


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance):
    """Smallest index reachable over links of up to so many bits, by flooding."""
    todo, label = set(range(len(prints))), {}
    while todo:
        start = min(todo)
        seen, edge = {start}, [start]
        while edge:
            k = edge.pop()
            near = {j for j in todo - seen if (prints[j] ^ prints[k]).bit_count() <= distance}
            seen |= near
            edge += near
        label |= dict.fromkeys(seen, start)
        todo -= seen
    return [label[k] for k in range(len(prints))]


@pytest.mark.parametrize(
    "text",
    [None, "", " \n", "One", "one two", "One two THREE", "a b c d e f g", "a a a a a a", "É é\x0bx\x0cy z", "a\x1cb c d e", "x " * 700],
)
def test_fingerprint(text):
    data = None if text is None else text.encode()
    assert s.fingerprint(data) == brute_fingerprint(text)


def test_majority_counts_past_a_byte():
    hashes = np.array([1] * 600 + [2] * 599, dtype=np.uint64)
    assert s.majority(hashes) == 1
    assert s.majority(np.array([3, 5], dtype=np.uint64)) == 1


def test_thresholds_add_up_and_cost_least():
    rng = np.random.default_rng(1)
    costs = rng.random((50, 3, 5)).cumsum(axis=2)
    costs[:, :, 0] = 0
    units = s.cheapest(costs, 4)
    assert (units.sum(axis=1) == 4).all()
    for row in range(50):
        ways = [(a, b, 4 - a - b) for a in range(5) for b in range(5 - a)]
        least = min(sum(costs[row, p, u] for p, u in enumerate(w)) for w in ways)
        assert sum(costs[row, p, u] for p, u in enumerate(units[row])) == pytest.approx(least)


def test_bits_are_grouped_once_with_those_they_follow():
    rng = np.random.default_rng(2)
    bits = rng.random((4000, 64)) < 0.5
    bits[:, 40] = bits[:, 3]
    both = bits.T.astype(float) @ bits
    groups = s.arrange(4000, both, 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert any(3 in g and 40 in g for g in groups)


def clouds(n, seed):
    """Random fingerprints, some of them near others, and one dense cloud."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(n)}
    for p in list(out)[: n // 2]:
        out.add(p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    centre = rng.getrandbits(64)
    out |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(n)}
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("distance", [0, 1, 3, 5])
def test_classes_equal_brute_force(spark, distance):
    prints = clouds(150, distance)
    df = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")
    got = {r.fingerprint: r.root for r in s.classes(df, distance).collect()}
    expected = brute_components(prints, distance)
    pairs = {(got[signed(p)], k) for p, k in zip(prints, expected)}
    assert len(pairs) == len({a for a, _ in pairs}) == len(set(expected))


@pytest.mark.parametrize("parts", [2, 3, 4])
def test_no_link_is_lost_however_bits_are_parted(spark, parts):
    prints = clouds(120, 9)
    df = spark.createDataFrame([(signed(p), signed(p)) for p in prints], "fingerprint long, root long")
    plan = s.Partitions(*s.bit_counts(df), 3, parts)
    got = {frozenset((r.a, r.b)) for r in s.linked(df, 3, plan).collect()}
    expected = {
        frozenset((signed(p), signed(q)))
        for k, p in enumerate(prints)
        for q in prints[:k]
        if (p ^ q).bit_count() <= 3
    }
    assert got == expected


def test_wide_thresholds_are_chosen_for_many_fingerprints():
    both = np.full((64, 64), 0.25) + np.eye(64) * 0.25
    few = s.partitions_for(10**5, both * 10**5, 3)
    many = s.partitions_for(10**9, both * 10**9, 3)
    assert len(few.groups) == 4 and len(many.groups) < 4


def docs(spark, rows):
    kind = "doc_id long, text string, fingerprint string, class string, component_id string, id int"
    return spark.createDataFrame([(i, t, "x", "y", "z", 0) for i, t in rows], kind)


EDGE = [
    (5, "the cat sat on the mat"), (3, "the  CAT sat on\nthe mat"), (9, None), (8, ""), (7, " \t"),
    (None, "the cat sat on the mat"), (20, "a quite different text than the others"), (None, "nameless words here"),
    (None, "nameless words here"), (30, "word " * 30_000), (31, "one"), (32, "one"), (40, "same id"), (40, "same id"),
    (50, "two texts"), (50, "under one id, not alike"),
]


def test_edge_rows(spark):
    out = s.near_duplicates(docs(spark, EDGE))
    assert out.columns == ["doc_id", "fingerprint", "class", "component_id"]
    got = sorted(((r.doc_id, r.component_id) for r in out.collect()), key=str)
    component = {5: 3, 3: 3, 9: 7, 8: 7, 7: 7, 20: 20, 30: 30, 31: 31, 32: 31, 40: 40, 50: 50}
    expected = [(i, component.get(i)) for i, _ in EDGE if i is not None] + [(None, 3), (None, None), (None, None)]
    assert got == sorted(expected, key=str)


def test_one_row_of_each_class_stays(spark):
    out = s.one_per_class(docs(spark, EDGE))
    assert out.columns == docs(spark, []).columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    kept = [(3, EDGE[1][1]), (7, " \t"), EDGE[6], EDGE[7], EDGE[9], (31, "one"), (40, "same id"), *EDGE[-2:]]
    assert got == sorted(kept, key=str)


def test_empty_table(spark):
    assert s.near_duplicates(docs(spark, [])).count() == 0
    assert s.one_per_class(docs(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "x long, y long")
    got = {r.node: r.root for r in components(df, "x", "y").collect()}
    expected = dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 160), 100) | {200: 200, 201: 200}
    assert got == expected
    assert components(df.where(F.lit(False)), "x", "y").count() == 0


def test_query_equals_brute_force(spark):
    from blockscope.llm import queries

    home = "/root/testdata/sf0.01"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{home}/documents.parquet").collect())
    prints = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(prints, 3)
    expected = {i: (f"{p:016x}", rows[k][0]) for (i, _), p, k in zip(rows, prints, label)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op3_simhash_dedup(spark, home).collect()}
    assert got == expected
