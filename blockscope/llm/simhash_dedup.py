"""SimHash near-duplicates: fingerprints, and a generalised-pigeonhole search for those within a distance.

The search (``linked``) groups correlated bits into partitions and gives each fingerprint its own
threshold per partition.  If the thresholds plus one add up to the distance plus one, two
fingerprints within the distance agree up to the threshold in at least one partition.  Dynamic
programming picks the cheapest thresholds by the number of fingerprints each would meet.
"""

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockscope.llm.common import stored, utf8, with_ids, without_ids
from blockscope.llm.components import components
from blockscope.operators.joins import skew_join

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
SEED = 42
BITS = 64

#: Cost of one probe row, which is shuffled, and of one comparison inside the join.
PROBE_COST, COMPARE_COST = 1.0, 0.1


# --- fingerprints ------------------------------------------------------------------------------
def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in more than half of the given ones."""
    n = len(hashes)
    ones = np.uint64(0x0101010101010101)
    counts = np.zeros(BITS, dtype=np.int64)
    for shift in range(8):
        lanes = (hashes >> np.uint64(shift)) & ones
        whole = n - n % 255  # a byte lane counts to 255
        sums = lanes[:whole].reshape(-1, 255).sum(axis=1, dtype=np.uint64)
        sums = np.append(sums, lanes[whole:].sum(dtype=np.uint64))
        counts[shift::8] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of a whole text, A-Z lowered, over word shingles; words end at ASCII white space.

    Fewer words than a shingle are one shingle; no word, or no text, gives zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    hashes = [
        xxhash.xxh64_intdigest(joined[s : e - 1], SEED)
        for s, e in zip(starts, ends[shingle - 1 :])
    ]
    return majority(np.array(hashes, dtype=np.uint64))


def fingerprint_of(text: Column, shingle: int = SHINGLE_WORDS) -> Column:
    """SimHash of a column of UTF-8 bytes, as a long that holds the bits as they are."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        found = [fingerprint(t, shingle) for t in texts]
        return pd.Series(np.array(found, dtype=np.uint64).view(np.int64))

    return run(text)


# --- partitions and thresholds -----------------------------------------------------------------
def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set, as a 64 x 64 table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8)
            bits = np.unpackbits(values.reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n += len(bits)
            both += bits.T @ bits
        cells = np.append(both.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "n"]
        )

    rows = prints.select("fingerprint").mapInArrow(run, "cell long, n long")
    found = np.zeros(BITS * BITS + 1)
    for cell, n in rows.groupBy("cell").agg(F.sum("n")).collect():  # 4097 numbers
        found[cell] = n
    return int(found[-1]), found[:-1].reshape(BITS, BITS)


def arrange(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits grouped so that correlated ones share a partition, which leaves the others selective."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        group = [max(left, key=lambda b: (abs(p[b] - 0.5), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (related[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def match_odds(n: int, both: np.ndarray, group: list[int], most: int) -> np.ndarray:
    """For d = 0..most, the chance that two fingerprints differ in d or fewer of the group's bits."""
    p = np.diag(both)[group] / max(n, 1)
    odds = np.array([1.0])
    for differ in 2 * p * (1 - p):
        odds = np.convolve(odds, [1 - differ, differ])
    return np.cumsum(np.append(odds, np.zeros(most + 1)))[: most + 1]


def masks_within(group: list[int], distance: int) -> np.ndarray:
    """Every way to flip up to ``distance`` of the group's bits."""
    flips = [
        sum(1 << b for b in chosen) for d in range(distance + 1) for chosen in combinations(group, d)
    ]
    return np.array(flips, dtype=np.uint64)


def cheapest(costs: np.ndarray, units: int) -> np.ndarray:
    """Units per partition, adding up to ``units``, of least total cost, for each row.

    ``costs[row, part, u]``: what u units in that partition cost; u units stand for the
    threshold u - 1, no unit for a partition that is not probed.
    """
    rows, parts, _ = costs.shape
    best = np.full((rows, units + 1), np.inf)
    best[:, 0] = 0
    chosen = np.zeros((parts, rows, units + 1), dtype=np.int64)
    for part in range(parts):
        after = np.full_like(best, np.inf)
        for total in range(units + 1):
            ways = np.stack([best[:, total - u] + costs[:, part, u] for u in range(total + 1)], axis=1)
            chosen[part, :, total] = ways.argmin(axis=1)
            after[:, total] = ways.min(axis=1)
        best = after
    out = np.zeros((rows, parts), dtype=np.int64)
    total = np.full(rows, units)
    for part in reversed(range(parts)):
        out[:, part] = chosen[part, np.arange(rows), total]
        total -= out[:, part]
    return out


class Partitions:
    """Bit partitions for one distance, and what probing them costs."""

    def __init__(self, n: int, both: np.ndarray, distance: int, parts: int):
        self.units = distance + 1
        self.groups = arrange(n, both, parts)
        self.flips = [[masks_within(g, u) for u in range(self.units)] for g in self.groups]
        odds = [match_odds(n, both, g, distance) for g in self.groups]
        #: for u units: probes, and fingerprints met besides those with the same value
        self.probes = np.array([[0, *(len(f) for f in flips)] for flips in self.flips], dtype=float)
        self.near = np.array([[0, *(n * (o - o[0]))] for o in odds])
        self.same = np.array([n * o[0] for o in odds])

    def costs(self, same: np.ndarray) -> np.ndarray:
        """``same[row, part]``: fingerprints with the row's value in that partition."""
        met = np.where(np.arange(self.units + 1) > 0, same[:, :, None], 0) + self.near
        return PROBE_COST * self.probes + COMPARE_COST * met

    def usual_cost(self) -> float:
        costs = self.costs(self.same[None, :])
        units = cheapest(costs, self.units)[0]
        return float(sum(costs[0, part, u] for part, u in enumerate(units)))


def partitions_for(n: int, both: np.ndarray, distance: int) -> Partitions:
    """The number of partitions that costs least for so many fingerprints."""
    ways = [Partitions(n, both, distance, parts) for parts in range(min(2, distance + 1), distance + 2)]
    return min(ways, key=Partitions.usual_cost)


# --- search ------------------------------------------------------------------------------------
def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def linked(prints: DataFrame, distance: int, plan: Partitions | None = None) -> DataFrame:
    """(a, b): pairs of different ``root`` that hold distinct ``fingerprint`` within the distance.

    Each fingerprint probes its partitions up to its own thresholds and is compared with
    the fingerprints found there inside the join, which returns only true links.
    """
    plan = plan or partitions_for(*bit_counts(prints), distance)
    masks = [sum(1 << b for b in g) for g in plan.groups]
    values = F.array(*[F.col("fingerprint").bitwiseAND(F.lit(_signed(m))) for m in masks])
    index = prints.select("fingerprint", "root", F.posexplode(values).alias("part", "value"))
    met = index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("same"))
    asked = (
        index.join(met, ["part", "value"])
        .groupBy("fingerprint", "root")
        .agg(F.sort_array(F.collect_list(F.struct("part", "same"))).alias("met"))  # one per partition
        .select("fingerprint", "root", F.col("met.same").alias("same"))
    )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            prints = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            roots = batch.column(1).to_numpy(zero_copy_only=False)
            same = np.array(batch.column(2).to_pylist(), dtype=float)
            units = cheapest(plan.costs(same), plan.units)
            for part, flips in enumerate(plan.flips):
                for u in range(1, plan.units + 1):
                    rows = np.flatnonzero(units[:, part] == u)
                    step = max(1, 200_000 // len(flips[u - 1]))
                    for at in range(0, len(rows), step):
                        some = rows[at : at + step]
                        found = (prints[some] & np.uint64(masks[part]))[:, None] ^ flips[u - 1][None, :]
                        again = np.repeat(some, found.shape[1])
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(again), part, dtype=np.int32)),
                                pa.array(found.ravel().view(np.int64)),
                                pa.array(prints[again].view(np.int64)),
                                pa.array(roots[again]),
                            ],
                            ["part", "value", "fingerprint", "root"],
                        )

    probes = asked.mapInArrow(probe, "part int, value long, fingerprint long, root long").alias("q")
    index = index.alias("x")
    near = F.bit_count(F.col("q.fingerprint").bitwiseXOR(F.col("x.fingerprint"))) <= distance
    met_there = (F.col("q.part") == F.col("x.part")) & (F.col("q.value") == F.col("x.value"))
    apart = (F.col("q.fingerprint") > F.col("x.fingerprint")) & (F.col("q.root") != F.col("x.root"))
    return (
        probes.join(index, met_there & apart & near)
        .select(F.col("q.root").alias("a"), F.col("x.root").alias("b"))
        .distinct()
    )


def classes(prints: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """(fingerprint, root) for distinct fingerprints; those that links of up to ``distance`` bits
    connect share a root.

    Links of one bit are followed first: a dense cloud of near copies has then one root or
    few, and the search for longer links, which skips pairs of one root, stays small in it.
    """
    nodes = prints.select("fingerprint").distinct()
    nodes = stored(nodes.withColumn("root", F.col("fingerprint")), "fingerprints")
    for within in sorted({min(1, distance), distance} - {0}):
        found = components(linked(nodes, within), "a", "b")
        found = found.select(F.col("node").alias("root"), F.col("root").alias("to"))
        nodes = nodes.join(found, "root", "left").select(
            "fingerprint", F.coalesce("to", "root").alias("root")
        )
        nodes = stored(nodes, "fingerprints")
    return nodes


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE_WORDS,
    distance: int = MAX_DISTANCE,
) -> DataFrame:
    """One row per document: id, ``fingerprint`` (long), ``class`` (long), ``component_id``.

    Documents whose fingerprints links of up to ``distance`` bits connect share a class;
    ``component_id`` is the smallest id in it, null if all its ids are null.  Null, empty
    and blank texts have fingerprint zero and are linked like any other.  Repeated rows and
    ids are rows of their own.  No document gives no rows.
    """
    prints = stored(
        docs.select(F.col(id_col).alias("id"), fingerprint_of(utf8(text_col), shingle).alias("fingerprint")),
        "prints",
    )
    roots = classes(prints, distance)
    first = prints.groupBy("fingerprint").agg(F.min("id").alias("first"))
    named = roots.join(first, "fingerprint")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("fingerprint", F.col("root").alias("class"), "component_id")
    every = skew_join(prints, named, ["fingerprint"], how="left", one_row_per_key=True)
    return every.select(F.col("id").alias(id_col), "fingerprint", "class", "component_id")


def one_per_class(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE_WORDS,
    distance: int = MAX_DISTANCE,
) -> DataFrame:
    """The documents without those that have a near duplicate of smaller id.

    All columns are kept.  Where the id that stays is on several rows, or a class has only
    null ids, its least row by all columns stays (they must then be of types with an order).
    """
    found = stored(
        near_duplicates(docs.select(id_col, text_col), id_col, text_col, shingle, distance), "found"
    )
    ids = found.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n"), F.min("component_id").alias("least")
    )
    repeated = stored(ids.where((F.col("n") > 1) | F.col(id_col).isNull()).select(id_col), "repeated")
    gone = ids.where((F.col("n") > 1) | (F.col("least") != F.col(id_col))).select(id_col)
    plain = without_ids(docs.where(F.col(id_col).isNotNull()), id_col, gone)
    if repeated.isEmpty():
        return plain
    twice = with_ids(docs, id_col, repeated).unionByName(docs.where(F.col(id_col).isNull()))
    named = found.select(F.col("fingerprint").alias("__print"), "class", "component_id").distinct()
    named = named.withColumnsRenamed({"class": "__class", "component_id": "__least"})
    rows = (
        twice.withColumn("__print", fingerprint_of(utf8(text_col), shingle))
        .join(named, "__print")
        .where(F.col("__least").eqNullSafe(F.col(id_col)))
    )
    least = rows.groupBy("__class").agg(F.min(F.struct(*docs.columns)).alias("__row"))
    return plain.unionByName(least.select("__row.*"))
