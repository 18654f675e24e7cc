"""Ranked lexical search by pipelined term partitioning.

Documents are cut into blocks, and each block's postings are stored.  Every term belongs to one
owner, by weight: the first owner has the rarest terms.  Items travel in bundles.  For each block a
bundle carries a sparse accumulator per (item, document) from owner to owner; at each owner it is
cogrouped with the block's postings of that owner's terms, whose integer contributions are added.
An accumulator is put down only when even the largest contribution of all terms to come cannot lift
it to the scores that already fill the item's ranks in its block, so no result is lost.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockscope.llm.common import stored, utf8

BEST = 10
OWNERS = 3
#: Items in a bundle; a power of two.
BUNDLE = 256
#: A block of documents ends at so many rows or bytes of text.
BLOCK_ROWS = 1024
BLOCK_BYTES = 16_000_000
#: Vocabularies of the items up to this size go to the workers, as a set of terms.
MOST_TERMS = 200_000
MOST_TERM_BYTES = 4_000_000
#: Rows of (item, term) broadcast at most, of 40 bytes and a term within the bytes above.
MOST_ITEM_TERMS = 200_000
#: Bundles whose sums are broadcast at most, 25 kB each.
MOST_BUNDLES = 64
#: No occurrence count brings a contribution of a unit of weight above this.
MOST_IMPACT = 1_000_000

#: Separators become blanks and A-Z lower case; bytes of other characters stay.
_TO_TERMS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in order: letters and digits of ASCII and all other characters."""
    return (text or b"").translate(_TO_TERMS).split()


def _lists(values: list[list[int]]) -> pa.Array:
    sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    flat = np.fromiter((v for each in values for v in each), dtype=np.int32, count=int(sizes.sum()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat))


def item_terms(items: DataFrame) -> DataFrame:
    """(row, term, times) of items given as (row, UTF-8 text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0), batch.column(1)):
                found = Counter(terms_of(text.as_py()))
                columns = [[row.as_py()] * len(found), [*found], [*found.values()]]
                kinds = (pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["row", "term", "times"]
                )

    return items.mapInArrow(run, "row long, term binary, times long")


def postings(docs: DataFrame, id_col: str, text_col: str, wanted: frozenset[bytes] | None) -> DataFrame:
    """Rows of blocks of documents: per term its documents, as places in the block, and its counts there.

    A row without a term lists the block's document ids and term totals; documents without a term
    are in no block.  With ``wanted`` other terms are counted in the totals alone.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        ids, totals, found, size = [], [], {}, 0

        def rows(kind: pa.DataType) -> pa.RecordBatch:
            n = len(found)
            at, times = ([[], *(f[k] for f in found.values())] for k in (0, 1))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * (n + 1), pa.int64()),
                    pa.array([ids, *[None] * n], pa.list_(kind)),
                    pa.array([totals, *[None] * n], pa.list_(pa.int64())),
                    pa.array([None, *found], pa.binary()),
                    _lists(at),
                    _lists(times),
                ],
                ["block", "ids", "totals", "term", "docs", "times"],
            )

        for batch in batches:
            of_id = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                data = text.as_py()
                terms = terms_of(data)
                if not terms:
                    continue
                place = len(ids)
                ids.append(doc_id.as_py())
                totals.append(len(terms))
                size += len(data)
                for term, times in Counter(terms if wanted is None else filter(wanted.__contains__, terms)).items():
                    if (lists := found.get(term)) is None:
                        found[term] = [place], [times]
                    else:
                        lists[0].append(place)
                        lists[1].append(times)
                if len(ids) == BLOCK_ROWS or size >= BLOCK_BYTES:
                    yield rows(of_id)
                    block += 1
                    ids, totals, found, size = [], [], {}, 0
        if ids:
            yield rows(of_id)

    out = f"block long, ids array<{kind.simpleString()}>, totals array<long>, term binary, docs array<int>, times array<int>"
    return docs.select(F.col(id_col), utf8(text_col).alias("text")).mapInArrow(run, out)


# --- one owner's stage -------------------------------------------------------------------------
def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a column of lists."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.cumsum(sizes))), lists.flatten().to_numpy(zero_copy_only=False)


def added(scores: np.ndarray, length: np.ndarray, right: pa.Table) -> None:
    """Add the contributions of an owner's postings to the (item, document) scores of a block."""
    at, docs = _flat(right.column("docs"))
    _, times = _flat(right.column("times"))
    to, slots = _flat(right.column("slots"))
    _, weights = _flat(right.column("weights"))
    times = times.astype(np.int64)
    impact = 1_000_000_000 * times // (1000 * times + 8 * length[docs])
    for a, b, c, d in zip(at[:-1], at[1:], to[:-1], to[1:]):
        scores[slots[c:d, None], docs[None, a:b]] += weights[c:d, None] * impact[None, a:b]


def contenders(scores: np.ndarray, to_come: np.ndarray, best: int) -> np.ndarray:
    """Which scores may still be among their item's ``best``, with ``to_come`` as weight left per item."""
    live = scores > 0
    if scores.shape[1] > best:
        least = np.partition(scores, -best, axis=1)[:, -best]  # 0 while ranks are free
        live &= scores + (to_come * MOST_IMPACT)[:, None] >= least[:, None]
    return live


def _weight_left(left: pa.Table, owner: int) -> np.ndarray:
    """Per slot the weight of the terms of later owners."""
    out = np.zeros(BUNDLE, dtype=np.int64)
    for each in left.column("sums")[0].as_py():
        if each["owner"] > owner:
            out[each["slot"]] += each["weight"]
    return out


def _stage(owner: int, best: int):
    """The bundle's accumulators of a block after this owner; after the last one its best rows."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left
        length = np.array(left.column("length")[0].as_py(), dtype=np.int64)
        scores = np.zeros((BUNDLE, len(length)), dtype=np.int64)
        slots, docs, carried = (_flat(left.column(c))[1] for c in ("slots", "docs", "scores"))
        scores[slots, docs] = carried
        if right.num_rows:
            added(scores, length, right)
        slots, docs = np.nonzero(contenders(scores, _weight_left(left, owner), best))
        carried = scores[slots, docs]
        if owner < OWNERS - 1:
            new = {"slots": slots.astype(np.int32), "docs": docs.astype(np.int32), "scores": carried}
            columns = {}
            for name in left.column_names:
                kind = left.schema.field(name).type
                plain = pa.list_(kind.value_type) if pa.types.is_list(kind) else kind  # of elements that may be null
                columns[name] = pa.array([new[name]], plain) if name in new else left.column(name).cast(plain)
            return pa.table(columns)
        ids = left.column("ids").combine_chunks()
        ids = (pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids).flatten()
        by_id = np.empty(len(ids), dtype=np.int64)
        by_id[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))  # nulls last
        order = np.lexsort((by_id[docs], -carried, slots))
        slots, docs, carried = slots[order], docs[order], carried[order]
        first = np.searchsorted(slots, slots)
        kept = np.arange(len(slots)) - first < best
        slots, docs, carried = slots[kept], docs[kept], carried[kept]
        bundle = left.column("bundle")[0].as_py()
        return pa.table(
            {"row": pa.array(bundle * BUNDLE + slots, pa.int64()), "id": ids.take(pa.array(docs)), "score": pa.array(carried)}
        )

    return run


# --- the search --------------------------------------------------------------------------------
def _total(docs_in_blocks: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""
    n, terms = docs_in_blocks.agg(
        F.sum(F.size("ids")), F.sum(F.aggregate("totals", F.lit(0).cast("long"), lambda a, x: a + x))
    ).first()
    return n or 0, terms or 0


def _weight(n: int, df: str) -> Column:
    return F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col(df) + 1)))


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    best: int = BEST,
) -> DataFrame:
    """Each item's ``best`` documents by score: item, ``rank`` from 1, document, ``score``.

    A term's weight falls with the documents that hold it, and its contribution saturates with its
    occurrences and falls with the document's length; all but the weight's logarithm is integer.
    Equal scores go by ascending id, null ids last.  Every row of ``docs`` is a document and every
    row of ``items`` an item, repeated ids too; those without a term get no row, and an item with
    fewer matching documents gets fewer.

    A task holds one block of documents and one bundle of items.
    """
    numbered = stored(
        items.select(F.monotonically_increasing_id().alias("row"), F.col(item_col).alias("item"), F.col(item_text_col).alias("text")),
        "items",
    )
    asked = stored(item_terms(numbered.select("row", utf8("text"))), "item-terms")
    terms = asked.select("term").distinct()
    many, size = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    few = many <= MOST_TERMS and size <= MOST_TERM_BYTES
    wanted = frozenset(bytes(r.term) for r in terms.collect()) if few else None  # the size is checked
    rows = stored(postings(docs, id_col, text_col, wanted), "postings")

    blocks = rows.where(F.col("term").isNull()).select("block", "ids", "totals")
    found = rows.where(F.col("term").isNotNull()).select("block", "term", "docs", "times")
    n, total = _total(blocks)
    top = F.floor(1000 * F.log(F.lit((2.0 * n + 2) / 3)))
    held = found.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weighed = asked.join(held, "term").select(
        F.shiftright("row", BUNDLE.bit_length() - 1).alias("bundle"),
        F.col("row").bitwiseAND(BUNDLE - 1).cast("int").alias("slot"),
        "term",
        F.least(F.floor((top - _weight(n, "df")) * OWNERS / (top + 1)), F.lit(OWNERS - 1)).alias("owner"),
        (_weight(n, "df") * F.col("times")).alias("weight"),
    )
    weighed = stored(weighed.where(F.col("weight") > 0), "weights")
    # At most BUNDLE slots in each array.
    by_term = weighed.groupBy("bundle", "owner", "term").agg(
        F.array_sort(F.collect_list(F.struct("slot", "weight"))).alias("asks")
    )
    by_term = by_term.select("bundle", "owner", "term", F.col("asks.slot").alias("slots"), F.col("asks.weight").alias("weights"))
    if few and weighed.limit(MOST_ITEM_TERMS + 1).count() <= MOST_ITEM_TERMS:
        by_term = F.broadcast(by_term)
    met = found.join(by_term, "term").drop("term")

    sums = weighed.groupBy("bundle", "owner", "slot").agg(F.sum("weight").alias("weight"))
    bundles = sums.groupBy("bundle").agg(F.collect_list(F.struct("owner", "slot", "weight")).alias("sums"))
    if bundles.limit(MOST_BUNDLES + 1).count() <= MOST_BUNDLES:
        bundles = F.broadcast(bundles)
    scaled = F.lit(75 * n).cast("long")
    length = F.transform("totals", lambda x: 25 + F.call_function("div", scaled * x, F.lit(max(total, 1)).cast("long")))
    state = (
        met.select("bundle", "block").distinct()
        .join(blocks.select("block", "ids", length.alias("length")), "block")
        .join(bundles, "bundle")
        .withColumns({
            "slots": F.array().cast("array<int>"),
            "docs": F.array().cast("array<int>"),
            "scores": F.array().cast("array<long>"),
        })
    )
    of_id = docs.schema[id_col].dataType.simpleString()
    carried = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema.fields)
    for owner in range(OWNERS):
        theirs = met.where(F.col("owner") == owner).select(
            F.col("bundle").alias("to_bundle"), F.col("block").alias("of_block"), "docs", "times", "slots", "weights"
        )
        kind = carried if owner < OWNERS - 1 else f"row long, id {of_id}, score long"
        pairs = state.groupBy("bundle", "block").cogroup(theirs.groupBy("to_bundle", "of_block"))
        state = pairs.applyInArrow(_stage(owner, best), kind)
    by_score = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = state.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= best)
    return ranked.join(numbered.select("row", "item"), "row").select(
        F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score"
    )
