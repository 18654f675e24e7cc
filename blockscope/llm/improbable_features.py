"""Document fingerprints from improbable features.

A feature is a window of bytes.  Its entropy class has a rank: the rarer the class among all windows
of the corpus, the better.  In each stretch of neighbouring windows the best one, the leftmost among
equals, wins, and windows with enough wins are selected.  A feature sets five bits of a Bloom filter;
a full filter is followed by the next one.  Two fingerprints are compared by the bits that their
filters share beyond chance.
"""

import hashlib
from base64 import b64decode, b64encode
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockscope.llm.common import stored, utf8

#: Bytes of a feature, and windows of a stretch, a power of two.
FEATURE = 32
STRETCH = 64
#: A feature needs wins in so many stretches: one in four of those it is in.
LEAST_WINS = STRETCH // 4
#: A text of fewer stretches than these, end to end, is cut into so many shorter ones.
LEAST_STRETCHES = 8
CLASSES = 1001
#: Windows of lower entropy, in thousandths of the largest possible, are taken only where a text has no others.
WEAK = 100
FILTER_BITS = 2048
FILTER_FEATURES = 160
HASHES = 5
#: Shared bits count beyond this part of the way from chance to all, and beyond so many deviations.
LEAST_SHARE = 0.1
LEAST_DEVIATIONS = 3.0
#: Bytes of text fingerprinted together, and windows measured at once.
SLICE_BYTES = 2_000_000
_CHUNK = 1 << 17

_COUNTS = np.arange(1, FEATURE + 1)
#: c log2 c in units of 2 ** -16, summed over the bytes of a window
_SPREAD = np.concatenate(([0], np.round(_COUNTS * np.log2(_COUNTS) * 65536))).astype(np.int32)
_GAIN = np.diff(_SPREAD)  # of one more byte of a kind met so many times
_MOST = int(_SPREAD[FEATURE])


def _entropy_sums(data: np.ndarray) -> np.ndarray:
    """Sum of c log2 c over the bytes of each window: each step drops one byte and takes in another."""
    behind = np.zeros(len(data), dtype=np.uint8)
    ahead = np.zeros(len(data), dtype=np.uint8)
    for apart in range(1, FEATURE):
        same = (data[apart:] == data[:-apart]).view(np.uint8)
        behind[apart:] += same
        ahead[:-apart] += same
    first = _SPREAD[np.bincount(data[:FEATURE])].sum(dtype=np.int64)
    steps = _GAIN[behind[FEATURE:]] - _GAIN[ahead[:-FEATURE]]
    return np.concatenate(([first], first + np.cumsum(steps, dtype=np.int64)))


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """Class of each window of the bytes: its entropy in thousandths of the largest one."""
    out = np.empty(max(0, len(data) - FEATURE + 1), dtype=np.int64)
    for at in range(0, len(out), _CHUNK):
        part = _entropy_sums(data[at : at + _CHUNK + FEATURE - 1])
        out[at : at + _CHUNK] = (_MOST - part) * (CLASSES - 1) // _MOST
    return out


def _whole(starts: np.ndarray, sizes: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` windows of ``width`` places lie within one of the texts."""
    marks = np.zeros(n + 1, dtype=np.int64)
    fits = np.maximum(sizes - width + 1, 0)
    np.add.at(marks, np.minimum(starts, n), 1)
    np.add.at(marks, np.minimum(starts + fits, n), -1)
    return np.cumsum(marks[:-1]) > 0


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


def class_counts(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts are in each class."""
    data, starts, sizes = _joined(texts)
    classes = entropy_classes(data)
    return np.bincount(classes[_whole(starts, sizes, FEATURE, len(classes))], minlength=CLASSES)


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Rank of each class, the rarest first and of equal counts the lower class; weak classes follow all others."""
    order = np.lexsort((np.arange(CLASSES), counts, np.arange(CLASSES) < WEAK))
    ranks = np.empty(CLASSES, dtype=np.int64)
    ranks[order] = np.arange(CLASSES)
    return ranks


def learn_ranks(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """``ranks_of`` the windows of all whole texts; counts are added per task and then per class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, dtype=np.int64)
        for texts in _slices(t for batch in batches for t in batch.column(0)):
            total += class_counts(texts)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["class", "n"])

    found = docs.select(utf8(text_col)).mapInArrow(run, "class long, n long")
    counts = np.zeros(CLASSES, dtype=np.int64)
    for row in found.groupBy("class").agg(F.sum("n").alias("n")).collect():  # a row per class
        counts[row["class"]] = row.n
    return ranks_of(counts)


def _slices(texts: Iterator[pa.Scalar]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        held.append(text.as_py() or b"")
        size += len(held[-1])
        if size >= SLICE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


# --- fingerprints ------------------------------------------------------------------------------
def _winners(order: np.ndarray, stretch: int) -> np.ndarray:
    """Place of the least value in each stretch; values are distinct and hold their place in the low half."""
    least, wide = order, 1
    while wide < stretch:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    return least & 0xFFFFFFFF


def _of_few(ranks: np.ndarray) -> list[int]:
    """Places of the features of a text of few windows: by shorter stretches, with as large a part of the wins.

    Where no window has enough wins, the first of those with most is the only feature.
    """
    stretch = min(STRETCH, max(1, len(ranks) // LEAST_STRETCHES))
    views = np.lib.stride_tricks.sliding_window_view(ranks, stretch)
    wins = np.bincount(views.argmin(axis=1) + np.arange(len(views)), minlength=len(ranks))
    strong = np.where(ranks < CLASSES - WEAK, wins, 0)
    enough = np.flatnonzero(strong * STRETCH >= LEAST_WINS * stretch) if strong.any() else ()
    return [int(p) for p in enough if strong[p]] or [int((strong if strong.any() else wins).argmax())]


def selected(texts: list[bytes], ranks: np.ndarray) -> list[list[int]]:
    """Places of each text's selected windows in order; a text shorter than one has none."""
    data, starts, sizes = _joined(texts)
    ranked = ranks[entropy_classes(data)]
    out: list[list[int]] = [[] for _ in texts]
    if len(ranked) >= STRETCH:
        order = (ranked << 32) | np.arange(len(ranked))
        order[~_whole(starts, sizes, FEATURE, len(order))] = np.iinfo(np.int64).max
        winners = _winners(order, STRETCH)
        winners = winners[_whole(starts, sizes, FEATURE + STRETCH - 1, len(winners))]
        new = np.flatnonzero(np.concatenate(([True], winners[1:] != winners[:-1]))) if len(winners) else np.zeros(0, int)
        wins = np.diff(np.concatenate((new, [len(winners)])))
        places = winners[new[(wins >= LEAST_WINS) & (ranked[winners[new]] < CLASSES - WEAK)]]
        owner = np.searchsorted(starts, places, side="right") - 1
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        places = (places - starts[owner]).tolist()
        out = [places[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    for k in range(len(texts)):
        windows = sizes[k] - FEATURE + 1
        if windows > 0 and (not out[k] or windows < LEAST_STRETCHES * STRETCH):
            out[k] = _of_few(ranked[starts[k] : starts[k] + windows])
    return out


def filters_of(features: list[bytes]) -> np.ndarray:
    """The chained filters of distinct features, a row of bytes each."""
    digests = b"".join([hashlib.sha1(f).digest() for f in features])
    places = np.frombuffer(digests, dtype=">u4").reshape(-1, HASHES) % FILTER_BITS
    bits = np.zeros((-(-len(features) // FILTER_FEATURES), FILTER_BITS), dtype=bool)
    bits[(np.arange(len(features)) // FILTER_FEATURES)[:, None], places] = True
    return np.packbits(bits, axis=1)


def digests_of(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Filters of each text: of its distinct selected windows by first place, or of all of a shorter text."""
    out = []
    for text, places in zip(texts, selected(texts, ranks)):
        features = [*dict.fromkeys(text[p : p + FEATURE] for p in places)] if places else [text] * bool(text)
        out.append(filters_of(features))
    return out


def as_text(filters: np.ndarray) -> str:
    return b64encode(filters.tobytes()).decode()


def as_filters(text: str) -> np.ndarray:
    return np.frombuffer(b64decode(text), dtype=np.uint8).reshape(-1, FILTER_BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over the filters of the shorter chain, by their bits, of the best match in the other, 0 to 1.

    A match is the part of the shared bits beyond chance.  Equal fingerprints give 1, one of an empty
    text with another 0.
    """
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if (len(a), a.tobytes()) > (len(b), b.tobytes()):  # so that the order does not matter
        a, b = b, a
    if not len(a):
        return 0.0
    theirs = np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    total = weight = 0.0
    for each in a:
        mine = int(np.bitwise_count(each).sum())
        shared = np.bitwise_count(b & each).sum(axis=1, dtype=np.int64)
        chance = mine * theirs / FILTER_BITS
        most = np.minimum(mine, theirs)
        least = chance + np.maximum(LEAST_SHARE * (most - chance), LEAST_DEVIATIONS * np.sqrt(chance))
        room = most - least
        match = np.where(room > 0, (shared - least) / np.where(room > 0, room, 1.0), 0.0)
        total += mine * float(np.clip(match, 0.0, 1.0).max())
        weight += mine
    return total / weight


def fingerprint_of(text: Column, ranks: np.ndarray) -> Column:
    """Fingerprints of UTF-8 bytes as text; null is empty and has the empty fingerprint."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for some in _slices(map(pa.scalar, texts)):
            out += [as_text(f) for f in digests_of(some, ranks)]
        return pd.Series(out, dtype=object)

    return run(text)


def likeness_of(a: Column, b: Column) -> Column:
    """``likeness`` of two columns of fingerprints."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(as_filters(x), as_filters(y)) for x, y in zip(a, b)], dtype=float)

    return run(a, b)


# --- documents and those that follow them ------------------------------------------------------
_LAST, _FIRST = "last", "first"
_RESULT = {
    "n_chars": "long", "variant_sha256": "string", "fingerprint": "string", "variant_fingerprint": "string",
    "near_variant": "double", "near_next": "double",
}
_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
_ARROW = {c: _KINDS[k] for c, k in {**_RESULT, "place": "string", "part": "long", "text": "string"}.items()}


class _Walk:
    """Documents in order; each is compared once the next one is known."""

    def __init__(self, ranks: np.ndarray, variant: Callable[[str, str], str]):
        self.ranks, self.variant = ranks, variant

    def compared(self, ids: list, texts: list[str], known: list[np.ndarray]) -> tuple[dict, np.ndarray]:
        """Columns of all documents but the last, and the last one's filters; ``known`` are the first's."""
        others = [self.variant(a, b) for a, b in zip(texts, texts[1:])]
        data = [t.encode() for t in (*texts[len(known) :], *others)]
        found = known + digests_of(data, self.ranks)
        own, changed = found[: len(texts)], found[len(texts) :]
        rows = {
            "id": ids[:-1],
            "n_chars": [len(t) for t in texts[:-1]],
            "variant_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in others],
            "fingerprint": [as_text(f) for f in own[:-1]],
            "variant_fingerprint": [as_text(f) for f in changed],
            "near_variant": [likeness(f, g) for f, g in zip(own, changed)],
            "near_next": [likeness(f, g) for f, g in zip(own, own[1:])],
        }
        return rows, own[-1]


def compare_with_next(
    docs: DataFrame,
    ranks: np.ndarray,
    variant: Callable[[str, str], str],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Fingerprints of each document and of ``variant`` (its text, the next one's), and their likeness.

    Returns the id, ``n_chars``, ``fingerprint``, ``variant_sha256``, ``variant_fingerprint``,
    ``near_variant`` (likeness of the text and its variant) and ``near_next`` (of the text and the
    next one).  The next document is that by ascending id, null ids first, rows of one id in the order
    of the input; the first follows the last.  A single document follows itself.  Null texts are empty.

    Whole texts move once, to ranges of ids.  The last document of a range meets the first of the
    next one in a second step, which has one row per range.  Memory is a few times ``SLICE_BYTES`` or
    the longest text; comparing two texts takes time by the product of their filters.
    """
    walk = _Walk(ranks, variant)
    out = ", ".join([f"id {docs.schema[id_col].dataType.simpleString()}", *(f"{n} {k}" for n, k in _RESULT.items())])
    edges = ", place string, part long, text string"

    def whole(found: dict, n: int, of_id: pa.DataType, names: list[str]) -> pa.RecordBatch:
        kinds = {**_ARROW, "id": of_id}
        return pa.RecordBatch.from_arrays([pa.array(found.get(c, [None] * n), kinds[c]) for c in names], names)

    results = ["id", *_RESULT]
    all_columns = [*results, "place", "part", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, texts, known, size, first, kind = [], [], [], 0, True, None

        def edge(place: str, at: int) -> pa.RecordBatch:
            found = {"place": [place], "part": [part], "text": [texts[at]], "id": [ids[at]]}
            return whole(found, 1, kind, all_columns)

        for batch in batches:
            kind = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc_id.as_py())
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if first:
                    yield edge(_FIRST, 0)
                    first = False
                if size >= SLICE_BYTES and len(texts) > 1:
                    rows, last = walk.compared(ids, texts, known)
                    yield whole(rows, len(ids) - 1, kind, all_columns)
                    ids, texts, known, size = ids[-1:], texts[-1:], [last], len(texts[-1])
        if len(texts) > 1:
            rows, last = walk.compared(ids, texts, known)
            yield whole(rows, len(ids) - 1, kind, all_columns)
        if texts:
            yield edge(_LAST, -1)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, follows in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows, _ = walk.compared([doc_id, None], [text, follows], [])
                yield whole(rows, 1, batch.schema.field(0).type, results)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    sorted_rows = rows.repartitionByRange("id", "place").sortWithinPartitions("id", "place")
    found = stored(sorted_rows.select("id", "text").mapInArrow(run, out + edges), "next")
    firsts = found.where(F.col("place") == _FIRST).select(F.col("part").alias("next_part"), F.col("text").alias("follows"))
    lasts = found.where(F.col("place") == _LAST).select("id", "text", "part")
    parts = found.where(F.col("place") == _FIRST).select("part")  # one number per range
    after = parts.select(
        "part",
        F.coalesce(
            F.lead("part").over(Window.orderBy("part")),
            F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        ).alias("next_part"),
    )
    met = lasts.join(after, "part").join(firsts, "next_part").select("id", "text", "follows")
    done = found.where(F.col("place").isNull()).select(*results)
    return done.unionByName(met.mapInArrow(close, out)).withColumnRenamed("id", id_col)
