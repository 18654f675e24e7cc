"""Periodic runs of words, by string synchronising sets at dyadic scales.

Many texts are searched as one array of word numbers, cut by separators that occur once.  At scale
t a position is selected by its context of 2 t words alone: the least hash of the t-word windows that
begin in it or up to t words on is that of the first or the last of them.  Windows inside a region of
period at most t / 3 do not count, which keeps the selected positions few.  A run of period p with
3 t <= p < 6 t and of three periods at least has a selected position in its first two periods, and the
same context is selected p words on, so equal contexts at that distance propose the period.  Proposals
are checked word by word.  Periods 1 and 2 come from direct comparison, and the regions left out at a
scale are the runs of smaller scales: they supply the small periods that selection omits.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockscope.llm.common import utf8

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
#: Words searched together; a longer text is searched by itself.
SLICE_WORDS = 300_000
#: Smallest exponent at which the selected positions find every run.
SOUGHT_EXPONENT = 3
_NEVER = np.uint64(2**64 - 1)

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # starts, lengths, periods


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x >> np.uint64(1)


def _flat(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges one after another, and where each range begins there."""
    sizes = hi - lo
    begins = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(lo - begins, sizes), begins


def _equal(ids: np.ndarray, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    return ids[at] == ids[at + period]


def _widened(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges grown to both sides, up to and with the first word that differs from that a period on."""
    lo, hi = lo.copy(), hi.copy()
    last = len(ids) - period
    active, step = np.flatnonzero(lo > 0), period.copy()
    while len(active):
        a = np.maximum(lo[active] - step[active], 0)
        at, begins = _flat(a, lo[active])
        p = np.repeat(period[active], lo[active] - a)
        differs = np.maximum.reduceat(np.where(_equal(ids, at, p), -1, at), begins)
        lo[active] = np.where(differs >= 0, differs, a)
        step[active] *= 2
        active = active[(differs < 0) & (a > 0)]
    active, step = np.flatnonzero(hi < last), period.copy()
    while len(active):
        b = np.minimum(hi[active] + step[active], last[active])
        at, begins = _flat(hi[active], b)
        p = np.repeat(period[active], b - hi[active])
        far = len(ids)
        differs = np.minimum.reduceat(np.where(_equal(ids, at, p), far, at), begins)
        hi[active] = np.where(differs < far, differs + 1, b)
        step[active] *= 2
        active = active[(differs == far) & (b < last[active])]
    return lo, hi


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last place of each stretch of true values."""
    edges = np.diff(np.concatenate(([0], equal.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _confirmed(ids: np.ndarray, at: np.ndarray, period: np.ndarray, reach: int) -> Runs:
    """Maximal runs of three periods at least around proposed places, whose next ``reach`` words repeat."""
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    # proposals of one run lie at most a period apart
    new = np.concatenate(([True], (period[1:] != period[:-1]) | (at[1:] - at[:-1] > period[1:])))
    ends = np.concatenate((new[1:], [True]))
    period = period[new]
    lo, hi = _widened(ids, at[new], at[ends] + reach, period)
    where, begins = _flat(lo, hi + 1)  # one more place each, which holds the ranges apart
    owner = np.repeat(np.arange(len(lo)), hi + 1 - lo)
    equal = np.zeros(len(where), dtype=bool)
    inside = where < hi[owner]
    equal[inside] = _equal(ids, where[inside], period[owner[inside]])
    first, stop = _stretches(equal)
    p = period[owner[first]]
    long = stop - first >= (SOUGHT_EXPONENT - 1) * p
    first, stop, p = first[long], stop[long], p[long]
    return where[first], stop - first + p, p


def _close(ids: np.ndarray, period: int) -> Runs:
    """Maximal runs of a small period, by comparing each word with that a period on."""
    first, stop = _stretches(ids[:-period] == ids[period:])
    long = stop - first >= (SOUGHT_EXPONENT - 1) * period
    first, stop = first[long], stop[long]
    return first, stop - first + period, np.full(len(first), period)


def _least_periods(*found: Runs) -> Runs:
    """One run for each stretch: found with a multiple of its period, it is found with the period too."""
    start, length, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return start[new], length[new], period[new]


def _least_ahead(key: np.ndarray, size: int) -> np.ndarray:
    """Least of the ``size`` + 1 values from each place on; ``size`` is a power of two."""
    least, wide = key, 1
    while wide < size:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    return np.minimum(least[:-1], key[size:]) if size == 1 else np.minimum(least[: len(key) - size], key[size:])


def _selected(hashes: np.ndarray, size: int, left_out: Runs) -> np.ndarray:
    """The synchronising positions of a scale, from the hashes of its windows of ``size`` words."""
    start, length, period = left_out
    key = hashes.copy()
    region = (SOUGHT_EXPONENT * period <= size) & (length >= size) & (start < len(key))
    if region.any():
        marks = np.zeros(len(key) + 1, dtype=np.int64)
        np.add.at(marks, start[region], 1)
        np.add.at(marks, np.minimum(start[region] + length[region] - size + 1, len(key)), -1)
        key[np.cumsum(marks[:-1]) > 0] = _NEVER
    least = _least_ahead(key, size)
    return np.flatnonzero((least != _NEVER) & ((least == key[: len(least)]) | (least == key[size:])))


def _proposed(places: np.ndarray, contexts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of selected places with equal contexts, three to six times ``size`` apart: place and distance."""
    at, apart = [], []
    near, ahead = np.arange(len(places)), 0
    while len(near):
        ahead += 1
        near = near[near + ahead < len(places)]
        distance = places[near + ahead] - places[near]
        close = distance < 2 * SOUGHT_EXPONENT * size
        near, distance = near[close], distance[close]
        same = (distance >= SOUGHT_EXPONENT * size) & (contexts[near + ahead] == contexts[near])
        at.append(places[near[same]])
        apart.append(distance[same])
    return np.concatenate([*at, places[:0]]), np.concatenate([*apart, places[:0]])


def repeats(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Runs:
    """All maximal runs of three periods at least, with their least periods.

    ``ids`` holds texts of falling ``lengths`` from ``starts`` on, each followed by a number of its own.
    """
    found = _least_periods(_close(ids, 1), _close(ids, 2))
    hashes, size = _scrambled(ids.astype(np.uint64)), 1
    while True:
        # texts that can hold a run of this scale come first
        many = int(np.searchsorted(-lengths, -SOUGHT_EXPONENT**2 * size, side="right"))
        if not many:
            return found
        end = int(starts[many - 1] + lengths[many - 1]) + 1
        hashes = hashes[: end - size + 1]
        contexts = _scrambled(hashes[:-size] * np.uint64(0xD6E8FEB86659FD93) + hashes[size:])
        places = _selected(hashes, size, found)
        at, period = _proposed(places, contexts[places], size)
        if len(at):
            found = _least_periods(found, _confirmed(ids[:end], at, period, 2 * size))
        hashes, size = contexts, 2 * size


def runs_of_texts(
    texts: list[list[bytes]], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT
) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each text's runs, by start and then period, for texts as words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    order = [k for k in order if len(texts[k]) >= least_length]
    if not order:
        return out
    numbers: dict[bytes, int] = {}
    lengths = np.array([len(texts[k]) for k in order])
    starts = np.cumsum(lengths + 1) - lengths - 1
    ids = np.empty(int(starts[-1] + lengths[-1]) + 1, dtype=np.int64)
    for k, start, n in zip(order, starts.tolist(), lengths.tolist()):
        ids[start : start + n] = [numbers.setdefault(w, len(numbers)) for w in texts[k]]
    ids[starts + lengths] = len(numbers) + np.arange(len(order))
    start, length, period = repeats(ids, starts, lengths)
    wanted = length >= np.maximum(least_length, least_exponent * period)
    start, length, period = start[wanted], length[wanted], period[wanted]
    owner = np.searchsorted(starts, start, side="right") - 1
    by_start = np.lexsort((period, start))
    for j in by_start.tolist():
        out[order[owner[j]]].append((int(start[j] - starts[owner[j]]), int(length[j]), int(period[j])))
    return out


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words less those that lie in a run after its first period."""
    if not runs:
        return words
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    start, length, period = np.array(runs).T
    np.add.at(marks, start + period, 1)
    np.add.at(marks, start + length, -1)
    kept = np.flatnonzero(np.cumsum(marks[:-1]) == 0)
    return [words[k] for k in kept.tolist()]


def find_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = LEAST_LENGTH,
    least_exponent: int = LEAST_EXPONENT,
) -> DataFrame:
    """Per document its id, ``n_words``, ``runs`` (start, length, period) and ``collapsed`` text.

    A run is a longest stretch of words with its least period, of ``least_length`` words and
    ``least_exponent`` (3 or more) periods at least.  The collapsed text joins by blanks the words that
    lie in no run after its first period.  Words are cut at ASCII white space over the whole text; a
    null or empty text has none.  Rows are judged by themselves, so repeated and null ids stay, no
    row moves, and memory is that of ``SLICE_WORDS`` words or of the longest text.
    """
    if least_exponent < SOUGHT_EXPONENT:
        raise ValueError(f"runs of less than {SOUGHT_EXPONENT} periods are not found")

    def found(ids: list[pa.Scalar], texts: list[list[bytes]], schema: pa.Schema) -> pa.RecordBatch:
        runs = runs_of_texts(texts, least_length, least_exponent)
        kept = [b" ".join(without_repeats(t, r)) for t, r in zip(texts, runs)]
        fields = ("start", "length", "period")
        rows = [[dict(zip(fields, r)) for r in each] for each in runs]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i.as_py() for i in ids], schema.field(0).type),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array(rows, pa.list_(pa.struct([(f, pa.int64()) for f in fields]))),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ],
            [id_col, "n_words", "runs", "collapsed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                words = (text.as_py() or b"").split()
                if ids and size + len(words) > SLICE_WORDS:
                    yield found(ids, texts, batch.schema)
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                size += len(words)
            if ids:
                yield found(ids, texts, batch.schema)

    kind = docs.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col(id_col), utf8(text_col)).mapInArrow(run, out)
