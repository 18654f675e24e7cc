"""Language by rank-order profiles: out-of-place distance between n-gram rankings.

A profile is the ranking of the ``PROFILE_GRAMS`` most frequent n-grams of one to three
characters, words padded by a blank.  A document's own ranking is compared with each
language's: a gram adds the difference of its two ranks, one the language lacks the most
a gram can add.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


PROFILE_GRAMS = 400
MOST_LANGUAGES = 2000
UNKNOWN = "und"
#: Code points per slice in which grams of a long text are counted.
SLICE = 1 << 20

NOT_LETTERS = re.compile(r"[\W\d_]+")
BLANK = 32

#: A bound is this share of the score that lies ``SPREAD`` standard deviations below the mean.
SHARE, SPREAD = 0.75, 4.0
#: A text whose second-best score is within this share of the best is torn between profiles, as text in a
#: language related to several is, and is held to ``TORN_SHARE`` in place of ``SHARE``.
TORN, TORN_SHARE = 0.25, 0.8
#: Learning rows of a length from which the language has a bound of its own for that length.
ENOUGH_ROWS = 30
#: With so many grams a text is held to half its bound, with more to more of it.
HALF_BOUND_GRAMS = 16


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text, ascending, and how often each occurs.

    A gram is its up to three code points in 21 bits each, the first lowest.  Grams reach
    to the blank before and after a word but not across it, nor are they a blank alone.
    """
    letters = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if not any(map(str.isalpha, letters)):  # number signs are no letters
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    grams = counts = np.empty(0, np.int64)
    for at in range(0, len(codes), SLICE):
        one = codes[at : at + SLICE]
        two = codes[at + 1 : at + 1 + SLICE]
        three = codes[at + 2 : at + 2 + SLICE]
        pairs = one[: len(two)] | two << 21
        triples = (pairs[: len(three)] | three << 42)[two[: len(three)] != BLANK]
        found, n = np.unique(np.concatenate([one[one != BLANK], pairs, triples]), return_counts=True)
        grams, counts = _added(grams, counts, found, n) if at else (found, n)
    return grams, counts


def _added(*both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of grams, counts of grams, ... as one."""
    grams, place = np.unique(np.concatenate(both[::2]), return_inverse=True)
    counts = np.bincount(place, weights=np.concatenate(both[1::2]), minlength=len(grams))
    return grams, counts.astype(np.int64)


def ranking(grams: np.ndarray, counts: np.ndarray, most: int = PROFILE_GRAMS) -> np.ndarray:
    """The most frequent grams, best first; equal counts by gram."""
    return grams[np.argsort(-counts, kind="stable")[:most]]


# --- learning ----------------------------------------------------------------------------------
def profiles(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = PROFILE_GRAMS
) -> dict[str, np.ndarray]:
    """Each language's ranked grams, counted over all given rows with a language and a letter.

    Counts are added per task, then per (language, gram); only the ranked grams reach the
    driver: ``most`` for each of at most ``MOST_LANGUAGES`` languages.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = gram_counts(text.as_py())
                held.setdefault(lang, []).extend(found)
                size[lang] = size.get(lang, 0) + len(found[0])
                if size[lang] > SLICE:
                    held[lang] = list(_added(*held[lang]))
                    size[lang] = len(held[lang][0]) // 2  # twice as many again before the next
        for lang, parts in held.items():
            grams, counts = _added(*parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)],
                ["lang", "gram", "n"],
            )

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = rows.mapInArrow(count, "lang string, gram long, n long")
    total = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = total.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= most)
    found: dict[str, list[tuple[int, int]]] = {}
    for row in top.limit(MOST_LANGUAGES * most + 1).collect():
        found.setdefault(row.lang, []).append((row["rank"], row.gram))
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return {lang: np.array([g for _, g in sorted(found[lang])]) for lang in sorted(found)}


# --- prediction --------------------------------------------------------------------------------
def out_of_place(ranked: np.ndarray, profile: np.ndarray, most: int = PROFILE_GRAMS) -> int:
    """Sum over the ranked grams of the rank difference, ``most`` where the profile lacks one."""
    order = np.argsort(profile)
    place = np.minimum(np.searchsorted(profile, ranked, sorter=order), len(profile) - 1)
    theirs = order[place]
    differ = np.abs(theirs - np.arange(len(ranked)))
    return int(np.where(profile[theirs] == ranked, differ, most).sum())


def nearest(text: str | None, learned: dict[str, np.ndarray]) -> tuple[str, float, float, int]:
    """The nearest profile, by name among equals, its nearness (1: same ranks, 0: no gram shared), that
    of the next profile (0 if there is none), and the number of ranked grams."""
    ranked = ranking(*gram_counts(text))
    if not len(ranked) or not learned:
        return UNKNOWN, 0.0, 0.0, len(ranked)
    most = PROFILE_GRAMS * len(ranked)
    (far, best), *others = sorted((out_of_place(ranked, profile), lang) for lang, profile in learned.items())
    return best, 1 - far / most, 1 - others[0][0] / most if others else 0.0, len(ranked)


def language(text: str | None, learned: dict[str, np.ndarray]) -> tuple[str, float]:
    """The language and score of ``nearest``."""
    return nearest(text, learned)[:2]


def language_of(text: Column, learned: dict[str, np.ndarray]) -> Column:
    """Struct of ``lang`` and ``score`` for a text column.

    Only the text counts.  Null text and text without a letter are ``und`` with score 0,
    and so is all text if nothing was learned.  Whole texts are read, in slices.
    """

    @F.pandas_udf("lang string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([language(t, learned) for t in texts], columns=["lang", "score"])

    return run(text)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from learning: CRC-32 of the id as text leaves 2 when divided by 4; null ids too."""
    left = F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
    return F.coalesce(left == 2, F.lit(True))


def predict_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """One row per document: id, ``held_out``, ``lang_pred``, ``score``; learned from rows not held out.

    Repeated rows count as often as they occur.  An empty table gives no rows.
    """
    learned = profiles(docs.where(~held_out(id_col)), text_col, lang_col)
    found = language_of(F.col(text_col), learned)
    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"), found.alias("found")).select(
        id_col, "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score")
    )


# --- rejection ---------------------------------------------------------------------------------
def length_class(grams: int) -> int:
    """Texts whose numbers of ranked grams have as many binary digits are of one length."""
    return int(grams).bit_length()


def bounds(
    docs: DataFrame, learned: dict[str, np.ndarray], text_col: str = "text", lang_col: str = "lang"
) -> dict[tuple[str, int | None], float]:
    """A low score per language and length of text, and per language (None); ``held_to`` takes a share.

    It lies at the foot of the scores of the rows whose nearest profile is that of the language
    they name.  Mean and deviation carry it, so that a few strange rows among many do not.
    """

    @F.pandas_udf("lang string, score double, length int")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [nearest(t, learned) for t in texts]
        return pd.DataFrame([(a, s, length_class(n)) for a, s, _, n in found], columns=["lang", "score", "length"])

    rows = docs.select(F.col(lang_col).alias("named"), run(F.col(text_col)).alias("found"))
    rows = rows.where(F.col("named") == F.col("found.lang")).select("found.*")
    # sums, so that lengths add up to the language; the learned languages bound the rows
    cells = rows.groupBy("lang", "length").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("q")
    )
    sums: dict[tuple[str, int | None], np.ndarray] = {}
    for row in cells.collect():
        cell = np.array([row.n, row.s, row.q])
        sums[row.lang, None] = sums.get((row.lang, None), 0) + cell
        if row.n >= ENOUGH_ROWS:
            sums[row.lang, row.length] = cell
    out = {}
    for key, (n, s, q) in sums.items():
        deviation = np.sqrt(max(q / n - (s / n) ** 2, 0.0))
        out[key] = float(s / n - SPREAD * deviation)
    return out


def held_to(lang: str, grams: int, torn: bool, found: dict[tuple[str, int | None], float], least: float) -> float:
    """The score a text must reach: a share of its language's for its length, the larger one if it is torn
    between profiles, less for few grams, ``least`` at least."""
    bound = found.get((lang, length_class(grams)), found.get((lang, None), least))
    return max(least, (TORN_SHARE if torn else SHARE) * bound * grams / (grams + HALF_BOUND_GRAMS))


def is_known(text: str | None, learned: dict[str, np.ndarray], found: dict, least: float) -> bool:
    """Whether the text has a letter and reaches the score it is held to."""
    lang, score, second, grams = nearest(text, learned)
    return lang != UNKNOWN and score >= held_to(lang, grams, score - second < TORN * score, found, least)


def keep_known(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    least: float = 0.05,
) -> DataFrame:
    """The documents whose language is known: not ``und``, and near enough to a profile.

    How near follows from the scores of the learning rows (``bounds``), and text about as near to
    a second profile must be nearer, so that text in a language not learned, related ones
    included, and letter noise go; a few words cannot be told from noise and are
    held to less, down to ``least``.  All columns are kept and no row moves.  If no row has a
    language to learn from, all text with a letter is kept.
    """
    teaching = docs.where(~held_out(id_col))
    learned = profiles(teaching, text_col, lang_col)
    if not learned:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    bound = bounds(teaching, learned, text_col, lang_col)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        return pd.Series([is_known(t, learned, bound, least) for t in texts], dtype=bool)

    return docs.where(known(F.col(text_col)))
