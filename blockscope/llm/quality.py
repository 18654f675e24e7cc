"""Quality rules: fixed base rules and gradient-boosted trees over document statistics.

Trees are complete, kept as numpy arrays of node features, node bounds and leaf values, and
score a batch of documents level by level.  Statistics named in ``WORSE`` may only lower a score.
"""

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents the trees are fitted on at most, drawn by a hash of the id.
MOST_LABELLED = 20_000
#: Losing a good document counts as much as keeping four bad ones: kept from a chance of one in five.
LEAST_CHANCE = 0.2
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

WHITE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics of which more is worse.
WORSE = (
    "symbol_share", "dup_line_share", "repeat_share", "upper_share", "shout_share", "echo_share", "top_share",
)
FREE = ("digit_share", "mark_share", "word_length", "line_words", "new_share", "log_words")
STATISTICS = WORSE + FREE

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def repeat_words(words: list[bytes], window: int = 5) -> int:
    """Words that lie in a window of words found twice or more, the first time included."""
    grams = list(zip(*(words[k:] for k in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    often = Counter(grams)
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero([often[g] > 1 for g in grams])
    np.add.at(marks, at, 1)
    np.add.at(marks, at + window, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple:
    """``BASE`` counts and then ``STATISTICS`` of a whole text; a null text has no word."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # at ASCII white space
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in WHITE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    again = len(lines) - len(set(lines))
    repeat = repeat_words(words)
    base = (n, chars, symbols, again, repeat)
    if not n:
        return (*base, *([0.0] * len(STATISTICS)))
    size = len(data)
    often = Counter(words)
    worse = (
        symbols / chars,
        again / len(lines),
        repeat / n,
        (size - len(data.translate(None, _UPPER))) / size,
        (data.count(b"!") + data.count(b"?")) / size,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        max(often.values()) / n,
    )
    free = (
        (size - len(data.translate(None, b"0123456789"))) / size,
        (size - len(data.translate(None, b".,;:()'\"-"))) / size,
        chars / n,
        n / len(lines),
        len(often) / n,
        float(np.log(n)),
    )
    return (*base, *worse, *free)


def statistics_of(text: Column) -> Column:
    """Struct of the ``BASE`` counts and of ``stats``, the ``STATISTICS`` in order."""
    kind = ", ".join(f"{c} long" for c in BASE) + ", stats array<double>"

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [statistics(t) for t in texts]
        k = len(BASE)
        return pd.DataFrame([(*r[:k], np.array(r[k:])) for r in rows], columns=[*BASE, "stats"])

    return run(text)


# --- trees -------------------------------------------------------------------------------------
@dataclass
class Trees:
    """Complete trees of one depth: per tree, node features and bounds level by level, then leaves."""

    feature: np.ndarray  # tree x node
    bound: np.ndarray  # tree x node; a row goes right if its value is larger
    leaf: np.ndarray  # tree x leaf
    start: float
    least: float = LEAST_CHANCE  # from which a document is kept

    def probability(self, values: np.ndarray) -> np.ndarray:
        total = np.full(len(values), self.start)
        rows = np.arange(len(values))
        nodes = self.feature.shape[1]
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf):
            at = np.zeros(len(values), dtype=np.int64)
            for _ in range(nodes.bit_length()):
                at = 2 * at + 1 + (values[rows, feature[at]] > bound[at])
            total += leaf[at - nodes]
        return 1 / (1 + np.exp(-total))


def _best_split(grad, hess, bins, n_bins, falls, low, high, ridge):
    """(gain, feature, bin) of the best split of some rows, monotone where ``falls``."""

    def value(g, h):
        return np.clip(-g / (h + ridge), low, high)

    def score(g, h):
        v = value(g, h)
        return -(g * v + 0.5 * (h + ridge) * v * v)

    all_g, all_h = grad.sum(), hess.sum()
    best = (1e-9, 0, n_bins)  # no split: every row goes left
    for f in range(bins.shape[1]):
        g = np.cumsum(np.bincount(bins[:, f], grad, n_bins))[:-1]
        h = np.cumsum(np.bincount(bins[:, f], hess, n_bins))[:-1]
        gain = score(g, h) + score(all_g - g, all_h - h) - score(all_g, all_h)
        allowed = (h > 1) & (all_h - h > 1)
        if falls[f]:
            allowed &= value(g, h) >= value(all_g - g, all_h - h)
        gain = np.where(allowed, gain, -np.inf)
        at = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[at] > best[0]:
            best = (float(gain[at]), f, at)
    return best


def fit(
    values: np.ndarray, good: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0
) -> Trees:
    """Boosted trees for the chance that a document is good; constant if all labels are the same.

    A split on a falling statistic must give the right side no larger value, and the
    values of all later splits stay on their side of the middle between the two.
    """
    nodes, leaves = 2**depth - 1, 2**depth
    falls = np.array([name in WORSE for name in STATISTICS])
    share = float(np.clip(good.mean(), 1e-6, 1 - 1e-6)) if len(good) else 1 - 1e-6
    model = Trees(np.zeros((0, nodes), int), np.zeros((0, nodes)), np.zeros((0, leaves)), np.log(share / (1 - share)))
    if len(np.unique(good)) < 2:
        model.least = 0.0
        return model
    edges = [np.unique(np.quantile(values[:, f], np.linspace(0, 1, 65)[1:-1])) for f in range(values.shape[1])]
    bins = np.stack([np.searchsorted(e, values[:, f]) for f, e in enumerate(edges)], axis=1)
    n_bins = max(len(e) for e in edges) + 1
    total = np.full(len(values), model.start)
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-total))
        grad, hess = chance - good, np.maximum(chance * (1 - chance), 1e-6)
        feature, bound, leaf = np.zeros(nodes, int), np.full(nodes, np.inf), np.zeros(leaves)
        place = np.zeros(len(values), dtype=np.int64)
        limits = {0: (-np.inf, np.inf)}
        for node in range(nodes):
            mine = np.flatnonzero(place == node)
            low, high = limits[node]
            _, f, at = _best_split(grad[mine], hess[mine], bins[mine], n_bins, falls, low, high, ridge)
            goes = np.zeros(len(mine), dtype=bool)
            left_limits = right_limits = (low, high)
            if at < len(edges[f]):
                feature[node], bound[node] = f, edges[f][at]
                goes = bins[mine, f] > at
                if falls[f]:
                    sides = [
                        np.clip(-grad[mine[s]].sum() / (hess[mine[s]].sum() + ridge), low, high)
                        for s in (~goes, goes)
                    ]
                    middle = sum(sides) / 2
                    left_limits, right_limits = (middle, high), (low, middle)
            place[mine] = 2 * node + 1 + goes
            limits[2 * node + 1], limits[2 * node + 2] = left_limits, right_limits
        for k in range(leaves):
            mine = place == nodes + k
            low, high = limits[nodes + k]
            best = -grad[mine].sum() / (hess[mine].sum() + ridge)
            leaf[k] = rate * np.clip(best, low, high)
        total += leaf[place - nodes]
        model = Trees(
            np.vstack([model.feature, feature]), np.vstack([model.bound, bound]),
            np.vstack([model.leaf, leaf]), model.start,
        )
    return model


# --- rules -------------------------------------------------------------------------------------
def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    most: int = MOST_LABELLED,
) -> Trees:
    """Trees fitted on at most ``most`` labelled documents; other rows of their ids count too.

    Labels other than 0 and 1 and null ids are left out.  Without labels, or with one
    kind only, every document gets the same score and is kept.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(id_col).agg(F.min(label_col).alias("__good"))
    known = known.orderBy(F.xxhash64(id_col), id_col).limit(most)
    texts = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    drawn = texts.join(F.broadcast(known), id_col)  # at most ``most`` rows of two numbers
    stats = statistics_of(F.col("__text"))["stats"]
    rows = drawn.select(id_col, F.struct("__good", stats.alias("stats")).alias("row"))
    rows = rows.groupBy(id_col).agg(F.min("row").alias("row")).orderBy(id_col).collect()
    good = np.array([r["row"]["__good"] for r in rows], dtype=float)
    return fit(np.array([r["row"]["stats"] for r in rows]).reshape(-1, len(STATISTICS)), good)


def verdict_of(text: Column, model: Trees) -> Column:
    """Struct of the ``BASE`` counts, ``base_failed`` and ``kept`` for a text column.

    A text fails the base rules with fewer than ``MIN_WORDS`` words or more than
    ``MAX_REPEAT_PERCENT`` per cent of them repeated; so null and empty texts fail.  It is kept
    if it does not fail and the trees give it the chance they ask for.
    """
    kind = ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean"

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        k = len(BASE)
        values = np.array([statistics(t) for t in texts], dtype=float).reshape(-1, k + len(STATISTICS))
        out = pd.DataFrame(values[:, :k].astype(np.int64), columns=list(BASE))
        few = out["n_words"] < MIN_WORDS
        out["base_failed"] = few | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
        out["kept"] = ~out["base_failed"] & (model.probability(values[:, k:]) >= model.least)
        return out

    return run(text)


def judge(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the ``BASE`` counts, ``base_failed``, ``kept``."""
    found = docs.select(F.col(id_col), verdict_of(F.col(text_col), model).alias("found"))
    return found.select(id_col, "found.*")


def keep_good(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns; no row moves."""
    return docs.where(verdict_of(F.col(text_col), model)["kept"])
