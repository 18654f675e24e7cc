import re

import numpy as np
import pytest

from blockscope.llm import quality as q
from blockscope.llm import queries


def brute_base(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
    windows = {}
    for k in range(len(words) - 4):
        windows.setdefault(tuple(words[k : k + 5]), []).append(k)
    repeated = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    again = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(repeated)


@pytest.mark.parametrize(
    "text",
    [
        None, "", " \n\t", "one", "a b c d e a b c d e", "a b c d e f a b c d e", "x " * 30, "#*$%&|<>! é|ü", "a\nb\na\n\n \n \na ",
        "l1 w\nl2\nl1 w\nl1 w", "a\x1cb c\x0bd\x0ce\x85f", "a a a a a a", "é ü ß " * 4,
    ],
)
def test_base_counts(text):
    assert q.statistics(text)[:5] == brute_base(text)


def test_statistics_have_their_names():
    s = dict(zip(q.STATISTICS, q.statistics("Aa 1! aa\nAa 1! aa")[5:]))
    assert s["dup_line_share"] == 0.5 and s["upper_share"] == 2 / 17 and s["digit_share"] == 2 / 17
    assert s["word_length"] == 2.0 and s["new_share"] == 0.5 and s["top_share"] == pytest.approx(1 / 3)


def data(n=4000, seed=1):
    rng = np.random.default_rng(seed)
    values = rng.random((n, len(q.STATISTICS)))
    noise = rng.normal(0, 0.3, n)
    return values, (1.5 * values[:, 0] + values[:, 8] - 1.2 + noise < 0).astype(float)


def test_trees_learn_and_hold_out():
    values, good = data()
    model = q.fit(values[:3000], good[:3000])
    right = (model.probability(values[3000:]) > 0.5) == good[3000:]
    assert right.mean() > 0.8


def test_scores_never_rise_with_what_is_worse():
    values, good = data()
    # labels that would like the opposite for one constrained statistic
    good = np.where(values[:, 2] > 0.5, 1.0, good)
    model = q.fit(values, good)
    rng = np.random.default_rng(3)
    rows = rng.random((300, len(q.STATISTICS)))
    for f in range(len(q.WORSE)):
        scores = []
        for x in np.linspace(-0.1, 1.1, 40):
            moved = rows.copy()
            moved[:, f] = x
            scores.append(model.probability(moved))
        assert (np.diff(np.array(scores), axis=0) <= 1e-12).all()


def test_node_arrays_score_as_trees_do():
    values, good = data(500)
    model = q.fit(values, good, trees=5)

    def walk(row):
        total = model.start
        for feature, bound, leaf in zip(model.feature, model.bound, model.leaf):
            at = 0
            while at < len(feature):
                at = 2 * at + 1 + int(row[feature[at]] > bound[at])
            total += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.probability(values), [walk(r) for r in values])


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, kept int, stats string")


def labels(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, quality int, toxic int")


CLEAN = "this is a line of plain words that nobody would throw away at all"


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "too few words"), (4, CLEAN), (4, CLEAN), (None, CLEAN), (5, "w " * 100), (6, CLEAN + " more" * 0 + " x y z " * 1)]
    model = q.train(docs(spark, rows), labels(spark, []))
    out = q.judge(docs(spark, rows), model)
    assert out.columns == ["doc_id", *q.BASE, "base_failed", "kept"]
    got = {r.doc_id: (r.base_failed, r.kept) for r in out.collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (True, False), 4: (False, True), None: (False, True), 5: (True, False), 6: (False, True)}
    assert out.count() == len(rows)
    kept = q.keep_good(docs(spark, rows), model)
    assert kept.columns == ["doc_id", "text", "kept", "stats"] and kept.count() == 4
    assert q.judge(docs(spark, []), model).count() == 0


@pytest.mark.parametrize("value", [0, 1])
def test_one_kind_of_label_keeps_what_passes_the_base(spark, value):
    rows = [(k, CLEAN + f" {k}") for k in range(30)]
    model = q.train(docs(spark, rows), labels(spark, [(k, value) for k in range(30)] + [(None, 0), (3, None), (99, 0)]))
    assert all(r.kept for r in q.judge(docs(spark, rows), model).collect())


def test_sample_of_labels_is_bounded_and_repeatable(spark):
    rows = [(k, f"{CLEAN} {k}" if k % 2 else "### *** " * 20) for k in range(200)]
    known = labels(spark, [(k, k % 2) for k in range(200)] * 2)
    a = q.train(docs(spark, rows + rows), known, most=50)
    b = q.train(docs(spark, rows[::-1] + rows).repartition(7), known.repartition(3), most=50)
    assert all(np.array_equal(x, y) for x, y in ((a.feature, b.feature), (a.bound, b.bound), (a.leaf, b.leaf)))


def test_query_equals_brute_force(spark):
    home = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{home}/documents.parquet").collect()}
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{home}/labels.parquet").collect()}
    lost = kept_bad = 0
    for r in queries.op7_quality_rules(spark, home).collect():
        base = brute_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        assert not (r.base_failed and r.kept)
        lost += marks.get(r.doc_id) == 1 and not r.kept and not r.base_failed
        kept_bad += marks.get(r.doc_id) == 0 and r.kept
    assert lost <= 1 and kept_bad <= 1


def test_held_out_labels(spark):
    home = "/root/testdata/sf0.01"
    docs_, known = spark.read.parquet(f"{home}/documents.parquet"), spark.read.parquet(f"{home}/labels.parquet")
    model = q.train(docs_, known.where("doc_id % 2 = 0"))
    out = q.judge(docs_, model).join(known.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept == bool(r.quality) for r in out]) > 0.97
