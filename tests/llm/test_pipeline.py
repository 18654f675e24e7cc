import zlib
import corpus_pipeline as p
from blockscope.llm import bpe, decontaminate, langid, quality, queries, simhash_dedup

HOME = "/root/testdata/sf0.001"
NAMES = ["language_id", "quality_rules", "near_duplicates", "decontamination", "encoding"]


def brute(spark, docs):
    """The rows after each stage, decided row by row from the operators' plain forms."""
    table = {r.doc_id: r for r in docs.collect()}
    learned = langid.profiles(docs.where(~langid.held_out()))
    stages = []

    import numpy as np

    found = {i: langid.nearest(r.text, learned) for i, r in table.items()}
    cells = {}
    for i, r in table.items():
        lang, score, _, grams = found[i]
        if zlib.crc32(str(i).encode()) % 4 != 2 and r.lang == lang:
            cells.setdefault((lang, None), []).append(score)
            cells.setdefault((lang, langid.length_class(grams)), []).append(score)

    def known(i):
        lang, score, second, grams = found[i]
        if lang == "und":
            return False
        cell = cells.get((lang, langid.length_class(grams)), [])
        cell = cell if len(cell) >= langid.ENOUGH_ROWS else cells.get((lang, None), [])
        if not cell:
            return score >= 0.05
        share = 0.8 if score - second < 0.25 * score else 0.75
        bound = share * (np.mean(cell) - 4 * np.std(cell)) * grams / (grams + 16)
        return score >= max(0.05, bound)

    kept = {i for i in table if known(i)}
    stages.append(kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{HOME}/labels.parquet").collect()}
    order = sorted(i for i in kept if i in labels)
    k = len(quality.BASE)
    values = {i: quality.statistics(table[i].text) for i in kept}
    model = quality.fit(np.array([values[i][k:] for i in order]), np.array([labels[i] for i in order], dtype=float))

    def good(i):
        n, repeat = values[i][0], values[i][4]
        return n >= 10 and 100 * repeat <= 20 * n and model.probability(np.array([values[i][k:]]))[0] >= model.least

    kept = {i for i in kept if good(i)}
    stages.append(kept)
    prints = {i: simhash_dedup.fingerprint((table[i].text or "").encode()) for i in sorted(kept)}
    left, first = dict(prints), set()
    for i in sorted(prints):
        if i in left:
            first.add(i)
            edge = [left.pop(i)]
            while edge:
                at = edge.pop()
                near = [j for j, x in left.items() if (x ^ at).bit_count() <= 3]
                edge += [left.pop(j) for j in near]
    kept = first
    stages.append(kept)
    found = decontaminate.leaks(docs, spark.read.parquet(f"{HOME}/benchmark.parquet")).collect()
    stages.append(kept - {r.doc_id for r in found})
    return stages


def test_stages_and_their_effect(spark):
    docs = spark.read.parquet(f"{HOME}/documents.parquet")
    assert [name for name, _ in p.STAGES] == NAMES
    expected = brute(spark, docs)
    at = docs
    for (name, stage), ids in zip(p.STAGES[:-1], expected):
        out = stage(spark, at, HOME)
        assert out.columns == docs.columns, name
        assert {r.doc_id for r in out.collect()} == ids, name
        assert out.count() == len(ids), name
        at = out
    assert len(expected[-1]) < docs.count()
    last = p.run(spark, HOME)
    texts = {r.doc_id: r.text for r in docs.collect()}
    word = bpe.WordBpe(bpe.read_vocabulary(queries.WORD_BPE))
    assert {r.doc_id: r.n_tokens for r in last.collect()} == {
        i: len(word.encode_pieces([texts[i].encode()])[0]) for i in expected[-1]
    }


def test_each_stage_takes_odd_rows(spark):
    docs = spark.read.parquet(f"{HOME}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", None, None, 0), (10**9, "", None, None, 0)], docs.schema)
    for name, stage in p.STAGES:
        for rows in (odd, odd.limit(0), docs.limit(30).unionByName(odd)):
            out = stage(spark, rows, HOME)
            assert out.count() <= rows.count(), name


def test_every_operator_has_its_query():
    found = queries.queries()
    assert [int(n[2:].split("_")[0]) for n in found] == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(found)
