"""The queries opN_<name>: each applies its operator to its whole table, with production parameters."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockscope.llm import (
    bpe,
    chat_quotes,
    decontaminate,
    html_extract,
    improbable_features,
    langid,
    periodic_runs,
    quality,
    ranked_search,
    simhash_dedup,
    token_counts,
    url_templates,
    warc,
)
from blockscope.llm.common import table
from blockscope.llm.oracle import oracle_sql
from blockscope.session import run_dir

__all__ = ["oracle_sql", "queries"]

Query = Callable[[SparkSession, str], DataFrame]

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
MOST_TOKENS = 512
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    home = run_dir(spark, "archives")
    warc.write_archives(pages, home)
    read = warc.read_archives(spark, home).where(F.col("gap").isNull())
    kind = pages.schema["page_id"].dataType
    return read.select(
        warc.page_of(F.col("record_id")).cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_of(F.col("refers_to")).cast(kind).alias("refers_to"),
    )


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, good) for pages whose document, named by the number in the path, is labelled.

    Good documents have quality 1 and are not toxic.
    """
    number = F.regexp_extract("url", r"/([0-9]{1,18})(?:[./?#]|$)", 1)
    urls = table(spark, sf_dir, "pages").select("url", number.alias("number")).where(F.col("number") != "")
    urls = urls.select("url", F.col("number").cast("long").alias("doc_id"))
    labels = table(spark, sf_dir, "labels")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return urls.join(labels.select("doc_id", good.alias("good")), "doc_id").select("url", "good")


def op6_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge_urls(table(spark, sf_dir, "pages"), page_labels(spark, sf_dir), URL_RULES)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), bpe.read_vocabulary(BYTE_BPE))
    return counted.withColumn("over_limit", F.col("n_tokens") > MOST_TOKENS)


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), bpe.read_vocabulary(WORD_BPE))


def op10_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_quotes.reply_ordered(table(spark, sf_dir, "conversations"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which one document of ten repeats a stretch of its words to its end.

    Place and period follow from the id.  A text without a word, or without an id, stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    found = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    words = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, found).alias("words"))
    n = F.size("words")
    a = F.col("g") % F.greatest(n, F.lit(1))
    placed = words.select("doc_id", "text", "g", "words", a.cast("int").alias("a"))
    p = 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))
    placed = placed.select("doc_id", "text", "words", "a", p.cast("int").alias("p"))
    a, p = F.col("a"), F.col("p")
    edited = F.transform("words", lambda w, i: F.when(i < a, w).otherwise(F.get("words", a + (i - a) % p)))
    return placed.select("doc_id", F.when(n > 0, F.array_join(edited, " ")).otherwise(F.col("text")).alias("text"))


def _longer_ratio(best: Column, run: Column) -> Column:
    """The run with the greater length / period; the earlier one of equals."""
    more = run["length"] * best["period"] > best["length"] * run["period"]
    return F.when(best.isNull() | more, run).otherwise(best)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.transform(lines, lambda line: F.concat(line, F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.reduce("runs", none, _longer_ratio).alias("best"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def with_other_half(text: str, follows: str) -> str:
    """The text with its last half, rounded down, replaced by as much of the start of another."""
    half = len(text) // 2
    return text[: len(text) - half] + follows[:half]


def op13_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranks = improbable_features.learn_ranks(docs)
    found = improbable_features.compare_with_next(docs, ranks, with_other_half)
    return found.select(
        "doc_id",
        "n_chars",
        F.col("variant_sha256").alias("edited_sha256"),
        "fingerprint",
        F.col("variant_fingerprint").alias("edited_fingerprint"),
        F.col("near_variant").alias("near_edited"),
        "near_next",
    )


def queries() -> dict[str, Query]:
    return {
        fn.__name__: fn
        for fn in (
            op1_language_id,
            op2_html_text,
            op3_simhash_dedup,
            op4_benchmark_leaks,
            op5_warc,
            op6_url_templates,
            op7_quality_rules,
            op8_token_counts,
            op9_bpe_round_trip,
            op10_chat_quotes,
            op11_periodic_runs,
            op12_ranked_search,
            op13_improbable_features,
        )
    }
