"""The corpus pipeline: five stages over documents, each written as Parquet before the next.

Every stage gets the documents its predecessor kept and the folder of the tables, and
decides on all of them with one operator of ``blockscope.llm``.
"""

from pyspark.sql import DataFrame, SparkSession

from blockscope.llm import bpe, decontaminate, langid, quality, simhash_dedup
from blockscope.llm.common import stored, table
from blockscope.llm.queries import WORD_BPE


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay; the profiles are learned from the documents given."""
    return langid.keep_known(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees stay; the trees learn from the given ones with a label."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return simhash_dedup.one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay; one without an id is judged by its text."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), judge_null_ids=True)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's id with its token count and the digests of its ids and of what they decode to."""
    return bpe.encode_documents(docs, bpe.read_vocabulary(WORD_BPE))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: No SQL: trained profiles and trees, XXH64 fingerprints and merges have no equal there.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
