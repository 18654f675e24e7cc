"""What was tried per key over many landings: a partitioned table of which a landing rewrites what it hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockscope.session import settled
from blockscope.sources.files import exists
from blockscope.sources.landing import MAX_TRIES


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(key, part, tries, done, landing): one row per key tried so far; empty where nothing was recorded.

    ``schema`` gives the types of key and part, as in ``"key string, part string"``.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], f"{schema}, tries int, done boolean, landing long")
    key, part = (f.strip() for f in schema.split(",", 1))
    return spark.read.schema(f"{key}, tries int, done boolean, landing long, {part}").parquet(path)


def record_attempts(spark: SparkSession, path: str, tried: DataFrame, landing: int) -> None:
    """Add the tries of one landing (key, part, done; a row per try) to the ledger below ``path``.

    A key always has the same part.  Only the parts that occur among the tries are read and
    written anew, each as a whole; they are merged into the shared folder before the first is
    replaced, so the old rows are not read while they go.  Landings are numbered upwards: a
    landing that is recorded again, after a cut-short run too, counts once.  One landing is recorded at a time.
    """
    kinds = {f.name: f.dataType.simpleString() for f in tried.schema.fields}
    schema = f"key {kinds['key']}, part {kinds['part']}"
    new = tried.where(F.col("key").isNotNull()).groupBy("key", "part").agg(
        F.count(F.lit(1)).cast("int").alias("tries"), F.max(F.coalesce("done", F.lit(False))).alias("done")
    )
    new = settled(new.withColumn("landing", F.lit(landing).cast("long")))
    hit = new.select("part").distinct()
    old = read_ledger(spark, path, schema)
    old = old.join(hit, old["part"].eqNullSafe(hit["part"]), "left_semi")
    both = old.withColumn("__old", F.lit(True)).unionByName(new.withColumn("__old", F.lit(False)))
    per_key = both.groupBy("key", "part").agg(
        F.max(F.when(F.col("__old"), F.col("landing"))).alias("__seen"),
        F.sum(F.when(F.col("__old"), F.col("tries"))).alias("__before"),
        F.sum(F.when(~F.col("__old"), F.col("tries"))).alias("__now"),
        F.max("done").alias("done"),
    )
    again = F.coalesce(F.col("__seen") >= landing, F.lit(False))  # in the ledger already
    now = F.when(again, 0).otherwise(F.coalesce("__now", F.lit(0)))
    merged = per_key.select(
        "key",
        (F.coalesce("__before", F.lit(0)) + now).cast("int").alias("tries"),
        "done",
        F.greatest("__seen", F.when(F.col("__now").isNotNull(), F.lit(landing).cast("long"))).alias("landing"),
        "part",
    )
    writer = settled(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("part").parquet(path)


def open_keys(work: DataFrame, ledger: DataFrame, max_tries: int = MAX_TRIES) -> DataFrame:
    """The rows of a work list whose key has no result yet and has tries left."""
    closed = ledger.where(F.col("done") | (F.col("tries") >= max_tries)).select("key")
    return work.join(closed, "key", "left_anti")


def given_up(ledger: DataFrame, max_tries: int = MAX_TRIES) -> DataFrame:
    """Keys without a result after all their tries."""
    return ledger.where(~F.col("done") & (F.col("tries") >= max_tries)).select("key", "tries")
