"""Incremental landing of new response files, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from blockscope.sources.landing import LANDED_LINE, classify


def read_landed_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(LANDED_LINE).option("maxFilesPerTrigger", files_per_batch).json(path)
    )


def run_available(
    df: DataFrame, out: str, checkpoint: str, by: list[str] | None = None
) -> StreamingQuery:
    """Append what is new since the last run to Parquet, then stop; returns the ended query.

    The checkpoint knows the files already taken, and the sink's log lists each
    batch's files once, so a run that was cut short can simply be repeated.
    """
    writer = (
        df.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    if by:
        writer = writer.partitionBy(*by)
    run = writer.start(out)
    run.awaitTermination()
    return run


def land_new(
    spark: SparkSession, source: str, out: str, checkpoint: str, schema: T.StructType
) -> None:
    """Classify new responses into ``out``, good ones and rejects in folders of their own."""
    rows = classify(read_landed_stream(spark, source), schema)
    outcome = F.when(F.col("reason").isNull(), "good").otherwise("reject")
    run_available(rows.withColumn("outcome", outcome), out, checkpoint, by=["outcome"])


def landed_rows(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The good rows landed so far."""
    names = [f"`{f.name}`" for f in schema.fields]
    return spark.read.parquet(out).where(F.col("outcome") == "good").select("key", "attempt", *names)
