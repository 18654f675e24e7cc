"""Keep-first over payloads that arrive in batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockscope.operators.windows import keep_first
from blockscope.sources.files import remove, written_folders


def first_arrivals(stream: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """The first arrival per key; state of a key is dropped ``delay`` after its event time."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def run_keep_first(
    stream: DataFrame, key: Sequence[str], order: Sequence[Column], out: str, checkpoint: str
) -> None:
    """Reduce each new batch to its first row per key and log it, then stop.

    Which row is preferred does not depend on arrival, so no state is kept between
    batches: a later batch may still bring a better row.  A repeated batch
    overwrites its own folder.
    """

    def log(batch: DataFrame, batch_id: int) -> None:
        keep_first(batch, key, order).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    (
        stream.writeStream.foreachBatch(log)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def preferred_so_far(
    stream: DataFrame, key: Sequence[str], order: Sequence[Column], event_time: str, delay: str
) -> DataFrame:
    """The preferred report per key so far; run it in update mode, and a better report replaces what was given out.

    All reports of a key have the same event time.  State is one row per key, dropped ``delay`` after
    that time; a report that comes later still changes nothing.  Of reports alike in ``order`` the least columns count.
    """
    rest = [c for c in stream.columns if c not in {*key, event_time}]
    ranks = [o.alias(f"__rank{i}") for i, o in enumerate(order)]
    best = F.min(F.struct(*ranks, *rest)).alias("__best")
    kept = stream.withWatermark(event_time, delay).groupBy(*key, event_time).agg(best)
    return kept.select(*key, event_time, *[F.col("__best").getField(c).alias(c) for c in rest])


def run_corrections(preferred: DataFrame, out: str, checkpoint: str) -> list[int]:
    """Log what each new batch of ``preferred_so_far`` gives out or corrects, then stop.

    Returns the keys held in state after each batch.  A repeated batch overwrites its own folder.
    """

    def log(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    running = (
        preferred.writeStream.foreachBatch(log)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return [sum(s.numRowsTotal for s in p.stateOperators) for p in running.recentProgress]


def corrected_rows(spark: SparkSession, out: str, key: Sequence[str]) -> DataFrame:
    """What was given out last per key, over the batches fully written."""
    batches, _ = _finished(spark, out)
    rows = spark.read.option("basePath", out).parquet(*[p for _, p in sorted(batches.items())])
    rest = [c for c in rows.columns if c not in {*key, "batch"}]
    last = F.max_by(F.struct(*rest), "batch").alias("__last")
    return rows.groupBy(*key).agg(last).select(*key, "__last.*")


def _finished(spark: SparkSession, out: str) -> tuple[dict[int, str], dict[int, str]]:
    """Number and folder of the log's batches and of its compactions, only those fully written."""
    found: dict[str, dict[int, str]] = {"batch": {}, "upto": {}}
    for name, folder in written_folders(spark, out).items():
        kind, _, number = name.partition("=")
        if kind in found:
            found[kind][int(number)] = folder
    return found["batch"], found["upto"]


def _live(batches: dict[int, str], upto: dict[int, str]) -> list[str]:
    """Folders that hold the log: the last compaction and the batches after it."""
    last = max(upto, default=-1)
    return [*[upto[k] for k in upto if k == last], *[p for k, p in sorted(batches.items()) if k > last]]


def kept_rows(
    spark: SparkSession, out: str, key: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """The first row per key over all batches logged so far; a batch being written is not seen."""
    return keep_first(spark.read.parquet(*_live(*_finished(spark, out))), key, order)


def compact_log(spark: SparkSession, out: str, key: Sequence[str], order: Sequence[Column]) -> None:
    """Reduce the log to one folder of first rows, and remove the folders that the compaction before it replaced.

    Run it between runs of the stream.  What this compaction replaces stays until the next one, so
    readers that began before it can end.  Cut short, it leaves the log as it was, or with
    folders that a later compaction removes.
    """
    batches, upto = _finished(spark, out)
    last, before = max(batches, default=-1), max(upto, default=-1)
    if last <= before:
        return
    rows = spark.read.parquet(*_live(batches, upto))
    keep_first(rows, key, order).write.mode("overwrite").parquet(f"{out}/upto={last}")
    for folder in [*[p for k, p in batches.items() if k <= before], *[p for k, p in upto.items() if k < before]]:
        remove(spark, folder)
