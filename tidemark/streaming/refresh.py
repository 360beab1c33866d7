"""Event tables as streams.

A stream reads files as they arrive; two days of late data are waited for, as the batch loads re-read
two days.  Batches are committed with their checkpoint only after the sink has succeeded.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import fresh_dir

LATE = "2 days"


def event_stream(spark: SparkSession, path: str, time: str = "ts") -> DataFrame:
    """Parquet files at a path or pattern, with a watermark; times without zone are read as UTC."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, LATE)


def deduplicated(stream: DataFrame, key: str = "event_id") -> DataFrame:
    """Each key once within the time that late data is waited for; state is dropped beyond."""
    return stream.dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, time: str, size: str, *keys: str, offset: str = "0 seconds") -> DataFrame:
    """Counts by fixed windows; weeks that start on Monday are '7 days' with offset '4 days'."""
    at = F.window(time, size, size, offset)
    return stream.groupBy(at.alias("w"), *keys).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), *keys, "events")


def calendar(stream: DataFrame, time: str, unit: str, *keys: str) -> DataFrame:
    """Counts by calendar periods, which have no fixed length ('month', 'quarter', 'year')."""
    at = F.date_trunc(unit, F.col(time)).alias("start")
    return stream.groupBy(at, *keys).agg(F.count(F.lit(1)).alias("events"))


def once(result: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is now; its result as a table in the shared folder, written by the executors."""
    spark, path = result.sparkSession, fresh_dir(result.sparkSession, "stream-result")
    spark.createDataFrame([], result.schema).write.parquet(path)  # what a stream without rows gives

    def replace(batch: DataFrame, number: int) -> None:
        # In complete mode a batch is the whole result; in append mode it is new rows, under their batch's name.
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    query = (
        result.writeStream.outputMode(mode).foreachBatch(replace)
        .option("checkpointLocation", fresh_dir(spark, "stream")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(result.schema).option("recursiveFileLookup", "true").parquet(path)


def upserting(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Starts a query that hands each micro-batch to ``apply``; the batch counts as done only if that returns."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def file_upsert(target: str, key: str, *order: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch's newest row per key, by the columns ``order``, as a delta of its own under ``target``.

    Nothing that is there already is read or rewritten, and a batch that is run again after a failure overwrites its own
    delta.  ``upserted`` reads the table.
    """

    def apply(batch: DataFrame, number: int) -> None:
        _newest(batch, key, order).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return apply


def _newest(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Of each key's rows the one with the largest ``order``, equal ones by all columns: an aggregate, so a hot key is folded first."""
    rank = F.struct(*order, *[c for c in rows.columns if c not in order])
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), rank).alias("_best"))
    return best.select("_best.*")


def upserted(spark: SparkSession, target: str, key: str, *order: str) -> DataFrame:
    """The table that deltas make up: each key's newest row; equal ones by their batch."""
    return _newest(spark.read.parquet(target), key, (*order, "batch")).drop("batch")


def compacted(spark: SparkSession, target: str, into: str, key: str, *order: str) -> None:
    """The same table with a single delta, under another path, for when deltas have become many."""
    upserted(spark, target, key, *order).write.parquet(f"{into}/batch=0")


def daily_events(spark: SparkSession, path: str) -> DataFrame:
    """Events per day and type, computed by a stream over the files at ``path``."""
    days = tumbling(event_stream(spark, path), "ts", "1 day", "event_type")
    return once(days).select(F.to_date("start").alias("day"), "event_type", "events")


def weekly_events(spark: SparkSession, path: str) -> DataFrame:
    """Events per week (from Monday) and type, computed by a stream over the files at ``path``."""
    weeks = tumbling(event_stream(spark, path), "ts", "7 days", "event_type", offset="4 days")
    return once(weeks).select(F.to_date("start").alias("week"), "event_type", "events")


def monthly_events(spark: SparkSession, path: str) -> DataFrame:
    """Events per calendar month and type, each event once, computed by a stream over the files at ``path``."""
    months = calendar(deduplicated(event_stream(spark, path)), "ts", "month", "event_type")
    return once(months).select(F.to_date("start").alias("month"), "event_type", "events")


def pushed_documents(spark: SparkSession, path: str, target: str, checkpoint: str):
    """Documents pushed as JSON lines (ref, content) into a folder: cut into chunks and appended to ``target``.

    A document without a ref counts as 'webhook'.
    """
    from ..operators.chunking import chunked

    stream = spark.readStream.schema("ref string, content string").json(path)

    def apply(batch: DataFrame, number: int) -> None:
        rows = batch.filter("content is not null").select(F.coalesce("ref", F.lit("webhook")).alias("ref"), "content")
        # A batch that is run again overwrites its own part.
        chunked(rows, "ref", "content").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return upserting(stream, apply, checkpoint)
