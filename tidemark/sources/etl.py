"""Loading event tables: full and incremental refresh, watermarks, column drop."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How far before its watermark an incremental load reads again.
OVERLAP = dt.timedelta(days=2)
#: Columns that never leave their source.
PRIVATE = ("prompt_text", "password_hash", "calendar_token", "email")


def without_private(rows: DataFrame) -> DataFrame:
    return rows.drop(*PRIVATE)


def incremental(old: DataFrame, source: DataFrame, key: str, time: str, watermark: dt.datetime, overlap: dt.timedelta = OVERLAP) -> DataFrame:
    """The table after a load of everything since the watermark less the overlap: new rows replace old ones of their key."""
    fresh = source.filter(F.col(time) >= F.lit(watermark - overlap).cast("timestamp_ntz"))
    return old.join(fresh.select(key), key, "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))


def watermark(rows: DataFrame, table: str, time: str, now: dt.datetime, mode: str) -> DataFrame:
    return rows.agg(F.max(time).alias("max_time"), F.count(F.lit(1)).alias("row_count")).select(
        F.lit(table).alias("table"), "max_time", "row_count", F.lit(now).cast("timestamp_ntz").alias("last_run"), F.lit(mode).alias("last_mode")
    )


def newest_by_key(rows: DataFrame, key: str, time: str, *tie: str) -> DataFrame:
    """One row per key, the newest; an aggregate, so a hot key is folded before it is moved."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(whole, F.struct(time, *tie)).alias("r")).select("r.*")


def stats(watermarks: DataFrame) -> DataFrame:
    """Loaded tables, the largest first."""
    return watermarks.orderBy(F.desc("row_count"), "table")


def snapshot(rows: DataFrame, path: str) -> None:
    """A dimension, loaded whole; columns that must not leave the source are dropped."""
    without_private(rows).write.mode("overwrite").parquet(path)


def extract(rows: DataFrame, path: str, key: str, time: str, previous: DataFrame | None, mark: dt.datetime | None) -> None:
    """A full load without a watermark, else an incremental one on the previous version; written as a new version."""
    rows = without_private(rows)
    if previous is not None and mark is not None:
        rows = incremental(previous, rows, key, time, mark)
    rows.write.mode("overwrite").parquet(path)
