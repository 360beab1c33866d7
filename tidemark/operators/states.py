"""Daily states that merge exactly, stored by day and kept up by the days that a load touches.

* Users of a day are bitmaps of their (whole) numbers, one per 32,768 numbers that occur: days fold into weeks and windows by ``or``, and distinct counts
  are bit counts.  A state is as large as its day has users at most, however many events there were.
* Waiting times are counts per whole minute: medians of any span of days come from cumulated counts, without keeping values in an aggregate.

A table of states is partitioned by day.  After a load only the partitions of days that it has rows of are computed and replaced; the files of other days stay
as they are.  A load that is run again gives the same table.  Rows without a time belong to no day; rows without a user count in no bitmap and, as in the views, no event.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import boundary_minutes, day, week

USERS = "bucket long, users binary, events long, day date"
WAITS = "repo_full_name string, kind string, minutes long, n long, day date"


def user_states(*sources: DataFrame) -> DataFrame:
    """day, bucket, users (a bitmap), events, of one or more tables with created_at and user_id."""
    rows = None
    for s in sources:
        one = s.select(day("created_at").alias("day"), F.col("user_id").cast("long").alias("u")).filter("u is not null and day is not null")
        rows = one if rows is None else rows.unionAll(one)
    return rows.groupBy("day", F.bitmap_bucket_number("u").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("u")).alias("users"), F.count(F.lit(1)).alias("events"))


def wait_states(pulls: DataFrame) -> DataFrame:
    """day, repo_full_name, kind ('review', 'merge'), minutes, n."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), boundary_minutes(F.col("created_at"), F.col(c)).alias("minutes")) for k, c in (("review", "first_review_at"), ("merge", "merged_at"))])
    rows = pulls.select(day("created_at").alias("day"), "repo_full_name", F.inline(kinds)).filter("minutes is not null and day is not null")
    return rows.groupBy("day", "repo_full_name", "kind", "minutes").agg(F.count(F.lit(1)).alias("n"))


def daily_users(states: DataFrame) -> DataFrame:
    return states.groupBy("day").agg(F.sum(F.bitmap_count("users")).alias("users"), F.sum("events").alias("events"))


def users_of(states: DataFrame, period: Column, name: str) -> DataFrame:
    """Distinct users of longer periods, from their days' bitmaps."""
    merged = states.groupBy(period.alias(name), "bucket").agg(F.bitmap_or_agg("users").alias("users"))
    return merged.groupBy(name).agg(F.sum(F.bitmap_count("users")).alias("users"))


def weekly_users(states: DataFrame) -> DataFrame:
    return users_of(states, week("day"), "week")


def last_days(states: DataFrame, days: int) -> DataFrame:
    """Users of each of the newest days; only their partitions are read."""
    newest = states.agg(F.max("day")).scalar()
    return daily_users(states.filter(F.col("day") > F.date_sub(newest, days))).orderBy(F.desc("day")).limit(days)


def weekly_medians(states: DataFrame) -> DataFrame:
    """week, repo_full_name, kind, median_minutes: the middle value, or the mean of the two in the middle."""
    counts = states.groupBy(week("day").alias("week"), "repo_full_name", "kind", "minutes").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("week", "repo_full_name", "kind")
    # A row per minute that occurs, not per pull request.
    ranked = counts.withColumns({"upto": F.sum("n").over(by.orderBy("minutes")), "total": F.sum("n").over(by)})
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    first = F.col("upto") - F.col("n")
    holds = lambda k: (first < k) & (F.col("upto") >= k)
    return ranked.groupBy("week", "repo_full_name", "kind").agg(
        ((F.max(F.when(holds(low), F.col("minutes"))) + F.max(F.when(holds(high), F.col("minutes")))) / 2.0).alias("median_minutes")
    )


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def refresh(path: str, loaded: Sequence[DataFrame], tables: Sequence[DataFrame], states: Callable[..., DataFrame]) -> list:
    """Replaces the states of the days that rows ``loaded`` fall on, from ``tables`` as they are after the load; the days, at most one per day of the calendar."""
    touched = None
    for one in loaded:
        days = one.select(day("created_at").alias("day"))
        touched = days if touched is None else touched.unionAll(days)
    found = sorted(r["day"] for r in touched.filter("day is not null").distinct().collect())
    if found:
        of_days = [t.filter(day("created_at").isin(*found)) for t in tables]
        states(*of_days).repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return found
