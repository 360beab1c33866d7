"""Product, engineering and AI activity: the daily and weekly views.

Every view is one grouping (or a union of groupings) of an event table by calendar and key columns.
Counting is partial before the shuffle; distinct counts are exact.  Dimension tables are joined
plainly: Spark broadcasts them while they are below its own size threshold and shuffles them beyond.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import boundary_minutes, day, sunday_first, week

EPOCH = dt.datetime(1970, 1, 1)


def n() -> Column:
    """Rows of a group."""
    return F.count(F.lit(1))


def feature_daily(feature_events: DataFrame) -> DataFrame:
    return feature_events.groupBy(day("created_at").alias("day"), "feature_key", "event").agg(
        n().alias("events"),
        F.countDistinct("user_id").alias("users"),
        F.countDistinct("session_id").alias("sessions"),
        (F.sum("engagement_ms") / 1000.0).alias("engagement_s"),
    )


def _per_user(feature_events: DataFrame, transition_events: DataFrame, period: Column, name: str) -> DataFrame:
    """One row per period and user of either source, with its events: only these are shuffled."""
    both = feature_events.select("created_at", "user_id").unionAll(transition_events.select("created_at", "user_id"))
    return both.filter("user_id is not null").groupBy(period.alias(name), "user_id").agg(n().alias("events"))


def dau(feature_events: DataFrame, transition_events: DataFrame) -> DataFrame:
    """Users of either source per day, and all their events: two levels, so a day's users are counted, not gathered."""
    by = _per_user(feature_events, transition_events, day("created_at"), "day")
    return by.groupBy("day").agg(n().alias("users"), F.sum("events").alias("events"))


def wau(feature_events: DataFrame, transition_events: DataFrame) -> DataFrame:
    by = _per_user(feature_events, transition_events, week("created_at"), "week")
    return by.groupBy("week").agg(n().alias("users"))


def feature_adoption_weekly(feature_events: DataFrame) -> DataFrame:
    return feature_events.groupBy(week("created_at").alias("week"), "feature_key").agg(
        n().alias("events"), F.countDistinct("user_id").alias("users")
    )


def user_activity(feature_events: DataFrame, dim_users: DataFrame) -> DataFrame:
    """Events are grouped before the join, so the dimension meets one row a user."""
    per_user = feature_events.filter("user_id is not null").groupBy("user_id").agg(
        n().alias("events"),
        F.countDistinct(day("created_at")).alias("active_days"),
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
    )
    users = dim_users.select(F.col("id").alias("user_id"), "display_name", "team")
    return per_user.join(users, "user_id", "left").select(
        "user_id", "display_name", "team", "events", "active_days", "first_seen", "last_seen"
    )


def top_paths(feature_events: DataFrame) -> DataFrame:
    return feature_events.filter("path is not null").groupBy("path").agg(
        n().alias("events"), F.countDistinct("user_id").alias("users"), F.countDistinct("session_id").alias("sessions")
    )


def venture_activity_daily(feature_events: DataFrame, agent_actions: DataFrame, dim_ventures: DataFrame) -> DataFrame:
    names = dim_ventures.select(F.col("id").alias("venture_id"), F.col("name").alias("venture"))

    def one(df: DataFrame, source: str) -> DataFrame:
        grouped = df.filter("venture_id is not null").groupBy(day("created_at").alias("day"), "venture_id").agg(n().alias("events"))
        return grouped.join(names, "venture_id", "left").select("day", "venture_id", "venture", F.lit(source).alias("source"), "events")

    return one(feature_events, "feature").unionByName(one(agent_actions, "agent"))


def venture_totals(dim_ventures: DataFrame, feature_events: DataFrame, agent_actions: DataFrame) -> DataFrame:
    """Every venture, also without activity; last seen is 1970 then."""

    def one(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("venture_id").agg(n().alias(name), F.max("created_at").alias(f"{name}_last"))

    zero = F.lit(EPOCH).cast("timestamp_ntz")
    return (
        dim_ventures.withColumnRenamed("id", "venture_id")
        .join(one(feature_events, "features"), "venture_id", "left")
        .join(one(agent_actions, "actions"), "venture_id", "left")
        .select(
            "venture_id",
            "name",
            F.coalesce("features", F.lit(0)).cast("long").alias("feature_events"),
            F.coalesce("actions", F.lit(0)).cast("long").alias("agent_actions"),
            F.greatest(F.coalesce("features_last", zero), F.coalesce("actions_last", zero)).alias("last_seen"),
        )
    )


def commits_repo_weekly(commits: DataFrame) -> DataFrame:
    return commits.groupBy(week("day").alias("week"), "org_slug", "repo_full_name").agg(
        n().alias("commits"),
        F.countDistinct("author_login").alias("authors"),
        F.sum("additions").alias("additions"),
        F.sum("deletions").alias("deletions"),
    )


def commits_author_daily(commits: DataFrame) -> DataFrame:
    return commits.groupBy("day", "author_login").agg(
        n().alias("commits"),
        F.countDistinct("repo_full_name").alias("repos"),
        F.sum("additions").alias("additions"),
        F.sum("deletions").alias("deletions"),
    )


def commit_hour_heatmap(commits: DataFrame) -> DataFrame:
    return commits.groupBy(sunday_first("day").alias("dow"), F.col("commit_hour").alias("hour")).agg(n().alias("commits"))


def pr_throughput_weekly(pulls: DataFrame) -> DataFrame:
    """Medians are exact and interpolated; minutes count boundaries crossed."""
    review = boundary_minutes(F.col("created_at"), F.col("first_review_at"))
    merge = boundary_minutes(F.col("created_at"), F.col("merged_at"))
    return pulls.groupBy(week("created_at").alias("week"), "repo_full_name").agg(
        n().alias("opened"),
        F.count("merged_at").alias("merged"),
        F.count("first_review_at").alias("reviewed"),
        F.percentile(review, 0.5).alias("median_review_minutes"),
        F.percentile(merge, 0.5).alias("median_merge_minutes"),
    )


def claude_daily(claude: DataFrame) -> DataFrame:
    return claude.groupBy(day("created_at").alias("day"), "actor_kind", "event_type").agg(
        n().alias("events"),
        F.countDistinct(F.coalesce(F.col("user_id").cast("string"), "agent_id")).alias("actors"),
        F.countDistinct("session_id").alias("sessions"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        F.sum(F.coalesce("total_tokens", F.lit(0))).alias("total_tokens"),
    )


def claude_by_actor(claude: DataFrame, dim_users: DataFrame) -> DataFrame:
    users = dim_users.select(F.col("id").alias("user_id"), "display_name")
    named = claude.join(users, "user_id", "left")
    return named.groupBy("actor_kind", F.coalesce("display_name", "agent_id").alias("actor")).agg(
        n().alias("events"),
        F.countDistinct("session_id").alias("sessions"),
        F.countDistinct(day("created_at")).alias("active_days"),
        F.sum(F.coalesce("total_tokens", F.lit(0))).alias("total_tokens"),
    )


def claude_sessions(claude: DataFrame) -> DataFrame:
    """cwd is the smallest of the session, as any one would not be reproducible."""
    by = claude.filter("session_id is not null").groupBy("session_id").agg(
        F.min("created_at").alias("started"),
        F.max("created_at").alias("ended"),
        n().alias("events"),
        F.sum(F.coalesce("total_tokens", F.lit(0))).alias("total_tokens"),
        F.min("cwd").alias("cwd"),
    )
    return by.withColumn("duration_min", boundary_minutes(F.col("started"), F.col("ended")))


def agent_actions_daily(agent_actions: DataFrame, dim_ventures: DataFrame) -> DataFrame:
    keys = [day("created_at").alias("day"), "agent_id", "trigger_kind", "kind", "venture_id"]
    names = dim_ventures.select(F.col("id").alias("venture_id"), F.col("name").alias("venture"))
    return agent_actions.groupBy(*keys).agg(n().alias("actions")).join(names, "venture_id", "left").drop("venture_id")


def issue_activity_daily(issue_activity: DataFrame) -> DataFrame:
    return issue_activity.groupBy(day("created_at").alias("day"), "action", "actor_kind").agg(
        n().alias("events"), F.countDistinct("issue_id").alias("issues")
    )


def notifications_daily(notifications: DataFrame) -> DataFrame:
    read = F.count("read_at")
    return notifications.groupBy(day("created_at").alias("day"), "kind").agg(
        n().alias("sent"), read.alias("read"), F.round(100.0 * read / F.nullif(n(), F.lit(0)), 1).alias("read_pct")
    )


def top_repos(commits: DataFrame, days: int = 30, k: int = 5) -> DataFrame:
    """Repositories by commits in the last days up to the newest commit."""
    newest = commits.agg(F.max("day")).scalar()
    recent = commits.filter(F.col("day") > F.date_sub(newest, days))
    return recent.groupBy("repo_full_name").agg(n().alias("commits")).orderBy(F.desc("commits"), "repo_full_name").limit(k)


def dau_last(feature_events: DataFrame, transition_events: DataFrame, days: int = 14) -> DataFrame:
    """The days up to the newest day with an event; older events are cut before they are counted."""
    newest = feature_events.select("created_at").unionAll(transition_events.select("created_at")).agg(day(F.max("created_at"))).scalar()
    recent = F.col("created_at") > F.date_sub(newest, days - 1).cast("timestamp_ntz") - F.expr("interval 1 microsecond")
    return dau(feature_events.filter(recent), transition_events.filter(recent)).orderBy(F.desc("day")).limit(days)


def feature_this_vs_earlier(feature_events: DataFrame, days: int = 14) -> DataFrame:
    """Events of each feature in the newest days and before."""
    newest = feature_events.agg(day(F.max("created_at"))).scalar()
    dated = feature_events.select("feature_key", (day("created_at") > F.date_sub(newest, days)).alias("late"))
    late = F.col("late")
    return dated.groupBy("feature_key").agg(F.count_if(late).alias("this_period"), F.count_if(~late).alias("earlier"))


def tokens_per_day(claude: DataFrame) -> DataFrame:
    return claude.groupBy(day("created_at").alias("day")).agg(
        F.sum(F.coalesce("total_tokens", F.lit(0))).alias("tokens"), n().alias("events")
    )


def top_ventures(dim_ventures: DataFrame, feature_events: DataFrame, agent_actions: DataFrame, k: int = 10) -> DataFrame:
    """Ventures by all their events and actions; one without any has 0."""
    both = feature_events.select("venture_id").unionAll(agent_actions.select("venture_id"))
    by = both.groupBy("venture_id").agg(n().alias("activity"))
    out = dim_ventures.select(F.col("id").alias("venture_id"), "name").join(by, "venture_id", "left")
    return out.select("name", F.coalesce("activity", F.lit(0)).cast("long").alias("activity")).orderBy(F.desc("activity"), "name").limit(k)
