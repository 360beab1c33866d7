"""Periodic rollups: weekly and monthly prose-ready rows, leaderboards, digests, derived edges.

Each rollup first groups the events by period and key; ranks, lists and joins then work on those
small groups.  Ordered lists have a total order, so texts are reproducible.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import boundary_minutes, day, iso_week_label, month, period_end, week
from ..functions.text import scaled, squeezed, thousands

WEEKS, TOP, FLOOR, AI_FLOOR = 16, 12, 3, 5
# Dollars per million tokens: input, output, cache read, cache write.
PRICES = {"input": 3.00, "output": 15.00, "cache_read": 0.30, "cache_write": 3.75}


def n() -> Column:
    """Rows of a group."""
    return F.count(F.lit(1))


def top_list(df: DataFrame, keys: Sequence[str], label: Column | str, value: str, k: int, name: str) -> DataFrame:
    """keys and 'X (3), Y (2)': each group's first k by value, then label.

    Ranks are cut before anything is gathered, so a group of any size sends k rows a task.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = df.select(*keys, label.alias("_label"), F.col(value).alias("_value"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_value"), "_label"))
    head = rows.withColumn("_rank", rank).filter(F.col("_rank") <= k)
    item = F.concat("_label", F.lit(" ("), F.col("_value").cast("string"), F.lit(")"))
    listed = F.array_sort(F.collect_list(F.struct("_rank", item.alias("item"))))
    return head.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["item"]), ", ").alias(name))


def last_weeks(df: DataFrame, time: str, weeks: int = WEEKS) -> DataFrame:
    """Rows of the last weeks up to the newest row's, with ``week``."""
    newest = df.agg(week(F.max(time))).scalar()
    return df.withColumn("week", week(time)).filter(F.col("week") >= F.date_sub(newest, 7 * (weeks - 1)))


def with_people(df: DataFrame, people: DataFrame, login: str) -> DataFrame:
    """Several logins of one person become that person; an unknown login stays itself."""
    names = people.select(F.col("login").alias(login), "person")
    return df.join(names, login, "left").withColumn("person", F.coalesce("person", login))


def _repo_weeks(commits: DataFrame, people: DataFrame, top: int, floor: int) -> DataFrame:
    small = last_weeks(commits, "day").groupBy("week", "repo_full_name", "author_login").agg(n().alias("commits"))
    people_of = with_people(small, people, "author_login").groupBy("week", "repo_full_name", "person").agg(F.sum("commits").alias("commits"))
    by_repo = people_of.groupBy("week", "repo_full_name").agg(F.sum("commits").alias("total"), n().alias("contributors"))
    rank = F.row_number().over(Window.partitionBy("week").orderBy(F.desc("total"), "repo_full_name"))
    kept = by_repo.withColumn("rank", rank).filter(F.col("rank") <= top).filter(F.col("total") >= floor)
    return kept.join(top_list(people_of, ["week", "repo_full_name"], "person", "commits", 5, "who"), ["week", "repo_full_name"])


def repo_weekly(commits: DataFrame, people: DataFrame, top: int = TOP, floor: int = FLOOR) -> DataFrame:
    """Per week the top repositories, of those the ones with enough commits: the cap comes first."""
    newest = commits.agg(F.max("day")).scalar()
    return _repo_weeks(commits, people, top, floor).select(
        F.concat_ws(":", F.lit("rollup:repo"), F.col("week").cast("string"), "repo_full_name").alias("source_ref"),
        iso_week_label(F.col("week")).alias("period"),
        "rank",
        F.col("total").alias("commits"),
        "contributors",
        F.format_string("%s had %d commits by %d people: %s", "repo_full_name", "total", "contributors", "who").alias("content"),
        period_end(F.col("week"), "week").alias("period_end"),
        (period_end(F.col("week"), "week") > newest).alias("partial"),
    )


def repo_week_details(commits: DataFrame, people: DataFrame, top: int = TOP, floor: int = FLOOR) -> DataFrame:
    """The repositories of ``repo_weekly`` with their organisation, logins, active days and lines."""
    kept = _repo_weeks(commits, people, top, floor).select("week", "repo_full_name", "rank", F.col("total").alias("commits"), "who")
    rows = last_weeks(commits, "day").groupBy("week", "repo_full_name").agg(
        F.min("org_slug").alias("org"), F.countDistinct("author_login").alias("logins"), F.countDistinct("day").alias("days"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions")
    )
    return kept.join(rows, ["week", "repo_full_name"])


def person_weekly(commits: DataFrame, people: DataFrame, top: int = TOP, floor: int = FLOOR, *, dated: bool = False) -> DataFrame:
    """Per week the people with most commits, their logins merged before they are ranked; with the week itself if ``dated``."""
    small = last_weeks(commits, "day").groupBy("week", "author_login", "repo_full_name").agg(
        n().alias("commits"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions")
    )
    named = with_people(small, people, "author_login")
    by_repo = named.groupBy("week", "person", "repo_full_name").agg(
        F.sum("commits").alias("commits"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions")
    )
    by = by_repo.groupBy("week", "person").agg(
        F.sum("commits").alias("total"), n().alias("repos"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions")
    )
    rank = F.row_number().over(Window.partitionBy("week").orderBy(F.desc("total"), "person"))
    kept = by.withColumn("rank", rank).filter(F.col("rank") <= top).filter(F.col("total") >= floor)
    kept = kept.join(top_list(by_repo, ["week", "person"], "repo_full_name", "commits", 3, "top_repos"), ["week", "person"])
    return kept.select(
        *(["week"] if dated else []), iso_week_label(F.col("week")).alias("period"), "person", "rank", F.col("total").alias("commits"), "repos", "additions", "deletions", "top_repos"
    )


def claude_person_weekly(claude: DataFrame, floor: int = AI_FLOOR) -> DataFrame:
    """Ranks are over all users of the week; only those with enough events come out."""
    by = last_weeks(claude, "created_at").groupBy("week", "user_id").agg(n().alias("events"), F.sum("total_tokens").alias("tokens"))
    w = Window.partitionBy("week")
    out = by.withColumn("rank", F.row_number().over(w.orderBy(F.desc("events"), "user_id"))).withColumn("of", n().over(w))
    return out.filter(F.col("events") >= floor).select("week", "user_id", "events", "tokens", "rank", "of")


def studio_weekly(commits: DataFrame, people: DataFrame, claude: DataFrame) -> DataFrame:
    """All engineering of a week in one row, with the AI use of the same week."""
    small = last_weeks(commits, "day").groupBy("week", "author_login", "repo_full_name", "org_slug").agg(n().alias("commits"))
    named = with_people(small, people, "author_login")
    total = named.groupBy("week").agg(
        F.sum("commits").alias("commits"), F.countDistinct("person").alias("people"), F.countDistinct("repo_full_name").alias("repos")
    )

    def top(key: str, k: int, name: str) -> DataFrame:
        by = named.groupBy("week", key).agg(F.sum("commits").alias("c"))
        return top_list(by, ["week"], key, "c", k, name)

    ai = claude.groupBy(week("created_at").alias("week")).agg(n().alias("ai_events"))
    out = total.join(top("person", 5, "top_people"), "week").join(top("repo_full_name", 5, "top_repos"), "week")
    out = out.join(top("org_slug", 4, "top_orgs"), "week").join(ai, "week", "left")
    return out.withColumn("ai_events", F.coalesce("ai_events", F.lit(0)).cast("long"))


def _person_weeks(commits: DataFrame, people: DataFrame) -> DataFrame:
    small = last_weeks(commits, "day").groupBy("week", "author_login").agg(n().alias("commits"))
    return with_people(small, people, "author_login").groupBy("week", "person").agg(F.sum("commits").alias("commits"))


def leaderboard_weekly(commits: DataFrame, people: DataFrame, k: int = 5) -> DataFrame:
    """The k with most and the k with least commits of each week; only the newest week is 'last week'."""
    by = _person_weeks(commits, people)
    best = F.row_number().over(Window.partitionBy("week").orderBy(F.desc("commits"), "person"))
    least = F.row_number().over(Window.partitionBy("week").orderBy("commits", "person"))
    ranked = by.withColumn("best", best).withColumn("least", least)
    newest = by.agg(F.max("week")).scalar()
    out = ranked.filter((F.col("best") <= k) | (F.col("least") <= k))
    return out.select("week", "person", "commits", "best", "least", (F.col("week") == newest).alias("is_last_week"))


def leaderboard_idle(commits: DataFrame, people: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """People of the roster (``person``; by default those with a login) without a commit, week by week."""
    by = _person_weeks(commits, people)
    # Weeks x roster: both are bounded by the report (16 weeks) and the organisation.
    roster = (people if roster is None else roster).select("person").distinct()
    weeks = F.collect_set("week")
    all_weeks = by.agg(F.array_sort(weeks)).scalar()
    grid = roster.withColumn("week", F.explode(all_weeks))
    return grid.join(by, ["week", "person"], "left_anti").groupBy("week").agg(
        n().alias("idle"), F.array_join(F.array_sort(F.collect_list("person")), ", ").alias("people")
    )


def studio_claude_weekly(claude: DataFrame) -> DataFrame:
    by = last_weeks(claude, "created_at").groupBy("week", "user_id").agg(n().alias("events"), F.sum("total_tokens").alias("tokens"))
    user = F.col("user_id").cast("string")
    total = by.groupBy("week").agg(F.sum("events").alias("events"), n().alias("users"), F.sum("tokens").alias("tokens"))
    out = total.join(top_list(by, ["week"], user, "events", 5, "top_by_events"), "week")
    return out.join(top_list(by, ["week"], user, "tokens", 3, "top_by_tokens"), "week")


def org_monthly(commits: DataFrame, people: DataFrame, top: int = TOP) -> DataFrame:
    """Per organisation and month.  The top logins are taken before they are merged to people, so
    someone with several logins may be undercounted: that is the rule."""
    by = commits.groupBy(month("day").alias("month"), "org_slug", "author_login").agg(n().alias("commits"))
    total = by.groupBy("month", "org_slug").agg(F.sum("commits").alias("commits"), n().alias("logins"))
    rank = F.row_number().over(Window.partitionBy("month", "org_slug").orderBy(F.desc("commits"), "author_login"))
    head = with_people(by.withColumn("rank", rank).filter(F.col("rank") <= top), people, "author_login")
    merged = head.groupBy("month", "org_slug", "person").agg(F.sum("commits").alias("commits"))
    who = top_list(merged, ["month", "org_slug"], "person", "commits", 5, "top_people")
    return total.join(who, ["month", "org_slug"])


def studio_monthly(commits: DataFrame, pulls: DataFrame, claude: DataFrame, issues: DataFrame) -> DataFrame:
    """Commits, pull requests, AI use and issue activity of each month, side by side."""
    c = commits.groupBy(month("day").alias("month")).agg(n().alias("commits"))
    p = pulls.groupBy(month("created_at").alias("month")).agg(n().alias("pulls"), F.count("merged_at").alias("merged"))
    a = claude.groupBy(month("created_at").alias("month")).agg(n().alias("ai_events"))
    i = issues.groupBy(month("created_at").alias("month")).agg(n().alias("issue_events"))
    out = c.join(p, "month", "full_outer").join(a, "month", "full_outer").join(i, "month", "full_outer")
    return out.select("month", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("commits", "pulls", "merged", "ai_events", "issue_events")])


def cost(tokens: dict[str, Column], prices: dict[str, float] = PRICES) -> Column:
    total = F.lit(0.0)
    for kind, count in tokens.items():
        total = total + count * prices[kind]
    return total / 1e6


def productivity_person_week(commits: DataFrame, people: DataFrame, claude: DataFrame, user_people: DataFrame) -> DataFrame:
    """Git and AI work per person and week; either side may be missing.  A user that ``user_people`` (user_id, person) lacks
    is a person of their own, 'user:<id>'."""
    git = with_people(commits.groupBy(week("day").alias("week"), "author_login").agg(n().alias("commits"), F.sum("additions").alias("additions")), people, "author_login")
    git = git.groupBy("week", "person").agg(F.sum("commits").alias("commits"), F.sum("additions").alias("additions"))
    kinds = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_tokens", "cache_write": "cache_creation_tokens"}
    by_user = claude.groupBy(week("created_at").alias("week"), "user_id").agg(n().alias("ai_events"), *[F.sum(c).alias(c) for c in kinds.values()])
    known = by_user.join(user_people.select("user_id", "person"), "user_id", "left")
    ai = known.groupBy("week", F.coalesce("person", F.concat(F.lit("user:"), F.col("user_id").cast("string"))).alias("person")).agg(
        F.sum("ai_events").alias("ai_events"), F.round(cost({k: F.sum(c) for k, c in kinds.items()}), 4).alias("cost")
    )
    out = git.join(ai, ["week", "person"], "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("week", "person", zero("commits"), zero("additions"), zero("ai_events"), F.coalesce("cost", F.lit(0.0)).alias("cost"))


def productivity_details(commits: DataFrame, people: DataFrame, claude: DataFrame, user_people: DataFrame) -> DataFrame:
    """Git and AI work per person and week as two halves, either of which may be null: with repositories and active days, sessions, tokens by kind, and their cost."""
    small = commits.groupBy(week("day").alias("week"), "author_login", "repo_full_name", "day").agg(n().alias("commits"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    git = with_people(small, people, "author_login").groupBy("week", "person").agg(
        F.sum("commits").alias("commits"), F.countDistinct("repo_full_name").alias("repos"), F.countDistinct("day").alias("days"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions")
    )
    kinds = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_tokens", "cache_write": "cache_creation_tokens"}
    by_session = claude.filter("user_id is not null").groupBy(week("created_at").alias("week"), "user_id", "session_id").agg(
        n().alias("events"), *[F.sum(c).alias(k) for k, c in kinds.items()], F.sum("total_tokens").alias("tokens")
    )
    named = by_session.join(user_people.select("user_id", "person"), "user_id", "left").withColumn("person", F.coalesce("person", F.concat(F.lit("user:"), F.col("user_id").cast("string"))))
    ai = named.groupBy("week", "person").agg(
        F.sum("events").alias("events"), F.countDistinct("session_id").alias("sessions"), *[F.sum(k).alias(k) for k in kinds], F.sum("tokens").alias("tokens"), cost({k: F.sum(k) for k in kinds}).alias("cost")
    )
    return git.join(ai, ["week", "person"], "full_outer")


def used_ai_on_facts(claude: DataFrame, repos: DataFrame, user_people: DataFrame) -> DataFrame:
    """``used_ai_on`` per person, with tokens, the last day, and a sentence that says how few events name a folder: src, relation, dst, weight, tokens, last_day, fact."""
    unique = repos.groupBy(F.lower("repo").alias("base")).agg(F.countDistinct("repo").alias("k"), F.min("repo").alias("repo")).filter("k = 1").drop("k")
    base = F.lower(F.element_at(F.split(F.regexp_replace("cwd", r"[\\/]+$", ""), r"[\\/]"), -1))
    by = claude.filter("cwd is not null").groupBy("user_id", base.alias("base")).agg(n().alias("events"), F.sum(F.coalesce("total_tokens", F.lit(0))).alias("tokens"), F.to_date(F.max("created_at")).alias("last_day"))
    named = by.join(unique, "base").join(user_people.select("user_id", "person"), "user_id", "left")
    edges = named.groupBy(F.coalesce("person", F.concat(F.lit("user:"), F.col("user_id").cast("string"))).alias("src"), F.col("repo").alias("dst")).agg(
        F.sum("events").alias("weight"), F.sum("tokens").alias("tokens"), F.max("last_day").alias("last_day")
    )
    has = F.when(F.col("cwd").isNotNull(), F.to_date("created_at"))
    cover = claude.agg(n().alias("all"), F.count("cwd").alias("some"), F.min(has).alias("low"), F.max(has).alias("high"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    fact = text(
        F.col("src"), " worked in the folder of ", F.col("dst"), " in ", thousands(F.col("weight")), " AI events (", scaled(F.col("tokens")), " tokens), last on ", F.col("last_day"),
        ". A folder is known for ", thousands(F.col("some")), " of ", thousands(F.col("all")), " events (", F.format_number(100.0 * F.col("some") / F.col("all"), 1), "%), from ", F.col("low"), " to ",
        F.col("high"), ": a sign of use, no measure of it.",
    )
    return edges.join(F.broadcast(cover)).select("src", F.lit("USED_AI_ON").alias("relation"), "dst", "weight", "tokens", "last_day", fact.alias("fact"))  # one row


def ai_spend_weekly(claude: DataFrame) -> DataFrame:
    return claude.groupBy(week("created_at").alias("week")).agg(
        F.countDistinct("user_id").alias("people"),
        F.sum("total_tokens").alias("tokens"),
        F.round(
            cost({"input": F.sum("input_tokens"), "output": F.sum("output_tokens"), "cache_read": F.sum("cache_read_tokens"), "cache_write": F.sum("cache_creation_tokens")}), 4
        ).alias("cost"),
    )


def used_ai_on(claude: DataFrame, repos: DataFrame) -> DataFrame:
    """Person to repository by the working folder's last name, only where exactly one repository has it."""
    unique = repos.groupBy(F.lower("repo").alias("base")).agg(F.countDistinct("repo").alias("k"), F.min("repo").alias("repo")).filter("k = 1")
    base = F.lower(F.element_at(F.split("cwd", r"[\\/]"), -1))
    by = claude.filter("cwd is not null").groupBy("user_id", base.alias("base")).agg(n().alias("weight"), F.min("created_at").alias("since"))
    return by.join(unique, "base").select(F.col("user_id").alias("src"), F.lit("USED_AI_ON").alias("relation"), F.col("repo").alias("dst"), "weight", "since")


def _key(c: Column) -> Column:
    """A name's letters and digits, lower case."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def repo_links(repos: DataFrame, ventures: DataFrame, orgs: DataFrame) -> DataFrame:
    """Repositories ('org/name') with what they belong to, by the first rule that applies; without a rule no row.

    url: a venture's ``url`` names the repository.  org: its organisation belongs to one venture.  name: its name or the
    venture's id or name are the same letters and digits, four at least.  portfolio: its organisation's portfolio.
    ventures: id, name, url; orgs: org, venture_id, portfolio_id.  Of several ventures the smallest id is taken.
    """
    one = repos.select("repo").distinct().withColumn("low", F.lower("repo")).withColumn("org", F.split_part("low", F.lit("/"), F.lit(1)))
    one = one.withColumn("key", _key(F.substr("low", F.length("org") + 2)))
    path = F.regexp_extract("url", r"github\.com[:/]+([^/\s]+/[^/\s#?]+)", 1)
    by_url = ventures.select(F.regexp_replace(F.lower(path), r"\.git$", "").alias("low"), "id").filter("low <> ''").groupBy("low").agg(F.min("id").alias("by_url"))
    keys = ventures.select("id", F.explode(F.array(_key(F.col("id")), _key(F.col("name")))).alias("key")).filter("length(key) >= 4")
    by_name = keys.groupBy("key").agg(F.min("id").alias("by_name"))
    known = ventures.select(F.col("id").alias("venture_id"), F.lit(True).alias("known"))
    by_org = orgs.join(known, "venture_id", "left").groupBy(F.lower("org").alias("org")).agg(
        F.min(F.when(F.col("known"), F.col("venture_id"))).alias("by_org"), F.min("portfolio_id").alias("by_portfolio")
    )
    out = one.join(by_url, "low", "left").join(by_org, "org", "left").join(by_name, "key", "left")
    rules = ("by_url", "by_org", "by_name", "by_portfolio")
    rule = F.coalesce(*[F.when(F.col(r).isNotNull(), r[3:]) for r in rules])
    relation = F.when(rule == "portfolio", "REPO_IN").otherwise("REPO_OF")
    return out.select("repo", F.coalesce(*rules).alias("target"), relation.alias("relation"), rule.alias("rule")).filter("target is not null")


def pr_digest(pulls: DataFrame) -> DataFrame:
    """Per repository: counts, exact median hours, rounded to one digit, and how many were never reviewed."""
    hours = lambda end: boundary_minutes(F.col("created_at"), F.col(end)) / 60.0
    return pulls.groupBy("repo_full_name").agg(
        n().alias("opened"),
        F.count("merged_at").alias("merged"),
        F.count_if(F.col("first_review_at").isNull()).alias("never_reviewed"),
        F.round(F.percentile(hours("first_review_at"), 0.5), 1).alias("median_review_hours"),
        F.round(F.percentile(hours("merged_at"), 0.5), 1).alias("median_merge_hours"),
    )


def thread_digest(turns: DataFrame, k: int = 3, cap: int = 80) -> DataFrame:
    """The latest k turns of each thread, in their order, joined by a spaced pipe."""
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role")))
    kept = turns.withColumn("rank", newest).filter(F.col("rank") <= k)
    said = F.concat(F.col("role"), F.lit(": "), squeezed(F.coalesce("text", F.lit("")), cap))
    tail = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), said.alias("said")))).alias("all"))
    count = turns.groupBy("conv_id").agg(n().alias("turns"))
    return tail.join(count, "conv_id").select("conv_id", "turns", F.array_join(F.transform("all", lambda x: x["said"]), " | ").alias("content"))


def agent_week_digest(actions: DataFrame, k: int = 25) -> DataFrame:
    """Per agent, venture and week: actions by kind, and distinct summaries, newest first."""
    at = actions.withColumn("week", week("created_at")).withColumn("short", F.substring("summary", 1, 45))
    keys = ["agent_id", "venture_id", "week"]
    counts = at.groupBy(*keys).agg(n().alias("actions"), F.countDistinct("kind").alias("kinds"))
    latest = at.groupBy(*keys, "short").agg(F.max("created_at").alias("at"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("at"), "short"))
    head = latest.withColumn("rank", rank).filter(F.col("rank") <= k)
    text = head.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "short"))).alias("all"))
    # Actions without a venture have a digest, too: the keys are compared null-safe.
    text = text.select(*[F.col(k).alias(f"{k}_") for k in keys], "all")
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    return counts.join(text, same).select(*keys, "actions", "kinds", F.array_join(F.transform("all", lambda x: x["short"]), "; ").alias("content"))


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def changed_only(new: DataFrame, written: DataFrame) -> DataFrame:
    """Rows whose (source_ref, content hash) has not been written."""
    hashed = new.select("source_ref", content_hash(F.col("content")).alias("hash"))
    return hashed.join(written.select("source_ref", "hash"), ["source_ref", "hash"], "left_anti")


def stale_refs(live: DataFrame, seen: DataFrame) -> DataFrame:
    """Live rows whose source_ref this run has not seen."""
    return live.join(seen.select("source_ref"), "source_ref", "left_anti").select("id", "source_ref")


def coverage_gap(commits: DataFrame, registry: DataFrame, days: int = 90, k: int = 10) -> DataFrame:
    """Repositories with recent commits that the registry lacks."""
    newest = commits.agg(F.max("day")).scalar()
    active = commits.filter(F.col("day") > F.date_sub(newest, days)).groupBy("repo_full_name").agg(n().alias("commits"))
    known = registry.select(F.col("repo").alias("repo_full_name")).distinct()
    return active.join(known, "repo_full_name", "left_anti").orderBy(F.desc("commits"), "repo_full_name").limit(k)


def provenance(edges: DataFrame, sample: int = 8) -> DataFrame:
    """(src, dst, relation) with the records behind it: one is a link, several an aggregate with a sample.

    The sample is the smallest few refs; they are ranked per edge over its distinct refs, so no
    edge's records are gathered in one list.
    """
    keys = ["src", "dst", "relation"]
    # Dealt out before equal refs fold: most are unlike, and a table of a whole file's refs would fold none of them.
    refs = edges.select(*keys, "ref").repartition(*keys, "ref").distinct()
    count = refs.groupBy(*keys).agg(n().alias("records"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("ref"))
    few = refs.withColumn("rank", rank).filter(F.col("rank") <= sample).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("ref")), ",").alias("refs"))
    kind = F.when(F.col("records") == 1, "link").otherwise("aggregate")
    return count.join(few, keys).select(*keys, kind.alias("kind"), "records", "refs")


def episodes(memories: DataFrame) -> DataFrame:
    """The newest row of each source_ref, live before retired, with a label from its kind and first line."""
    order = F.struct(F.col("invalid_at").isNull().alias("live"), "valid_at", "id")
    best = memories.filter("source_ref is not null").groupBy("namespace", "source_ref").agg(
        F.max_by(F.struct("id", "source_kind", "content"), order).alias("m")
    )
    first_line = F.substring(F.split_part(F.col("m.content"), F.lit("\n"), F.lit(1)), 1, 90)
    label = F.concat(F.initcap(F.replace(F.coalesce("m.source_kind", F.lit("memory")), F.lit("-"), F.lit(" "))), F.lit(" · "), first_line)
    return best.select("namespace", "source_ref", F.col("m.id").alias("id"), label.alias("label"))


def clamp_valid_at(start: Column, unit: str, now: dt.datetime) -> Column:
    """The end of a period's last day, or now if that is earlier."""
    end = F.to_timestamp_ntz(F.concat(period_end(start, unit).cast("string"), F.lit(" 23:59:59")))
    return F.least(end, F.lit(now).cast("timestamp_ntz"))


def fk_edges(df: DataFrame, relation: str, src: Column, dst: Column, ref: Column) -> DataFrame:
    """Typed edges from a table's foreign keys."""
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), ref.alias("ref")).filter("src is not null and dst is not null")


def screened_threads(messages: DataFrame, *, least_chars: int = 120, latest: int = 30, cap: int = 400) -> DataFrame:
    """Team threads (thread, at, sender, body, scope) as transcripts: no private ones, no message with a
    credential in it, and only threads whose latest messages have some substance."""
    from ..functions.text import has_credential

    clean = messages.filter((F.coalesce("scope", F.lit("")) != "direct") & (F.coalesce("body", F.lit("")) != "") & ~has_credential(F.coalesce("body", F.lit(""))))
    rank = F.row_number().over(Window.partitionBy("thread").orderBy(F.desc("at"), "sender", "body"))
    kept = clean.withColumn("rank", rank).filter(F.col("rank") <= latest)
    line = F.concat(F.coalesce("sender", F.lit("someone")), F.lit(": "), F.substring(F.regexp_replace("body", r"\s+", " "), 1, cap))
    by = kept.groupBy("thread").agg(
        n().alias("messages"),
        F.sum(F.length("body")).alias("substance"),
        F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), line.alias("line")))).alias("all"),
    )
    text = F.array_join(F.transform("all", lambda x: x["line"]), " | ")
    return by.filter(F.col("substance") >= least_chars).select("thread", "messages", "substance", text.alias("content"))


def cwd_coverage(claude: DataFrame) -> DataFrame:
    """How many events name a working folder, in percent, and over which days."""
    return claude.agg(
        n().alias("events"), F.count("cwd").alias("with_cwd"), F.round(100.0 * F.count("cwd") / F.nullif(n(), F.lit(0)), 1).alias("share"),
        day(F.min("created_at")).alias("first_day"), day(F.max("created_at")).alias("last_day"),
    )


def commits_of_usernames(commits: DataFrame, people: DataFrame) -> DataFrame:
    """Commits per person, where people list their user names in an array; case doesn't matter."""
    names = people.select("person", F.explode("usernames").alias("name")).select("person", F.lower("name").alias("low"))
    by = commits.groupBy(F.lower("author_login").alias("low")).agg(n().alias("commits"))
    return by.join(names, "low").groupBy("person").agg(F.sum("commits").alias("commits"))
