"""Rollups as documents: a text per period and subject, ready to be remembered.

Each has source_ref, content, period, scope, valid_at, partial, importance and metadata.  valid_at is the end of the period's last day or
now, whichever is earlier, so that a period in progress is found by a recall up to now; its text says up to which day there are data.
The rows come from ``rollups``, which ranks and cuts lists before they are gathered; here each becomes one string.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_week_label, period_end
from ..functions.text import scaled, thousands
from . import rollups as ro
from .mappings import top_children

IMPORTANCE = 0.55


def _said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _count(name: str) -> Column:
    return thousands(F.col(name))


def week_phrase(start: Column) -> Column:
    """ISO week 2024-W03 (Monday 2024-01-15 to 2024-01-21)."""
    return _said("ISO week ", iso_week_label(start), " (Monday ", start, " to ", period_end(start, "week"), ")")


def documents(rows: DataFrame, kind: str, unit: str, subject: Column | None, scope: Column, content: Column, metrics: Sequence[str], newest: Column, now: dt.datetime) -> DataFrame:
    """Rows with a column named as their ``unit`` ('week', 'month'), the period's first day, as documents."""
    start = F.col(unit)
    label = iso_week_label(start) if unit == "week" else F.date_format(start, "yyyy-MM")
    end = period_end(start, unit)
    partial = end > newest
    ref = F.concat_ws(":", F.lit(f"rollup:{kind}"), *([subject] if subject is not None else []), label)
    note = F.when(partial, _said(" (The period is not over: data up to ", newest, ".)")).otherwise("")
    metadata = F.to_json(F.struct(F.lit("activity-rollup").alias("type"), F.lit(unit).alias("period"), scope.alias("scope"), *metrics), {"ignoreNullFields": "false"})
    return rows.select(
        ref.alias("source_ref"), F.concat(content, note).alias("content"), label.alias("period"), scope.alias("scope"),
        ro.clamp_valid_at(start, unit, now).alias("valid_at"), partial.alias("partial"), F.lit(IMPORTANCE).alias("importance"), metadata.alias("metadata"),
    )


def repo_weeks(commits: DataFrame, people: DataFrame, now: dt.datetime) -> DataFrame:
    net = F.col("additions") - F.col("deletions")
    content = _said(
        "In ", week_phrase(F.col("week")), " the repository ", F.col("repo_full_name"), " of ", F.col("org"), " had ", _count("commits"), " commits by ", F.col("logins"), " logins on ", F.col("days"),
        " days, +", _count("additions"), "/-", _count("deletions"), " lines (", thousands(net), " net). Most by: ", F.col("who"), ".",
    )
    rows, scope = ro.repo_week_details(commits, people), F.concat(F.lit("repo:"), "repo_full_name")
    return documents(rows, "commits", "week", F.col("repo_full_name"), scope, content, ["commits", "logins", "days"], commits.agg(F.max("day")).scalar(), now)


def _money(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 2))


ESTIMATED = " The cost is an estimate from token counts and list prices, as neither model nor price is recorded; use is known by person and not by project."


def productivity_weeks(commits: DataFrame, people: DataFrame, claude: DataFrame, user_people: DataFrame, now: dt.datetime) -> DataFrame:
    git = F.when(
        F.col("commits").isNull(), " No commits."
    ).otherwise(_said(" ", _count("commits"), " commits in ", F.col("repos"), " repositories on ", F.col("days"), " days, +", _count("additions"), "/-", _count("deletions"), " lines."))
    kinds = [x for k, label in (("input", "input"), ("output", "output"), ("cache_read", "read from cache"), ("cache_write", "written to cache")) for x in (", " if k != "input" else " (", scaled(F.col(k)), f" {label}")]
    ai = F.when(F.col("events").isNull(), " No AI use.").otherwise(
        _said(" ", _count("events"), " AI events in ", _count("sessions"), " sessions, ", scaled(F.col("tokens")), " tokens", *kinds, "), about ", _money(F.col("cost")), ".")
    )
    each = F.when(
        F.col("commits").isNotNull() & F.col("events").isNotNull(),
        _said(" Per commit: ", _money(F.col("cost") / F.col("commits")), " and ", thousands(F.floor(F.col("tokens") / F.col("commits"))), " tokens."),
    ).otherwise("")
    content = _said("Work of ", F.col("person"), " in ", week_phrase(F.col("week")), ":", git, ai, each, ESTIMATED)
    rows = ro.productivity_details(commits, people, claude, user_people)
    newest = commits.select("day").unionAll(claude.select(F.to_date("created_at"))).agg(F.max("day")).scalar()
    return documents(rows, "productivity", "week", F.col("person"), F.concat(F.lit("person:"), "person"), content, ["commits", "events"], newest, now)


def ai_spend_weeks(claude: DataFrame, now: dt.datetime) -> DataFrame:
    content = _said("AI use of all in ", week_phrase(F.col("week")), ": ", F.col("people"), " people, ", scaled(F.col("tokens")), " tokens, about ", _money(F.col("cost")), ".", ESTIMATED)
    newest = claude.agg(F.to_date(F.max("created_at"))).scalar()
    return documents(ro.ai_spend_weekly(claude), "ai-spend", "week", None, F.lit("studio"), content, ["people", "tokens"], newest, now)


def person_weeks(commits: DataFrame, people: DataFrame, now: dt.datetime) -> DataFrame:
    content = _said(
        "In ", week_phrase(F.col("week")), " ", F.col("person"), " made ", _count("commits"), " commits in ", F.col("repos"), " repositories, +", _count("additions"), "/-",
        _count("deletions"), " lines. Most in: ", F.col("top_repos"), ".",
    )
    scope = F.concat(F.lit("person:"), "person")
    return documents(ro.person_weekly(commits, people, dated=True), "person-commits", "week", F.col("person"), scope, content, ["commits", "repos"], commits.agg(F.max("day")).scalar(), now)


def ai_person_weeks(claude: DataFrame, user_people: DataFrame, now: dt.datetime) -> DataFrame:
    rows = ro.claude_person_weekly(claude).join(user_people.select("user_id", "person"), "user_id", "left")
    rows = rows.withColumn("who", F.coalesce("person", F.concat(F.lit("user:"), F.col("user_id").cast("string"))))
    content = _said(
        "In ", week_phrase(F.col("week")), " ", F.col("who"), " used the AI assistant for ", _count("events"), " events and ", scaled(F.col("tokens")), " tokens: rank ",
        F.col("rank"), " of ", F.col("of"), " users.",
    )
    newest = claude.agg(F.to_date(F.max("created_at"))).scalar()
    return documents(rows, "ai", "week", F.col("user_id").cast("string"), F.concat(F.lit("person:"), "who"), content, ["events", "tokens", "rank"], newest, now)


def studio_weeks(commits: DataFrame, people: DataFrame, claude: DataFrame, now: dt.datetime) -> DataFrame:
    ai = F.when(F.col("ai_events") > 0, _said(" AI events in the same week: ", _count("ai_events"), ".")).otherwise("")
    content = _said(
        "All engineering in ", week_phrase(F.col("week")), ": ", _count("commits"), " commits by ", F.col("people"), " people in ", F.col("repos"), " repositories. People: ",
        F.col("top_people"), ". Repositories: ", F.col("top_repos"), ". Organisations: ", F.col("top_orgs"), ".", ai,
    )
    rows = ro.studio_weekly(commits, people, claude)
    return documents(rows, "studio-commits", "week", None, F.lit("studio"), content, ["commits", "people"], commits.agg(F.max("day")).scalar(), now)


def leaderboards(commits: DataFrame, people: DataFrame, roster: DataFrame, now: dt.datetime) -> DataFrame:
    """One text a week, in English and Arabic: who has most commits, who least, and who of the roster none."""
    board, idle = ro.leaderboard_weekly(commits, people), ro.leaderboard_idle(commits, people, roster)

    def listed(place: str) -> Column:
        # At most five a week.
        items = F.array_sort(F.collect_list(F.when(F.col(place) <= 5, F.struct(place, _said(F.col("person"), " (", F.col("commits"), ")").alias("item")))))
        return F.array_join(F.transform(items, lambda x: x["item"]), ", ").alias(f"{place}_list")

    by = board.groupBy("week").agg(listed("best"), listed("least"), F.bool_or("is_last_week").alias("last"))
    rows = by.join(idle.select("week", "idle", F.col("people").alias("idle_people")), "week", "left")
    last = F.when(F.col("last"), " (last week)").otherwise("")
    none = F.coalesce(F.col("idle_people"), F.lit("-"))
    english = _said("Leaderboard of ", week_phrase(F.col("week")), last, ". Most commits: ", F.col("best_list"), ". Least: ", F.col("least_list"), ". No commits: ", none, ".")
    last_ar = F.when(F.col("last"), " (الأسبوع الأخير)").otherwise("")
    arabic = _said(" ترتيب الأعضاء في الأسبوع ", iso_week_label(F.col("week")), last_ar, ". الأكثر نشاطا: ", F.col("best_list"), ". الأقل نشاطا: ", F.col("least_list"), ". بلا نشاط: ", none, ".")
    return documents(rows, "leaderboard", "week", None, F.lit("studio"), F.concat(english, arabic), ["idle"], commits.agg(F.max("day")).scalar(), now)


def studio_ai_weeks(claude: DataFrame, now: dt.datetime) -> DataFrame:
    content = _said(
        "AI use in ", week_phrase(F.col("week")), ": ", _count("events"), " events by ", F.col("users"), " users, ", scaled(F.col("tokens")), " tokens. By events: ",
        F.col("top_by_events"), ". By tokens: ", F.col("top_by_tokens"), ".",
    )
    newest = claude.agg(F.to_date(F.max("created_at"))).scalar()
    return documents(ro.studio_claude_weekly(claude), "studio-ai", "week", None, F.lit("studio"), content, ["events", "users", "tokens"], newest, now)


def org_months(commits: DataFrame, people: DataFrame, now: dt.datetime) -> DataFrame:
    content = _said(
        "In ", F.date_format("month", "yyyy-MM"), " the organisation ", F.col("org_slug"), " had ", _count("commits"), " commits by ", F.col("logins"), " logins. Most by: ",
        F.col("top_people"), ".",
    )
    rows, scope = ro.org_monthly(commits, people), F.concat(F.lit("org:"), "org_slug")
    return documents(rows, "org-commits", "month", F.col("org_slug"), scope, content, ["commits", "logins"], commits.agg(F.max("day")).scalar(), now)


def studio_months(commits: DataFrame, pulls: DataFrame, claude: DataFrame, issues: DataFrame, now: dt.datetime) -> DataFrame:
    content = _said(
        "All work in ", F.date_format("month", "yyyy-MM"), ": ", _count("commits"), " commits, ", _count("pulls"), " pull requests (", _count("merged"), " merged), ",
        _count("ai_events"), " AI events, ", _count("issue_events"), " issue events.",
    )
    rows, newest = ro.studio_monthly(commits, pulls, claude, issues), commits.agg(F.max("day")).scalar()
    return documents(rows, "studio", "month", None, F.lit("studio"), content, ["commits", "pulls", "merged"], newest, now)


def coverage_report(commits: DataFrame, registry: DataFrame, now: dt.datetime, days: int = 90, k: int = 10) -> DataFrame:
    """One document: how many repositories with commits in the last days the registry (``repo``, case aside) lacks, and the k most active of them.

    Commits are counted by repository and author first, so one with a third of all commits is folded before it is moved.
    """
    newest = commits.agg(F.max("day")).scalar()
    recent = commits.filter((F.col("day") > F.date_sub(newest, days)) & (F.col("repo_full_name") != ""))
    by_author = recent.groupBy("repo_full_name", "author_login").agg(ro.n().alias("n"), F.max("day").alias("last"))
    active = by_author.groupBy("repo_full_name").agg(F.sum("n").alias("commits"), F.count("author_login").alias("authors"), F.max("last").alias("last"))
    known = registry.select(F.lower("repo").alias("_low")).distinct()
    missing = active.withColumn("_low", F.lower("repo_full_name")).join(known, "_low", "left_anti")
    line = _said(F.col("repo_full_name"), " (", _count("commits"), " commits by ", F.col("authors"), " people, last on ", F.col("last"), ")")
    order = F.struct(-F.col("commits"), F.col("repo_full_name"), line.alias("line"))
    first = missing.orderBy(F.desc("commits"), "repo_full_name").limit(k).agg(F.array_sort(F.collect_list(order)).alias("first"))  # at most k rows
    row = missing.agg(ro.n().alias("unindexed")).join(first)  # one row each
    span = _said(f"in the {days} days up to ", newest)
    gap = _said(
        _count("unindexed"), " repositories with commits ", span, " are not registered for indexing, so nothing can be said from their code. The most active: ",
        F.array_join(F.transform("first", lambda x: x["line"]), "; "), ".",
    )
    metadata = F.to_json(F.struct(F.lit("code-coverage").alias("type"), "unindexed", F.lit(days).alias("window_days")))
    return row.select(
        F.lit("code:index-coverage-gap").alias("source_ref"), F.when(F.col("unindexed") > 0, gap).otherwise(_said("All repositories with commits ", span, " are registered for indexing.")).alias("content"),
        F.lit(now).cast("timestamp_ntz").alias("valid_at"), metadata.alias("metadata"),
    )


def repository_overviews(files: DataFrame, docs: DataFrame, heads: DataFrame, *, opening: int = 700, languages: int = 8, folders: int = 14, largest: int = 12, listed: int = 12) -> DataFrame:
    """A document per repository of ``files`` (repo, path, language, bytes): languages, top folders, largest files, documents, how its README begins, and its head.

    ``docs`` has repo, path and content; READMEs are named first, then docs/, then the rest.  ``heads`` has repo, sha and date.
    Lists are cut by rank and READMEs to their opening before anything is gathered, so a repository of any size sends few rows a task.
    """
    top = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise("(root)")
    base = files.groupBy("repo").agg(ro.n().alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    by_language = files.groupBy("repo", "language").agg(ro.n().alias("n"))
    by_folder = files.groupBy("repo", top.alias("folder")).agg(ro.n().alias("n"))
    named = F.concat("path", F.lit(" ("), F.col("bytes").cast("string"), F.lit(" bytes)"))
    low = F.lower("path")
    is_readme = F.element_at(F.split(low, "/"), -1).startswith("readme")
    place = F.struct(F.when(is_readme, 0).when(low.startswith("docs/"), 1).otherwise(2), low, F.col("path"))
    ws = r"[ \t\n\r]+"
    tidy = F.regexp_replace(F.regexp_replace(F.coalesce("content", F.lit("")), rf"^{ws}|{ws}$", ""), r"\n{3,}", "\n\n")
    ordered = docs.select("repo", "path", place.alias("place"), F.when(is_readme, F.nullif(F.substring(tidy, 1, opening), F.lit(""))).alias("opening"))
    readme = ordered.groupBy("repo").agg(ro.n().alias("n_docs"), F.min_by("opening", F.when(F.col("opening").isNotNull(), F.col("place"))).alias("readme"))
    head = heads.groupBy("repo").agg(F.max_by(F.struct("sha", "date"), F.struct("date", "sha")).alias("head"))
    rows = base.join(ro.top_list(by_language, ["repo"], F.coalesce("language", F.lit("other")), "n", languages, "languages"), "repo", "left")
    rows = rows.join(ro.top_list(by_folder, ["repo"], "folder", "n", folders, "folders"), "repo", "left")
    rows = rows.join(top_children(files, "repo", [F.desc("bytes"), F.asc("path")], named, largest, "\n").withColumnRenamed("items", "largest"), "repo", "left")
    rows = rows.join(top_children(ordered, "repo", [F.asc("place")], F.col("path"), listed).withColumnRenamed("items", "documents"), "repo", "left")
    rows = rows.join(readme, "repo", "left").join(head, "repo", "left")
    content = F.concat_ws(
        "\n\n",
        _said(F.col("repo"), " has ", _count("files"), " files of code, ", scaled(F.col("bytes")), " bytes."),
        _said("Its head is ", F.substring("head.sha", 1, 9), " of ", F.col("head.date"), "."),
        _said("Languages (files): ", F.col("languages")), _said("Top folders (files): ", F.col("folders")), _said("Largest files:\n", F.col("largest")),
        F.concat(F.lit("Documents: "), F.col("documents"), F.when(F.col("n_docs") > listed, _said(" and ", F.col("n_docs") - listed, " more")).otherwise("")),
        _said("The README begins:\n", F.col("readme")),
    )
    metadata = F.to_json(F.struct(F.lit("repository-overview").alias("type"), "files", F.coalesce("n_docs", F.lit(0)).alias("documents")))
    return rows.select(F.concat(F.lit("code:"), "repo", F.lit(":overview")).alias("source_ref"), content.alias("content"), F.col("head.date").alias("valid_at"), metadata.alias("metadata"))
