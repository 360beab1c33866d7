"""Business entities as documents: (ref_id, event_time, content), and the choice of files worth indexing.

``MAPPINGS`` names the entities with their domain type, source kind, content cap and importance.
Their shapes are few, and each is a function here: a row joined with its dimensions, a row with a list
of its children, with its top few children, a grouped digest, and a survey's answers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeezed
from .rollups import top_list

CAP, IMPORTANCE = 1500, 0.6
# Entity, domain type, source kind; then caps and importances that differ from the defaults.
MAPPINGS = {
    name: (kind, source)
    for name, kind, source in (
        ("posts", "post", "post"), ("issues", "issue", "issue"), ("user_goals", "goal", "goal"), ("venture_goals", "goal", "goal"),
        ("learnings", "learning", "learning"), ("roadmaps", "roadmap", "roadmap"), ("releases", "release", "release"), ("people", "person", "person"),
        ("ventures", "venture", "venture"), ("portfolios", "portfolio", "portfolio"), ("decisions", "decision", "decision"), ("harvested", "harvested", "harvested"),
        ("agents", "agent", "agent"), ("marketing_campaigns", "marketing", "marketing"), ("marketing_content", "marketing", "marketing"),
        ("responsibilities", "responsibility", "management"), ("okr_snapshots", "okr", "management"), ("okr_targets", "okr", "management"),
        ("venture_metrics", "metric", "management"), ("budget", "budget", "management"), ("dependencies", "dependency", "management"),
        ("pipeline_deals", "pipeline", "pipeline"), ("pipeline_timeline", "pipeline", "pipeline"), ("lean_canvas", "canvas", "canvas"),
        ("calendar", "calendar-event", "calendar"), ("transcripts", "transcript", "transcript"), ("transcript_reports", "transcript", "transcript"),
        ("big_shift_levels", "transition", "bigshift"), ("big_shift_picks", "transition", "bigshift"), ("activity_scores", "activity-score", "analytics"),
        ("tasks", "task", "task"), ("nala_approvals", "approval", "nala"), ("session_topics", "session-topic", "session"), ("channels", "channel", "channel"),
        ("issue_threads", "issue-thread", "issue_thread"), ("agent_activity", "agent-activity", "agent_activity"), ("chat_threads", "chat-thread", "chat"),
        ("post_threads", "post-thread", "post_thread"), ("github_pr_activity", "pr-activity", "github_pr"), ("pulse_surveys", "pulse", "pulse"),
        ("pulse_anonymous", "pulse-anonymous", "pulse"), ("deployments", "deployment-history", "deployment"), ("feature_catalog", "feature-catalog", "feature"),
        ("harvest_sources", "harvest-sources", "harvested"), ("curator_backlog", "curator-backlog", "learning"), ("boards", "board", "board"),
        ("playbook_progress", "playbook-progress", "management"),
    )
}
CAPS = {
    "learnings": 2800, "issue_threads": 4800, "agent_activity": 4200, "chat_threads": 4200, "post_threads": 4200, "github_pr_activity": 2000, "pulse_surveys": 5200,
    "pulse_anonymous": 5200, "deployments": 2500, "feature_catalog": 5200, "harvest_sources": 4200, "curator_backlog": 2500, "boards": 2500, "playbook_progress": 2500,
}
IMPORTANCES = {
    "issue_threads": 0.45, "agent_activity": 0.4, "chat_threads": 0.5, "post_threads": 0.45, "github_pr_activity": 0.35, "pulse_surveys": 0.55, "pulse_anonymous": 0.6,
    "deployments": 0.4, "feature_catalog": 0.45, "harvest_sources": 0.4, "curator_backlog": 0.35, "boards": 0.5, "playbook_progress": 0.4,
}


def as_memories(documents: DataFrame, name: str, namespace: str) -> DataFrame:
    """(ref_id, event_time, content) rows as memories of a mapping: ref, type, kind, cap and importance set."""
    kind, source = MAPPINGS[name]
    return documents.select(
        F.concat(F.lit(f"db:{kind}:"), F.col("ref_id").cast("string")).alias("source_ref"),
        F.lit(namespace).alias("namespace"),
        F.lit(source).alias("source_kind"),
        F.lit(kind).alias("domain_raw"),
        F.col("event_time").alias("valid_at"),
        squeezed(F.col("content"), CAPS.get(name, CAP)).alias("content"),
        F.lit(IMPORTANCES.get(name, IMPORTANCE)).alias("importance"),
    )


def since(documents: DataFrame, watermark: Column) -> DataFrame:
    """The rows of any mapping after a watermark."""
    return documents.filter(F.col("event_time") > watermark)


def run_since(mappings: dict[str, Callable[[], DataFrame]], watermark: Column, write: Callable[[str, DataFrame], None]) -> tuple[dict[str, str], bool]:
    """Runs each mapping for the rows after a watermark and hands it to ``write``.

    One that fails does not stop the others; its error is returned, and the watermark may advance only if there is none.
    """
    errors = {}
    for name, build in mappings.items():
        try:
            write(name, since(build(), watermark))
        except Exception as e:  # any source may fail in its own way
            errors[name] = f"{type(e).__name__}: {e}".splitlines()[0]
    return errors, not errors


def with_dimension(rows: DataFrame, dimension: DataFrame, on: Sequence[str] | str, content: Column, ref: str, time: str) -> DataFrame:
    """A row and what its dimension says of it; a missing dimension must be coalesced in ``content``."""
    return rows.join(dimension, on, "left").select(F.col(ref).alias("ref_id"), F.col(time).alias("event_time"), content.alias("content"))


def children_list(children: DataFrame, key: str, label: Column, *, distinct: bool = False, separator: str = ", ") -> DataFrame:
    """key, items: all labels of a parent's children in order."""
    items = F.collect_set(label) if distinct else F.collect_list(label)
    return children.groupBy(key).agg(F.array_join(F.array_sort(items), separator).alias("items"))


def top_children(children: DataFrame, key: str, order: Sequence[Column], label: Column, k: int, separator: str = ", ") -> DataFrame:
    """key, items: the labels of a parent's first k children, in their order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    head = children.withColumn("_label", label).withColumn("_rank", rank).filter(F.col("_rank") <= k)
    listed = F.array_sort(F.collect_list(F.struct("_rank", "_label")))
    return head.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["_label"]), separator).alias("items"))


def deployment_digest(rows: DataFrame, key: str, who: str, failed: Column) -> DataFrame:
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(failed).alias("failed"),
        F.array_join(F.array_sort(F.collect_set(who)), ", ").alias("by"),
    )


def survey_digest(answers: DataFrame, *, least: int = 12, cap: int = 220, texts: int = 24) -> DataFrame:
    """Per survey: responses, the newest texts given, and how often each choice was made.

    answers: survey, key (of the question), value (JSON with ``text``, or ``choice`` or ``value``), at.  A text is quoted with its
    question if it is ``least`` characters long, cut to ``cap``; texts are ranked before they are gathered.
    """
    said = answers.select(
        "survey", "key", "at", F.get_json_object("value", "$.text").alias("text"),
        F.coalesce(F.get_json_object("value", "$.choice"), F.get_json_object("value", "$.value")).alias("choice"),
    )
    total = said.groupBy("survey").agg(F.count(F.lit(1)).alias("responses"))
    line = F.concat(F.lit("["), "key", F.lit("] "), F.substring(F.regexp_replace("text", r"\s+", " "), 1, cap))
    quoted = top_children(said.filter(F.length("text") >= least), "survey", [F.desc("at"), F.asc("key"), F.asc("text")], line, texts, " | ")
    made = said.filter("choice is not null").groupBy("survey", "key", "choice").agg(F.count(F.lit(1)).alias("n"))
    # Questions and their choices are few; what is gathered is one line a choice.
    listed = F.array_sort(F.collect_list(F.struct("key", (-F.col("n")).alias("o"), "choice")))
    item = lambda x: F.concat(x["key"], F.lit(": "), x["choice"], F.lit(" x"), (-x["o"]).cast("string"))
    choices = made.groupBy("survey").agg(F.array_join(F.transform(listed, item), ", ").alias("choices"))
    out = total.join(quoted.withColumnRenamed("items", "texts"), "survey", "left").join(choices, "survey", "left")
    content = F.concat(
        F.lit("Survey "), "survey", F.lit(". Responses: "), F.col("responses").cast("string"), F.lit("."),
        F.coalesce(F.concat(F.lit(" Free-text answers (verbatim): "), "texts"), F.lit("")), F.coalesce(F.concat(F.lit(" Choices: "), "choices"), F.lit("")),
    )
    return out.select("survey", "responses", content.alias("content"))


def document_files(files: DataFrame) -> DataFrame:
    """Markdown files of a useful size: READMEs first, then docs/, then the rest, by path."""
    low = F.lower("path")
    keep = F.col("path").rlike(r"\.mdx?$") & (F.col("bytes") <= 400_000) & (F.length(F.trim("content")) >= 120)
    place = F.when(low.contains("readme"), 0).when(low.startswith("docs/"), 1).otherwise(2)
    return files.filter(keep).select("path", place.alias("place"), "bytes").orderBy("place", low)


# What in a path makes a source file worth reading, or not; each group counts once.
BOOSTS = (
    (("readme.md",), 14), (("main.go", "index.ts", "index.js", "app.py", "server.ts", "server.js", "main.py", "app.tsx", "bootstrap"), 8),
    (("route", "router", "handler", "controller", "endpoint", "/api/"), 7), (("service", "usecase", "core/", "engine", "domain/", "repository"), 6),
    (("auth", "token", "session", "permission", "livekit", "webhook", "payment", "billing", "subscription", "queue", "worker", "cron", "agent"), 6),
    (("schema", "model", "migration", ".sql", "entity", "types.ts"), 5), (("config", "settings", "env", "docker-compose", "dockerfile", ".tf"), 4),
    (("hook", "store", "context", "provider", "middleware", "util", "helper"), 2),
    (("test", "spec", "mock", "stub", "example", "demo", "sample"), -8), (("component", "widget", "styles", "css", "icon", "svg"), -3), (("docs/", "doc/"), -1),
)
# Suffixes of files that are read, and what in a path or a name rules a file out.
SUFFIXES = (".go", ".ts", ".tsx", ".js", ".jsx", ".py", ".sql", ".md", ".yaml", ".yml", ".tf", ".php", ".vue")
SKIPPED_PATHS = (
    "node_modules/", "vendor/", "dist/", "build/", ".next/", "out/", "testdata/", "__pycache__/", ".venv/", "coverage/", "third_party/", "public/build/",
    "storage/framework/", "__snapshots__/", "bootstrap/cache/", ".github/workflows/", "locales/", "translations/", "lang/", "fixtures/", "seeders/", "assets/",
)
SKIPPED_NAMES = (
    ".min.", ".gen.", ".d.ts", "_test.go", ".test.ts", ".spec.ts", ".test.tsx", "-lock.json", "package-lock.json", "yarn.lock", "composer.lock",
    "pnpm-lock.yaml", "go.sum", "changelog.md", "license",
)


def _has_any(c: Column, parts: Sequence[str]) -> Column:
    return c.rlike("|".join(p.replace(".", r"\.") for p in parts))


def code_shortlist(files: DataFrame, *, per_dir: int = 3, limit: int = 14) -> DataFrame:
    """The files most worth reading: by what their path says, less depth, more if of a good size; few per folder."""
    low = F.lower("path")
    base = F.element_at(F.split(low, "/"), -1)
    keep = base.rlike("(?:" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + ")$") & F.col("bytes").between(250, 60_000)
    keep = keep & ~_has_any(low, SKIPPED_PATHS) & ~_has_any(base, SKIPPED_NAMES)
    score = F.lit(0.0)
    for parts, weight in BOOSTS:
        score = score + F.when(_has_any(low, parts), float(weight)).otherwise(0.0)
    depth = F.size(F.split("path", "/")) - 1
    score = F.round(score - 0.8 * depth + F.when(F.col("bytes").between(800, 25_000), 3.0).otherwise(0.0), 6)
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(".")
    rows = files.filter(keep).select("path", folder.alias("dir"), score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("score"), "path"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= per_dir).orderBy(F.desc("score"), "path").limit(limit).select("path", "score")


def repository_overview(files: DataFrame) -> DataFrame:
    """Per repository: files, files by language, the largest files."""
    language = files.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n"))
    counted = language.groupBy("repo").agg(F.sum("n").alias("files"))
    counted = counted.join(top_list(language, ["repo"], "language", "n", 50, "languages"), "repo")
    largest = top_children(files, "repo", [F.desc("bytes"), F.asc("path")], F.col("path"), 3)
    return counted.join(largest.withColumnRenamed("items", "largest"), "repo")
