"""Business tables folded to the grain of a question, as documents: (ref_id, event_time, content).

A thread per issue, post or chat, a history per venture, a catalogue per stage, one backlog.  Counts are aggregates; what is quoted is
ranked per group before it is gathered, so a group of any size sends a few rows a task.  ``named`` and ``said`` are those of
``entity_documents``, with its fields and tables.  A group without a key is left out; of equal times the smaller text comes first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_credential
from .entity_documents import VENTURE, named, said, user_link
from .mappings import CAPS, as_memories, top_children

Table = Callable[[str], DataFrame]
SUCCEEDED, FAILED = ("success", "succeeded", "ready"), ("failed", "error")


def _short(c: str, chars: int) -> Column:
    return F.substring(F.regexp_replace(c, r"\s+", " "), 1, chars)


def _listed(children: DataFrame, key: str, field: str, sentence: str, k: int, order: list[Column] = [], separator: str = ", ") -> DataFrame:  # noqa: B006
    """key, field: what the first k children of each group say."""
    line = said(children, sentence)
    told = children.filter(F.col(key).isNotNull() & line.isNotNull())
    return top_children(told, key, [*order, line], line, k, separator).withColumnRenamed("items", field)


def _distinct(children: DataFrame, key: str, field: str, sentence: str, k: int) -> DataFrame:
    line = said(children, sentence, optional=True)
    return _listed(children.select(key, line.alias("line")).filter("line is not null").distinct(), key, field, "{line}", k)


def latest(messages: DataFrame, key: str, sentence: str, k: int) -> DataFrame:
    """key, n, first_at, last_at, substance, body: the k newest messages of each group, the oldest of them first."""
    line = said(messages, sentence)
    at = messages.filter(F.col(key).isNotNull()).select(key, "created_at", F.length("body").alias("chars"), line.alias("line"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("created_at"), "line"))
    head = at.withColumn("rank", rank).filter(F.col("rank") <= k)
    lines = F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), "line")))
    return head.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.sum("chars").alias("substance"),
        F.array_join(F.transform(lines, lambda x: x["line"]), " | ").alias("discussion"),
    )


def _document(rows: DataFrame, ref: str, at: str, sentence: str, brand: str) -> DataFrame:
    return rows.select(F.col(ref).alias("ref_id"), F.col(at).alias("event_time"), F.concat(F.lit(brand), said(rows, sentence)).alias("content"))


def _keyed(rows: DataFrame, *lists: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with lists that are keyed by the first of their columns."""
    for more in lists:
        parent, *fields = more.columns
        more = more.select(F.col(parent).cast("string").alias("_parent"), *fields)
        rows = rows.drop(*fields).join(more, F.col(key).cast("string") == F.col("_parent"), "left").drop("_parent")
    return rows


def _who(kind: str, user: str, agent: str) -> Column:
    """The agent's name (or id) where an agent spoke, else the person's."""
    return F.when(F.col(kind) == "agent", F.coalesce("agent", F.col(agent).cast("string"))).otherwise(F.col(user))


def issue_threads(table: Table, brand: str = "", *, least: int = 40, k: int = 8) -> DataFrame:
    """Issues with comments of some length: the newest of them, how the status went, and linked issues."""
    comments = table("issue_comments").withColumn("body", F.col("body_md")).filter(F.length("body") >= least)
    comments = named(comments, user_link("person", "author_user_id") | {"agent": ("agents", "as_agent_id", "name")}, table)
    comments = comments.withColumns({"who": _who("author_kind", "person", "as_agent_id"), "body_short": _short("body", 500)})
    cap = CAPS["issue_threads"]
    history = _listed(table("issue_status_history"), "issue_id", "trail", "{from_status|new}->{to_status} ({@changed_at})", cap, [F.col("changed_at")])
    linked = named(table("issue_links"), {"other": ("issues", "to_issue_id", "number")}, table).filter("other is not null")
    links = _listed(linked, "from_issue_id", "links", "{type} #{other}", cap)
    rows = named(table("issues"), VENTURE | user_link("assignee", "assignee_id"), table)
    rows = _keyed(rows, latest(comments, "issue_id", "[{@created_at} {who|someone}] {body_short}", k), history, links).filter("n > 0")
    return _document(
        rows, "id", "last_at",
        "Issue discussion thread — Issue #{number}« in venture {venture}»: {title}. Issue status: {status|-}, type {type|-}, assignee {assignee|unassigned}. "
        "{n} substantive comment(s) from {@first_at} to {@last_at}.« Status lifecycle: {trail}.»« Linked issues: {links}.» Discussion: {discussion}", brand,
    )


def post_threads(table: Table, brand: str = "", *, k: int = 10) -> DataFrame:
    """Posts with comments: the newest of them."""
    comments = table("comments").withColumn("body", F.col("body_md")).filter("target_type = 'post' and body <> ''")
    comments = named(comments, user_link("person", "author_id"), table).withColumn("body_short", _short("body", 400))
    rows = named(table("posts"), VENTURE | user_link("author", "author_id"), table)
    rows = _keyed(rows, latest(comments, "target_id", "[{@created_at} {person,as_agent_id|someone}] {body_short}", k)).filter("n > 0")
    return _document(
        rows, "id", "last_at",
        'Post discussion — comments on the post "{title||(untitled)}" ({type|status} posted {@created_at}« by {author}»« in venture {venture}»): '
        "{n} comment(s) up to {@last_at}. {discussion}", brand,
    )


def chat_threads(table: Table, brand: str = "", *, k: int = 30, least: int = 120) -> DataFrame:
    """Team chats as transcripts: none of one person with another, no message with a credential, and only chats of some substance."""
    messages = table("chat_messages").filter((F.col("body") != "") & F.col("deleted_at").isNull() & ~has_credential(F.col("body")))
    messages = named(messages, user_link("person", "sender_id") | {"agent": ("agents", "sender_agent_id", "name")}, table)
    messages = messages.withColumns({"who": _who("sender_kind", "person", "sender_agent_id"), "body_short": _short("body", 400)})
    members = named(table("chat_members"), user_link("person", "user_id") | {"agent": ("agents", "member_agent_id", "name")}, table)
    rows = named(table("chats").filter("coalesce(scope, '') <> 'direct'"), VENTURE, table)
    told = latest(messages, "chat_id", "{who|someone}: {body_short}", k).filter(F.col("substance") >= least)
    rows = _keyed(rows, told, _distinct(members, "chat_id", "present", "{person,agent|unknown}", CAPS["chat_threads"])).filter("n > 0")
    return _document(
        rows, "id", "last_at",
        'Chat conversation ({scope|-}« — venture {venture}») titled "{title|(untitled)}": {n} message(s) from {@first_at} to {@last_at}. Participants: {present|unknown}. '
        "Transcript (original language preserved): {discussion}", brand,
    )


def pulse_anonymous(table: Table, brand: str = "", *, least: int = 20) -> DataFrame:
    """What was said without a name in a survey."""
    messages = table("pulse_anonymous_messages").filter(F.length("body") >= least).withColumn("body_short", _short("body", 700))
    told = _listed(messages, "campaign_id", "told", "{body_short}", CAPS["pulse_anonymous"], separator=" | ")
    counts = messages.filter("campaign_id is not null").groupBy("campaign_id").agg(F.count(F.lit(1)).alias("n"))
    rows = _keyed(table("pulse_campaigns"), counts, told).filter("n > 0")
    rows = rows.withColumn("at", F.coalesce("anonymous_revealed_at", "closes_at", "updated_at"))
    return _document(
        rows, "id", "at",
        'Team Pulse — ANONYMOUS messages from the team, survey "{title_en|(untitled)}"« / {title_ar}»«, revealed {@anonymous_revealed_at}» '
        "({n} message(s), names withheld, in the language they were written in): {told}", brand,
    )


def deployments(table: Table, brand: str = "", *, k: int = 12) -> DataFrame:
    """Per venture: how many deployments went well or failed, where to, and the newest."""
    events = table("venture_deployment_events").filter("venture_id is not null")
    events = events.withColumns({"sha_short": F.substring("sha", 1, 7), "message": _short("commit_message", 90)})
    rows = events.groupBy("venture_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
        F.count_if(F.col("status").isin(*SUCCEEDED)).alias("ok"), F.count_if(F.col("status").isin(*FAILED)).alias("failed"),
    )
    cap = CAPS["deployments"]
    recent = _listed(events, "venture_id", "recent", '{@created_at} {status|-} {sha_short}« "{message}"»« by {author}»', k, [F.desc("created_at")], " | ")
    seen = [_distinct(events, "venture_id", field, f"{{{c}}}", cap) for field, c in (("providers", "provider"), ("places", "env"))]
    rows = named(_keyed(rows, recent, *seen, key="venture_id"), VENTURE, table)
    return _document(
        rows, "venture_id", "last_at",
        "Deployment history — venture {venture,venture_id}: {n} deployment events between {@first_at} and {@last_at}. Succeeded: {ok}, failed: {failed}. "
        "Providers: {providers|-}. Environments: {places|-}. Recent deploys: {recent|-}", brand,
    )


def feature_catalog(table: Table, brand: str = "") -> DataFrame:
    """Per stage of their life, the features and the state of their flags."""
    flags = table("feature_flags").select(F.col("key").alias("flag_key"), "enabled", "kill_switch")
    features = table("feature_registry").drop("enabled", "kill_switch").join(flags, "flag_key", "left").withColumns({
        "stage": F.coalesce("lifecycle", F.lit("unspecified")), "touched": F.coalesce("updated_at", "created_at"), "about": _short("description", 220),
        "state": F.concat(F.when(F.col("enabled"), "ON").otherwise("OFF"), F.when(F.col("kill_switch"), ", KILL SWITCH ENGAGED").otherwise("")),
    })
    rows = features.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.max("touched").alias("last_at"))
    sentence = "{name}« / {name_ar}»« at route {route}»« [flag {flag_key} = {state}]»«: {about}»"
    told = _listed(features.filter("name is not null"), "stage", "told", sentence, CAPS["feature_catalog"], [F.col("name")], " | ")
    return _document(_keyed(rows, told, key="stage"), "stage", "last_at", "feature catalogue — {stage} features ({n} of them): {told}", brand)


def harvest_sources(table: Table, brand: str = "") -> DataFrame:
    """Per type, the sources that are watched."""
    sources = table("harvester_sources").filter("source_type is not null").withColumns({
        "touched": F.coalesce("updated_at", "created_at"), "tagged": F.nullif("tags", F.lit("")), "noted": _short("note", 150),
        "mark": F.when(F.col("confirmed"), " [confirmed]").otherwise(""),
    })
    rows = sources.groupBy("source_type").agg(F.count(F.lit(1)).alias("n"), F.max("touched").alias("last_at"))
    sentence = "{title,url||}« ({tagged})»« — {noted}»{mark}"
    told = _listed(sources, "source_type", "told", sentence, CAPS["harvest_sources"], [F.asc_nulls_last("title")], " | ")
    return _document(
        _keyed(rows, told, key="source_type"), "source_type", "last_at", "Harvester sources — {n} {source_type} source(s) of the harvest: {told}", brand
    )


def curator_backlog(table: Table, brand: str = "", *, k: int = 8) -> DataFrame:
    """One document: proposals by type and status, and the newest reasons."""
    proposals = table("curator_proposals").withColumn("all", F.lit("all"))
    rows = proposals.groupBy("all").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last_at"))
    counts = proposals.filter("proposal_type is not null and status is not null").groupBy("all", "proposal_type", "status").agg(F.count(F.lit(1)).alias("n"))
    cap = CAPS["curator_backlog"]
    kinds = _listed(counts, "all", "kinds", "{proposal_type}/{status}", cap)
    counted = _listed(counts, "all", "counted", "{proposal_type} {status} x{n}", cap)
    given = proposals.filter("reason <> ''").withColumn("because", _short("reason", 260))
    reasons = _listed(given, "all", "reasons", "{because}", k, [F.desc("created_at")], " | ")
    return _document(
        _keyed(rows, kinds, counted, reasons, key="all"), "all", "last_at",
        "Learnings curator backlog as of {@last_at}: {n} curator proposals — {kinds}. Counts: {counted}. Sample reasons the curator gave: {reasons|-}", brand,
    )


def playbook_progress(table: Table, brand: str = "") -> DataFrame:
    """One document: who has completed which steps, the furthest first.  ``completed_step_ids`` is an array."""
    done = named(table("playbook_completions"), user_link("person", "user_id"), table).withColumns({
        "all": F.lit("all"), "steps": F.coalesce(F.size(F.coalesce("completed_step_ids", F.array().cast("array<string>"))), F.lit(0)),
    })
    rows = done.groupBy("all").agg(F.count(F.lit(1)).alias("n"), F.max("updated_at").alias("last_at"))
    sentence = "{person|someone} completed {steps} step(s) ({completed_step_ids|none})"
    told = _listed(done, "all", "told", sentence, CAPS["playbook_progress"], [F.desc("steps")], " | ")
    return _document(
        _keyed(rows, told, key="all"), "all", "last_at", "Playbook (onboarding) progress as of {@last_at}: {n} people have progress recorded. {told}", brand
    )


def agent_activity(table: Table, brand: str = "", *, k: int = 25) -> DataFrame:
    """Per agent, venture (or none) and ISO week: actions by kind, runs, and what was done, each beginning of a summary once."""
    week = F.date_trunc("week", "created_at").cast("date")
    label = F.concat(F.extract(F.lit("YEAROFWEEK"), week).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(week).cast("string"), 2, "0"))
    digest = F.concat_ws("|", F.col("agent_id").cast("string"), F.coalesce(F.col("venture_id").cast("string"), F.lit("none")), label).alias("digest")
    acts = table("agent_actions").filter("agent_id is not null").select(digest, week.alias("week"), "agent_id", "venture_id", "kind", "summary", "created_at")
    counts = acts.groupBy("digest", "week", "agent_id", "venture_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last_at"))
    rows = counts.groupBy("digest", "week", "agent_id", "venture_id").agg(F.sum("n").alias("n"), F.max("last_at").alias("last_at"))
    cap = CAPS["agent_activity"]
    breakdown = _listed(counts.filter("kind is not null"), "digest", "breakdown", "{kind} x{n}", cap, [F.desc("n")])
    newest = F.max(F.struct("created_at", "summary")).alias("m")
    said_once = acts.filter("summary <> ''").groupBy("digest", F.substring("summary", 1, 45).alias("start")).agg(newest).select("digest", "m.created_at", "m.summary")
    notable = _listed(said_once, "digest", "notable", "{summary}", k, [F.desc("created_at")], " | ")
    runs = table("agent_runs").filter("agent_id is not null").select(digest, "status").groupBy("digest").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "failed").alias("failed")
    )
    rows = named(_keyed(rows, breakdown, notable, runs, key="digest"), VENTURE | {"agent": ("agents", "agent_id", "name")}, table)
    rows = rows.withColumn("place", F.coalesce(F.concat(F.lit("venture "), "venture"), F.lit("the studio (no venture)")))
    return _document(
        rows, "digest", "last_at",
        "Agent activity digest — agent {agent,agent_id} on {place} for the week of {@week}: {n} recorded actions. Breakdown by kind: {breakdown}."
        "« {runs} agent run(s), {failed} failed.»« Newest first: {notable}»", brand,
    )


def github_pr_activity(table: Table, brand: str = "", *, authors: int = 8, k: int = 10) -> DataFrame:
    """Per repository: how many pull requests were merged, how long that took, by whom, and the newest."""
    pulls = table("github_pull_requests").filter("repo_full_name is not null")
    hours = lambda end: F.round(F.median((F.unix_timestamp(F.col(end).cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))) / 3600.0), 1)
    rows = pulls.groupBy("repo_full_name", "org_slug").agg(
        F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("newest_at"),
        F.max(F.greatest("created_at", "merged_at", "closed_at")).alias("last_at"), F.count("merged_at").alias("merged"),
        F.count_if(F.col("state") == "open").alias("open"), F.count_if(F.col("merged_at").isNull() & (F.col("state") != "open")).alias("dropped"),
        hours("first_review_at").cast("decimal(18,1)").alias("to_review"), hours("merged_at").cast("decimal(18,1)").alias("to_merge"),
    )
    by = pulls.filter("author_login is not null").groupBy("repo_full_name", "author_login").agg(F.count(F.lit(1)).alias("n"))
    who = _listed(by, "repo_full_name", "who", "{author_login} ({n})", authors, [F.desc("n")])
    ended = F.when(F.col("merged_at").isNotNull(), F.concat(F.lit("merged "), F.date_format("merged_at", "yyyy-MM-dd")))
    told = pulls.withColumn("ended", ended.otherwise(F.concat("state", F.lit(" since "), F.date_format("created_at", "yyyy-MM-dd"))))
    recent = _listed(told.filter("ended is not null"), "repo_full_name", "recent", "#{number} by {author_login|?} {ended}", k, [F.desc("created_at")])
    return _document(
        _keyed(rows, who, recent, key="repo_full_name"), "repo_full_name", "last_at",
        "GitHub pull-request activity — repository {repo_full_name} (org {org_slug|-}): {n} pull requests tracked between {@first_at} and {@newest_at}. Merged: {merged}, "
        "still open: {open}, closed without merging: {dropped}. Median hours to first review: {to_review|never reviewed}. Median hours open before merge: {to_merge|-}. "
        "Authors: {who|-}. Most recent pull requests: {recent|-}", brand,
    )


def pulse_surveys(table: Table, brand: str = "", *, least: int = 12, texts: int = 24, least_anonymous: int = 20) -> DataFrame:
    """Per survey with responses: its questions, the newest texts given, how often each choice was made, and what was said without a name."""
    cap, campaigns = CAPS["pulse_surveys"], table("pulse_campaigns")
    responses = table("pulse_responses").filter("campaign_id is not null").select(F.col("id").alias("response_id"), F.col("campaign_id").alias("response_to"), "submitted_at")
    questions = table("pulse_questions").filter("campaign_id is not null")
    asked = _listed(questions.filter("prompt_en is not null"), "campaign_id", "asked", "{prompt_en}« / {prompt_ar}»", cap, [F.col("sort_order")], "; ")
    counts = responses.groupBy("response_to").agg(F.count(F.lit(1)).alias("n"), F.max("submitted_at").alias("last_at"))
    answers = table("pulse_answers").select(
        "question_id", "response_id", F.get_json_object("value", "$.text").alias("text"),
        F.coalesce(F.get_json_object("value", "$.choice"), F.get_json_object("value", "$.value")).alias("choice"),
    ).join(questions.select(F.col("id").alias("question_id"), "campaign_id", "key"), "question_id")
    given = answers.filter(F.length("text") >= least).join(responses, "response_id").filter("campaign_id = response_to").withColumn("text_short", _short("text", 220))
    told = _listed(given.filter("key is not null"), "campaign_id", "told", "[{key}] {text_short}", texts, [F.desc("submitted_at")], " | ")
    chosen = answers.filter("choice is not null and key is not null").groupBy("campaign_id", "key", "choice").agg(F.count(F.lit(1)).alias("times"))
    made = _listed(chosen, "campaign_id", "made", "{key}: {choice} x{times}", cap, [F.col("key"), F.desc("times")])
    unsigned = table("pulse_anonymous_messages").filter(F.length("body") >= least_anonymous).withColumn("body_short", _short("body", 500))
    rows = _keyed(campaigns, counts, asked, told, made, _listed(unsigned, "campaign_id", "unsigned", "{body_short}", cap, separator=" | ")).filter("n > 0")
    rows = rows.withColumn("at", F.coalesce("anonymous_revealed_at", "last_at", "closes_at", "updated_at", "created_at"))
    return _document(
        rows, "id", "at",
        'Team Pulse survey "{title_en|(untitled)}"« / {title_ar}» — status {status|-}«, opened {@opens_at}»«, closes {@closes_at}». Responses: {n}. {intro_en} {intro_ar}'
        "« Questions asked: {asked}.»« Free-text answers from the team (verbatim): {told}»« Scale/choice results: {made}»"
        "« Anonymous messages to the company (verbatim): {unsigned}»", brand,
    )


DIGESTS = {f.__name__: f for f in (
    pulse_surveys,
    agent_activity, github_pr_activity,
    issue_threads, post_threads, chat_threads, pulse_anonymous, deployments, feature_catalog, harvest_sources, curator_backlog, playbook_progress,
)}


def digest_memories(table: Table, name: str, namespace: str, brand: str = "", **options) -> DataFrame:
    return as_memories(DIGESTS[name](table, brand, **options), name, namespace)
