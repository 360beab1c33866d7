"""Business entities as documents, one per row of their table: (ref_id, event_time, content).

An entity is declared by its table, the columns that say when it happened, the tables that give names to its keys, and the sentence that it
says.  A sentence is text with fields: ``{a,b|x}`` is the first of the columns a and b that is not null, else x (nothing if x
is left out), ``{a||x}`` counts an empty text as null, ``{@a}`` is a date, ``{#a}`` a time of day, ``{%a}`` both, and
``«...»`` is left out as a whole if a field in it is null.

Tables come from a function of their name.  A key without a row in its table counts as null.  Names are joined from the left without a hint.  What lists
its children (a person's ventures) ranks them first, and keeps as many as could show within the cap of its text, so a parent with any
number of children is a bounded row.  Rows with a null key column stay; their reference is null.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .mappings import CAP, CAPS, as_memories, top_children

DATES = {"@": "yyyy-MM-dd", "#": "HH:mm", "%": "yyyy-MM-dd HH:mm"}
_PIECE = re.compile(r"«(?P<maybe>.*?)»|\{(?P<date>[@#%]?)(?P<names>[\w,]+)(?P<bar>\|\|?)?(?P<other>[^}]*)\}")


class Entity(NamedTuple):
    """``times``: the first that is not null is the event time, ``at`` in the sentence.  ``links``: field -> (table, key, name column)."""

    table: str
    times: tuple[str, ...]
    says: str
    links: dict[str, tuple[str, str, str]] = {}
    keep: str | None = None
    ref: str = "id"


def pieces(sentence: str) -> Iterator[str | re.Match]:
    """The text between fields, and the fields."""
    at = 0
    for m in _PIECE.finditer(sentence):
        if m.start() > at:
            yield sentence[at : m.start()]
        yield m
        at = m.end()
    if at < len(sentence):
        yield sentence[at:]


def said(rows: DataFrame, sentence: str, optional: bool = False) -> Column:
    """The sentence as a column of ``rows``."""
    kinds = {f.name: f.dataType for f in rows.schema}

    def one(name: str, date: str, empty: bool) -> Column:
        c = F.col(name)
        text = F.date_format(c, DATES[date]) if date else F.array_join(c, ", ") if isinstance(kinds[name], ArrayType) else c.cast("string")
        return F.nullif(text, F.lit("")) if empty else text

    def column(piece: str | re.Match) -> Column:
        if isinstance(piece, str):
            return F.lit(piece)
        if piece["maybe"] is not None:
            return F.coalesce(said(rows, piece["maybe"], optional=True), F.lit(""))
        found = [one(n, piece["date"], piece["bar"] == "||") for n in piece["names"].split(",")]
        return F.coalesce(*found, *([] if optional and not piece["bar"] else [F.lit(piece["other"])]))

    return F.concat(*[column(p) for p in pieces(sentence)])


VENTURE = {"venture": ("ventures", "venture_id", "name")}


def user_link(field: str, key: str) -> dict[str, tuple[str, str, str]]:
    return {field: ("users", key, "display_name")}


# What each entity says, and which of its times count.
ENTITIES = {
    "posts": Entity(
        "posts", ("created_at",), "Post [{type|status}] on {@created_at} by {author|unknown}« in venture {venture}»: {title||(untitled)}. {body_md}",
        VENTURE | user_link("author", "author_id"),
    ),
    "issues": Entity(
        "issues", ("created_at",),
        "Issue #{number}« in venture {venture}» opened {@created_at}«, closed {@closed_at}»: {title}. Type: {type|-}. Status: {status|-}. Priority: {priority|-}. "
        "Area: {area|-}. Assignee: {assignee|unassigned}. {description}", VENTURE | user_link("assignee", "assignee_id"),
    ),
    "user_goals": Entity(
        "user_goals", ("set_at", "created_at"),
        "Goal (personal) of {user|unknown} set {@at}«, deadline {@deadline_at}»«, resolved {@resolved_at}»: {title}. Status: {status|-}. {resolution_note}",
        user_link("user", "user_id"),
    ),
    "venture_goals": Entity(
        "venture_goals", ("set_at", "created_at"),
        "Goal (venture {venture|?}) set {@at}«, deadline {@deadline_at}»«, resolved {@resolved_at}»: {title}. Status: {status|-}. {resolution_note}", VENTURE,
    ),
    "learnings": Entity(
        "issue_learnings", ("last_at", "created_at"),
        "Learning ({scope|general})« in venture {venture}» recorded {@created_at}: {title}. Status: {status|-}. Classification: {classification|-}. {body}"
        "« How this learning evolved: {trail}»", VENTURE,
    ),
    "roadmaps": Entity(
        "roadmaps", ("created_at",),
        "Roadmap ({cadence|-}) for venture {venture|?} period {@period_start|?} to {@period_end|?}, status {status|-}. Focus: {focus}. Blocked: {blocked|none}. "
        "Notes: {notes}", VENTURE,
    ),
    "releases": Entity("releases", ("created_at",), "Release {version|?} of venture {venture|?} on {@created_at}. Notes: {notes}", VENTURE),
    "people": Entity(
        "users", ("created_at",),
        "Person: {display_name,email} (slug: {slug|-}). Email: {email}. Position: {position||-}. Admin: {is_admin}. Account type: {account_type|-}. "
        "Joined {@created_at}«. GitHub: {github_usernames}»«. Offboarded {@offboarded_at}»«. Works on: {works_on}»«. Owns: {owned}»", keep="deleted_at is null",
    ),
    "ventures": Entity(
        "ventures", ("updated_at", "created_at"),
        "Venture: {name} (slug: {id}). Portfolio: {portfolio_title|(none)}. Stage: {stage|-}. Kind: {kind|-}. On-hold: {on_hold|false}. Created {@created_at}. "
        "Tagline: {tagline}. North star: {north_star}. {description}« Website: {website_url}»«. Team: {team}»«. Agents on this venture: {agents}»",
        {"portfolio": ("portfolios", "portfolio_id", "name")},
    ),
    "portfolios": Entity(
        "portfolios", ("created_at",),
        "Portfolio: {title_name}« (or {alias}: two names of one portfolio)». "
        "{description}. Ventures: {members|none}",
    ),
    "decisions": Entity(
        "venture_decisions", ("decided_at", "created_at"), "Decision for venture {venture|?} on {@at}: {title}. Context: {context}. Decision: {decision}", VENTURE
    ),
    "harvested": Entity(
        "harvester_items", ("created_at",),
        "Harvested research on {@created_at}: {title,url}. Why it matters: {why_it_matters}. Summary: {summary}. URL: {url}«. Submitted by {who}»",
        keep="status is null or status <> 'rejected'",
    ),
    "agents": Entity(
        "agents", ("updated_at",),
        "Domain-Expert Agent: {name}« / {name_ar}» (slug: {id}). Domain: {domain|-}. Position: {position|-}. Status: {status|-}. Model: {model|-}. Health: {health|-}. "
        "{headline} {description}",
    ),
    "marketing_campaigns": Entity(
        "marketing_campaigns", ("updated_at", "created_at"),
        "Marketing Campaign for venture {venture|?}: {name}. Channel: {channel|-}. Status: {status|-}. Budget: {budget|-}«. Runs {@starts_at} to {@ends_at}». "
        "Owner: {owner_name|-}. {notes}", VENTURE | user_link("owner_name", "owner_id"),
    ),
    "marketing_content": Entity(
        "marketing_content", ("updated_at", "created_at"),
        "Marketing Content for venture {venture|?}: {title}. Channel: {channel|-}. Status: {status|-}«. Publish {@publish_at}»«. URL: {url}». {notes}", VENTURE,
    ),
    "responsibilities": Entity(
        "venture_responsibilities", ("updated_at", "created_at"), "Management — responsibility in venture {venture|?}: {member,member_id} owns {owns|-}. {notes}",
        VENTURE | user_link("member", "member_id"),
    ),
    "okr_snapshots": Entity(
        "venture_okr_snapshots", ("period_end", "period_start", "now"),
        "OKR snapshot for venture {venture|?} ({period_kind|-} {period_label|-}, {@period_start|?} to {@period_end|?}): status {status|-}, RAG {rag|-}, confidence {confidence|-}, "
        "project {project_pct|-}%, new clients {new_clients|-}. What: {what_happened}. Blocker: {blocker|none}", VENTURE,
    ),
    "okr_targets": Entity(
        "venture_okr_targets", ("updated_at", "created_at"), "OKR target for venture {venture|?} quarter {quarter|-}: target clients {target_clients|-}", VENTURE
    ),
    "venture_metrics": Entity("venture_metrics", ("recorded_at", "created_at"), "Metric for venture {venture|?} on {@at}: {metric_key} = {value|-}", VENTURE),
    "budget": Entity(
        "venture_budget_entries", ("occurred_at", "created_at"), "Budget entry for venture {venture|?} on {@at}: {kind|-} {label} amount {amount|-}", VENTURE
    ),
    "dependencies": Entity(
        "venture_dependencies", ("created_at",), "Venture dependency: {source_venture|?} {relation|depends on} {target_venture|?}. {notes}",
        {"source_venture": ("ventures", "from_venture_id", "name"), "target_venture": ("ventures", "to_venture_id", "name")},
    ),
    "pipeline_deals": Entity(
        "bd_deals", ("won_at", "next_action_due_at", "now"),
        "BD Pipeline — venture {venture|?} is at stage {pipeline_stage|-}. Source: {source_category|-} / {source_detail|-}. Owner: {owner_name|-}. "
        "Next action: {next_action|-}« due {@next_action_due_at}»«. Won {@won_at}»«. Lost reason: {lost_reason}»", VENTURE | user_link("owner_name", "owner_user_id"),
        ref="venture_id",
    ),
    "pipeline_timeline": Entity(
        "bd_timeline", ("occurred_at", "created_at"), "BD timeline for venture {venture|?} on {@at} [{kind|note}] by {author|-}: {body}",
        VENTURE | user_link("author", "author_user_id"),
    ),
    "lean_canvas": Entity(
        "ventures", ("updated_at", "created_at"), "Lean Canvas for venture {name}: {lean_canvas}", keep="lean_canvas is not null and lean_canvas not in ('null', '{}')"
    ),
    "calendar": Entity(
        "calendar_events", ("start_at", "created_at"),
        "Calendar event on {%start_at}« to {#end_at}»« for venture {venture}»: {title|(untitled)}. Owner: {owner_name|-}«. Location: {location}». {description}"
        "«. Attendees: {attendees}»", VENTURE | user_link("owner_name", "owner_id"),
    ),
    "transcripts": Entity(
        "transcript_jobs", ("backend_created_at", "first_seen_at"),
        "Meeting transcript ({provider|-}) on {@backend_created_at|unknown date}: {title|(untitled)}. Status: {status|-}. Summary: {summary}", ref="job_id",
    ),
    "transcript_reports": Entity(
        "transcript_reports", ("backend_created_at", "fetched_at"),
        "Meeting transcript REPORT ({provider|-}) on {@backend_created_at|unknown date}: {title|(untitled)}. Summary: {summary} {report_md}", ref="job_id",
    ),
    "big_shift_levels": Entity(
        "transition_level_docs", ("published_at", "updated_at"), "Transition level {level_code} (status {status|-}): {body_md}", ref="level_code"
    ),
    "big_shift_picks": Entity(
        "transition_picks", ("updated_at", "created_at"), "Transition pick by {user|?} on {@at}: level {level_code|-}. Intent: {intent|-}", user_link("user", "user_id")
    ),
    "activity_scores": Entity(
        "activity_scores", ("computed_at",), "Analytics — activity score for {user|?} on {@computed_at}: {kind|-} = {score|-}. Reason: {reason}", user_link("user", "user_id")
    ),
    "tasks": Entity(
        "tasks", ("updated_at", "created_at"), "Task {human_id} raised {@raised_date|-}: {title}. Status: {status|-}. Owner: {owner_name,owner|-}. {note}",
        user_link("owner_name", "owner_user_id"),
    ),
    "nala_approvals": Entity(
        "nala_approvals", ("decided_at", "created_at"),
        "Approval for venture {venture|?} on {@at} [{kind|-}] status {status|-}: {summary}. Recommendation: {recommendation}", VENTURE,
    ),
    "session_topics": Entity(
        "session_topics", ("updated_at", "created_at"), "Session topic ({category|-}) proposed by {author|?} on {@created_at}: {title}. {description}",
        user_link("author", "author_user_id"),
    ),
    "channels": Entity(
        "channels", ("updated_at", "created_at"), "Channel #{slug,name} ({type|-})« for venture {venture}»: {name}. {description}", VENTURE, keep="archived_at is null"
    ),
    "boards": Entity(
        "boards", ("updated_at", "created_at"),
        'Board "{name}"« / {name_ar}» (key {key}, task prefix {task_prefix|-}, visibility {visibility|-}«, sourced from {source}»«, registry year {registry_year}»): '
        "{description} {description_ar}",
    ),
}


def named(rows: DataFrame, links: dict[str, tuple[str, str, str]], table: Callable[[str], DataFrame]) -> DataFrame:
    """``rows`` and, for each link, the name that its key has in another table."""
    for field, (other, key, name) in links.items():
        names = table(other).select(F.col("id").cast("string").alias(f"_{field}"), F.col(name).alias(field))
        rows = rows.drop(field).join(names, F.col(key).cast("string") == F.col(f"_{field}"), "left").drop(f"_{field}")
    return rows


def _line_up(children: DataFrame, key: str, order: Sequence[Column], sentence: str, cap: int, field: str, separator: str = ", ") -> DataFrame:
    """_parent, field: what a parent's first children say."""
    line = said(children, sentence)
    told = top_children(children.filter(line.isNotNull()), key, [*order, line], line, cap, separator)
    return told.select(F.col(key).cast("string").alias("_parent"), F.col("items").alias(field))


def _learning_lists(table: Callable[[str], DataFrame], cap: int) -> list[DataFrame]:
    events = named(table("learning_events"), user_link("actor", "actor_user_id"), table)
    trail = _line_up(
        events, "learning_id", [F.col("created_at")], "{@created_at} {event_type}« by {actor,actor_agent_id,actor_type}»« — {reason}»", cap, "trail", "; "
    )
    last = events.groupBy("learning_id").agg(F.max("created_at").alias("last_at"))
    return [trail, last.select(F.col("learning_id").cast("string").alias("_parent"), "last_at")]


def _member_lists(parent: str, kinds: dict[str, tuple[str, str, dict, str | None]]) -> Callable[[Callable, int], list[DataFrame]]:
    """Lists over a venture's members; those of role cofounder come first."""

    def build(table: Callable[[str], DataFrame], cap: int) -> list[DataFrame]:
        lists = []
        for field, (source, sentence, links, keep) in kinds.items():
            rows = table(source).filter(keep) if keep else table(source)
            rows = named(rows, links, table)
            order = ([F.coalesce(F.col("role") == "cofounder", F.lit(False)).desc()] if "{role}" in sentence else []) + [F.col(next(iter(links)))]
            lists.append(_line_up(rows.filter(F.col(next(iter(links))).isNotNull()), parent, order, sentence, cap, field))
        return lists

    return build


def _submitters(table: Callable[[str], DataFrame], cap: int) -> list[DataFrame]:
    sent = named(table("harvester_submissions"), user_link("submitter", "submitter_id"), table)
    line = said(sent, "{submitter|someone} via {channel|-}")
    return [_line_up(sent.select("item_id", line.alias("line")).distinct(), "item_id", [], "{line}", cap, "who")]


def _portfolio_lists(table: Callable[[str], DataFrame], cap: int) -> list[DataFrame]:
    ventures = table("ventures").filter("portfolio_id is not null and name is not null")
    aliases = table("portfolio_aliases").select(F.col("portfolio_id").cast("string").alias("_parent"), "alias")
    return [_line_up(ventures, "portfolio_id", [], "{name}", cap, "members"), aliases]


def _attendees(table: Callable[[str], DataFrame], cap: int) -> list[DataFrame]:
    came = named(table("calendar_event_attendees"), user_link("attendee", "user_id"), table).filter("attendee is not null")
    return [_line_up(came, "event_id", [], "{attendee}", cap, "attendees")]


_TEAM = user_link("member", "member_id")
LISTS: dict[str, Callable[[Callable[[str], DataFrame], int], list[DataFrame]]] = {
    "learnings": _learning_lists,
    "people": _member_lists("member_id", {
        "works_on": ("venture_members", "{venture}« ({role})»", VENTURE, "member_type = 'human'"),
        "owned": ("venture_responsibilities", "{owns} in {venture}", VENTURE, "owns <> ''"),
    }),
    "ventures": _member_lists("venture_id", {
        "team": ("venture_members", "{member}« ({role})»", _TEAM, "member_type = 'human'"),
        "agents": ("venture_members", "{agent}", {"agent": ("agents", "member_id", "name")}, "member_type = 'agent'"),
    }),
    "portfolios": _portfolio_lists,
    "harvested": _submitters,
    "calendar": _attendees,
}


def entity_documents(table: Callable[[str], DataFrame], name: str, now: dt.datetime, brand: str = "") -> DataFrame:
    """(ref_id, event_time, content) of one entity of ``ENTITIES``; ``brand`` is put before each text.

    ``now`` is the time of what has none (an open deal, an OKR period without dates).
    """
    entity = ENTITIES[name]
    rows = table(entity.table)
    if entity.keep:
        rows = rows.filter(entity.keep)
    rows = named(rows, entity.links, table)
    for more in LISTS[name](table, CAPS.get(name, CAP)) if name in LISTS else []:
        rows = rows.drop(*[c for c in more.columns if c != "_parent"]).join(more, F.col("id").cast("string") == F.col("_parent"), "left").drop("_parent")
    if name == "portfolios":
        rows = rows.withColumn("title_name", F.initcap("name"))
    if name == "ventures":
        rows = rows.withColumn("portfolio_title", F.initcap("portfolio"))
    times = [F.lit(now).cast("timestamp_ntz") if c == "now" else F.col(c) for c in entity.times]
    rows = rows.withColumn("at", F.coalesce(*times))
    return rows.select(F.col(entity.ref).alias("ref_id"), F.col("at").alias("event_time"), F.concat(F.lit(brand), said(rows, entity.says)).alias("content"))


def entity_memories(table: Callable[[str], DataFrame], name: str, namespace: str, now: dt.datetime, brand: str = "") -> DataFrame:
    return as_memories(entity_documents(table, name, now, brand), name, namespace)
