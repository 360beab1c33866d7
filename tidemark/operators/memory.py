"""The memory plane: filters, dedup, write decisions, telemetry, gaps and access.

A memories table has id, namespace, source_kind, source_ref, content, embedding, importance, valid_at,
invalid_at, tier, domain_raw, metadata (JSON) and owner_agent_id.  State is append-only: what is current, or was at a time, is derived.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metadata import merged
from ..functions.text import domain_type, has_negation, memory_type, network_of, norm_text
from ..plans.staging import staged
from .vector_index import VectorIndex, build, search

DUPLICATE, SUPERSEDE = 0.97, 0.88
NOOP_BUMP = 0.02


def ntz(t: dt.datetime) -> Column:
    return F.lit(t).cast("timestamp_ntz")


def live(memories: DataFrame, namespaces: Sequence[str] = (), *, as_of: dt.datetime | None = None) -> DataFrame:
    """Hot rows that are valid now, or were valid at ``as_of``; in the namespaces given, or all."""
    out = memories.filter(F.col("tier") == "hot")
    if as_of is None:
        out = out.filter("invalid_at is null")
    else:
        at = ntz(as_of)
        out = out.filter((F.col("valid_at") <= at) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > at)))
    names = [n.strip() for n in namespaces if n.strip() and n.strip() != "*" and "," not in n]
    return out.filter(F.col("namespace").isin(*names)) if names else out


def filtered(
    memories: DataFrame,
    *,
    types: Sequence[str] = (),
    exclude_kinds: Sequence[str] = (),
    since: dt.datetime | None = None,
    until: dt.datetime | None = None,
    min_importance: float | None = None,
) -> DataFrame:
    """The recall filters; since and until are both inclusive, an absent source kind passes the exclusion."""
    out = memories
    if types:
        out = out.filter(domain_type(F.col("domain_raw")).isin(*types))
    if exclude_kinds:
        out = out.filter(~F.coalesce("source_kind", F.lit("")).isin(*exclude_kinds))
    if since is not None:
        out = out.filter(F.col("valid_at") >= ntz(since))
    if until is not None:
        out = out.filter(F.col("valid_at") <= ntz(until))
    if min_importance is not None:
        out = out.filter(F.col("importance") >= min_importance)
    return out


def newest_per_ref(memories: DataFrame) -> DataFrame:
    """rank 1 is the newest row of a source_ref, in its namespace."""
    by = Window.partitionBy("namespace", "source_ref").orderBy(F.desc("valid_at"), "id")
    return memories.filter("source_ref is not null").withColumn("rank", F.row_number().over(by))


def superseded_by_ref(memories: DataFrame, source_kind: str | None = None) -> DataFrame:
    """Live rows that a newer live row of their source_ref makes redundant, and that row; of one source kind, or of all.

    Rows without a ref, or with an empty one, are never redundant.
    """
    rows = memories.filter("source_ref <> ''")
    if source_kind:
        rows = rows.filter(F.col("source_kind") == source_kind)
    # One max per group instead of a window: a hot ref needs no sort.
    best = rows.groupBy("namespace", "source_ref").agg(F.max_by("id", F.struct("valid_at", "id")).alias("kept_id"))
    return rows.join(best, ["namespace", "source_ref"]).filter("id <> kept_id").select("id", "namespace", "source_ref", "kept_id", "metadata")


def forget_metadata(memories: DataFrame, reason: str) -> DataFrame:
    """The metadata of rows that dedup retires: their own, with the reason and the row that stays merged in."""
    return merged(superseded_by_ref(memories), {"forget_reason": F.lit(reason), "superseded_by": F.col("kept_id")}).select("id", "metadata")


def classified(memories: DataFrame, prefixes: Sequence[str] = ()) -> DataFrame:
    kind = memory_type(domain_type(F.col("domain_raw")), F.col("source_kind"), prefixes=prefixes)
    return memories.select("id", domain_type(F.col("domain_raw")).alias("domain_type"), kind.alias("memory_type")).withColumn(
        "network", network_of(F.col("memory_type"))
    )


def write_decision(top: Column, content: Column, top_content: Column, similarity: Column) -> Column:
    """add, noop, update or invalidate, by the nearest live memory; the order of the cases matters."""
    return (
        F.when(top.isNull(), "add")
        .when(norm_text(content) == norm_text(top_content), "noop")
        .when((similarity >= SUPERSEDE) & has_negation(content), "invalidate")
        .when(similarity >= DUPLICATE, "noop")
        .when(similarity >= SUPERSEDE, "update")
        .otherwise("add")
    )


def nearest(new: DataFrame, current: DataFrame, index: VectorIndex | None = None) -> DataFrame:
    """For each new row the most similar current row of its namespace: the largest similarity, then the smallest id.

    Found through a vector index over the current rows: one that is stored and kept, or else one that is made here.
    """
    index = index or build(current)
    # Staged, so that the search is made once however often its result is read.
    best = staged(search(index, new), "nearest")
    return best.join(current.select(F.col("id").alias("top_id"), F.col("content").alias("top_content")), "top_id").select("id", "top_id", "top_content", "similarity")


def planned_writes(new: DataFrame, current: DataFrame, index: VectorIndex | None = None) -> DataFrame:
    """One decision per new row by similarity, each against the rows before the batch (``ordered_writes`` decides them in order)."""
    near = nearest(new, current, index)
    out = new.join(near, "id", "left")
    decision = write_decision(F.col("top_id"), F.col("content"), F.col("top_content"), F.col("similarity"))
    # Staged, as ``applied`` reads decisions twice: texts are read and joined once.
    return staged(out.select("id", "top_id", "similarity", decision.alias("decision")), "planned")


def planned_by_ref(new: DataFrame, current: DataFrame) -> DataFrame:
    """Rows with a source_ref: an update of the newest live row with that ref, else an addition; similarity has no say."""
    newest = current.filter("source_ref is not null").groupBy("namespace", "source_ref").agg(F.max_by("id", F.struct("valid_at", "id")).alias("top_id"))
    out = new.join(newest, ["namespace", "source_ref"], "left")
    return out.select("id", "source_ref", "top_id", F.when(F.col("top_id").isNull(), "add").otherwise("update").alias("decision"))


def applied(current: DataFrame, decisions: DataFrame) -> DataFrame:
    """Current rows and new ones after a batch of decisions: id, live, superseded_by, importance.

    A repeated statement makes its row a little more important; an update or a denial retires it,
    and an update leaves a pointer to its successor.  Rows are derived, never changed in place.
    """
    hits = decisions.filter("top_id is not null and decision <> 'add'").groupBy(F.col("top_id").alias("id")).agg(
        F.count_if(F.col("decision") == "noop").alias("noops"),
        F.max(F.when(F.col("decision") == "update", F.col("id"))).alias("superseded_by"),
        F.count_if(F.col("decision").isin("update", "invalidate")).alias("retirements"),
    )
    old = current.select("id", "importance").join(hits, "id", "left").select(
        "id",
        (F.coalesce("retirements", F.lit(0)) == 0).alias("live"),
        "superseded_by",
        F.round(F.least(F.lit(1.0), F.col("importance") + NOOP_BUMP * F.coalesce("noops", F.lit(0))), 6).alias("importance"),
    )
    added = decisions.filter("decision in ('add', 'update')").select(
        "id", F.lit(True).alias("live"), F.lit(None).cast("string").alias("superseded_by"), F.lit(0.5).alias("importance")
    )
    return old.unionByName(added)


def forgotten(memories: DataFrame, ids: DataFrame, reason: str, now: dt.datetime) -> DataFrame:
    """The rows among ``ids`` that are live, as they are after being forgotten; without a reason their metadata stays as it is."""
    live_rows = memories.filter("invalid_at is null").join(ids.select("id"), "id", "left_semi").select("id", ntz(now).alias("invalid_at"), "metadata")
    return merged(live_rows, {"forget_reason": F.lit(reason)}) if reason else live_rows


def edited(memory: DataFrame, content: Column, now: dt.datetime) -> DataFrame:
    """A new version of a row with other content; it is embedded again, so its embedding is empty."""
    return memory.withColumns({"content": content, "embedding": F.lit(None).cast("array<float>"), "valid_at": ntz(now), "invalid_at": F.lit(None).cast("timestamp_ntz")})


def searchable(grants: DataFrame, agent: str, requested: Sequence[str]) -> list[str]:
    """The requested namespaces that an agent may read; none is an error, not an empty result."""
    allowed = {r["namespace"] for r in grants.filter((F.col("agent_id") == agent) & F.col("can_read")).select("namespace").collect()}
    names = sorted(allowed & set(requested)) if requested else sorted(allowed)
    if not names:
        raise PermissionError(f"{agent} may read none of the namespaces")
    return names


def shared(memories: DataFrame, ids: DataFrame, grants: DataFrame, agent: str) -> DataFrame:
    """Copies of rows made visible to all; the agent needs write access to their namespace."""
    writable = grants.filter((F.col("agent_id") == agent) & F.col("can_write")).select("namespace")
    return memories.join(ids.select("id"), "id", "left_semi").join(writable, "namespace", "left_semi").withColumn("visibility", F.lit("global"))


def current_state(log: DataFrame) -> DataFrame:
    """The version of each source_ref that is current in an append-only log, and how many it has had."""
    # One max per ref; ties in time go to the larger id.
    return log.groupBy("namespace", "source_ref").agg(
        F.max_by("id", F.struct("valid_at", "id")).alias("current_id"),
        F.max("valid_at").alias("valid_at"),
        F.count(F.lit(1)).alias("versions"),
    )


def access_stats(memory_events: DataFrame, base_importance: float = 0.5) -> DataFrame:
    """Per agent and namespace: reads, last read, and the importance that repeated writes add up to."""
    hits = memory_events.filter(F.col("op").isin("recall", "search"))
    return hits.groupBy("namespace", "agent_id").agg(
        F.count(F.lit(1)).alias("access_count"),
        F.max("ts").alias("last_accessed_at"),
        F.round(F.least(F.lit(1.0), F.lit(base_importance) + NOOP_BUMP * F.count(F.lit(1))), 6).alias("importance"),
    )


def stats(
    memories: DataFrame, memory_events: DataFrame, entities: DataFrame, memory_entities: DataFrame, now: dt.datetime, resolved: Sequence[str] = ()
) -> DataFrame:
    """One row of totals; the windows of 24 hours end at ``now``.  Agents and sessions count retired rows too, the rest live ones."""
    since, until = ntz(now - dt.timedelta(hours=24)), ntz(now)

    def recent(time: str) -> Column:
        return (F.col(time) > since) & (F.col(time) <= until)

    alive = F.col("invalid_at").isNull()
    m = memories.agg(
        F.countDistinct(F.when(alive, F.col("namespace"))).alias("namespaces"),
        F.count_if(alive).alias("memories"),
        F.countDistinct("owner_agent_id").alias("agents"),
        F.countDistinct(F.when(recent("valid_at"), F.col("source_ref"))).alias("sessions_24h"),
    )
    e = memory_events.agg(F.count_if(recent("ts") & (F.col("op") == "recall")).alias("recalls_24h"))
    open_gaps = gaps(memory_events).filter(~F.col("query").isin(*resolved)) if resolved else gaps(memory_events)
    parts = (
        entities.agg(F.count(F.lit(1)).alias("entities")), memory_entities.agg(F.count(F.lit(1)).alias("links")), e,
        open_gaps.agg(F.count(F.lit(1)).alias("open_gaps")),
    )
    for one in parts:  # one row each
        m = m.join(F.broadcast(one))
    return m


def namespaces(memories: DataFrame) -> DataFrame:
    return (
        memories.filter("invalid_at is null")
        .groupBy("namespace")
        .agg(F.count(F.lit(1)).alias("memories"), F.max("valid_at").alias("last_activity"))
        .orderBy(F.desc("memories"), "namespace")
    )


def histogram(memories: DataFrame, namespace: str, by: str) -> DataFrame:
    """Live rows of a namespace by domain type or source kind."""
    key = domain_type(F.col("domain_raw")) if by == "type" else F.coalesce("source_kind", F.lit(""))
    return memories.filter(F.col("invalid_at").isNull() & (F.col("namespace") == namespace)).groupBy(key.alias(by)).agg(
        F.count(F.lit(1)).alias("memories")
    )


def detail(memories: DataFrame, memory_events: DataFrame, namespace: str) -> DataFrame:
    """One row about a namespace: live rows and their first and last time, open gaps, recalls."""
    m = memories.filter((F.col("namespace") == namespace) & F.col("invalid_at").isNull()).agg(
        F.count(F.lit(1)).alias("memories"), F.min("valid_at").alias("first"), F.max("valid_at").alias("last")
    )
    own = memory_events.filter(F.col("namespace") == namespace)
    g = gaps(own).agg(F.count(F.lit(1)).alias("open_gaps"))
    r = own.agg(F.count_if(F.col("op") == "recall").alias("recalls"))
    return m.join(F.broadcast(g)).join(F.broadcast(r))  # one row each


def activity_log(memory_events: DataFrame, limit: int = 50, namespace: str | None = None, kind: str | None = None) -> DataFrame:
    """Newest operations; ``kind``: 'searches', 'writes' or all."""
    out = memory_events
    if namespace:
        out = out.filter(F.col("namespace") == namespace)
    if kind == "searches":
        out = out.filter(F.col("op") == "recall")
    elif kind == "writes":
        out = out.filter(F.col("op").isin("retain", "reconsolidate"))
    elif kind == "errors":
        out = out.filter(F.col("outcome") == "error")
    return out.orderBy(F.desc("ts"), F.desc("id")).limit(min(limit, 200)).select("id", "ts", "namespace", "op", "agent_id", "latency_ms")


def gaps(memory_events: DataFrame) -> DataFrame:
    """Queries without an answer, one row per namespace and normal form."""
    empty = memory_events.filter("op in ('recall', 'search') and outcome = 'empty'")
    text = F.substring(norm_text(F.col("query")), 1, 2000)
    return empty.groupBy("namespace", text.alias("query")).agg(
        F.count(F.lit(1)).alias("hits"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )


def gaps_ranked(memory_events: DataFrame, resolved: Sequence[str] = (), limit: int = 100) -> DataFrame:
    """Open gaps first, then by hits and recency."""
    status = F.when(F.col("query").isin(*resolved), "resolved").otherwise("open") if resolved else F.lit("open")
    out = gaps(memory_events).withColumn("status", status)
    order = [(F.col("status") == "open").desc(), F.desc("hits"), F.desc("last_seen"), "namespace", "query"]
    return out.orderBy(*order).limit(min(limit, 500)).select("namespace", "query", "hits", "last_seen", "status")


def readable(memories: DataFrame, grants: DataFrame, agent: str) -> DataFrame:
    """Rows of the namespaces that an agent may read; without a grant none."""
    allowed = grants.filter((F.col("agent_id") == agent) & F.col("can_read")).select("namespace")
    return memories.join(allowed, "namespace", "left_semi")
