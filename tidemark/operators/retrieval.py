"""Retrieval: vector and term ranking, rank fusion, spreading activation, lookup by entity.

All filters go before the rankings: that is part of the meaning, not only faster.  A query is a
bounded parameter (one vector, a list of terms); the corpus is scanned once per ranking, and each
ranking keeps its top rows per task before anything is moved.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_text, tokens
from ..functions.vectors import cosine
from ..plans.staging import staged
from .memory import filtered, live
from .term_index import TermIndex, score

RRF_K = 60
SALIENCE = 0.01
FALLBACK_SALIENCE = 0.15
RECALL_POOL, SEARCH_POOL = 40, 60
RECALL_LIMIT, SEARCH_LIMIT, SEARCH_MAX = 8, 12, 50


def vector_ranking(memories: DataFrame, query: Column, k: int, columns: Sequence[str] = ()) -> DataFrame:
    """The k nearest rows by cosine distance, ranked: id, distance, rank, and further columns."""
    distance = F.round(1 - cosine(F.col("embedding"), query), 6)
    near = memories.filter("embedding is not null").select("id", distance.alias("distance"), *columns).orderBy("distance", "id").limit(k)
    # At most k rows are left, so one window over all of them is small.
    return near.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")))


def _times(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def bm25_scores(memories: DataFrame, terms: Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
    """Okapi BM25 of rows that hold one of the terms: id, score, and further columns.

    Only the query's terms are counted, in one pass over the texts that leaves a few numbers a row.  The corpus figures (rows, mean length, document
    frequencies) are those of ``memories``.  ``term_index`` does without the pass, for live rows of whole namespaces.
    """
    terms = sorted({t.lower() for t in terms})
    words = memories.select("id", *columns, tokens(F.col("content")).alias("words")).withColumn("n_terms", F.size("words"))
    counted = words.select("id", "n_terms", *columns, *[_times("words", t).alias(f"tf{i}") for i, t in enumerate(terms)])
    some = counted.filter(" or ".join(f"tf{i} > 0" for i in range(len(terms))))
    corpus = counted.agg(F.count(F.lit(1)).alias("rows"), F.avg("n_terms").alias("mean_length"))
    found = some.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    at = some.join(F.broadcast(corpus)).join(F.broadcast(found))  # one row each
    total = F.lit(0.0)
    for i in range(len(terms)):
        total = total + score(F.col(f"tf{i}").cast("double"), F.col(f"df{i}"), F.col("n_terms"), F.col("rows"), F.col("mean_length"))
    return at.select("id", F.round(total, 6).alias("score"), *columns)


def bm25_ranking(memories: DataFrame, terms: Sequence[str], k: int, columns: Sequence[str] = ()) -> DataFrame:
    best = bm25_scores(memories, terms, columns).orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def fused(
    memories: DataFrame,
    query: Column,
    terms: Sequence[str],
    *,
    pool: int = RECALL_POOL,
    limit: int = RECALL_LIMIT,
    min_importance: float | None = None,
    columns: Sequence[str] = ("namespace",),
    index: TermIndex | None = None,
    namespaces: Sequence[str] = (),
) -> DataFrame:
    """Reciprocal rank fusion of both rankings, plus a little importance; the floor applies after fusion.

    ``index``, where given, is kept to the live rows that ``memories`` are: those of ``namespaces``, or all.
    """
    # The rankings carry what the result shows; an index's few best rows get it from the memories' narrow columns.
    carried = list(dict.fromkeys([*columns, "importance", "valid_at"]))
    v = vector_ranking(memories, query, pool, carried).select("id", *carried, F.col("rank").alias("rv"), F.lit(None).cast("int").alias("rt"))
    if index is None:
        t = bm25_ranking(memories, terms, pool, carried)
    else:
        t = memories.select("id", *carried).join(F.broadcast(index.ranking(terms, pool, namespaces)), "id")
    t = t.select("id", *carried, F.lit(None).cast("int").alias("rv"), F.col("rank").alias("rt"))
    # Twice the pool at most: one task, and no shuffle.
    ranked = v.unionByName(t).coalesce(1).groupBy("id").agg(*[F.first(c).alias(c) for c in carried], F.max("rv").alias("rv"), F.max("rt").alias("rt"))
    score = (
        F.coalesce(1.0 / (RRF_K + F.col("rv")), F.lit(0.0))
        + F.coalesce(1.0 / (RRF_K + F.col("rt")), F.lit(0.0))
        + SALIENCE * F.col("importance")
    )
    out = ranked.select("id", *carried, F.round(score, 6).alias("score"))
    if min_importance is not None:
        out = out.filter(F.col("importance") >= min_importance)
    return out.orderBy(F.desc("score"), "id").limit(limit)


def vector_fallback(memories: DataFrame, query: Column, *, limit: int = RECALL_POOL, min_importance: float | None = None) -> DataFrame:
    """Vector ranking alone: ordered by distance, while the score blends importance in."""
    rows = memories if min_importance is None else memories.filter(F.col("importance") >= min_importance)
    near = F.broadcast(vector_ranking(rows, query, limit))
    score = (1 - F.col("distance")) + FALLBACK_SALIENCE * F.col("importance")
    return rows.join(near, "id").select("id", "rank", "distance", F.round(score, 6).alias("score"))


def search_limit(limit: int | None) -> int:
    return SEARCH_LIMIT if not limit or limit > SEARCH_MAX else limit


def search(
    memories: DataFrame, query: Column, terms: Sequence[str], limit: int | None = None, index: TermIndex | None = None, namespaces: Sequence[str] = ()
) -> DataFrame:
    """Fusion over all the namespaces given, without a floor."""
    return fused(memories, query, terms, pool=SEARCH_POOL, limit=search_limit(limit), index=index, namespaces=namespaces)


def by_time(recalled: DataFrame, oldest: bool = False) -> DataFrame:
    return recalled.orderBy(F.asc("valid_at") if oldest else F.desc("valid_at"), "id")


def reranked(recalled: DataFrame, score: Callable[[DataFrame], Column], limit: int) -> DataFrame:
    """A second score over the pool (a pandas UDF of a model, say); ties keep their order."""
    before = recalled.withColumn("before", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    return before.withColumn("score", score(before)).orderBy(F.desc("score"), "before").limit(limit).drop("before")


def token_overlap(content: Column, terms: Sequence[str]) -> Column:
    """The default rerank score: the share of the query's terms that a text has."""
    wanted = F.array(*[F.lit(t.lower()) for t in sorted(set(terms))])
    return F.size(F.array_intersect(tokens(content), wanted)) / float(max(1, len(set(terms))))


def expanded(
    seeds: DataFrame, memories: DataFrame, memory_entities: DataFrame, entities: DataFrame, limit: int, columns: Sequence[str] = ()
) -> DataFrame:
    """Memories that share an entity with the seeds, best by importance; via the first such entity by name."""
    budget = max(2, limit // 2)
    of_seeds = memory_entities.join(F.broadcast(seeds.select(F.col("id").alias("memory_id"))), "memory_id", "left_semi").select("entity_id").distinct()
    linked = memory_entities.join(of_seeds, "entity_id").join(seeds.select(F.col("id").alias("memory_id")), "memory_id", "left_anti")
    named = linked.join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id")
    via = named.groupBy("memory_id").agg(F.min("name").alias("via_entity"))
    out = memories.join(via.withColumnRenamed("memory_id", "id"), "id")
    score = F.round(0.05 + FALLBACK_SALIENCE * F.col("importance"), 6)
    return out.select("id", *columns, "via_entity", score.alias("score")).orderBy(F.desc("score"), "id").limit(budget)


def within(rows: DataFrame, *, since: dt.datetime | None = None, until: dt.datetime | None = None, as_of: dt.datetime | None = None) -> DataFrame:
    """Rows whose valid_at is in the window (both ends included) and not after ``as_of``."""
    for bound, keep in ((since, F.col("valid_at") >= _ntz(since)), (until, F.col("valid_at") <= _ntz(until)), (as_of, F.col("valid_at") <= _ntz(as_of))):
        if bound is not None:
            rows = rows.filter(keep)
    return rows


def _ntz(t: dt.datetime | None) -> Column:
    return F.lit(t).cast("timestamp_ntz")


def recall(
    memories: DataFrame,
    memory_entities: DataFrame,
    entities: DataFrame,
    query: Column,
    terms: Sequence[str],
    *,
    namespaces: Sequence[str] = (),
    types: Sequence[str] = (),
    exclude_kinds: Sequence[str] = (),
    since: dt.datetime | None = None,
    until: dt.datetime | None = None,
    as_of: dt.datetime | None = None,
    min_importance: float | None = None,
    limit: int | None = None,
    expand: bool = False,
    order_by: str = "",
    rerank: Callable[[DataFrame], Column] | None = None,
) -> DataFrame:
    """Recall, whole: place, id, score, valid_at, importance, via_entity.

    The filters apply before the rankings; a pool of 40 is fused, reranked if a second score is given, and cut to the limit
    (8).  Expansion then adds memories that share an entity with those, after them: they are chosen among all live rows of the
    namespaces, and only then cut to the time window, as a neighbour outside of it would answer another question.
    ``order_by`` 'recent' or 'oldest' orders what was chosen by time, equal times in their order before.
    """
    limit = limit if limit and limit > 0 else RECALL_LIMIT
    rows = filtered(live(memories, namespaces, as_of=as_of), types=types, exclude_kinds=exclude_kinds, since=since, until=until)
    pool = fused(rows, query, terms, limit=RECALL_POOL, min_importance=min_importance, columns=("content",) if rerank else ())
    best = reranked(pool, rerank, limit) if rerank else pool.orderBy(F.desc("score"), "id").limit(limit)
    # A few rows, read by what follows three times.
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    out = staged(best.select("id", "score", "valid_at", "importance", rank.alias("first")), "recalled").withColumn("via_entity", F.lit(None).cast("string"))
    if expand:
        extra = expanded(out, live(memories, namespaces), memory_entities, entities, limit, ("valid_at", "importance"))
        extra = within(extra, since=since, until=until, as_of=as_of)
        after = limit + F.row_number().over(Window.orderBy(F.desc("score"), "id"))
        out = out.unionByName(extra.withColumn("first", after))
    by = {"recent": [F.desc("valid_at")], "oldest": [F.asc("valid_at")]}.get(order_by.lower(), [])
    place = F.row_number().over(Window.orderBy(*by, "first"))
    return out.select(place.alias("place"), "id", "score", "valid_at", "importance", "via_entity")


def recall_effects(recalled: DataFrame, namespace: str, query: str, now: dt.datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a recall leaves behind, as rows to append: the event, the accesses, and the gap if nothing was found."""
    found = recalled.agg(F.count(F.lit(1)).alias("rows"))
    event = found.select(
        F.lit(now).cast("timestamp_ntz").alias("ts"), F.lit(namespace).alias("namespace"), F.lit("recall").alias("op"),
        F.when(F.col("rows") > 0, "hit").otherwise("empty").alias("outcome"), F.lit(query).alias("query"),
    )
    accesses = recalled.select("id", F.lit(1).cast("long").alias("accesses"), F.lit(now).cast("timestamp_ntz").alias("last_accessed_at"))
    gap = event.filter("outcome = 'empty'").select("namespace", F.substring(norm_text(F.col("query")), 1, 2000).alias("query"), F.col("ts").alias("last_seen"))
    return event, accesses, gap


def memories_of_entity(memories: DataFrame, memory_entities: DataFrame, entities: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """Memories that mention an entity whose name contains ``text``, case aside."""
    found = entities.filter(F.contains(F.lower("name"), F.lit(text.lower()))).select(F.col("id").alias("entity_id"))
    ids = memory_entities.join(found, "entity_id", "left_semi").select(F.col("memory_id").alias("id")).distinct()
    return (
        memories.join(ids, "id", "left_semi").select("id", "namespace", "importance").orderBy(F.desc("importance"), "id").limit(min(limit, 20))
    )


def entity_lookup(
    memories: DataFrame, memory_entities: DataFrame, entities: DataFrame, text: str, query: Column, terms: Sequence[str], *, namespaces: Sequence[str] = (), limit: int = 8
) -> DataFrame:
    """Live memories that mention an entity of that name (via the first such name), else a recall of the text: id, importance, valid_at, via.

    ``query`` and ``terms`` are the text's own, for the recall.
    """
    limit = 8 if limit < 1 else min(limit, 20)
    found = entities.filter(F.contains(F.lower("name"), F.lit(text.lower()))).select(F.col("id").alias("entity_id"), "name")
    via = memory_entities.join(found, "entity_id").groupBy(F.col("memory_id").alias("id")).agg(F.min("name").alias("via"))
    hits = live(memories, namespaces).join(via, "id").select("id", "importance", "valid_at", "via").orderBy(F.desc("importance"), "id").limit(limit)
    if not hits.isEmpty():
        return hits
    recalled = recall(memories, memory_entities, entities, query, terms, namespaces=namespaces, limit=limit, expand=True)
    return recalled.select("id", "importance", "valid_at", F.col("via_entity").alias("via"))


def cache_key(namespace: str, query: str, limit: int, epoch: int) -> Column:
    """Equal for queries that differ in case and outer white space alone; changes with the epoch."""
    return F.sha1(F.concat_ws("|", F.lit(namespace), F.lower(F.trim(F.lit(query))), F.lit(str(limit)), F.lit(str(epoch))).cast("binary"))


def context_rows(recalled: DataFrame, memories: DataFrame) -> DataFrame:
    """Numbered context for a grounded answer: n, id, content."""
    n = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    return memories.join(F.broadcast(recalled.select("id", n.alias("n"))), "id").select("n", "id", "content")
