"""The named queries: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import analytics as an
from ..operators import chunking as ch
from ..operators import entity_digests as eg
from ..operators import entity_documents as ed
from ..operators import graph as gr
from ..operators import knowledge as kn
from ..operators import mappings as mp
from ..operators import memory as me
from ..operators import ontology as on
from ..operators import ordered_writes as ow
from ..operators import retrieval as re_
from ..operators import rollup_documents as rd
from ..operators import rollups as ro
from ..operators import states as st
from ..operators import term_index as ti
from ..sources import connectors as co
from ..sources import etl
from ..sources.adapters import Tables
from ..streaming import refresh
from .staging import fresh_dir

NOW = dt.datetime(2024, 1, 15, 12)
AS_OF = dt.datetime(2024, 1, 20)
TERMS = ("thing", "disgusting", "trash")


def _query_vector(t: Tables) -> Column:
    """The query's vector, a parameter: here that of the table's first vector."""
    row = t.embeddings.filter("vec_id = 0").select("embedding").first()
    return F.array(*[F.lit(float(x)) for x in row["embedding"]])


def _nudged(by: Column) -> Column:
    """The embedding as doubles, ``by`` added to its first component.

    ``by`` is no part of a lambda: where one refers to a column of a row, Spark may send a filter on the result to the side of a join that lacks that column.
    """
    v = F.col("embedding").cast("array<double>")
    return F.when(F.size(v) > 0, F.zip_with(v, F.array(by), lambda x, y: x + F.coalesce(y, F.lit(0.0)))).otherwise(v)


def _batch(t: Tables) -> DataFrame:
    """A batch of writes: altered copies of rows that exist, and rows of their own."""
    m = me.live(t.memories).filter("embedding is not null")
    new = m.filter(F.pmod(F.regexp_extract("id", "([0-9]+)$", 1).cast("long"), F.lit(50)) == 0)
    k = F.pmod(F.regexp_extract("id", "([0-9]+)$", 1).cast("long"), F.lit(3))
    nudged = _nudged(F.when(k == 1, 0.3).when(k == 2, 0.02).otherwise(0.0))
    content = F.when(k == 0, F.col("content")).when(k == 1, F.concat(F.lit("no longer "), F.col("content"))).otherwise(F.concat(F.col("content"), F.lit(" more")))
    return new.select(F.concat(F.lit("new-"), F.col("id")).alias("id"), "namespace", content.alias("content"), nudged.alias("embedding"))


def _write_decision(t: Tables) -> DataFrame:
    out = me.planned_writes(_batch(t), me.live(t.memories).filter("embedding is not null"))
    return out.select("id", "top_id", "similarity", "decision")


def _ann(t: Tables) -> DataFrame:
    return re_.vector_ranking(me.live(t.memories), _query_vector(t), 40)


def _neighbor_pairs(t: Tables) -> DataFrame:
    """Nearest other vector of each vector whose id is divisible by 50, among all."""
    e = t.embeddings
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), F.lit("all").alias("namespace"), F.lit("").alias("content"), "embedding")
    c = e.select(F.col("vec_id").alias("id"), F.lit("all").alias("namespace"), F.lit("").alias("content"), "embedding")
    near = me.nearest(q, c)
    return near.select(F.col("id").alias("vec_id"), F.col("top_id").alias("neighbor"), "similarity")


def _spine_window(t: Tables) -> DataFrame:
    # Persons are taken as a time role here, so that the window has something to apply to.
    return gr.spine(
        t.entity_edges, t.entities, "NATION_7", window=(dt.datetime(2024, 1, 10), dt.datetime(2024, 2, 10)), time_types=("person",), hubs=("venture",), per_group=5
    )


_INDEXES: dict[tuple[str, ...], ti.TermIndex] = {}


def term_index(t: Tables) -> ti.TermIndex:
    """The stored term index of the live memories, made when it is first asked for and kept for the application."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir, *sorted(t.loaded.values()))
    if key not in _INDEXES or not _INDEXES[key].exists():
        _INDEXES[key] = ti.stored(me.live(t.memory_texts()))
    return _INDEXES[key]


_SEARCHED = ("en", "de", "es")


def _index_after_writes(t: Tables) -> ti.TermIndex:
    """An index that has seen rows come in two batches, others go, and texts change."""
    rows = t.memory_texts()
    m, k = me.live(rows), F.regexp_extract("id", "([0-9]+)$", 1).cast("long") % 3
    wrong = m.filter(k == 2).withColumn("content", F.concat("content", F.lit(" thing trash")))
    index = ti.stored(m.filter(k == 0).unionByName(wrong))
    gone = rows.filter("tier = 'hot' and invalid_at is not null")
    return index.add("second", m.filter(k == 1).unionByName(gone)).add("third", m.filter(k == 2), wrong.unionByName(gone)).compacted()


def _user_states(t: Tables) -> DataFrame:
    """Stored states that have seen a load and then late rows."""
    path, tables = fresh_dir(t.spark, "user-states"), [t.feature_events, t.transition_events]
    first = [x.filter("coalesce(user_id, 0) % 7 <> 3") for x in tables]
    st.refresh(path, first, first, st.user_states)
    st.refresh(path, [x.filter("user_id % 7 = 3") for x in tables], tables, st.user_states)
    return st.read(t.spark, path, st.USERS)


def _ingested(t: Tables) -> DataFrame:
    """The ledger after two runs, the second of them run again; some pages have no content, some no ref, some metadata that is no JSON."""
    k, path = F.col("page_id") % 10, fresh_dir(t.spark, "ingest")
    docs = t.pages.select(
        F.when(k != 1, F.concat(F.lit("page:"), F.col("page_id").cast("string"))).alias("ref"), F.col("url").alias("title"), F.when(k == 2, F.lit("  ")).otherwise(F.col("html")).alias("content"),
        F.lit(NOW).cast("timestamp_ntz").alias("event_time"), F.when(k == 3, "{no").otherwise('{"type":"page"}').alias("metadata"), "page_id",
    )
    first, second = docs.filter("page_id % 2 = 0").drop("page_id"), docs.filter("page_id % 2 = 1").drop("page_id")
    for run, rows in (("r1", first), ("r2", second), ("r2", second)):
        co.ingest(rows, path, run, now=NOW, cut=lambda text: [text])
    ledger = co.ledger(t.spark, path)
    return ledger.select("run", "status", "documents", "ingested", "failed", F.sum("ingested").over(Window.orderBy("run")).alias("doc_count"))


def _rollup_docs(t: Tables) -> DataFrame:
    out = rd.repo_weeks(t.github_commits, t.people, NOW)
    more = (rd.person_weeks(t.github_commits, t.people, NOW), rd.ai_person_weeks(t.claude_activity_events, t.user_people, NOW), rd.org_months(t.github_commits, t.people, NOW), rd.studio_ai_weeks(t.claude_activity_events, NOW))
    for docs in more:
        out = out.unionByName(docs)
    return out


def _restamped(t: Tables) -> DataFrame:
    e = t.memories.select(F.concat(F.lit("e"), "id").alias("src"), "source_ref", F.col("id").alias("memory_id"), F.when(F.length("id") % 3 == 0, F.col("valid_at")).alias("valid_to"))
    return kn.restamped(e, t.memories).select("src", "memory_id")


def _pr_medians(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "wait-states")
    st.refresh(path, [t.github_pull_requests], [t.github_pull_requests], st.wait_states)
    by = st.weekly_medians(st.read(t.spark, path, st.WAITS))
    return by.groupBy("week", "repo_full_name").agg(*[F.max(F.when(F.col("kind") == k, F.col("median_minutes"))).alias(f"median_{k}_minutes") for k in ("review", "merge")])


def _expand(t: Tables) -> DataFrame:
    live = me.live(t.memories)
    seeds = re_.fused(live, _query_vector(t), TERMS)
    return re_.expanded(seeds, live, t.memory_entities, t.entities, re_.RECALL_LIMIT)


def _apply_writes(t: Tables) -> DataFrame:
    return me.current_state(t.memories.select("namespace", "source_ref", "id", "valid_at"))


def _changed(t: Tables) -> DataFrame:
    docs = t.documents.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source_ref"), F.col("text").alias("content"), "doc_id")
    old = docs.select("source_ref", ro.content_hash(F.when(F.pmod("doc_id", F.lit(10)) == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).alias("hash"))
    return ro.changed_only(docs, old)


def _stale(t: Tables) -> DataFrame:
    live = t.memories.filter("invalid_at is null and source_kind in ('src1', 'src2')").select("id", F.concat("source_ref", F.lit("/"), "id").alias("source_ref"))
    seen = t.documents.filter("doc_id % 3 <> 0").select(
        F.concat(F.lit("doc:"), F.floor(F.col("doc_id") / 2.0).cast("string"), F.lit("/m"), F.col("doc_id").cast("string")).alias("source_ref")
    )
    return ro.stale_refs(live, seen)


def _provenance(t: Tables) -> DataFrame:
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    buys = t.orders.withColumn("k", F.pmod("o_orderkey", F.lit(25)))
    return ro.provenance(ro.fk_edges(buys, "ORDERED_IN", s("c", "o_custkey"), s("n", "k"), s("db:order:", "o_orderkey")))


def _incremental(t: Tables) -> DataFrame:
    """A table loaded on the 10th, then refreshed from a source in which some rows have changed."""
    source = t.events.withColumn("value", F.when(F.pmod("event_id", F.lit(7)) == 0, F.col("value") + 1).otherwise(F.col("value")))
    old = t.events.filter(F.col("ts") < me.ntz(dt.datetime(2024, 1, 10)))
    return etl.incremental(old, source, "event_id", "ts", dt.datetime(2024, 1, 10)).select("event_id", "ts", "event_type", "value")


def _late(t: Tables) -> DataFrame:
    """Rows that arrive twice, the second time later and with another value: one stays."""
    again = t.events.filter("event_id % 5 = 0").select("event_id", (F.col("ts") + F.expr("interval 1 hour")).alias("ts"), F.col("event_type"), (F.col("value") + 1).alias("value"))
    rows = t.events.select("event_id", "ts", "event_type", "value").unionByName(again)
    return etl.newest_by_key(rows, "event_id", "ts", "value")


def _secret_screen(t: Tables) -> DataFrame:
    """Conversations as team chats; some messages get a credential, some threads are private."""
    body = F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)) == 0, F.concat(F.lit("Pass: 123 "), "text")).otherwise(F.col("text"))
    scope = F.when(F.pmod("conv_id", F.lit(9)) == 0, "direct").otherwise("team")
    rows = t.conversations.select(F.col("conv_id").alias("thread"), F.col("turn").alias("at"), F.col("role").alias("sender"), body.alias("body"), scope.alias("scope"))
    return ro.screened_threads(rows)


def _mapping(t: Tables) -> DataFrame:
    """An entity-to-document mapping: orders with their customer and nation, as (ref_id, event_time, content)."""
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    content = F.concat(
        F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" by "), F.coalesce("c_name", F.lit("unknown")), F.lit(" ("), F.coalesce("n_name", F.lit("-")),
        F.lit("), status "), F.col("o_orderstatus"), F.lit(", priority "), F.col("o_orderpriority"),
    )
    return o.select(F.concat(F.lit("db:order:"), F.col("o_orderkey").cast("string")).alias("ref_id"), F.col("o_orderdate").alias("event_time"), tx.squeezed(content, 1500).alias("content"))


def _mapping_top_list(t: Tables) -> DataFrame:
    """A mapping with a lateral list: each customer with the three dearest orders."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    head = t.orders.withColumn("rank", rank).filter("rank <= 3")
    text = head.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("rank", "o_orderkey"))).alias("all"))
    out = t.customer.join(text, F.col("c_custkey") == F.col("o_custkey"), "left")
    listed = F.array_join(F.transform("all", lambda x: x["o_orderkey"].cast("string")), ", ")
    return out.select(
        F.concat(F.lit("db:customer:"), F.col("c_custkey").cast("string")).alias("ref_id"),
        F.concat(F.col("c_name"), F.lit(": "), F.coalesce(listed, F.lit("no orders"))).alias("content"),
    )


def _hashed_rerank(t: Tables) -> DataFrame:
    live = me.live(t.memories)
    pool = re_.fused(live, _query_vector(t), TERMS, limit=re_.RECALL_POOL, columns=("namespace", "content"))
    return re_.reranked(pool, lambda df: F.round(re_.token_overlap(df["content"], TERMS), 6), re_.RECALL_LIMIT).select("id", "score")


def _files(t: Tables) -> DataFrame:
    """Parts as files of repositories."""
    path = F.concat_ws("/", F.lit("src"), F.lower("p_type"), F.concat(F.when(F.pmod("p_partkey", F.lit(5)) == 0, "handler_").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".go")))
    return t.part.select(F.col("p_brand").alias("repo"), path.alias("path"), F.lower("p_type").alias("language"), (F.col("p_size") * 1000).cast("long").alias("bytes"))


def _doc_files(t: Tables) -> DataFrame:
    n = F.col("doc_id").cast("string")
    k = F.pmod("doc_id", F.lit(5))
    path = F.when(k == 0, F.concat(F.lit("pkg"), n, F.lit("/README.md"))).when(k == 1, F.concat(F.lit("docs/g"), n, F.lit(".mdx"))).when(k == 2, F.concat(F.lit("src/n"), n, F.lit(".md"))).otherwise(F.concat(F.lit("src/c"), n, F.lit(".go")))
    return t.documents.select(path.alias("path"), F.length("text").cast("long").alias("bytes"), F.col("text").alias("content"))


def _repo_docs(t: Tables) -> DataFrame:
    """Markdown files of some repositories, READMEs in some of their folders."""
    repo = F.concat(F.lit("Brand#"), (F.pmod("doc_id", F.lit(4)) + 1).cast("string"), (F.pmod("doc_id", F.lit(3)) + 1).cast("string"))
    place = F.when(F.pmod("doc_id", F.lit(7)) == 0, F.lit("/ReadMe.md")).when(F.pmod("doc_id", F.lit(7)) < 3, F.lit(".md"))
    text = F.concat(F.lit("\n # title \n\n\n\n"), F.col("text"), F.lit(" \n"))
    rows = t.documents.select(repo.alias("repo"), F.concat(F.when(F.pmod("doc_id", F.lit(5)) == 0, "Docs/g").otherwise("pkg"), F.col("doc_id").cast("string"), place).alias("path"), text.alias("content"))
    return rows.filter("path is not null")


def _heads(t: Tables) -> DataFrame:
    day = F.date_add(F.lit(dt.date(2024, 1, 1)), F.pmod("p_partkey", F.lit(300)).cast("int"))
    return t.part.filter("p_size > 48").select(F.col("p_brand").alias("repo"), F.sha2("p_name", 256).alias("sha"), day.alias("date"))


def _labels(t: Tables) -> DataFrame:
    repos = t.part.select(F.concat(F.lit("r:"), "p_brand").alias("id"), F.col("p_brand").alias("name"), F.lit("repo").alias("kind"))
    teams = t.part.select(F.concat(F.lit("t:"), "p_brand", F.lit(":"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("name"), F.lit("team").alias("kind"))
    return kn.disambiguated(repos.unionByName(teams))


def _feeds(t: Tables) -> DataFrame:
    e = t.events
    posts = e.select(
        F.col("event_type").alias("kind"), F.col("user_id").alias("author"), F.concat(F.lit("ch"), F.pmod("user_id", F.lit(10)).cast("string")).alias("channel"),
        F.when(F.pmod("event_id", F.lit(3)) != 0, F.concat(F.lit("v"), F.pmod("user_id", F.lit(25)).cast("string"))).alias("venture_id"),
    )
    channels = t.nation.filter("n_nationkey < 5").select(F.concat(F.lit("ch"), F.col("n_nationkey").cast("string")).alias("channel"), F.concat(F.lit("v"), F.col("n_nationkey").cast("string")).alias("venture_id"))
    return kn.feed_nodes(posts, channels)


def _titles(t: Tables) -> DataFrame:
    two = F.when(F.pmod("event_id", F.lit(7)) == 0, F.lit(" and NATION_1")).otherwise("")
    titles = t.events.select(F.col("event_id").alias("id"), F.concat(F.lit("Sync: nation_"), F.pmod("event_id", F.lit(40)).cast("string"), two).alias("title"))
    return kn.title_matches(titles, t.dim_ventures)


def _relink(t: Tables) -> DataFrame:
    """Rollups of a nation's first eight customers by name; the links to some of them exist."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_name"))
    head = t.customer.withColumn("rank", rank).filter("rank <= 8").groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_name")).alias("ranking"))
    by = head.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rollups = by.select(
        F.concat(F.lit("rollup:"), F.col("c_nationkey").cast("string")).alias("source_ref"), F.to_json(F.struct(F.lower("n_name").alias("scope"), F.col("ranking"))).alias("metadata")
    )
    have = t.customer.filter("c_custkey % 3 = 0").select(F.concat(F.lit("rollup:"), F.col("c_nationkey").cast("string")).alias("source_ref"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("entity_id"))
    return kn.relinked(rollups, t.entities, have)


def _prefixed(t: Tables) -> DataFrame:
    """Kinds with a qualifier or a prefix of the application; a prefix of its own, as in photos_post, stays."""
    kinds = F.array(*[F.lit(x) for x in ("app_post", "photos_post", "Venture:x/y", "app_Playbook/a", "doc", " apps_doc ", "videos_doc")])
    docs = t.documents.select(F.col("doc_id").alias("id"), F.element_at(kinds, (F.pmod("doc_id", F.lit(7)) + 1).cast("int")).alias("source_kind"))
    return docs.select("id", tx.bare_kind(F.col("source_kind"), ["app_"]).alias("kind"), tx.memory_type(F.lit("item_"), F.col("source_kind"), prefixes=["app_"]).alias("memory_type"))


def _emptied_refs(t: Tables) -> DataFrame:
    """Dedup of one source kind, where some rows have an empty ref and some none."""
    k = F.pmod(F.regexp_extract("id", "([0-9]+)$", 1).cast("long"), F.lit(4))
    ref = F.when(k == 0, "").when(k == 1, F.lit(None).cast("string")).otherwise(F.concat(F.lit("ref:"), F.length("content").cast("string")))
    rows = me.live(t.memories).withColumns({"source_ref": ref, "source_kind": F.when(k < 3, "post").otherwise("doc")})
    return me.superseded_by_ref(rows, "post").select("id", "kept_id")


def _answers(t: Tables) -> DataFrame:
    """Conversations as a survey's answers: some turns make a choice, the others give a text."""
    choice = F.to_json(F.struct(F.concat(F.lit("c"), F.pmod("conv_id", F.lit(4)).cast("string")).alias("choice")))
    return t.conversations.select(
        F.concat(F.lit("s"), F.pmod("conv_id", F.lit(5)).cast("string")).alias("survey"), F.col("role").alias("key"),
        F.when(F.pmod("turn", F.lit(3)) == 0, choice).otherwise(F.to_json(F.struct("text"))).alias("value"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"),
    )


def _ventures_said(t: Tables) -> DataFrame:
    """Memories that say which venture they are about: of type venture with its name and perhaps its portfolio, others 'in venture X'."""
    k = F.regexp_extract("id", "([0-9]+)$", 1).cast("long")
    name = F.concat(F.lit("V"), F.pmod(k, F.lit(25)).cast("string"))
    portfolio = F.when(F.pmod(k, F.lit(3)) > 0, F.concat(F.lit(" Portfolio: P"), F.pmod(k, F.lit(5)).cast("string"), F.lit(". "))).otherwise(" ")
    said = F.when(F.col("domain_raw") == "venture", F.concat(F.lit("Venture: "), name, F.lit(" (x)"), portfolio)).when(F.pmod(k, F.lit(4)) == 0, F.concat(F.lit("Noted in venture "), name, F.lit(": "))).otherwise("")
    return t.memories.withColumn("content", F.concat(said, "content"))


def _roster(t: Tables) -> DataFrame:
    return t.people.select("person").unionByName(t.agent_actions.select(F.col("agent_id").alias("person"))).distinct()


def _recall(t: Tables, **options) -> DataFrame:
    return re_.recall(t.memories, t.memory_entities, t.entities, _query_vector(t), TERMS, **options)


def _retired_edges(t: Tables) -> DataFrame:
    produced = t.customer.filter("c_custkey % 3 <> 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    return kn.retired(t.entity_edges, produced, "MEMBER_OF", NOW)


def _reopened(t: Tables) -> DataFrame:
    return kn.new_open_edges(t.entity_edges.select("src_id", "relation", "dst_id"), t.entity_edges)


def _mirror_links(t: Tables) -> DataFrame:
    links = t.memory_entities.select(F.when(F.pmod(F.length("memory_id"), F.lit(2)) == 0, "en").otherwise("fr").alias("namespace"), "memory_id", "entity_id")
    return kn.mirrored(t.entities.select(F.lit("en").alias("namespace"), "name"), links, t.entities.limit(0).select(F.lit("en").alias("namespace"), "name"), me.live(t.memories))[1]


def _applied(t: Tables) -> DataFrame:
    current = me.live(t.memories).filter("embedding is not null")
    return me.applied(current, me.planned_writes(_batch(t), current))


def _ordered_batch(t: Tables) -> DataFrame:
    """Four writes about each 25th live row, in turns: near copies, their copies, denials, and the row itself again, some by its ref."""
    k = F.regexp_extract("id", "([0-9]+)$", 1).cast("long")
    m = me.live(t.memories).filter("embedding is not null").withColumn("k", k).filter("k % 25 = 0").withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(3))))
    content = F.when(F.col("v") < 2, F.concat("content", F.lit(" more"))).when(F.col("v") == 2, F.concat(F.lit("no longer "), F.col("content"))).otherwise(F.col("content"))
    nudge = F.when(F.col("v") < 2, 0.3).when(F.col("v") == 2, 0.1).otherwise(0.0)
    return m.select(
        (F.col("v").cast("long") * 1_000_000_000 + F.col("k")).alias("seq"), F.concat(F.lit("w"), F.col("v").cast("string"), F.lit("-"), "id").alias("id"), "namespace",
        F.when((F.col("v") > 1) & (F.col("k") % 3 == 0), F.col("source_ref")).alias("source_ref"), content.alias("content"),
        _nudged(nudge).alias("embedding"), "valid_at", F.lit(0.4).alias("importance"),
    )


def _ordered(t: Tables) -> DataFrame:
    return ow.write_batch_ordered(_ordered_batch(t), me.live(t.memories)).select("id", "decision", F.when(F.col("decision") != "add", F.col("target_id")).alias("target_id"))


def _ordered_state(t: Tables) -> DataFrame:
    new, current = _ordered_batch(t), me.live(t.memories)
    return ow.state_after(new, current, ow.write_batch_ordered(new, current))


def _by_ref(t: Tables) -> DataFrame:
    new = t.documents.select(
        F.concat(F.lit("new"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("namespace"), F.concat(F.lit("doc:"), F.floor(F.col("doc_id") / 2.0).cast("string")).alias("source_ref")
    )
    return me.planned_by_ref(new, me.live(t.memories))


def _usernames(t: Tables) -> DataFrame:
    people = t.people.groupBy("person").agg(F.collect_list(F.upper("login")).alias("usernames"))
    return ro.commits_of_usernames(t.github_commits, people)


def _scoped(t: Tables) -> DataFrame:
    return me.live(t.memories, me.searchable(t.grants, "a1", ["en", "de"])).select("id", "namespace")


def _post_memories(t: Tables) -> DataFrame:
    return mp.as_memories(_mapping(t).select(F.regexp_replace("ref_id", "^db:order:", "").alias("ref_id"), "event_time", "content"), "post_threads", "en")


def _nation_people(t: Tables) -> DataFrame:
    lists = mp.children_list(t.supplier, "s_nationkey", F.col("s_name"))
    content = F.concat(F.col("n_name"), F.lit(": "), F.coalesce("items", F.lit("nobody")))
    return t.nation.join(lists, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("n_nationkey").cast("long").alias("ref_id"), content.alias("content"))


TABLE_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    # Views
    "v_feature_daily": lambda t: an.feature_daily(t.feature_events),
    "v_dau": lambda t: an.dau(t.feature_events, t.transition_events),
    "v_wau": lambda t: an.wau(t.feature_events, t.transition_events),
    "v_feature_adoption_weekly": lambda t: an.feature_adoption_weekly(t.feature_events),
    "v_user_activity": lambda t: an.user_activity(t.feature_events, t.dim_users),
    "v_top_paths": lambda t: an.top_paths(t.feature_events),
    "v_venture_activity_daily": lambda t: an.venture_activity_daily(t.feature_events, t.agent_actions, t.dim_ventures),
    "v_venture_totals": lambda t: an.venture_totals(t.dim_ventures, t.feature_events, t.agent_actions),
    "v_commits_repo_weekly": lambda t: an.commits_repo_weekly(t.github_commits),
    "v_commits_author_daily": lambda t: an.commits_author_daily(t.github_commits),
    "v_commit_hour_heatmap": lambda t: an.commit_hour_heatmap(t.github_commits),
    "v_pr_throughput_weekly": lambda t: an.pr_throughput_weekly(t.github_pull_requests),
    "v_claude_daily": lambda t: an.claude_daily(t.claude_activity_events),
    "v_claude_by_actor": lambda t: an.claude_by_actor(t.claude_activity_events, t.dim_users),
    "v_claude_sessions": lambda t: an.claude_sessions(t.claude_activity_events),
    "v_agent_actions_daily": lambda t: an.agent_actions_daily(t.agent_actions, t.dim_ventures),
    "v_issue_activity_daily": lambda t: an.issue_activity_daily(t.issue_activity),
    "v_notifications_daily": lambda t: an.notifications_daily(t.notifications),
    "top_repos_30d": lambda t: an.top_repos(t.github_commits),
    "dau_last_14d": lambda t: an.dau_last(t.feature_events, t.transition_events),
    "feature_this_vs_earlier": lambda t: an.feature_this_vs_earlier(t.feature_events),
    "tokens_per_day": lambda t: an.tokens_per_day(t.claude_activity_events),
    "top_ventures": lambda t: an.top_ventures(t.dim_ventures, t.feature_events, t.agent_actions),
    # Memory plane
    "live_memories": lambda t: me.live(t.memories, ["en", "fr"]).select("id", "namespace", "importance", "valid_at"),
    "recall_filters_types": lambda t: me.filtered(me.live(t.memories), types=["post", "item"]).select("id", "domain_raw"),
    "recall_exclude_kinds": lambda t: me.filtered(me.live(t.memories), exclude_kinds=["src1", "src7"]).select("id", "source_kind"),
    "recall_since_until": lambda t: me.filtered(me.live(t.memories), since=dt.datetime(2024, 1, 5), until=dt.datetime(2024, 1, 20)).select("id", "valid_at"),
    "recall_as_of": lambda t: me.live(t.memories, as_of=AS_OF).select("id", "valid_at", "invalid_at"),
    "dedup_source_ref": lambda t: me.superseded_by_ref(me.live(t.memories)).drop("metadata"),
    "dedup_source_kind": _emptied_refs,
    "classify_prefixed": _prefixed,
    "dedup_forget_metadata": lambda t: me.forget_metadata(me.live(t.memories), "duplicate"),
    "classify_memory": lambda t: me.classified(t.memories),
    "norm_text": lambda t: t.documents.select("doc_id", F.sha2(tx.norm_text(F.col("text")), 256).alias("norm_sha"), F.length(tx.norm_text(F.col("text"))).alias("norm_chars")),
    "negation_cues": lambda t: t.documents.select("doc_id", tx.has_negation(F.when(F.pmod("doc_id", F.lit(9)) == 0, F.concat(F.lit("That Was WRONG. "), "text")).otherwise(F.col("text"))).alias("negates")),
    "brain_stats": lambda t: me.stats(t.memories, t.memory_events, t.entities, t.memory_entities, NOW, resolved=["q3", "q7"]),
    "namespaces": lambda t: me.namespaces(t.memories),
    "brain_detail_types": lambda t: me.histogram(t.memories, "en", "type"),
    "brain_detail_sources": lambda t: me.histogram(t.memories, "en", "source"),
    "brain_detail": lambda t: me.detail(t.memories, t.memory_events, "en"),
    "activity_log": lambda t: me.activity_log(t.memory_events, 50, "en", "searches"),
    "gap_upsert": lambda t: me.gaps(t.memory_events),
    "gaps_ranked": lambda t: me.gaps_ranked(t.memory_events, resolved=["q3", "q7"], limit=60),
    "acl_readable_memories": lambda t: me.readable(t.memories, t.grants, "a1").select("id", "namespace"),
    "write_decision": _write_decision,
    "apply_writes_current_state": _apply_writes,
    "access_stats": lambda t: me.access_stats(t.memory_events),
    # Retrieval
    "ann_topk": _ann,
    "nearest_neighbor_pairs": _neighbor_pairs,
    "bm25_topk": lambda t: term_index(t).ranking(TERMS, 40),
    "bm25_indexed": lambda t: _index_after_writes(t).ranking(TERMS, 40),
    "recall_hybrid_rrf": lambda t: re_.fused(me.live(t.memories), _query_vector(t), TERMS, index=term_index(t)).select("id", "score"),
    "recall_full": lambda t: _recall(t, namespaces=["en"], expand=True, order_by="recent"),
    "recall_full_window": lambda t: _recall(
        t, namespaces=["en", "de"], types=["post", "doc", "item"], exclude_kinds=["src1"], since=dt.datetime(2024, 1, 3), until=dt.datetime(2024, 1, 20), min_importance=0.2, limit=6, expand=True
    ),
    "recall_full_as_of": lambda t: _recall(t, as_of=AS_OF, order_by="oldest", limit=10, expand=True),
    "recall_vector_fallback": lambda t: re_.vector_fallback(me.live(t.memories), _query_vector(t)),
    "search_cross_brain": lambda t: re_.search(me.live(t.memories, _SEARCHED), _query_vector(t), TERMS, index=term_index(t), namespaces=_SEARCHED).select("id", "namespace", "score"),
    "recall_min_importance": lambda t: re_.fused(me.live(t.memories), _query_vector(t), TERMS, limit=40, min_importance=0.5).select("id", "importance", "score"),
    "recall_order_recent": lambda t: re_.by_time(re_.fused(me.live(t.memories), _query_vector(t), TERMS)).select("id", "valid_at"),
    "recall_rerank": _hashed_rerank,
    "expand_entities": _expand,
    "entity_lookup": lambda t: re_.entity_lookup(t.memories, t.memory_entities, t.entities, "nation_1", _query_vector(t), TERMS, namespaces=["en"], limit=20),
    "entity_lookup_fallback": lambda t: re_.entity_lookup(t.memories, t.memory_entities, t.entities, "nowhere", _query_vector(t), TERMS, namespaces=["en"]),
    "entity_memories": lambda t: re_.memories_of_entity(me.live(t.memories), t.memory_entities, t.entities, "nation_1"),
    # Graph
    "graph_neighbors": lambda t: gr.neighbors(t.entity_edges, t.entities, "NATION_3"),
    "graph_neighbors_as_of": lambda t: gr.neighbors(t.entity_edges, t.entities, "NATION_3", as_of=AS_OF),
    "graph_traverse_out": lambda t: gr.traverse(t.entity_edges, t.entities, "Customer#000000007", direction="out"),
    "graph_traverse_in": lambda t: gr.traverse(t.entity_edges, t.entities, "ASIA", direction="in", depth=2, types=["agent", "venture"]),
    "graph_traverse_both": lambda t: gr.traverse(t.entity_edges, t.entities, "Supplier#000000003", direction="both", depth=3, limit=200),
    "graph_traverse_as_of": lambda t: gr.traverse(t.entity_edges, t.entities, "NATION_3", as_of=AS_OF, relations=["MEMBER_OF", "BELONGS_TO"]),
    "graph_shortest_path": lambda t: gr.shortest_path(t.entity_edges, t.entities, "Customer#000000007", "Customer#000000002"),
    "graph_spine": lambda t: gr.spine(t.entity_edges, t.entities, "nation_7"),
    "graph_spine_by_id": lambda t: gr.spine(t.entity_edges, t.entities, "n7"),
    "graph_spine_asked_roles": lambda t: gr.spine(t.entity_edges, t.entities, "NATION_7", roles=("venture", "nobody", "repo"), per_group=3),
    "graph_spine_candidates": lambda t: gr.root_candidates(t.entities, "nation_2"),
    "graph_spine_window": _spine_window,
    "graph_communities": lambda t: gr.label_propagation(t.entity_edges, t.entities),
    "community_leads": lambda t: gr.communities(gr.label_propagation(t.entity_edges, t.entities), t.entities),
    "graph_degree": lambda t: gr.degrees(gr.open_edges(t.entity_edges)),
    "graph_sample_quota": lambda t: gr.sample_by_quota(t.entity_edges, t.entities),
    "graph_sample_edges": lambda t: gr.edges_between(t.entity_edges, gr.sample_by_quota(t.entity_edges, t.entities), 12000),
    "graph_type_counts": lambda t: gr.type_counts(t.entities),
    "graph_relation_counts": lambda t: gr.relation_counts(t.entity_edges),
    "graph_cooccurrence": lambda t: gr.cooccurrence(t.memory_entities, t.entities),
    "derived_mindmap": lambda t: gr.mindmap(t.memories),
    "venture_graph_nodes": lambda t: gr.venture_graph(_ventures_said(t), "en", 200)[0],
    "venture_graph_edges": lambda t: gr.venture_graph(_ventures_said(t), "en", 200)[1],
    "graph_sample_fallback": lambda t: gr.sample_edges(t.entity_edges.filter("relation = 'COMMITS_TO'"), t.entities.filter("entity_type in ('venture', 'person')"), t.memory_entities, 100),
    "ontology_to_register": lambda t: on.to_register(t.declared_types, t.declared_relations, t.entities, t.entity_edges),
    "ontology_counts": lambda t: gr.ontology_counts(t.declared_types, t.entities),
    "ontology_undeclared": lambda t: gr.undeclared(t.declared_types, t.entities),
    "ontology_reconciled": lambda t: on.reconciled(t.declared_types, t.entities),
    "fk_edge_families": lambda t: on.family_edges(lambda name: getattr(t, name)),
    "fk_edge_provenance": lambda t: ro.provenance(on.family_edges(lambda name: getattr(t, name), ["DISCUSSED_IN", "AGENT_DISCUSSED_IN", "TARGETS", "ATTENDED"])),
    "attended_with": lambda t: on.together(t.events.select((F.floor(F.col("event_id") / 4)).alias("meeting"), "user_id"), "meeting", "user_id"),
    "edge_endpoint_types": lambda t: gr.endpoint_types(t.entity_edges, t.entities),
    "hop_trace": lambda t: gr.hop_trace(t.entity_edges, t.entities, "NATION_7"),
    # Rollups
    "rollup_repo_weekly": lambda t: ro.repo_weekly(t.github_commits, t.people),
    "rollup_person_weekly": lambda t: ro.person_weekly(t.github_commits, t.people),
    "rollup_claude_person_weekly": lambda t: ro.claude_person_weekly(t.claude_activity_events),
    "rollup_studio_weekly": lambda t: ro.studio_weekly(t.github_commits, t.people, t.claude_activity_events),
    "leaderboard_weekly": lambda t: ro.leaderboard_weekly(t.github_commits, t.people),
    "leaderboard_idle": lambda t: ro.leaderboard_idle(t.github_commits, t.people, _roster(t)),
    "rollup_studio_claude_weekly": lambda t: ro.studio_claude_weekly(t.claude_activity_events),
    "rollup_org_monthly": lambda t: ro.org_monthly(t.github_commits, t.people),
    "rollup_studio_monthly": lambda t: ro.studio_monthly(t.github_commits, t.github_pull_requests, t.claude_activity_events, t.issue_activity),
    "productivity_person_week": lambda t: ro.productivity_person_week(t.github_commits, t.people, t.claude_activity_events, t.user_people),
    "ai_spend_weekly": lambda t: ro.ai_spend_weekly(t.claude_activity_events),
    "used_ai_on_edges": lambda t: ro.used_ai_on(t.claude_activity_events, t.part.select(F.col("p_brand").alias("repo")).distinct()),
    "repo_link_cascade": lambda t: ro.repo_links(t.repositories, t.venture_sites, t.organisations),
    "pr_activity_digest": lambda t: ro.pr_digest(t.github_pull_requests),
    "thread_digest": lambda t: ro.thread_digest(t.conversations),
    "agent_week_digest": lambda t: ro.agent_week_digest(t.agent_actions),
    "rollup_changed_only": _changed,
    "prune_stale_refs": _stale,
    "venture_trace": lambda t: gr.venture_trace(
        t.entity_edges.unionByName(t.trace_edges), t.entities.unionByName(t.trace_nodes), t.memory_entities.withColumn("entity_id", F.regexp_replace("entity_id", "^n", "feed")), "ion_3", dt.datetime(2024, 2, 20)
    ),
    "coverage_report": lambda t: rd.coverage_report(t.github_commits, t.repo_links.filter("url_venture in ('v0', 'v4')").select(F.upper("repo").alias("repo")), NOW),
    "coverage_gap": lambda t: ro.coverage_gap(t.github_commits, t.repo_links.filter("org = 'org0' and url_venture = 'v5'")),
    "edge_provenance_classify": _provenance,
    "episodes_latest": lambda t: ro.episodes(t.memories),
    "rollup_activity_nodes": lambda t: kn.rollup_nodes(_rollup_docs(t)),
    "rollup_activity_edges": lambda t: kn.rollup_edges(_rollup_docs(t), t.memories.withColumn("source_ref", F.concat(F.lit("rollup:studio-ai:"), "id"))),
    "rollup_edges_restamped": _restamped,
    "organized_edges": lambda t: kn.organized(t.business_rows, t.business_rows.filter("id % 9 <> 4"), t.memories, "doc:"),
    "rollup_docs_repo": lambda t: rd.repo_weeks(t.github_commits, t.people, NOW),
    "rollup_docs_productivity": lambda t: rd.productivity_weeks(t.github_commits, t.people, t.claude_activity_events, t.user_people, NOW),
    "rollup_docs_ai_spend": lambda t: rd.ai_spend_weeks(t.claude_activity_events, NOW),
    "used_ai_on_facts": lambda t: ro.used_ai_on_facts(t.claude_activity_events, t.part.select(F.col("p_brand").alias("repo")).distinct(), t.user_people),
    "rollup_docs_person": lambda t: rd.person_weeks(t.github_commits, t.people, NOW),
    "rollup_docs_ai_person": lambda t: rd.ai_person_weeks(t.claude_activity_events, t.user_people, NOW),
    "rollup_docs_studio": lambda t: rd.studio_weeks(t.github_commits, t.people, t.claude_activity_events, NOW),
    "rollup_docs_leaderboard": lambda t: rd.leaderboards(t.github_commits, t.people, _roster(t), NOW),
    "rollup_docs_studio_ai": lambda t: rd.studio_ai_weeks(t.claude_activity_events, NOW),
    "rollup_docs_org": lambda t: rd.org_months(t.github_commits, t.people, NOW),
    "rollup_docs_studio_month": lambda t: rd.studio_months(t.github_commits, t.github_pull_requests, t.claude_activity_events, t.issue_activity, NOW),
    # Tending the graph and the memories
    "graph_candidates": lambda t: kn.candidates(t.entities, "nation_1"),
    "graph_spine_roles": lambda t: kn.roles_of(gr.spine(t.entity_edges, t.entities, "nation_7")).select("role", "total", "shown", "place"),
    "graph_labels": _labels,
    "graph_activity_nodes": lambda t: kn.activity_nodes(
        ro.repo_weekly(t.github_commits, t.people).withColumn("repo", F.regexp_extract("source_ref", "([^:]+)$", 1)), "repo"
    ),
    "feed_nodes": _feeds,
    "meeting_title_match": _titles,
    "rollup_relink": _relink,
    "stale_edges_retired": _retired_edges,
    "edges_to_open": _reopened,
    "mirror_links": _mirror_links,
    "provenance_stats": lambda t: kn.provenance_stats(_provenance(t)),
    "brain_facets": lambda t: kn.facets(me.live(t.memories), ["namespace", "source_kind", "domain_raw"]),
    "search_scoped": _scoped,
    "write_decision_by_ref": _by_ref,
    "write_applied": _applied,
    "ingest_best_effort": _ingested,
    "states_dau": lambda t: st.daily_users(_user_states(t)),
    "states_wau": lambda t: st.weekly_users(_user_states(t)),
    "states_dau_14d": lambda t: st.last_days(_user_states(t), 14),
    "states_pr_medians": _pr_medians,
    "write_batch_ordered": _ordered,
    "write_batch_state": _ordered_state,
    "memory_forget": lambda t: me.forgotten(t.memories, t.memories.filter("importance > 0.85").select("id"), "outdated", NOW),
    "coverage_share": lambda t: ro.cwd_coverage(t.claude_activity_events),
    "commits_by_username": _usernames,
    # Mappings and digests
    "mapping_memories": _post_memories,
    "mapping_nation_people": _nation_people,
    "deployment_digest": lambda t: mp.deployment_digest(t.agent_actions, "venture_id", "agent_id", F.col("kind") == "signup"),
    "pulse_survey_digest": lambda t: mp.survey_digest(_answers(t)),
    "doc_collection": lambda t: mp.document_files(_doc_files(t)),
    "code_shortlist": lambda t: mp.code_shortlist(_files(t)),
    "repository_overview": lambda t: mp.repository_overview(_files(t)),
    "repository_overview_documents": lambda t: rd.repository_overviews(_files(t), _repo_docs(t), _heads(t)),
    "etl_stats": lambda t: etl.stats(
        etl.watermark(t.events, "events", "ts", NOW, "full")
        .unionByName(etl.watermark(t.github_pull_requests, "pulls", "created_at", NOW, "full")).unionByName(etl.watermark(t.agent_actions, "actions", "created_at", NOW, "full"))
    ),
    # Sources
    "html_to_text": lambda t: co.page_documents(t.pages, cap=None).select(F.col("ref"), F.sha2("content", 256).alias("content_sha"), F.length("content").alias("n_chars"), "title"),
    "chunk_text": lambda t: ch.chunked(t.documents, "doc_id", "text"),
    "md_chunks": lambda t: ch.chunked(t.documents.select("doc_id", F.regexp_replace("text", "(?m)^(\\w+)\\.$", "# $1").alias("text")), "doc_id", "text", ch.markdown_chunks),
    "pack_chunks": lambda t: ch.chunked(t.documents.select("doc_id", F.concat(F.lit("## File: src/a.go\n"), "text", F.lit("\n## File: b.go\nfunc b() {}\n")).alias("text")), "doc_id", "text", functools.partial(ch.code_chunks, per_file=None)),
    "sql_rows_to_documents": lambda t: co.rows_as_documents(t.customer, "c_custkey", "c_name").select("ref", "title", "content", "metadata"),
    "mapping_orders": _mapping,
    "mapping_customer_orders": _mapping_top_list,
    "secret_screen": _secret_screen,
    "incremental_upsert": _incremental,
    "late_data_dedupe": _late,
    "etl_watermark": lambda t: etl.watermark(t.events, "events", "ts", NOW, "full"),
    # Streaming
    "stream_monthly": lambda t: refresh.monthly_events(t.spark, f"{t.sf_dir}/events*.parquet"),
    "stream_tumbling_weekly": lambda t: refresh.weekly_events(t.spark, f"{t.sf_dir}/events*.parquet"),
    "stream_tumbling_daily": lambda t: refresh.daily_events(t.spark, f"{t.sf_dir}/events*.parquet"),
}


def _business(t: Tables) -> Callable[[str], DataFrame]:
    """The business tables; all but two are one table here, which has the columns of each."""
    return lambda name: getattr(t, name) if name in ("portfolio_aliases", "feature_flags") else t.business_rows


def _entity_query(name: str) -> Callable[[Tables], DataFrame]:
    return lambda t: ed.entity_memories(_business(t), name, "studio", NOW)


TABLE_QUERIES |= {f"mapping_{name}": _entity_query(name) for name in ed.ENTITIES}

# The texts of the test table are short, so what counts as substance is little here.
_LEAST = {"issue_threads": {"least": 10}, "chat_threads": {"least": 12}, "pulse_anonymous": {"least": 7}, "pulse_surveys": {"least_anonymous": 7}}


def _digest_query(name: str) -> Callable[[Tables], DataFrame]:
    return lambda t: eg.digest_memories(_business(t), name, "studio", **_LEAST.get(name, {}))


TABLE_QUERIES |= {f"mapping_{name}": _digest_query(name) for name in eg.DIGESTS}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def of(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: build(Tables(spark, sf_dir))

    return {name: of(build) for name, build in TABLE_QUERIES.items()}
