"""Building and tending the graph: labels, activity and feed nodes, title matches, relinking, retirement."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metadata import value
from ..functions.vectors import hashed_embedding
from .rollups import top_list

# The order in which roles are shown; others follow by name.
ROLE_ORDER = (
    "portfolio", "venture", "repo", "person", "agent", "activity", "feed", "channel", "goal", "okr", "roadmap", "code_module", "doc", "learning", "issue",
    "meeting", "campaign",
)


def ntz(t: dt.datetime) -> Column:
    return F.lit(t).cast("timestamp_ntz")


def role_order(role: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(r) for r in ROLE_ORDER]), role)
    return F.when(at > 0, at).otherwise(len(ROLE_ORDER) + 1).cast("int")


def roles_of(spine: DataFrame) -> DataFrame:
    """One row per role of a spine: its total, what is shown of it, and its place."""
    by = spine.groupBy("role").agg(F.max("total").alias("total"), F.count(F.lit(1)).alias("shown"))
    return by.withColumn("place", role_order(F.col("role"))).orderBy("place", "role")


def candidates(entities: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Entities whose name contains a text, case aside: portfolios and ventures first, then the shortest name."""
    hub = F.col("entity_type").isin("portfolio", "venture")
    found = entities.filter(F.contains(F.lower("name"), F.lit(text.lower())))
    return found.orderBy(hub.desc(), F.length("name"), "name").limit(limit).select("name", "entity_type")


def disambiguated(nodes: DataFrame) -> DataFrame:
    """Names that several kinds share get their kind as a suffix; of one kind the smallest id has the name."""
    one = nodes.groupBy("name", "kind").agg(F.min("id").alias("id"))
    kinds = F.count(F.lit(1)).over(Window.partitionBy("name"))
    label = F.when(kinds > 1, F.concat("name", F.lit(" ("), "kind", F.lit(")"))).otherwise(F.col("name"))
    return one.select("id", "kind", label.alias("label"))


def activity_nodes(rollup: DataFrame, subject: str) -> DataFrame:
    """A node and an edge to its subject for each row of a rollup: one per subject and period."""
    node = F.concat_ws(":", F.lit("activity"), F.col(subject), F.col("period"))
    return rollup.select(
        node.alias("src"), F.lit("ACTIVITY_OF").alias("relation"), F.col(subject).alias("dst"), F.col("commits").alias("weight")
    )


def _activity(docs: DataFrame) -> DataFrame:
    """Rollups' documents with their node: those with a scope that is a repository, a person, an organisation or the studio."""
    kind, subject = F.substring_index("scope", ":", 1), F.expr("if(instr(scope, ':') > 0, substring(scope, instr(scope, ':') + 1), scope)")
    signal = F.when(F.split_part("source_ref", F.lit(":"), F.lit(2)).rlike("^(ai|studio-ai)"), "AI").otherwise("commits")
    out = docs.filter(kind.isin("repo", "person", "org", "studio") & (F.coalesce("period", F.lit("")) != ""))
    return out.withColumns({"id": F.concat(F.lit("activity:"), "source_ref"), "kind": kind, "subject": subject, "name": F.concat(subject, F.lit(" · "), "period", F.lit(" "), signal)})


def rollup_nodes(docs: DataFrame) -> DataFrame:
    """A node per rollup's document, of every scope: id, name, entity_type, subject, source_ref."""
    return _activity(docs).select("id", "name", F.lit("activity").alias("entity_type"), "subject", "source_ref")


def rollup_edges(docs: DataFrame, memories: DataFrame) -> DataFrame:
    """ACTIVITY_OF a person and ACTIVITY_IN a repository: src, relation, dst, since, weight, memory_id (the live memory of the document's ref, the newest)."""
    newest = memories.filter("invalid_at is null and source_ref is not null").groupBy("source_ref").agg(F.max_by("id", F.struct("valid_at", "id")).alias("memory_id"))
    relation = F.when(F.col("kind") == "person", "ACTIVITY_OF").when(F.col("kind") == "repo", "ACTIVITY_IN")
    weight = F.coalesce(value(F.col("metadata"), "commits", "double"), value(F.col("metadata"), "events", "double"), F.lit(0.0))
    edges = _activity(docs).select("source_ref", F.col("id").alias("src"), relation.alias("relation"), F.col("subject").alias("dst"), F.col("valid_at").alias("since"), weight.alias("weight"))
    return edges.filter("relation is not null").join(newest, "source_ref", "left").drop("source_ref")


def restamped(edges: DataFrame, memories: DataFrame) -> DataFrame:
    """Open edges (with source_ref and memory_id) that cite another memory than the newest live one of their ref, as they should be."""
    newest = memories.filter("invalid_at is null and source_ref is not null").groupBy("source_ref").agg(F.max_by("id", F.struct("valid_at", "id")).alias("now_id"))
    stale = edges.filter("valid_to is null").join(newest, "source_ref").filter(~F.col("memory_id").eqNullSafe(F.col("now_id")))
    return stale.withColumn("memory_id", F.col("now_id")).select(*edges.columns)


def feed_nodes(posts: DataFrame, channels: DataFrame) -> DataFrame:
    """Posts by venture, else by their channel's venture, else 'studio': how many, the three commonest kinds, the authors."""
    at = posts.join(channels.select("channel", F.col("venture_id").alias("channel_venture")), "channel", "left")
    at = at.withColumn("venture", F.coalesce("venture_id", "channel_venture", F.lit("studio")))
    kinds = at.groupBy("venture", "kind").agg(F.count(F.lit(1)).alias("n"))
    top = kinds.groupBy("venture").agg(F.sum("n").alias("posts")).join(top_list(kinds, ["venture"], "kind", "n", 3, "kinds"), "venture")
    authors = at.groupBy("venture").agg(F.countDistinct("author").alias("authors"))
    return top.join(authors, "venture").select(F.concat(F.lit("feed:"), "venture").alias("feed"), "posts", "kinds", "authors")


def _collapsed(c: Column) -> Column:
    """Letters and digits alone, lower case."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def title_matches(titles: DataFrame, ventures: DataFrame) -> DataFrame:
    """Titles that name exactly one venture.

    A venture's tokens are its id and name, collapsed, of four characters or more, unless another venture
    has the token, too.  A title names it by a word, or, for tokens of five or more, anywhere in
    the collapsed title: then by one of the title's substrings of the tokens' lengths, so that this is
    an equi-join as well.
    """
    tokens = ventures.select("id", F.explode(F.array_distinct(F.array(_collapsed(F.col("id")), _collapsed(F.col("name"))))).alias("token"))
    own = tokens.filter(F.length("token") >= 4).groupBy("token").agg(F.countDistinct("id").alias("k"), F.min("id").alias("venture_id")).filter("k = 1").drop("k")
    # The distinct lengths of names: a handful.
    lengths = sorted(r["n"] for r in own.select(F.length("token").alias("n")).distinct().collect())
    whole = _collapsed(F.coalesce("title", F.lit("")))
    parts = [F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))]
    for n in (n for n in lengths if n >= 5):
        starts = F.when(F.length(whole) >= n, F.sequence(F.lit(1), F.length(whole) - n + 1)).otherwise(F.array().cast("array<int>"))
        parts.append(_pieces(whole, starts, n))
    named = titles.select("id", F.explode(F.array_distinct(F.concat(*parts))).alias("token")).join(own, "token")
    by = named.groupBy("id").agg(F.countDistinct("venture_id").alias("k"), F.min("venture_id").alias("venture_id"))
    return by.filter("k = 1").select("id", F.lit("MEETING_ABOUT").alias("relation"), "venture_id")


def organized(events: DataFrame, people: DataFrame, memories: DataFrame, prefix: str = "db:event:") -> DataFrame:
    """Owners of meetings and the meetings: src, relation, dst, since, name, memory_id.

    An owner that ``people`` (id, display_name, email) lacks makes no edge.  The edge cites the memory of the meeting's ref, a live one before a retired one and then the newest.
    """
    name = F.coalesce(F.nullif(F.col("display_name"), F.lit("")), F.col("email"))
    owners = people.select(F.col("id").cast("string").alias("src"), name.alias("name"))
    cited = memories.filter("source_ref is not null").groupBy("source_ref").agg(F.max_by("id", F.struct(F.col("invalid_at").isNull(), "valid_at", "id")).alias("memory_id"))
    held = events.select(F.col("owner_id").cast("string").alias("src"), F.col("id").cast("string").alias("dst"), F.col("start_at").alias("since"), F.concat(F.lit(prefix), F.col("id").cast("string")).alias("source_ref"))
    return held.join(owners, "src").join(cited, "source_ref", "left").select("src", F.lit("ORGANIZED").alias("relation"), "dst", "since", "name", "memory_id")


def _pieces(text: Column, starts: Column, n: int) -> Column:
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))


def retired(edges: DataFrame, produced: DataFrame, relation: str, now: dt.datetime) -> DataFrame:
    """Open edges of a relation whose source this run hasn't produced, closed at ``now``."""
    stale = edges.filter((F.col("relation") == relation) & F.col("valid_to").isNull())
    gone = stale.join(produced.select(F.col("id").alias("src_id")), "src_id", "left_anti")
    return gone.select("src_id", "relation", "dst_id", "valid_from", ntz(now).alias("valid_to"))


def relinked(rollups: DataFrame, entities: DataFrame, have: DataFrame) -> DataFrame:
    """Links from rollups to the entities that their metadata names (scope, person, repo, ranking), that are missing."""
    shape = "scope string, person string, repo string, ranking array<string>, zeroCommit array<string>"
    m = rollups.select("source_ref", F.from_json("metadata", shape).alias("m"))
    names = F.array_compact(F.concat(F.array("m.scope", "m.person", "m.repo"), F.coalesce("m.ranking", F.array().cast("array<string>")), F.coalesce("m.zeroCommit", F.array().cast("array<string>"))))
    wanted = m.select("source_ref", F.explode(names).alias("name")).select("source_ref", F.lower(F.trim("name")).alias("low")).distinct()
    known = entities.select(F.lower(F.trim("name")).alias("low"), F.col("id").alias("entity_id"))
    return wanted.join(known, "low").select("source_ref", "entity_id").join(have, ["source_ref", "entity_id"], "left_anti")


def mirrored(parsed: DataFrame, links: DataFrame, entities: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities to insert, links to insert): names that are not there yet; links whose memory exists."""
    new = parsed.select("namespace", "name").distinct().join(entities.select("namespace", "name"), ["namespace", "name"], "left_anti")
    held = links.join(memories.select("namespace", F.col("id").alias("memory_id")), ["namespace", "memory_id"], "left_semi")
    return new, held.distinct()


def embedded_facts(edges: DataFrame, embed=None) -> DataFrame:
    """Edges without a fact embedding get one; ``embed`` is a column function, by default the hashing one."""
    embed = embed or (lambda c: hashed_embedding(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))
    return edges.withColumn("embedding", F.coalesce("embedding", embed(F.col("fact"))))


def provenance_stats(classified: DataFrame) -> DataFrame:
    return classified.groupBy("relation", "kind").agg(F.count(F.lit(1)).alias("edges"), F.sum("records").alias("records"))


def new_open_edges(wanted: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges to add: those that aren't open already (a closed one may open again)."""
    there = edges.filter("valid_to is null").select("src_id", "relation", "dst_id")
    return wanted.distinct().join(there, ["src_id", "relation", "dst_id"], "left_anti")


def facets(memories: DataFrame, columns: Sequence[str], important: float = 0.7) -> DataFrame:
    """Values of each column with their rows, and how many of those are important."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return (
        memories.select(pairs.alias("p"), "importance").filter("p.value is not null").groupBy("p.facet", "p.value")
        .agg(F.count(F.lit(1)).alias("memories"), F.count_if(F.col("importance") >= important).alias("important"))
    )
