"""The entity graph: neighbours, walks, paths, communities, spines, samples, ontology.

Edges have src_id, dst_id, relation, valid_from, valid_to; entities id, name, entity_type.  A walk
over both directions is an equi-join with the edges and their mirror image, never a join on
"source or target".  Walks are loops of at most a few joins; each level keeps a node's nearest
arrival only, so they do not multiply paths.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged

# How many nodes of a type a sample takes at most; other types share what the limit leaves.
QUOTAS = {
    "portfolio": 500, "venture": 500, "person": 500, "agent": 500, "repo": 500, "channel": 500, "campaign": 500, "goal": 200, "okr": 200, "roadmap": 200,
    "code_module": 200, "doc": 100, "feed": 80, "issue": 80, "learning": 60, "activity": 60, "meeting": 60,
}
HUBS = ("repo", "venture", "feed")
TIME_ROLES = ("activity", "meeting", "channel", "feed")


def open_edges(edges: DataFrame, as_of: dt.datetime | None = None) -> DataFrame:
    if as_of is None:
        return edges.filter("valid_to is null")
    at = F.lit(as_of).cast("timestamp_ntz")
    return edges.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def steps(edges: DataFrame, direction: str = "both") -> DataFrame:
    """x -> y along the direction: out, in or both."""
    out = edges.select(F.col("src_id").alias("x"), F.col("dst_id").alias("y"), "relation", "valid_from")
    back = edges.select(F.col("dst_id").alias("x"), F.col("src_id").alias("y"), "relation", "valid_from")
    return {"out": lambda: out, "in": lambda: back, "both": lambda: out.unionByName(back)}[direction]()


def neighbors(edges: DataFrame, entities: DataFrame, name: str, as_of: dt.datetime | None = None) -> DataFrame:
    live = open_edges(edges, as_of)
    source = entities.select(F.col("id").alias("src_id"), F.col("name").alias("src"))
    target = entities.select(F.col("id").alias("dst_id"), F.col("name").alias("dst"))
    # Only edges that touch the node meet the entities.
    node = entities.filter(F.col("name") == name).select("id")
    touching = live.join(F.broadcast(node.select(F.col("id").alias("src_id"))), "src_id", "left_semi").unionByName(
        live.join(F.broadcast(node.select(F.col("id").alias("dst_id"))), "dst_id", "left_semi").select(*live.columns)
    )
    return touching.distinct().join(source, "src_id").join(target, "dst_id").select("src", "relation", "dst", "valid_from", "valid_to")


def _depth(depth: int | None, default: int, most: int, reset: int) -> int:
    return default if not depth or depth < 1 else reset if depth > most else depth


def reachable(walk: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """id, depth, path of every node within ``depth`` steps: the nearest arrival, ties by path.

    Each level joins the frontier with the steps and drops nodes seen before, so a level has at most as
    many rows as there are nodes.  Every second level is written, so a plan holds two levels at most.
    """
    frontier = start.select("id", F.lit(0).alias("depth"), F.array("id").alias("path"))
    seen = frontier
    for d in range(1, depth + 1):
        reached = frontier.join(walk.select(F.col("x").alias("id"), "y"), "id").select(
            F.col("y").alias("id"), F.concat("path", F.array("y")).alias("path")
        )
        best = reached.groupBy("id").agg(F.min("path").alias("path"))
        frontier = best.join(seen, "id", "left_anti").select("id", F.lit(d).alias("depth"), "path")
        if d % 2 == 0 and d < depth:
            frontier = staged(frontier, "frontier")
        seen = seen.unionByName(frontier)
    return seen


def traverse(
    edges: DataFrame,
    entities: DataFrame,
    name: str,
    *,
    depth: int = 2,
    direction: str = "both",
    relations: Sequence[str] = (),
    types: Sequence[str] = (),
    as_of: dt.datetime | None = None,
    limit: int = 100,
) -> DataFrame:
    """Nodes near one, nearest first.  Relations limit the walk, types only the result."""
    live = open_edges(edges, as_of)
    if relations:
        live = live.filter(F.col("relation").isin(*relations))
    start = entities.filter(F.col("name") == name).select("id")
    seen = reachable(steps(live, direction), start, min(max(depth, 1), 6)).filter("depth > 0")
    out = seen.select("id", "depth").join(entities, "id")
    if types:
        out = out.filter(F.col("entity_type").isin(*types))
    out = out.select("name", "entity_type", "depth", F.round(1.0 / (1 + F.col("depth")), 6).alias("distance"))
    return out.orderBy("depth", "name").limit(100 if limit > 500 or limit < 1 else limit)


def shortest_path(edges: DataFrame, entities: DataFrame, source: str, target: str, depth: int | None = 4) -> DataFrame:
    """One row: names along a shortest path and its hops; null and -1 where there is none in reach.

    The walk over nodes ends as soon as the target is seen; of equal paths the first by ids is taken.
    """
    depth = _depth(depth, 4, 6, 4)
    walk = steps(open_edges(edges), "both").select("x", "y").distinct()
    start = entities.filter(F.col("name") == source).select("id")
    goal = entities.filter(F.col("name") == target).select("id")
    seen = reachable(walk, start, depth).join(F.broadcast(goal), "id", "left_semi")
    named = (
        seen.select("depth", F.posexplode("path").alias("i", "id")).join(entities.select("id", "name"), "id")
        .groupBy("depth").agg(F.array_sort(F.collect_list(F.struct("i", "name"))).alias("p"))
    )
    found = named.select(F.array_join(F.transform("p", lambda e: e["name"]), " > ").alias("path"), F.col("depth").alias("hops"))
    none = edges.sparkSession.sql("select cast(null as string) path, -1 hops")
    return found.unionByName(none).orderBy(F.desc("hops")).limit(1)


#: So many steps of one node go to one task; a node with more is dealt out in parts.
HUB = 50_000


def dealt(walk: DataFrame, hub: int = HUB) -> tuple[DataFrame, DataFrame]:
    """Steps (x, y, ...) with a part, and y, parts of the nodes whose steps have several: as many as keep a part to about ``hub`` steps.

    There are at most steps / ``hub`` such nodes.
    """
    hubs = staged(walk.groupBy("y").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hub).select("y", F.ceil(F.col("n") / hub).cast("int").alias("parts")), "hubs")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("x"), F.col("parts"))).cast("int")
    return walk.join(hubs, "y", "left").withColumn("part", part).drop("parts"), hubs


def heard(steps_in_parts: DataFrame, hubs: DataFrame, said: DataFrame) -> DataFrame:
    """Each step with what its far end says (``said``: y and further columns): a hub says it to each of its parts."""
    parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    return steps_in_parts.join(said.join(hubs, "y", "left").withColumn("part", F.explode(parts)).drop("parts"), ["y", "part"])


def label_propagation(edges: DataFrame, entities: DataFrame, iterations: int = 8, *, hub: int = HUB) -> DataFrame:
    """id, label after a fixed number of synchronous rounds.

    A node takes the label that most of its edges' other ends have, the smallest of equals;
    parallel edges weigh.  A node without edges keeps its own.  Steps to a hub are dealt out in parts once; votes are summed in each task before they
    meet, so a hub's own votes are a row per label and task.
    """
    iterations = 20 if iterations > 20 else iterations
    walk = steps(open_edges(edges), "both").select("x", "y")
    walk = staged(walk.groupBy("x", "y").agg(F.count(F.lit(1)).alias("weight")), "steps")
    adjacency, hubs = dealt(walk, hub)
    adjacency = staged(adjacency, "adjacency")
    labels = entities.select("id", F.col("id").alias("label"))
    for _ in range(iterations):
        votes = heard(adjacency, hubs, labels.withColumnRenamed("id", "y")).groupBy(F.col("x").alias("id"), "label").agg(F.sum("weight").alias("votes"))
        won = votes.groupBy("id").agg(F.min(F.struct((-F.col("votes")).alias("v"), "label")).alias("w"))
        labels = staged(
            labels.select("id", F.col("label").alias("old")).join(won, "id", "left").select("id", F.coalesce("w.label", "old").alias("label")),
            "labels",
        )
    return labels


def communities(labels: DataFrame, entities: DataFrame) -> DataFrame:
    """Labels of more than one node: size, and the lead, a portfolio before a venture before a name."""
    order = F.struct(
        F.when(F.col("entity_type") == "portfolio", 0).when(F.col("entity_type") == "venture", 1).otherwise(2).alias("o"), "name"
    )
    by = labels.join(entities, "id").groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("lead"))
    return by.filter("size > 1").select("label", "size", F.concat(F.lit("cluster: "), F.col("lead.name")).alias("name"))


def root_of(entities: DataFrame, text: str) -> DataFrame:
    """The one node that a text names: by its name, else its id, else its name in another case, there the shortest; then the smallest id."""
    hit = (F.col("name") == text) | (F.lower("name") == text.lower()) | (F.col("id") == text)
    by = [F.coalesce(F.col("name") == text, F.lit(False)).desc(), (F.col("id") == text).desc(), F.length("name"), "id"]
    return entities.filter(hit).orderBy(*by).limit(1).select("id")


def root_candidates(entities: DataFrame, text: str, k: int = 10) -> DataFrame:
    """What a text that names no node may have meant: names that contain it, case aside, portfolios and ventures and short ones first."""
    return (
        entities.filter(F.contains(F.lower("name"), F.lit(text.lower())))
        .orderBy(F.coalesce(F.col("entity_type").isin("portfolio", "venture"), F.lit(False)).desc(), F.length("name"), "name")
        .limit(k).select("name", "entity_type")
    )


def spine(
    edges: DataFrame,
    entities: DataFrame,
    name: str,
    *,
    roles: Sequence[str] = (),
    depth: int = 2,
    per_group: int = 10,
    window: tuple[dt.datetime, dt.datetime] | None = None,
    hubs: Sequence[str] = HUBS,
    time_types: Sequence[str] = TIME_ROLES,
) -> DataFrame:
    """What surrounds a node (see ``root_of``), by role: true totals and the first items of each role.

    ``roles``, where given, are the only ones that are shown; one without any node is a row with a total of 0 and no item.
    Past the first step only hub types are walked on.  A time window applies to the edge that reaches a
    node of a time role, before the best arrival is chosen.

    A level holds nodes, not paths.  A walk that comes back to a node reaches what follows by the same edge as a shorter one, which is better;
    so only returns to a node whose own arrivals the window may have ruled out (a hub of a time role) must be avoided, and
    only those nodes are remembered along a walk.
    """
    depth, per_group = min(max(depth, 1), 4), min(max(per_group, 1), 200)
    walk = steps(edges.filter("valid_to is null"), "both").select(F.col("x").alias("id"), "y", "relation", F.col("valid_from").alias("at"))
    typed = entities.select("id", F.col("entity_type").alias("type"))
    remembered = [t for t in hubs if window is not None and t in time_types]
    root = root_of(entities, name)
    frontier = root.select(F.col("id").alias("root"), "id", F.slice(F.array("id"), 1, 0).alias("been"))
    arrivals = None
    for d in range(1, depth + 1):
        if d > 1:
            frontier = frontier.join(typed, "id").filter(F.col("type").isin(*hubs))
            if remembered:
                been = F.array_sort(F.concat("been", F.array("id")))
                frontier = frontier.withColumn("been", F.when(F.col("type").isin(*remembered), been).otherwise(F.col("been")))
            frontier = frontier.select("root", "id", "been").distinct()
        reached = frontier.join(walk, "id").filter((F.col("y") != F.col("root")) & ~F.array_contains("been", F.col("y")))
        reached = staged(reached.select("root", F.col("y").alias("id"), "been", F.lit(d).alias("depth"), "relation", "at").distinct(), "spine")
        arrivals = reached if arrivals is None else arrivals.unionByName(reached)
        frontier = reached.select("root", "id", "been").distinct()
    out = arrivals.join(typed, "id")
    if window is not None:
        since, until = (F.lit(t).cast("timestamp_ntz") for t in window)
        out = out.filter(~F.col("type").isin(*time_types) | F.col("at").between(since, until))
    # Nearest arrival, then the latest edge, then the relation's name.
    best = out.groupBy("id", "type").agg(
        F.min(F.struct("depth", F.col("at").isNull().alias("unknown"), (-F.unix_timestamp(F.col("at").cast("timestamp"))).alias("t"), "relation")).alias("b")
    )
    best = best.select("id", F.col("type").alias("role"), F.col("b.depth").alias("depth"), F.col("b.relation").alias("relation"))
    totals = best.groupBy("role").agg(F.count(F.lit(1)).alias("total"))
    # The bound on the rank lets Spark drop all but a role's first rows before it shuffles.
    rank = F.row_number().over(Window.partitionBy("role").orderBy("depth", "name"))
    shown = best.join(entities.select("id", "name"), "id").withColumn("rank", rank).filter(F.col("rank") <= per_group)
    if not roles:
        return shown.join(totals, "role").select("role", "total", "rank", "name", "depth", "relation")
    asked = edges.sparkSession.createDataFrame([(r,) for r in dict.fromkeys(roles)], "role string")
    counted = asked.join(totals, "role", "left").select("role", F.coalesce("total", F.lit(0)).cast("long").alias("total"))
    return counted.join(shown, "role", "left").select("role", "total", "rank", "name", "depth", "relation")


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("src_id").alias("id")).unionByName(edges.select(F.col("dst_id").alias("id")))
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def sample_by_quota(edges: DataFrame, entities: DataFrame, quotas: dict[str, int] = QUOTAS, *, limit: int = 3000) -> DataFrame:
    """The best-connected nodes of each type, up to the type's quota, then up to the limit."""
    limit = 3000 if limit < 1 else min(limit, 8000)
    typed = entities.withColumn("entity_type", F.coalesce(F.nullif("entity_type", F.lit("")), F.lit("entity")))
    types = typed.agg(F.countDistinct("entity_type")).scalar()
    quota = F.greatest(F.lit(20), F.floor(limit / types)).cast("long")
    for name, n in sorted(quotas.items()):
        quota = F.when(F.col("entity_type") == name, n).otherwise(quota)
    ranked = (
        typed.join(degrees(open_edges(edges)), "id", "left")
        .withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("entity_type").orderBy(F.desc("degree"), "name")))
    )
    # The fixed bound lets Spark drop all but the first rows of a type before it shuffles for the ranks.
    ranked = ranked.filter(F.col("rank") <= max(limit, *quotas.values()))
    kept = ranked.filter(F.col("rank") <= quota).orderBy(F.desc("degree"), "entity_type", "name").limit(limit)
    return kept.select("id", "name", "entity_type", "degree")


def edges_between(edges: DataFrame, kept: DataFrame, limit: int) -> DataFrame:
    """Edges whose both ends are kept."""
    ids = kept.select("id")
    both = (
        open_edges(edges).join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi")
        .join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    )
    return both.select("src_id", "relation", "dst_id").orderBy("src_id", "relation", "dst_id").limit(limit)


def type_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity_type").agg(F.count(F.lit(1)).alias("nodes"))


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("valid_to").isNull()).alias("open"))


#: Members of a group are paired in blocks of about so many.
BLOCK = 2_000


def paired(rows: DataFrame, group: str, member: str, block: int = BLOCK) -> DataFrame:
    """a, b (a < b) of each group: a row per group and pair.

    Members of a large group stand in blocks, by a hash; each pair of blocks is a key of its own, so a group of any size is many tasks of at
    most about ``block`` squared pairs.
    """
    held = rows.select(F.col(group).alias("g"), F.col(member).alias("m")).filter("g is not null and m is not null").distinct()
    large = held.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("g", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    cut = held.join(large, "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("k", F.pmod(F.xxhash64("m"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = cut.select("g", F.col("m").alias("a"), F.col("k").alias("i"), others.alias("j"))
    b = cut.select("g", F.col("m").alias("b"), others.alias("i"), F.col("k").alias("j"))
    return a.join(b, ["g", "i", "j"]).filter("a < b").select("a", "b")


def _smallest(rows: DataFrame, group: str, member: str, k: int) -> DataFrame:
    """Of each group its k smallest members: enough for its k - 1 first pairs."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(member))
    return rows.select(group, member).distinct().withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


def top_pairs(rows: DataFrame, group: str, member: str, most: int, block: int = BLOCK, seeds: int = 200) -> DataFrame:
    """The ``most`` pairs of members that share most groups: a, b, n; equal counts by a and b.  Exact, without all pairs.

    A pair shares no more groups than either member has.  Counting among the ``seeds`` most frequent members gives a count that the
    last of the top pairs has at least; members with fewer groups are left out.  Pairs that share one group only are made from each group's smallest members.
    """
    held = staged(rows.select(F.col(group).alias("g"), F.col(member).alias("m")).filter("g is not null and m is not null").distinct(), "pair-members")
    often = staged(held.groupBy("m").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "pair-counts")
    count = lambda some: paired(some, "g", "m", block).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    by = [F.desc("n"), "a", "b"]
    first = often.orderBy(F.desc("n"), "m").limit(seeds).select("m")
    seen = [r["n"] for r in count(held.join(first, "m", "left_semi")).orderBy(*by).limit(most).select("n").collect()]  # ``most`` numbers
    floor = max(2, seen[-1] if len(seen) == most else 0)
    many = count(held.join(often.filter(F.col("n") >= floor), "m", "left_semi")).filter(F.col("n") >= floor)
    if floor > 2:
        return many.orderBy(*by).limit(most)
    # Too few pairs may share two groups or more; then those of one group follow, the smallest first.
    few = count(_smallest(held, "g", "m", most + 1)).join(many.select("a", "b"), ["a", "b"], "left_anti").withColumn("n", F.lit(1).cast("long"))
    return many.unionByName(few.select(*many.columns)).orderBy(*by).limit(most)


def cooccurrence(memory_entities: DataFrame, entities: DataFrame, most: int = 50, block: int = BLOCK) -> DataFrame:
    """Pairs of entities that memories mention together, those most often."""
    top = top_pairs(memory_entities, "memory_id", "entity_id", most, block).withColumnRenamed("n", "memories")
    name = lambda c: entities.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    return top.join(name("a"), "a").join(name("b"), "b").select("a_name", "b_name", "memories")


def sample_edges(edges: DataFrame, kept: DataFrame, memory_entities: DataFrame, limit: int) -> DataFrame:
    """Edges between the nodes of a sample, at most four times its limit; if there are none, the first pairs that memories mention together."""
    kept = staged(kept.select("id"), "kept-nodes")
    between = staged(edges_between(edges, kept, 4 * limit), "kept-edges")
    if not between.isEmpty():
        return between
    held = memory_entities.join(kept.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    pairs = paired(_smallest(held, "memory_id", "entity_id", limit + 1), "memory_id", "entity_id").distinct()
    return pairs.select(F.col("a").alias("src_id"), F.lit("").alias("relation"), F.col("b").alias("dst_id")).orderBy("src_id", "dst_id").limit(limit)


def _label(chars: int, *keys: str) -> Column:
    """What a memory is called: the first of these keys of its metadata, else its content."""
    from ..functions.text import squeezed

    return squeezed(F.coalesce(*[F.nullif(F.get_json_object("metadata", f"$.{k}"), F.lit("")) for k in keys], F.col("content")), chars)


def mindmap(memories: DataFrame, per_type: int = 4) -> DataFrame:
    """Namespace, domain type, number of live memories, and the labels (slug, path or content) of a few."""
    from ..functions.text import domain_type

    per_type = min(max(per_type, 4), 20)
    live = memories.filter("invalid_at is null").select(
        "namespace", domain_type(F.col("domain_raw")).alias("type"), _label(48, "slug", "path").alias("label"), "id"
    )
    by = Window.partitionBy("namespace", "type")
    shown = live.withColumn("rank", F.row_number().over(by.orderBy("id"))).filter(F.col("rank") <= per_type)
    totals = live.groupBy("namespace", "type").agg(F.count(F.lit(1)).alias("total"))
    return shown.join(totals, ["namespace", "type"]).select("namespace", "type", "total", "rank", "label")


def venture_graph(memories: DataFrame, namespace: str, limit: int = 3000) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name, group) and edges (source, target) read out of a namespace's live texts.

    root, its portfolios and their ventures ('Venture: X', 'Portfolio: Y' in texts of type venture; without one 'unassigned'); the newest
    ``limit`` memories that say 'in venture X' of a known X; and the 30 commonest types with a few of their newest memories each.
    """
    from ..functions.text import domain_type

    live = memories.filter(F.col("invalid_at").isNull() & (F.col("namespace") == namespace)).withColumn("type", domain_type(F.col("domain_raw")))
    grab = lambda pattern: F.nullif(F.trim(F.regexp_extract("content", pattern, 1)), F.lit(""))
    ventures = live.filter("type = 'venture'").select(
        grab(r"Venture: ([^(\n]+)").alias("venture"), F.coalesce(grab("Portfolio: ([A-Za-z0-9_ -]+)"), F.lit("unassigned")).alias("portfolio")
    ).filter("venture is not null").distinct()
    others = live.filter("type <> 'venture'")
    newest = [F.desc("valid_at"), F.asc("id")]
    linked = others.filter(F.col("content").contains("in venture ")).orderBy(*newest).limit(limit).select(
        "id", "type", grab(r" in venture ([^:.\n]+)").alias("venture"), _label(44).alias("name")
    ).join(ventures.select("venture").distinct(), "venture", "left_semi")
    types = others.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").limit(30)
    rank = F.row_number().over(Window.partitionBy("type").orderBy(*newest))
    few = others.withColumn("rank", rank).filter(F.col("rank") <= min(max(limit // 10, 8), 40)).join(F.broadcast(types.select("type")), "type", "left_semi")
    few = few.select("id", "type", _label(44, "slug", "path", "file").alias("name"))
    pre = lambda p, c: F.concat(F.lit(p), F.col(c))
    entity = pre("ent:", "id")
    nodes = (
        memories.sparkSession.range(1).select(F.lit("root").alias("id"), F.lit(namespace).alias("name"), F.lit("root").alias("group"))
        .unionByName(ventures.select(pre("pf:", "portfolio").alias("id"), F.col("portfolio").alias("name"), F.lit("portfolio").alias("group")).distinct())
        .unionByName(ventures.select(pre("v:", "venture").alias("id"), F.col("venture").alias("name"), F.lit("venture").alias("group")).distinct())
        .unionByName(types.select(pre("type:", "type").alias("id"), F.concat("type", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("name"), F.lit("type").alias("group")))
        .unionByName(linked.select(entity.alias("id"), "name", F.col("type").alias("group")))
        # A memory that is linked to a venture keeps the name it has there.
        .unionByName(few.join(linked.select("id"), "id", "left_anti").select(entity.alias("id"), "name", F.col("type").alias("group")))
    )
    edge = lambda df, a, b: df.select(a.alias("source"), b.alias("target"))
    edges = (
        edge(ventures.select("portfolio").distinct(), F.lit("root"), pre("pf:", "portfolio"))
        .unionByName(edge(ventures, pre("pf:", "portfolio"), pre("v:", "venture"))).unionByName(edge(linked, pre("v:", "venture"), entity))
        .unionByName(edge(types, F.lit("root"), pre("type:", "type"))).unionByName(edge(few, pre("type:", "type"), entity))
    )
    return nodes, edges


def ontology_counts(declared: DataFrame, entities: DataFrame) -> DataFrame:
    """Nodes of every declared type, also those without any."""
    counted = type_counts(entities).withColumnRenamed("entity_type", "name")
    return declared.join(counted, "name", "left").select("name", F.coalesce("nodes", F.lit(0)).cast("long").alias("nodes"))


def undeclared(declared: DataFrame, entities: DataFrame) -> DataFrame:
    names = declared.select(F.col("name").alias("entity_type"))
    return type_counts(entities.filter("entity_type is not null")).join(names, "entity_type", "left_anti")


def endpoint_types(edges: DataFrame, entities: DataFrame, dominance: float = 0.95) -> DataFrame:
    """For each relation the types of the ends of its live edges: one if it has at least ``dominance``, else all by count."""
    of = lambda end: entities.select(F.col("id").alias(f"{end}_id"), F.col("entity_type").alias(end))
    typed = edges.filter("valid_to is null").join(of("src"), "src_id").join(of("dst"), "dst_id")
    # Relations x types: a small table, folded once per end.
    counts = typed.groupBy("relation", "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    ends = counts.select("relation", "n", F.explode(F.array(*[F.struct(F.lit(e).alias("end"), F.col(e).alias("type")) for e in ("src", "dst")])).alias("e"))
    per_type = ends.groupBy("relation", "e.end", "e.type").agg(F.sum("n").alias("n"))
    by = per_type.groupBy("relation", "end").agg(
        F.sum("n").alias("edges"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "type"))).alias("all")
    )
    first = F.col("all")[0]
    joined = F.array_join(F.transform("all", lambda x: x["type"]), "|")
    said = by.withColumn("types", F.when(-first["o"] / F.col("edges") >= dominance, first["type"]).otherwise(joined))
    pick = lambda end: F.max(F.when(F.col("end") == end, F.col("types"))).alias(f"{end}_types")
    return said.groupBy("relation").agg(F.max("edges").alias("edges"), pick("src"), pick("dst"))


def hop_trace(edges: DataFrame, entities: DataFrame, name: str) -> DataFrame:
    """Relations of one node, with how many nodes each reaches, and how many those reach in turn."""
    walk = steps(open_edges(edges), "both")
    node = entities.filter(F.col("name") == name).select(F.col("id").alias("x"))
    first = walk.join(F.broadcast(node), "x").select("relation", F.col("y").alias("x"), F.col("x").alias("root")).distinct()
    ones = first.groupBy("relation").agg(F.count(F.lit(1)).alias("first_hop"))
    twos = (
        first.withColumnRenamed("relation", "first").join(walk.select("x", "y"), "x").filter("y <> root").select("first", "y").distinct()
        .groupBy(F.col("first").alias("relation")).agg(F.count(F.lit(1)).alias("second_hop"))
    )
    return ones.join(twos, "relation", "left").select("relation", "first_hop", F.coalesce("second_hop", F.lit(0)).cast("long").alias("second_hop"))


# What is counted at a venture, by relation, and which of its ends the venture is; then what is counted at those.
FIRST_HOPS = (
    ("portfolio", "BELONGS_TO"), ("repos", "REPO_OF"), ("members", "MEMBER_OF"), ("goals", "GOAL_FOR"), ("roadmaps", "PLANS"), ("okrs", "TARGETS"),
    ("learnings", "APPLIES_TO"), ("channels", "CHANNEL_OF"), ("meetings", "MEETING_ABOUT"), ("agents", "WORKS_ON"), ("feed", "FEED_OF"),
)
SECOND_HOPS = (
    ("repos", "code_modules", "CODE_IN"), ("repos", "docs", "DOC_IN"), ("repos", "committers", "COMMITS_TO"), ("repos", "repo_activity", "ACTIVITY_IN"),
    ("members", "member_activity", "ACTIVITY_OF"), ("feed", "feed_authors", "POSTED_IN"),
)


def venture_trace(edges: DataFrame, entities: DataFrame, mentions: DataFrame, needle: str, now: dt.datetime, days: int = 14) -> DataFrame:
    """How much hangs on one venture, hop by hop: place, after (the step before), step, n, a row for each step, with 0 where there is nothing.

    The venture is the one of the shortest name that contains the text, case aside; without one the result is empty.  First steps count
    known nodes at open edges of the venture, second steps nodes at open edges of those, ``recent_activity`` the members' activity that began
    in the last days, ``feed_posts`` the mentions (entity_id) of its feeds.  Repeated edges count once.
    """
    root = (
        entities.filter((F.col("entity_type") == "venture") & F.contains(F.lower("name"), F.lit(needle.lower())))
        .orderBy(F.length("name"), "name", "id").limit(1).select(F.col("id").alias("root"), F.col("name").alias("venture"))
    )
    step_of = {relation: step for step, relation in FIRST_HOPS}
    live = open_edges(edges).select("src_id", "dst_id", "relation", "valid_from")
    # Each relation has the venture at one end: it belongs to a portfolio, all else points to it.
    ends = live.filter(F.col("relation").isin(*step_of)).select(
        F.when(F.col("relation") == "BELONGS_TO", F.col("src_id")).otherwise(F.col("dst_id")).alias("root"),
        F.when(F.col("relation") == "BELONGS_TO", F.col("dst_id")).otherwise(F.col("src_id")).alias("node"), _named(F.col("relation"), step_of).alias("step"),
    )
    near = ends.join(F.broadcast(root.select("root")), "root").select("node", "step").distinct()
    first = near.join(entities.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    second = live.filter(F.col("relation").isin(*[r for _, _, r in SECOND_HOPS])).select(
        F.col("dst_id").alias("node"), F.col("src_id").alias("far"), "valid_from",
        _named(F.col("relation"), {r: after for after, _, r in SECOND_HOPS}).alias("step"), _named(F.col("relation"), {r: s for _, s, r in SECOND_HOPS}).alias("next"),
    )
    since = F.lit(now - dt.timedelta(days=days)).cast("timestamp_ntz")
    # One row a far node, whichever of the first nodes it hangs on.
    reached = second.join(first, ["node", "step"]).groupBy("next", "far").agg(F.max("valid_from").alias("newest"))
    twos = reached.groupBy("next").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("newest") > since).alias("recent"))
    posts = mentions.join(first.filter("step = 'feed'").select(F.col("node").alias("entity_id")), "entity_id", "left_semi")
    counted = (
        first.groupBy("step").agg(F.count(F.lit(1)).alias("n"))
        .unionByName(twos.select(F.col("next").alias("step"), "n"))
        .unionByName(twos.filter("next = 'member_activity'").select(F.lit("recent_activity").alias("step"), F.col("recent").alias("n")))
        .unionByName(posts.agg(F.count(F.lit(1)).alias("n")).select(F.lit("feed_posts").alias("step"), "n"))
    )
    plan = [("venture", step) for step, _ in FIRST_HOPS] + [(after, step) for after, step, _ in SECOND_HOPS] + [("members", "recent_activity"), ("feed", "feed_posts")]
    wanted = root.select("venture", F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(a).alias("after"), F.lit(s).alias("step")) for i, (a, s) in enumerate(plan)])).alias("w")).select("venture", "w.*")
    return wanted.join(counted, "step", "left").select("venture", "place", "after", "step", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _named(c: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for value, name in names.items():
        out = F.when(c == value, name).otherwise(out)
    return out
