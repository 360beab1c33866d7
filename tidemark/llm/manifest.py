"""Operator 13, Merkle dataset manifest: iterative levels of a hash tree over all rows, with a proof for each row.

A row's leaf is the SHA-256 of its fields (``-`` for null, else UTF-8 byte count, ``:``, value).  In each group (language) leaves are numbered
in the order of their ids, every ``fanout`` consecutive nodes are hashed into a parent, until one node is left: the subroot.  The subroots, ordered by
group (null first, bytewise), make the root by the same code.  Digests enter a hash as lowercase hex text; tables hold 32 bytes.

* Numbers come without a window over a whole group: rows are range-partitioned by (group, id, leaf) and staged with their partition,
  ``row_number`` counts within (partition, group), and counts per partition and group give the first number of each.
* A level is a ``groupBy`` of (group, number div fanout) with at most ``fanout`` children in a sorted array, written to the shared folder.
* Proofs are made from the top: each level's join hands a node's path to its children, a child adding what stands left and right of
  it in its run.  So a path is made once per node and not once per row and level, and rows are not shuffled but as parts of their first run.

``folded`` recomputes a root from a leaf and a path.  ``changed`` compares a table with its manifest.

Nulls in any column, and empty and very long texts, have the leaf stated above.  Rows may repeat: each is a leaf; rows with equal ids are ordered by their leaf, null ids come
first.  An empty table gives an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, shuffle_width, staged

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left: binary, right: binary>>"


def text_of(digest: Column) -> Column:
    """A digest as it enters hashes and results: lowercase hex."""
    return F.lower(F.hex(digest))


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row's values, 32 bytes."""
    said = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*said), 256))


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (key, position, digest, ...) with their number in the key, from 0, and the key's total."""
    rows = staged(rows.withColumn("_at", F.monotonically_increasing_id()), name)
    dealt = rows.repartitionByRange(shuffle_width(rows.sparkSession), "key", "position", "digest", "_at")
    dealt = staged(dealt.withColumn("_part", F.spark_partition_id()), name)
    counts = dealt.groupBy("_part", "key").agg(F.count(F.lit(1)).alias("_n"))
    # A row per partition and key that meet.
    by = Window.partitionBy("key")
    counts = counts.withColumns({"_first": F.sum("_n").over(by.orderBy("_part")) - F.col("_n"), "total": F.sum("_n").over(by)})
    within = F.row_number().over(Window.partitionBy("_part", "key").orderBy("position", "digest", "_at")) - 1
    out = dealt.withColumn("_rank", within).join(counts.drop("_n"), ["_part", "key"])
    return out.withColumn("index", F.col("_first") + F.col("_rank")).drop("_part", "_rank", "_first", "_at", "position")


def _runs(nodes: DataFrame, fanout: int, kept: Sequence[str]) -> DataFrame:
    """Parents of nodes: key, total, index, the children in order, their digests one after the other, the parent's digest."""
    child = F.struct((F.col("index") % fanout).cast("int").alias("at"), "digest", *kept)
    runs = nodes.groupBy("key", "total", F.floor(F.col("index") / fanout).alias("index")).agg(F.sort_array(F.collect_list(child)).alias("children"))
    runs = runs.withColumn("run", F.aggregate("children", F.lit(b""), lambda a, c: F.concat(a, c["digest"])))
    # A group of one row is its own subroot.
    return runs.withColumn("digest", F.when(F.col("total") == 1, F.col("children")[0]["digest"]).otherwise(F.unhex(F.sha2(text_of(F.col("run")), 256))))


def _tree(rows: DataFrame, fanout: int, kept: Sequence[str], name: str) -> list[DataFrame]:
    """The levels of all keys' trees over ``rows`` (key, position, digest and the columns ``kept``), lowest first."""
    nodes = _numbered(rows, name)
    levels = [staged(_runs(nodes, fanout, kept), name)]
    most = levels[0].agg(F.max("total")).first()[0] or 0
    while most > fanout ** len(levels):
        wide = fanout ** len(levels)
        levels.append(staged(_runs(levels[-1].filter(F.col("total") > wide).select("key", "total", "index", "digest"), fanout, ()), name))
    return levels


def _tops(levels: list[DataFrame], fanout: int) -> DataFrame:
    """key, digest of each key's last node."""
    made = [x.filter((F.col("total") <= fanout ** (k + 1)) & ((F.col("total") > fanout**k) | F.lit(k == 0))) for k, x in enumerate(levels)]
    out = made[0].select("key", "digest")
    for x in made[1:]:
        out = out.unionByName(x.select("key", "digest"))
    return out


def _paths(levels: list[DataFrame], starts: DataFrame, fanout: int, kept: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """Every leaf with its path: ``starts`` has key, path and the columns ``carried`` of each key's last node."""
    heads = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        ending = (F.col("total") <= fanout ** (k + 1)) & ((F.col("total") > fanout**k) | F.lit(k == 0))
        here = level.filter(ending).join(starts, "key")
        if heads is not None:
            here = here.unionByName(level.filter(F.col("total") > fanout ** (k + 1)).join(heads, ["key", "index"]))
        child = here.select("key", "index", "total", "run", "path", *carried, F.explode("children").alias("c"))
        at = F.col("c.at")
        beside = F.struct(F.substring("run", F.lit(1), at * 32).alias("left"), F.substring("run", at * 32 + 33, F.lit(32 * fanout)).alias("right"))
        path = F.when(F.col("total") == 1, F.col("path")).otherwise(F.concat(F.array(beside).cast(PATH), "path")).alias("path")
        if k:
            heads = child.select("key", (F.col("index") * fanout + at).alias("index"), path, *carried)
        else:
            return child.select("key", F.col("c.digest").alias("digest"), *[F.col(f"c.{x}").alias(x) for x in kept], path, *carried)


def manifest(
    docs: DataFrame,
    *,
    fields: Sequence[str] = FIELDS,
    id_col: str = "doc_id",
    group_col: str = "lang",
    fanout: int = 8,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot, root (bytes) and its path; and the columns ``carry``, made of the row while it is read."""
    carry = carry or {}
    values = [F.col(f"`{f}`") for f in fields]
    group = F.col(f"`{group_col}`").cast("string")
    # Null before all texts, the empty one too.
    key = F.coalesce(F.concat(F.lit("="), group), F.lit(""))
    position = F.col(f"`{id_col}`")
    rows = docs.select(key.alias("key"), position.alias("position"), position.alias("doc_id"), leaf(values).alias("digest"), *[c.alias(f"_{n}") for n, c in carry.items()])
    kept = ["doc_id", *[f"_{n}" for n in carry]]
    lower = _tree(rows, fanout, kept, "manifest")
    tops = _tops(lower, fanout).withColumnRenamed("key", "member")
    upper = _tree(tops.select(F.lit("").alias("key"), F.col("member").alias("position"), "digest", "member"), fanout, ["member"], "manifest-top")
    whole = _tops(upper, fanout).select("key", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    starts = staged(_paths(upper, whole, fanout, ["member"], ["root"]), "manifest-top")
    starts = starts.select(F.col("member").alias("key"), F.col("digest").alias("subroot"), "root", "path")
    out = _paths(lower, starts, fanout, kept, ["subroot", "root"])
    return out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", *[F.col(f"_{n}").alias(n) for n in carry])


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its path give, as text."""
    return F.aggregate(path, text_of(digest), lambda a, s: F.sha2(F.concat(text_of(s["left"]), a, text_of(s["right"])), 256))


def proof(path: Column) -> Column:
    """The digest of all siblings on a path, as text."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(text_of(s["left"]), text_of(s["right"]))), ""), 256)


def changed(entries: DataFrame, docs: DataFrame, *, fields: Sequence[str] = FIELDS, id_col: str = "doc_id") -> DataFrame:
    """doc_id and what became of it, of rows that a table and its manifest don't share: 'changed', 'missing' or 'new'.

    Rows that share an id are compared as a multiset of leaves, so a repeated row that went is missing.
    """
    now = docs.select(F.col(f"`{id_col}`").alias("doc_id"), leaf([F.col(f"`{f}`") for f in fields]).alias("leaf"), F.lit(1).alias("n"))
    both = entries.select("doc_id", "leaf", F.lit(-1).alias("n")).unionByName(now)
    differ = both.groupBy("doc_id", "leaf").agg(F.sum("n").alias("n")).filter("n <> 0")
    sides = differ.groupBy("doc_id").agg(F.count_if(F.col("n") < 0).alias("was"), F.count_if(F.col("n") > 0).alias("is"))
    kind = F.when(F.col("was") == 0, "new").when(F.col("is") == 0, "missing").otherwise("changed")
    return sides.select("doc_id", kind.alias("what"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    values = [F.translate(F.col(c), UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    out = manifest(docs, carry={"tampered": F.when(chosen, leaf(values))})
    found = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    out = out.select("doc_id", text_of(F.col("leaf")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), text_of(F.col("root")).alias("root"),
                     proof(F.col("path")).alias("proof_sha256"), found.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_SAID = "coalesce(strlen(cast({0} as varchar)) || ':' || cast({0} as varchar), '-')"
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"""
_LEAF = "sha256(" + " || ".join(_SAID.format(c) for c in FIELDS[:-1]) + " || {0})"
_LEVELS = """{up} as (
    select {key}, 0 as level, list(digest order by {by}) as nodes from {rows} group by all
    union all
    select {key}, level + 1, list_transform(range(0, len(nodes), 8), lambda i: sha256(array_to_string(nodes[i + 1:i + 8], ''))) from {up} where len(nodes) > 1)"""
_RUN = "nodes[u.n // 8 * 8 + 1:u.n] as l, nodes[u.n + 2:u.n // 8 * 8 + 8] as r"

OP13_SQL = f"""
with recursive crc as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as t),
d as (select doc_id, lang, {_LEAF.format(_SAID.format("text"))} as digest,
        case when {_CRC} % 3 = 0 then {_LEAF.format(_SAID.format(f"translate(text, '{UPPER}', '{LOWER}')"))} end as tampered from documents, crc),
leaves as (select *, coalesce('=' || lang, '') as key, row_number() over (partition by lang order by doc_id nulls first, digest) - 1 as n from d),
{_LEVELS.format(up="low", key="key", by="n", rows="leaves")},
subroots as (select key, nodes[1] as digest, row_number() over (order by key) - 1 as n from low where len(nodes) = 1),
{_LEVELS.format(up="high", key="1 as k", by="n", rows="subroots").replace("select 1 as k, level + 1", "select k, level + 1")},
whole as (select nodes[1] as root from high where len(nodes) = 1),
up as (
    select doc_id, key, digest as leaf, tampered, n as first, 0 as level, n, coalesce(tampered, digest) as folded, '' as proof, 'low' as tree from leaves
    union all
    select doc_id, key, leaf, tampered, first, level, n,
           case when size = 1 then folded else sha256(array_to_string(l, '') || folded || array_to_string(r, '')) end,
           case when size = 1 then proof else proof || array_to_string(l, '') || array_to_string(r, '') end, tree
    from (
        select u.doc_id, u.key, leaf, tampered, first, folded, proof, len(nodes) as size, {_RUN},
               case when len(nodes) = 1 then 0 else u.level + 1 end as level, case when len(nodes) = 1 then s.n else u.n // 8 end as n,
               case when len(nodes) = 1 then 'high' else 'low' end as tree
        from up u join low on low.key = u.key and low.level = u.level join subroots s on s.key = u.key where u.tree = 'low'
        union all
        select u.doc_id, u.key, leaf, tampered, first, folded, proof, len(nodes) as size, {_RUN}, u.level + 1, u.n // 8, 'high'
        from up u join high on high.level = u.level where u.tree = 'high' and len(nodes) > 1)),
proved as (select doc_id, key, leaf, proof, folded from up where tree = 'high' and level = (select max(level) from high))
select doc_id, leaf, s.digest as subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified
from proved join subroots s using (key), whole
"""
