"""Operator 6, exact dedup: skew-safe combining of digest groups.

Three combining stages, each of which compares the full text and not only its digest:

1. local: every task folds the rows it has read by (digest, salt, text) before it sends any
   (the partial aggregate below the first exchange);
2. salted: rows meet by (digest, salt, text), so that a text with a third of all rows is
   spread over ``salts`` tasks;
3. global: the winners of the salts, at most ``salts`` rows a text, meet by (digest, text).

Every row then gets its group's verdict by a join on the digest, whose left side Spark may
split where one digest is hot.  Should different texts share a digest, the rows of those
digests alone are joined on the text as well.

Null text counts as empty.  Rows may repeat, also with the same id; of equal texts the
largest id stays; rows that repeat an id and its text are one document and get one verdict
(``exact_winners`` keeps a single one of them).  Rows with a null id are grouped like others
and stay only if no row of their text has an id.  An empty table gives an empty result.
Other columns are ignored by ``exact_dedup`` and carried by ``exact_winners``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, staged, text_or_empty


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_groups(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] = sha256_hex,
) -> DataFrame:
    """One row per distinct text: (digest, text, keep_id, group_size)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        .groupBy("digest", "salt", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    return salted.groupBy("digest", "text").agg(
        F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size")
    )


def exact_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] = sha256_hex,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    groups = exact_groups(docs, id_col=id_col, text_col=text_col, salts=salts, digest=digest)
    verdicts = staged(groups.drop("text"), "digest-groups")
    shared = verdicts.groupBy("digest").count().filter("count > 1").select("digest")
    if shared.isEmpty():
        out = rows.drop("text").join(verdicts, "digest")
    else:
        alone = rows.drop("text").join(shared, "digest", "left_anti").join(verdicts, "digest")
        clash = rows.join(shared, "digest", "left_semi").join(
            groups.join(shared, "digest", "left_semi"), ["digest", "text"]
        )
        out = alone.unionByName(clash.drop("text"))
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
    )


def exact_winners(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows that stay, with all columns of ``docs``: of equal texts the one with the largest id.

    The same three stages; a group's whole best row rides along instead of its id, so exactly
    one of several repeated rows stays.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    rank = F.struct(F.col(f"`{id_col}`"), F.xxhash64(F.to_json(row)))
    keyed = docs.select(
        text_or_empty(f"`{text_col}`").alias("_text"), rank.alias("_rank"), row.alias("_row")
    ).withColumn("_digest", F.xxhash64("_text"))
    salted = (
        keyed.withColumn("_salt", F.pmod(F.xxhash64("_rank"), F.lit(salts)).cast("int"))
        .groupBy("_digest", "_salt", "_text")
        .agg(F.max_by("_row", "_rank").alias("_row"), F.max("_rank").alias("_rank"))
    )
    best = salted.groupBy("_digest", "_text").agg(F.max_by("_row", "_rank").alias("_row"))
    return best.select("_row.*").select(*[F.col(f"`{c}`") for c in names])


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).withColumnRenamed("digest", "text_sha256")


OP6_SQL = """
select doc_id,
       max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
"""
