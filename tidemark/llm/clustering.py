"""Operator 12, centroid clustering: plain Lloyd iterations in exact integers.

Components are turned into integers floor(scale * x) once and staged.  Each round sends the centroids (k x dimension integers, a
size that does not grow with the data) to all tasks; ``mapInPandas`` computes the squared differences to one centroid after the other in
NumPy and keeps the lowest index among the nearest; each task sends one row of integer sums per cluster, which merge by a
``groupBy``, and the k merged rows come to the driver as the next centroids.  Integer sums don't depend on the order of rows, so
results are the same however the data is dealt out, and a lost executor's tasks can run again.

Vectors of another length, and those with a null or non-finite component, are left out.  The first centroids are the vectors with the
smallest SHA-256 of a seed and their id; ties (repeated ids) go to the smaller vector; fewer vectors than centroids make
fewer centroids.  Empty clusters keep their centroid.  Rows with a null id are clustered like others but start no cluster.  Rows may repeat and count as often.
A vector with an integer component of 2^27 or more in magnitude could overflow a squared distance of 64 bits: it comes back with a null
cluster and distance, and counts nowhere.  An empty table gives an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

LIMIT = 1 << 27
ROWS = 8192


def integers(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dimension: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, q: the vectors with ``dimension`` finite components, as integers; q is null where one is out of range."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.filter((F.size(v) == dimension) & ~bad)
    fits = F.forall(v, lambda x: F.abs(x * scale) < LIMIT)
    return rows.select("vec_id", F.when(fits, F.transform(v, lambda x: F.floor(x * scale).cast("int"))).alias("q"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest digest of seed and id: an ordered limit, k rows a task."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    top = rows.filter("vec_id is not null and q is not null").orderBy(digest, "q").limit(k).select("q").collect()
    return np.array([r["q"] for r in top], dtype=np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest centroid (the lowest index of several) and the squared distance."""
    best = np.full(len(x), np.iinfo(np.int64).max)
    at = np.zeros(len(x), dtype=np.int32)
    for i, c in enumerate(centroids):
        d = x - c
        d = np.einsum("ij,ij->i", d, d)
        closer = d < best
        best[closer], at[closer] = d[closer], i
    return at, best


def _blocks(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for i in range(0, len(pdf), ROWS):
        part = pdf.iloc[i : i + ROWS]
        yield part, np.stack(part["q"].to_numpy()).astype(np.int64)


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), dtype=np.int64)
        for pdf in batches:
            for _, x in _blocks(pdf):
                at, _ = nearest(x, centroids)
                np.add.at(sums, at, x)
                counts += np.bincount(at, minlength=len(centroids))
        full = np.flatnonzero(counts)
        yield pd.DataFrame({"cluster": full.astype(np.int32), "n": counts[full], "sums": [s.tolist() for s in sums[full]]})

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, x in _blocks(pdf):
                at, d = nearest(x, centroids)
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "cluster": at, "distance": d})

    return run


def moved(usable: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    parts = usable.select("q").mapInPandas(_sums(centroids), "cluster int, n long, sums array<long>")
    sums = F.array(*[F.sum(F.col("sums")[i]) for i in range(centroids.shape[1])])
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), sums.alias("sums")).collect():  # at most k rows
        out[r["cluster"]] = np.array([s // r["n"] for s in r["sums"]], dtype=np.int64)
    return out


def lloyd(
    vectors: DataFrame, k: int = 40, rounds: int = 5, *, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", dimension: int = 64, scale: int = 256
) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance of each vector that has ``dimension`` finite components, and the final centroids."""
    rows = staged(integers(vectors, id_col=id_col, vector_col=vector_col, dimension=dimension, scale=scale), "vectors")
    usable = rows.filter("q is not null")
    centroids = first_centroids(rows, k, seed).reshape(-1, dimension)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(usable, centroids)
    null = {"cluster": F.lit(None).cast("int"), "distance": F.lit(None).cast("long")}
    out = rows.filter("q is null").select("vec_id", *[c.alias(n) for n, c in null.items()])
    kind = rows.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return rows.select("vec_id", *[c.alias(n) for n, c in null.items()]), centroids
    placed = usable.select("vec_id", "q").mapInPandas(_assigned(centroids), f"vec_id {kind}, cluster int, distance long")
    return placed.unionByName(out), centroids


def op12_lloyd_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster and distance, with the inertia of its cluster and of all, and its centroid's digest."""
    placed, centroids = lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    placed = staged(placed, "clusters")
    inertia = {r["cluster"]: r["d"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # at most k + 1 rows
    total = sum(d or 0 for d in inertia.values())
    told = [(i, int(inertia.get(i) or 0), total, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # k rows
    out = placed.join(F.broadcast(about), "cluster", "left")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql(k: int, rounds: int, seed: int) -> str:
    near = """a{i} as materialized (select vec_id, q, cluster, distance from (select *, row_number() over (partition by u order by distance, cluster) as r from (
      select u, vec_id, q, cluster, cast(list_sum(list_transform(list_zip(q, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint) as distance from v, c{i})) where r = 1)"""
    move = """c{j} as materialized (select cluster, coalesce(m, c) as c from c{i} left join (select cluster, list(f order by d) as m from (
      select cluster, d, (s - (s % n + n) % n) // n as f from (select cluster, d, cast(sum(q[d]) as bigint) as s, count(*) as n from a{i}, range(1, 65) t(d) group by all)) group by 1) using (cluster))"""
    steps = [near.format(i=0)]
    for i in range(rounds):
        steps += [move.format(i=i, j=i + 1), near.format(i=i + 1)]
    return f"""
with v as materialized (
    select row_number() over () as u, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as materialized (select cast(row_number() over (order by sha256('{seed}:' || vec_id), q) - 1 as integer) as cluster, q as c from v
    where vec_id is not null order by sha256('{seed}:' || vec_id), q limit {k}),
{", ".join(steps)}
select vec_id, cluster, distance, cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia, cast(sum(distance) over () as bigint) as inertia,
       sha256(array_to_string(c, ',')) as centroid_sha256
from a{rounds} join c{rounds} using (cluster)
"""


OP12_SQL = _rounds_sql(40, 5, 2)
