"""A vector index for cosine similarity: a trained coarse quantiser, lists stored by cell, and cells probed by bounds.

``build`` trains unit centroids by spherical k-means on a bounded sample (``SAMPLE`` rows, chosen by a hash of their ids) and files *every* vector under its nearest
centroid.  Vectors of one scope (a namespace) and cell stand in blocks of up to ``BLOCK``, ordered by their angle to the centroid; a block is a
row with its ids, its vectors as bytes and the smallest and largest angle.  A cell of any size is many blocks, dealt over tasks by a range partitioning.

Angles obey the triangle inequality: a vector within angle b of a query lies at an angle to any centroid that differs from the query's by at
most b.  So ``similar`` (all pairs above a floor) reads the blocks whose range of angles meets that band, and loses nothing.  ``search`` probes the nearest cells
first; with ``exact`` a second pass reads every other block that the distance found so far does not rule out.

Cells stand on shelves of up to ``SHELF`` vectors (a larger cell on several).  A query is sent once to each shelf that it has to read, with the cells that
count there; a task holds the vectors of one scope and shelf at a time and lets the queries pass by, ``QUERIES`` of them in one matrix product.  So memory has a
bound that neither vectors nor queries raise, and where bounds rule nothing out (vectors without clusters), what moves is queries times shelves.

Null, empty and zero vectors, those with a null or non-finite component, and those of another length than the index's are in no block and find nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import norm
from ..plans.staging import staged

SAMPLE, BLOCK, SHELF, QUERIES, ROWS, PROBES, MOST_CELLS = 20_000, 1024, 32_768, 64, 512, 4, 4096
#: Similarities are rounded to six digits; bounds leave room for that and for rounding errors.
SLACK = 2e-6


@dataclass(frozen=True)
class VectorIndex:
    """``blocks``: scope, cell, low, high, ids, vectors."""

    centroids: np.ndarray
    blocks: DataFrame
    id_type: str


def usable(vectors: DataFrame, dimension: int) -> DataFrame:
    """scope, id, v of the vectors that have a direction."""
    v = F.col("v")
    fine = (F.size(v) == dimension) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("scope", "id", F.col("v").cast("array<double>").alias("v")).filter(fine)
    return rows.filter(norm(v) > 0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _learnt(cells: int, seed: int, rounds: int = 8):
    """The sample's unit centroids: spherical k-means from k-means++ seeds, in the one task that holds the sample."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [_matrix(pdf["v"]) for pdf in batches if len(pdf)]
        if not parts:
            return
        x, rng = _unit(np.concatenate(parts)), np.random.default_rng(seed)
        at, far = [int(rng.integers(len(x)))], np.full(len(x), np.inf)
        while len(at) < cells:
            far = np.minimum(far, np.maximum(0.0, 1.0 - x @ x[at[-1]]))
            far[far < 1e-12] = 0.0
            if not far.sum():  # no other vectors
                break
            at.append(int(rng.choice(len(x), p=far / far.sum())))
        c = x[at]
        for _ in range(rounds):
            near = np.concatenate([(x[i : i + ROWS] @ c.T).argmax(axis=1) for i in range(0, len(x), ROWS)])
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
        yield pd.DataFrame({"c": list(c)})

    return run


def train(rows: DataFrame, cells: int, seed: int = 7) -> np.ndarray:
    """Unit centroids from a sample of ``rows`` (at most ``SAMPLE``), ``cells`` at most."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v")
    return np.array([r["c"] for r in some.mapInPandas(_learnt(cells, seed), "c array<double>").collect()], dtype=np.float64)


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(np.float64)


def _angles(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(x) @ centroids.T, -1.0, 1.0))


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches in parts of ``ROWS``, so that a matrix of rows by cells stays small."""
    for pdf in batches:
        for i in range(0, len(pdf), ROWS):
            yield pdf.iloc[i : i + ROWS]


def _filed(centroids: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slices(batches):
            angles = _angles(_matrix(pdf["v"]), centroids)
            cell = angles.argmin(axis=1)
            yield pdf.assign(cell=cell.astype(np.int32), angle=angles[np.arange(len(pdf)), cell])

    return run


def _packed(most: int):
    """Consecutive rows of one scope and cell as blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for (scope, cell), part in pdf.groupby(["scope", "cell"], sort=False, dropna=False):
                for i in range(0, len(part), most):
                    p = part.iloc[i : i + most]
                    out.append((scope, cell, p["angle"].min(), p["angle"].max(), p["id"].tolist(), _matrix(p["v"]).tobytes()))
            if out:
                yield pd.DataFrame(out, columns=["scope", "cell", "low", "high", "ids", "vectors"])

    return run


def _blocks(filed: DataFrame, most: int) -> DataFrame:
    kind = filed.schema["id"].dataType.simpleString()
    width = int(filed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = filed.repartitionByRange(width, "scope", "cell", "angle", "id").sortWithinPartitions("scope", "cell", "angle")
    return dealt.mapInPandas(_packed(most), f"scope string, cell int, low double, high double, ids array<{kind}>, vectors binary")


def build(vectors: DataFrame, *, scope: str = "namespace", id_col: str = "id", vector_col: str = "embedding", dimension: int | None = None, cells: int | None = None) -> VectorIndex:
    """An index of ``vectors``; the number of cells is about the root of the number of rows unless given."""
    rows = vectors.select(F.col(f"`{scope}`").cast("string").alias("scope"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    if dimension is None:
        first = rows.filter(F.size("v") > 0).select(F.size("v").alias("n")).first()
        dimension = first["n"] if first else 1
    rows = staged(usable(rows, dimension), "index-rows")
    n = rows.count()
    centroids = train(rows, cells or max(1, min(MOST_CELLS, math.isqrt(n)))) if n > 1 else np.ones((1, dimension)) / math.sqrt(dimension)
    return VectorIndex(centroids, staged(_blocks(rows.mapInPandas(_filed(centroids), "scope string, id {0}, v array<double>, cell int, angle double".format(rows.schema["id"].dataType.simpleString())), BLOCK), "index-blocks"), rows.schema["id"].dataType.simpleString())


def extended(index: VectorIndex, vectors: DataFrame, *, scope: str = "namespace", id_col: str = "id", vector_col: str = "embedding") -> VectorIndex:
    """The index with further vectors, filed under the centroids that it has; its own blocks stay where they are."""
    rows = vectors.select(F.col(f"`{scope}`").cast("string").alias("scope"), F.col(f"`{id_col}`").cast(index.id_type).alias("id"), F.col(f"`{vector_col}`").alias("v"))
    filed = usable(rows, index.centroids.shape[1]).mapInPandas(_filed(index.centroids), f"scope string, id {index.id_type}, v array<double>, cell int, angle double")
    return VectorIndex(index.centroids, index.blocks.unionByName(staged(_blocks(filed, BLOCK), "index-blocks")), index.id_type)


def _routed(centroids: np.ndarray, radii: np.ndarray, first: np.ndarray, parts: np.ndarray, probes: int | None, skip: int):
    """A row per query and shelf that it reads, with the shelf's cells that it reads: its ``probes`` nearest, or those that its ``reach`` (an angle) meets, without its ``skip`` nearest."""
    shelf = np.array([x for f, n in zip(first, parts, strict=True) for x in range(f, f + n)])
    owner = np.repeat(np.arange(len(parts)), parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slices(batches):
            x = _matrix(pdf["v"])
            angles = _angles(x, centroids)
            if probes or skip:
                place = np.empty(angles.shape, dtype=np.int32)
                np.put_along_axis(place, angles.argsort(axis=1, kind="stable"), np.arange(len(centroids), dtype=np.int32)[None, :], axis=1)
            hit = place < probes if probes else angles - pdf["reach"].to_numpy()[:, None] <= radii[None, :]
            if not probes and skip:
                hit &= place >= skip
            q, c = np.nonzero(hit[:, owner])
            if not len(q):
                continue
            # Cells of a shelf follow one another, so do a query's cells in it.
            cells = owner[c].astype(np.int32)
            starts = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (shelf[c[1:]] != shelf[c[:-1]])])
            rows, lists = q[starts], np.split(cells, starts[1:])
            v = [r.tobytes() for r in x]
            yield pd.DataFrame({
                "scope": pdf["scope"].to_numpy()[rows], "shelf": shelf[c[starts]].astype(np.int32), "q_id": pdf["id"].to_numpy()[rows],
                "q_reach": pdf["reach"].to_numpy()[rows], "q_cells": lists, "vectors": [v[i] for i in rows],
            })

    return run


class _Shelf:
    """The index's vectors of one scope and shelf, and the pairs that queries make with them."""

    def __init__(self, scope: str, shelf: int):
        self.key, self.blocks, self.ids = (scope, shelf), [], None

    def close(self) -> None:
        """No further blocks come."""
        self.ids = [x for b in self.blocks for x in b.ids]
        self.x = np.concatenate([np.frombuffer(b.vectors).reshape(len(b.ids), -1) for b in self.blocks])
        self.length = np.linalg.norm(self.x, axis=1)
        self.unit = self.x / self.length[:, None]
        self.cell, self.low, self.high = (np.array([getattr(b, n) for b in self.blocks], dtype=t) for n, t in (("cell", int), ("low", float), ("high", float)))
        self.sizes = [len(b.ids) for b in self.blocks]
        self.blocks, self.rank, self.where = [], np.empty(len(self.ids), dtype=np.int64), {}
        self.rank[sorted(range(len(self.ids)), key=self.ids.__getitem__)] = np.arange(len(self.ids))
        self.joined = np.arange(len(self.ids))  # equal for vectors that crowded queries have joined so far
        for j, x in enumerate(self.ids):
            self.where.setdefault(x, []).append(j)

    def links(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Places of pairs (those of a query follow one another) that join what was not joined: each query and each vector has one at least."""
        out = []
        for at in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1):
            sets, first = np.unique(self.joined[j[at]], return_index=True)
            out.append(at[first])
            if len(sets) > 1:
                self.joined[np.isin(self.joined, sets)] = sets[0]
        return np.concatenate(out)

    def pairs(self, queries: pd.DataFrame, centroids: np.ndarray, k: int | None, floor: float, crowd: int | None = None) -> pd.DataFrame | None:
        """id, top_id, similarity: the k best of each query, or all above the floor; with ``crowd`` also crowded (see ``linked``)."""
        a = np.stack([np.frombuffer(v) for v in queries["vectors"]])
        reach, length = queries["q_reach"].to_numpy()[:, None], np.linalg.norm(a, axis=1)
        read = np.zeros((len(a), len(centroids)), dtype=bool)
        for i, cells in enumerate(queries["q_cells"]):
            read[i, cells] = True
        angles = _angles(a, centroids[self.cell])
        read = read[:, self.cell] & (angles - reach <= self.high) & (angles + reach >= self.low)
        sims = (a / length[:, None]) @ self.unit.T
        if not read.all():
            sims[~np.repeat(read, self.sizes, axis=1)] = -2.0
        ids = queries["q_id"].tolist()
        for i, x in enumerate(ids):
            for j in self.where.get(x, ()):
                sims[i, j] = -2.0
        # Pairs that may count, before they are rounded.
        if k is None:
            least = np.full(len(a), floor)
        else:
            n = min(k, sims.shape[1])
            least = sims.max(axis=1) if n == 1 else np.partition(sims, -n, axis=1)[:, -n]
        i, j = np.nonzero(sims >= np.maximum(least - SLACK, -1.5)[:, None])
        found = np.empty(len(i))
        for at in range(0, len(i), 1 << 14):
            some = slice(at, at + (1 << 14))
            found[some] = np.einsum("ij,ij->i", a[i[some]], self.x[j[some]]) / (length[i[some]] * self.length[j[some]])
        found = np.round(found, 6)
        keep = found >= floor
        if k is not None:
            order = np.lexsort((self.rank[j], -found, i))
            place = np.arange(len(i)) - np.searchsorted(i[order], i[order])
            i, j, found, keep = i[order], j[order], found[order], keep[order] & (place < k)
        if keep.any():  # Arrow can't send an empty column of texts
            i, j, found, more = i[keep], j[keep], found[keep], {}
            if crowd is not None:
                many = np.bincount(i, minlength=len(a))[i] > crowd
                if many.any():
                    dense = np.flatnonzero(many)
                    some = np.concatenate([np.flatnonzero(~many), dense[self.links(i[dense], j[dense])]])
                    i, j, found, many = i[some], j[some], found[some], many[some]
                more = {"crowded": many}
            return pd.DataFrame({"id": [ids[x] for x in i], "top_id": [self.ids[x] for x in j], "similarity": found} | more)
        return None


def _matched(centroids: np.ndarray, k: int | None, floor: float, crowd: int | None = None):
    """Rows in order of scope and shelf, a shelf's blocks before its queries: one shelf is held at a time, queries pass by."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for pdf in batches:
            for (scope, shelf, asks), rows in pdf.groupby(["scope", "shelf", "asks"], sort=False, dropna=False):
                scope = None if pd.isna(scope) else scope
                if now is None or now.key != (scope, shelf):
                    now = _Shelf(scope, shelf)
                if not asks:
                    now.blocks += list(rows[["cell", "low", "high", "ids", "vectors"]].itertuples(index=False))
                    continue
                if now.ids is None and now.blocks:
                    now.close()
                for at in range(0, len(rows) if now.ids else 0, QUERIES):
                    out = now.pairs(rows.iloc[at : at + QUERIES], centroids, k, floor, crowd)
                    if out is not None:
                        yield out

    return run


def _shelves(index: VectorIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each cell its radius, its first shelf and on how many shelves it stands: cells share a shelf of up to ``SHELF`` vectors, a larger one has several."""
    rows = index.blocks.groupBy("cell").agg(F.max("high").alias("high"), F.sum(F.size("ids")).alias("n")).collect()  # a row per cell
    found = {r["cell"]: r for r in rows}
    cells = range(len(index.centroids))
    radii = np.array([found[c]["high"] if c in found else -math.inf for c in cells])
    first, parts, shelf, held = [], [], 0, 0
    for c in cells:
        n = found[c]["n"] if c in found else 0
        if held and held + n > SHELF:
            shelf, held = shelf + 1, 0
        first.append(shelf)
        parts.append(max(1, -(-n // SHELF)))
        shelf, held = (shelf + parts[-1], 0) if parts[-1] > 1 else (shelf, held + n)
    return radii, np.array(first), np.array(parts)


def _read(index: VectorIndex, queries: DataFrame, probes: int | None, skip: int, k: int | None, floor: float, crowd: int | None = None) -> DataFrame:
    """id, top_id, similarity (and crowded) from the blocks that ``queries`` (scope, id, v, reach) have to read.

    A query travels once per shelf that it reads, and not once per cell or block.
    """
    radii, first, parts = _shelves(index)
    kind = queries.schema["id"].dataType.simpleString()
    asks = f"scope string, shelf int, q_id {kind}, q_reach double, q_cells array<int>, vectors binary"
    asked = queries.select("scope", "id", "v", "reach").mapInPandas(_routed(index.centroids, radii, first, parts, probes, skip), asks)
    cells = index.blocks.sparkSession.createDataFrame([(c, int(f), int(n)) for c, (f, n) in enumerate(zip(first, parts, strict=True))], "cell int, first int, parts int")
    spread = F.pmod(F.xxhash64("low", "high", F.element_at("ids", 1)), F.col("parts")).cast("int")
    blocks = index.blocks.join(F.broadcast(cells), "cell").select("scope", (F.col("first") + spread).alias("shelf"), "cell", "low", "high", "ids", "vectors", F.lit(False).alias("asks"))
    both = blocks.unionByName(asked.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    dealt = both.repartition("scope", "shelf").sortWithinPartitions("scope", "shelf", "asks")
    found = f"id {kind}, top_id {index.id_type}, similarity double" + ", crowded boolean" * (crowd is not None)
    return dealt.mapInPandas(_matched(index.centroids, k, floor, crowd), found)


def _asked(index: VectorIndex, queries: DataFrame, scope: str, id_col: str, vector_col: str) -> DataFrame:
    rows = queries.select(F.col(f"`{scope}`").cast("string").alias("scope"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    # Staged before they are filtered: what a query's vector is made of stays out of the filter.
    return usable(staged(rows, "index-queries"), index.centroids.shape[1])


def similar(index: VectorIndex, queries: DataFrame, floor: float, *, scope: str = "namespace", id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """All pairs of a query and another vector of its scope with a similarity of at least ``floor``: id, top_id, similarity."""
    reach = F.lit(math.acos(max(-1.0, floor - SLACK)))
    return _read(index, _asked(index, queries, scope, id_col, vector_col).withColumn("reach", reach), None, 0, None, floor)


def linked(index: VectorIndex, queries: DataFrame, floor: float, crowd: int, *, scope: str = "namespace", id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """What ``similar`` joins, without the square of a group's size: id, top_id, similarity, crowded.

    A query with more than ``crowd`` pairs on a shelf is crowded there.  Of such pairs those stay that join what others have not joined yet, so that all that hung together still does: a row
    or more for each such query and for each vector that one of them meets, and no more than both together.  All other pairs are there.
    """
    reach = F.lit(math.acos(max(-1.0, floor - SLACK)))
    return _read(index, _asked(index, queries, scope, id_col, vector_col).withColumn("reach", reach), None, 0, None, floor, crowd)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """Of each query its k best, equal similarities by id: k rows a task and query before they meet."""
    if k == 1:
        best = pairs.groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("d"), "top_id")).alias("t"))
        return best.select("id", "t.top_id", (-F.col("t.d")).alias("similarity"))
    from pyspark.sql import Window

    by = Window.partitionBy("id").orderBy(F.desc("similarity"), "top_id")
    return pairs.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= k).drop("_r")


def search(
    index: VectorIndex, queries: DataFrame, k: int = 1, *, probes: int = PROBES, exact: bool = True, scope: str = "namespace", id_col: str = "id", vector_col: str = "embedding"
) -> DataFrame:
    """The k most similar other vectors of each query's scope: id, top_id, similarity."""
    asked = _asked(index, queries, scope, id_col, vector_col).withColumn("reach", F.lit(math.pi))
    first = _read(index, asked, min(probes, len(index.centroids)), 0, k, -1.0)
    if not exact or probes >= len(index.centroids):
        return _best(first, k)
    first = staged(_best(first, k), "index-first")
    worst = first.groupBy("id").agg(F.min("similarity").alias("worst"), F.count(F.lit(1)).alias("n"))
    reach = F.when(F.col("n") < k, math.pi).otherwise(F.acos(F.greatest(F.lit(-1.0), F.col("worst") - SLACK)))
    left = asked.drop("reach").join(worst, "id", "left").withColumn("reach", F.coalesce(reach, F.lit(math.pi))).drop("worst", "n")
    rest = _read(index, left, None, min(probes, len(index.centroids)), k, -1.0)
    return _best(first.unionByName(rest), k)
