"""The vector index against all pairs in NumPy."""

import numpy as np
import pytest

from tidemark.operators import vector_index as vi


def make(n=3000, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    x = centres[rng.integers(0, 40, n)] + 0.35 * rng.normal(size=(n, dim))
    x[n // 2 : n // 2 + n // 5] = x[7]  # a group of equal vectors
    return x


def rows(spark, x, scopes=2):
    return spark.createDataFrame([(i, f"s{i % scopes}", [float(v) for v in r]) for i, r in enumerate(x)], "id long, namespace string, embedding array<double>").repartition(6)


def all_pairs(x, scopes=2):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    i = np.arange(len(x))
    sims[(i[:, None] % scopes != i[None, :] % scopes) | (i[:, None] == i[None, :])] = -2
    return sims


@pytest.fixture(scope="module")
def indexed(spark):
    x = make()
    data = rows(spark, x)
    return x, data, vi.build(data)


def test_every_vector_is_in_one_block(indexed):
    x, _, index = indexed
    blocks = index.blocks.select("ids", "low", "high").collect()
    assert sorted(i for b in blocks for i in b["ids"]) == list(range(len(x)))
    assert all(len(b["ids"]) <= vi.BLOCK and b["low"] <= b["high"] for b in blocks)


@pytest.mark.parametrize("k", [1, 5])
def test_exact_search_equals_all_pairs(indexed, k):
    x, data, index = indexed
    got = {}
    for r in vi.search(index, data.filter("id % 50 = 0"), k).collect():
        got.setdefault(r["id"], []).append((-r["similarity"], r["top_id"]))
    sims = all_pairs(x)
    for i in range(0, len(x), 50):
        want = sorted((-s, j) for j, s in enumerate(sims[i]) if s > -2)[:k]
        assert sorted(got[i]) == want


def test_recall_of_the_probed_cells(indexed):
    x, data, index = indexed
    sims, hits, total = all_pairs(x), 0, 0
    found = vi.search(index, data.filter("id % 50 = 0"), 10, exact=False).collect()
    for i in range(0, len(x), 50):
        tenth = np.sort(sims[i])[-10]
        hits += sum(r["similarity"] >= tenth for r in found if r["id"] == i)
        total += 10
    print(f"recall at 10 with {vi.PROBES} of {len(index.centroids)} cells: {hits / total:.3f}")
    assert hits / total >= 0.9 and len(index.centroids) > 5 * vi.PROBES


def test_pairs_above_a_floor_are_whole(indexed):
    x, data, index = indexed
    got = {(r["id"], r["top_id"]) for r in vi.similar(index, data.filter("id % 7 = 0"), 0.9).collect()}
    sims = all_pairs(x)
    assert got == {(i, int(j)) for i in range(0, len(x), 7) for j in np.flatnonzero(sims[i] >= 0.9)}


def test_bounds_rule_blocks_out(indexed):
    """The floor's search makes far fewer pairs of blocks than there are."""
    _, data, index = indexed
    pairs = vi._read(index, vi._asked(index, data.filter("id % 50 = 0"), "namespace", "id", "embedding").selectExpr("*", "0.3d as reach"), None, 0, None, 0.955)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_further_vectors_and_odd_ones(spark, indexed):
    x, data, index = indexed
    more = spark.createDataFrame(
        [(9001, "s0", [float(v) for v in -x[0]]), (9002, "s0", None), (9003, "s0", []), (9004, "s0", [0.0] * 16), (9005, "s0", [float("nan")] * 16), (9006, "s0", [1.0] * 3), (9007, "new", [1.0] * 16)],
        "id long, namespace string, embedding array<double>",
    )
    wider = vi.extended(index, more)
    q = spark.createDataFrame([(1, "s0", [float(v) for v in -x[0]]), (2, "new", [2.0] * 16), (3, "none", [1.0] * 16), (4, "s0", None)], more.schema)
    got = {r["id"]: (r["top_id"], r["similarity"]) for r in vi.search(wider, q).collect()}
    assert got[1] == (9001, 1.0) and got[2] == (9007, 1.0) and set(got) == {1, 2}
    empty = vi.build(data.limit(0))
    assert vi.search(empty, q).count() == 0 and vi.similar(empty, q, 0.5).count() == 0


def test_a_query_travels_once_a_shelf():
    """Where nothing is ruled out, a batch of queries makes a row per query and shelf, in parts, and none per cell."""
    import pandas as pd

    rng = np.random.default_rng(1)
    x, centroids = rng.normal(size=(1200, 16)), rng.normal(size=(300, 16))
    batch = pd.DataFrame({"scope": "s", "id": range(len(x)), "v": list(x), "reach": np.pi})
    outs = list(vi._routed(centroids, np.full(300, np.pi), np.arange(300) // 100, np.ones(300, dtype=int), None, 0)(iter([batch])))
    assert sum(map(len, outs)) == 3 * len(x) and max(map(len, outs)) <= 3 * vi.ROWS
    assert all(len(r) == 100 for out in outs for r in out["q_cells"])


def test_cells_on_several_shelves_lose_nothing(indexed, monkeypatch):
    x, data, index = indexed
    monkeypatch.setattr(vi, "SHELF", 150)
    assert vi._shelves(index)[2].max() > 1
    got = {(r["id"], r["top_id"]) for r in vi.similar(index, data.filter("id % 50 = 0"), 0.9).collect()}
    sims = all_pairs(x)
    assert got == {(i, int(j)) for i in range(0, len(x), 50) for j in np.flatnonzero(sims[i] >= 0.9)}
