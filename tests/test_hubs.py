"""Nodes with very many edges: dealt out in parts, with the same results."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph

EDGE = "src_id string, relation string, dst_id string, valid_from timestamp_ntz, valid_to timestamp_ntz"


def test_a_star_is_dealt_out(spark):
    n = 200_000
    star = spark.range(n).select(F.concat(F.lit("n"), "id").alias("x"), F.lit("hub").alias("y"))
    rest = spark.range(n // 4).select(F.concat(F.lit("n"), "id").alias("x"), F.concat(F.lit("m"), "id").alias("y"))
    walk, hubs = graph.dealt(star.unionByName(rest), 1_000)
    assert [tuple(r) for r in hubs.collect()] == [("hub", 200)]
    assert walk.groupBy("part").count().agg(F.max("count")).first()[0] < n // 4 + 2_000
    said = star.unionByName(rest).select("y").distinct().withColumn("label", F.col("y"))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = [r["count"] for r in graph.heard(walk, hubs, said).groupBy(F.spark_partition_id()).count().collect()]
        unsplit = [r["count"] for r in star.unionByName(rest).join(said, "y").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(rows) == sum(unsplit) == n + n // 4
    assert max(rows) < 1.5 * sum(rows) / 4 and max(unsplit) >= n


def test_labels_are_the_same(spark):
    draw = random.Random(4)
    edges = [(f"n{draw.randrange(5) if draw.random() < 0.5 else draw.randrange(60)}", "R", f"n{draw.randrange(60)}", None, None) for _ in range(400)]
    e = spark.createDataFrame(edges, EDGE)
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(62)], "id string")
    plain = {r["id"]: r["label"] for r in graph.label_propagation(e, nodes, 5).collect()}
    split = {r["id"]: r["label"] for r in graph.label_propagation(e, nodes, 5, hub=3).collect()}
    assert plain == split and len(plain) == 62


def all_pairs(held):
    groups = {}
    for g, m in held:
        groups.setdefault(g, set()).add(m)
    counts = Counter(p for ms in groups.values() for p in itertools.combinations(sorted(ms), 2))
    return counts, sorted(((-n, *p) for p, n in counts.items()))


@pytest.mark.parametrize("block", [2, 7, 1000])
def test_pairs_in_blocks(spark, block):
    draw = random.Random(block)
    held = [(f"g{draw.randrange(6)}", draw.randrange(40)) for _ in range(150)] + [("large", i) for i in range(50)] + [(None, 1), ("g1", None), ("alone", 3)]
    rows = spark.createDataFrame(held, "g string, m long")
    counts, ranked = all_pairs([(g, m) for g, m in held if g is not None and m is not None])
    assert Counter((r["a"], r["b"]) for r in graph.paired(rows, "g", "m", block).collect()) == counts
    for most in (1, 10, 200, 2000):
        got = [(-r["n"], r["a"], r["b"]) for r in graph.top_pairs(rows, "g", "m", most, block, seeds=8).collect()]
        assert got == ranked[:most]


def test_a_group_of_100_000(spark):
    """Five billion pairs share one group; none of them is made."""
    large = spark.range(100_000).select(F.lit("large").alias("g"), "id")
    small = spark.range(600).select(F.concat(F.lit("s"), (F.col("id") % 30).cast("string")).alias("g"), (F.col("id") % 25).alias("id"))
    got = graph.top_pairs(large.unionByName(small), "g", "id", 10).collect()
    _, ranked = all_pairs([(f"s{i % 30}", i % 25) for i in range(600)] + [("large", i) for i in range(25)])
    assert [(-r["n"], r["a"], r["b"]) for r in got] == ranked[:10]
