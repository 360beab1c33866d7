"""Operator 2, sharding: longest-processing-time scheduling of whole groups.

Rows with equal text are a group that must stay together.  A group's size is the sum over its
rows of UTF-8 bytes plus 1.  Groups, sorted by size, go to the least-loaded bin through a heap.

One heap over billions of groups would be one task, so the schedule has two levels, both LPT:

* groups are range-partitioned by size, descending; each task runs the heap over its groups
  with ``bins`` bins and so makes ``bins`` bundles of near equal size;
* the driver runs the heap over the bundles, largest first.  There are at most
  partitions x ``bins`` of them, however many groups there are.  The bundles of the smallest
  groups come last and even out what the large ones leave.

Two narrow shuffles (digest, size) are all that moves; texts stay where they are read.
Slots are numbered without a global sort: rows are staged with their partition's number, the
counts by (partition, shard) are summed up on the driver, and each such cell counts on from its offset.

Null text counts as empty (size 1).  Rows may repeat: each is a row of its group.  An empty
table gives an empty result.  Null ids are carried along.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, shuffle_width, staged, text_or_empty


def lpt(sizes, bins: int) -> list[int]:
    """The bin of each job: jobs in the order given, each to the least-loaded bin."""
    heap = [(0, b) for b in range(bins)]
    out = []
    for size in sizes:
        load, b = heap[0]
        heapq.heapreplace(heap, (load + int(size), b))
        out.append(b)
    return out


def _bundles(bins: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() * bins
        heap = [(0, b) for b in range(bins)]
        for pdf in batches:
            put = np.empty(len(pdf), dtype=np.int64)
            for i, size in enumerate(pdf["bytes"].to_numpy()):
                load, b = heap[0]
                heapq.heapreplace(heap, (load + int(size), b))
                put[i] = base + b
            pdf["bundle"] = put
            yield pdf

    return run


def lpt_shards(
    docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", bins: int = 32
) -> DataFrame:
    """doc_id, size, text_crc32, group_rows, shard, slot of every row of ``docs``."""
    spark = docs.sparkSession
    text = F.col("_text")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text")).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    rows = staged(rows, "shard-rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("group_rows"))
    ordered = groups.repartitionByRange(shuffle_width(spark), F.desc("bytes"), "digest").sortWithinPartitions(
        F.desc("bytes"), "digest"
    )
    bundled = staged(
        ordered.mapInPandas(_bundles(bins), "digest binary, bytes long, group_rows long, bundle long"), "shard-groups"
    )
    loads = bundled.groupBy("bundle").agg(F.sum("bytes").alias("bytes")).toPandas()
    loads = loads.sort_values(["bytes", "bundle"], ascending=[False, True], kind="stable")
    loads["shard"] = np.array(lpt(loads["bytes"], shards), dtype=np.int32)
    # At most partitions x bins rows of 12 bytes.
    where = spark.createDataFrame(
        [(int(b), int(s)) for b, s in zip(loads["bundle"], loads["shard"], strict=True)], "bundle long, shard int"
    )
    placed = bundled.join(F.broadcast(where), "bundle").select("digest", "group_rows", "shard")
    put = rows.join(placed, "digest").select("doc_id", "size", "text_crc32", "group_rows", "shard")
    put = staged(put.withColumn("part", F.spark_partition_id()), "shard-put")
    cells = put.groupBy("part", "shard").count().toPandas().sort_values(["shard", "part"])
    cells["first"] = cells.groupby("shard")["count"].cumsum() - cells["count"]
    # At most partitions x shards rows.
    first = spark.createDataFrame(
        [(int(p), int(s), int(o)) for p, s, o in zip(cells["part"], cells["shard"], cells["first"], strict=True)],
        "part int, shard int, first long",
    )
    cell = Window.partitionBy("part", "shard").orderBy("doc_id", "text_crc32", "size")
    return (
        put.withColumn("rank", F.row_number().over(cell) - 1)
        .join(F.broadcast(first), ["part", "shard"])
        .select("doc_id", "size", "text_crc32", "group_rows", "shard", (F.col("first") + F.col("rank")).alias("slot"))
    )


def op2_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lpt_shards(documents(spark, sf_dir), 8)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "group_rows",
    )
