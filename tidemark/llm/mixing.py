"""Operator 4, mixing sources to target weights: Pfair scheduling.

Each source's rows are cut into blocks.  With weight w a source's block j is released at slot
floor(j / w) and due by slot ceil((j + 1) / w).  Earliest deadline first among the released
blocks fills one slot after another.  The schedule is feasible, as the weights sum to 1, so
after t slots of a phase a source has had w * t blocks with less than one block of deviation.

Weights are taken as they are: a floating-point number is a fraction, and releases and deadlines are
whole numbers computed from fractions, so nothing is rounded however long a phase is.  When a
source has run out, the weights of the others are scaled up and a new phase begins; no row is dropped or
repeated.

Where things are: sizes of sources are counted by Spark and stay there.  The slots of a schedule depend on each
other, so one task walks through them; it reads one row a source, holds a few numbers a source, and
streams out one row a block: ``block_rows`` rows of the corpus, a parameter to be raised with the corpus (32 rows a
block suit a small one; a million blocks take a few seconds).  The schedule is a staged table, which Spark broadcasts
if it is small and shuffles if not.  The driver holds no table.

Ranks within a source come from a salted count: (source, salt) cells are ranked on their own,
and the sizes of the cells before a cell are its offset.  A source with a third of all rows is
so spread over ``salts`` tasks.

``mixed`` deals the rows to partitions by their position itself, so no range has to be sampled.

A null source is the source "".  Rows may repeat.  Null and empty texts are rows like others.
An empty table gives an empty result.  A source without a given weight, or with weight 0 or
less, is scheduled after all sources with a weight, in proportion to its size.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, shuffle_width, staged

#: Rows of the schedule that are sent on at a time.
BATCH = 50_000


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportion of ``weights``."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * scale) for s, x in exact.items()}
    common = math.gcd(*whole.values())
    return {s: n // common for s, n in whole.items()}


def pfair_slots(share: dict[str, int]) -> Iterator[str]:
    """The source of each slot of a phase."""
    period, done, slot = sum(share.values()), dict.fromkeys(share, 0), 0
    # A source's next block alone stands for the source: later ones have later deadlines.
    ready = [(-(-period // n), s) for s, n in share.items()]
    heapq.heapify(ready)
    waiting: list[tuple[int, str]] = []
    while True:
        while waiting and waiting[0][0] <= slot:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[s] + 1) * period // share[s]), s))
        s = heapq.heappop(ready)[1]
        yield s
        done[s] += 1
        slot += 1
        heapq.heappush(waiting, (done[s] * period // share[s], s))


def pfair_period(share: dict[str, int]) -> list[str]:
    """One period of the schedule: the source of each slot."""
    return list(islice(pfair_slots(share), sum(share.values())))


def pfair_schedule(sizes: dict[str, int], weights: dict[str, float], block_rows: int) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, slot, phase, position of the block's first row) of all blocks, in slot order."""
    left = {s: -(-n // block_rows) for s, n in sizes.items() if n}
    done, slot, phase, position = dict.fromkeys(left, 0), 0, 0, 0
    given = {s: float(weights.get(s) or 0) for s in left}
    # First the sources with a weight, then the others by their size; shares keep their proportions from phase to phase.
    for live in ({s: w for s, w in given.items() if w > 0}, {s: float(sizes[s]) for s, w in given.items() if not w > 0}):
        share = whole_weights(live) if live else {}
        while share:
            for s in pfair_slots(share):
                j = done[s]
                yield s, j, slot, phase, position
                done[s] += 1
                slot += 1
                position += min(block_rows, sizes[s] - j * block_rows)
                if done[s] == left[s]:
                    del share[s]
                    break
            phase += 1


def _schedule(cells: DataFrame, weights: dict[str, float] | None, alpha: float, block_rows: int) -> DataFrame:
    """The schedule as a table.  Without ``weights`` a source's weight is its number of rows to the power ``alpha``."""
    names = ["_source", "_block", "_slot", "_phase", "_first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[str, int] = {}
        for batch in batches:
            sizes |= zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        sizes = dict(sorted(sizes.items()))
        wanted = {s: n**alpha for s, n in sizes.items()} if weights is None else weights
        walk = pfair_schedule(sizes, wanted, block_rows)
        while part := list(islice(walk, BATCH)):
            columns = list(zip(*part, strict=True))
            types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    sizes = cells.groupBy("_source").agg(F.sum("count").alias("rows"))
    schedule = sizes.coalesce(1).mapInArrow(run, "_source string, _block long, _slot long, _phase int, _first long")
    return staged(schedule, "schedule")


def mix_positions(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    *,
    alpha: float = 0.5,
    block_rows: int = 32,
    salts: int = 64,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str | None = "text",
) -> DataFrame:
    """``docs`` as structs _row, with _source, _block, _slot, _phase and _position, the row's place in the mixture.

    Without ``weights`` a source's weight is its number of rows to the power ``alpha``.  ``text_col`` orders rows
    that share an id; None if they are equal in all columns, so that texts need not be read.
    """
    source = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("_source")
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in (id_col, text_col) if c]).alias("_tie")
    salt = F.pmod(F.col("_tie"), F.lit(salts)).cast("int").alias("_salt")
    cells = staged(docs.select(source, tie).select("_source", salt).groupBy("_source", "_salt").count(), "cells")
    schedule = _schedule(cells, weights, alpha, block_rows)
    # At most ``salts`` rows a source.
    before = Window.partitionBy("_source").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("_source", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    cell = Window.partitionBy("_source", "_salt").orderBy("_tie", F.col("_row")[id_col])
    ranked = docs.select(row, source, tie).select("*", salt).withColumn("_rank", F.row_number().over(cell) - 1)
    ranked = ranked.join(offsets, ["_source", "_salt"]).withColumn("_rank", F.col("_offset") + F.col("_rank"))
    ranked = ranked.withColumn("_block", F.floor(F.col("_rank") / block_rows).cast("long"))
    placed = ranked.join(schedule, ["_source", "_block"])
    return placed.select(
        "_row", "_source", "_block", "_slot", "_phase", (F.col("_first") + F.pmod("_rank", F.lit(block_rows))).alias("_position")
    )


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, **options) -> DataFrame:
    """The rows of ``docs``, all columns, in the order of the mixture (by partitions and within them)."""
    parts = shuffle_width(docs.sparkSession)
    rows = max(1, docs.select(F.lit(1)).count())
    at = mix_positions(docs, weights, **options)
    dealt = at.repartitionById(parts, F.floor(F.col("_position") * parts / rows).cast("int"))
    return dealt.sortWithinPartitions("_position").select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = mix_positions(documents(spark, sf_dir).select("doc_id", "source"), text_col=None)
    return at.select(
        F.col("_row.doc_id").alias("doc_id"),
        F.col("_source").alias("source"),
        F.col("_block").alias("block"),
        F.col("_slot").alias("slot"),
        F.col("_phase").alias("phase"),
        F.col("_position").alias("position"),
    )
