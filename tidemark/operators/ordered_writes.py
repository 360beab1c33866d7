"""A batch of writes, decided as if one came after the other.

Each write is compared with what is live when its turn comes: the rows that were there, and those that earlier writes of the batch added and
later ones did not retire.  A write with a source_ref replaces the newest live row of that ref, or is an addition; one without is decided by its nearest live
row (see ``memory.write_decision``).  An update or a denial retires that row, and both add one of their own; a repetition adds none.

Writes of one outcome don't wait for each other.  Rows with equal text and vector are one class; pairs of classes at ``SUPERSEDE`` or more come from the vector
index, without all pairs.  What a write may read or change are the classes near its own and the refs of rows in them (or its ref and the classes of that ref's rows).  In
each of ``ROUNDS`` rounds a write is decided if no undecided write before it shares any of these.  A chain of repetitions is decided at once, as they change nothing; so is a
chain of writes of one ref.

What is left then are chains of changes, in which each write waits for the one before.  Writes that share anything, by however many steps, are a component; components are
found by labels and each is played in the order of its writes, by one task: the live rows that it may read come first, then its writes stream by, and the task holds those
live rows' vectors, no pairs and no texts.  So their work doesn't grow with the length of the longest chain times the store.

Of a class with more than ``CROWD`` near ones not all pairs are listed, which would be the square of a group of near texts, but those that keep its component together.  It takes
no part in rounds, nor does any key that shares something with such a class; components need no more, as they are played by vectors.

Rounds and components work on the batch and the rows that it touches, not on the whole store.  Each round's decisions are a staged table.

Ids and ``seq`` are unique in a batch.  Rows without a vector (null, empty, zero or not finite) are near none; a null ``valid_at`` comes before all times.  A text equal to a live one below ``SUPERSEDE`` (a
vector of another model) is no repetition.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_negation, norm_text
from ..functions.vectors import norm
from ..plans.staging import staged
from . import vector_index
from .memory import DUPLICATE, NOOP_BUMP, SUPERSEDE

CHANGES = ("add", "update", "invalidate")
#: Rounds before what is left is played by components.
ROUNDS = 2
#: A class with more near ones than this (on a shelf of the index) waits for its component.
CROWD = 256


def _described(rows: DataFrame, seq: Column) -> DataFrame:
    """id, seq, namespace, ref and class keys, and what decisions ask of a text."""
    v = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.size(v) > 0, F.lit(False)) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ref = F.when(F.trim("source_ref") != "", F.md5(F.to_json(F.struct("namespace", "source_ref"))))
    out = rows.select("id", seq.alias("seq"), "namespace", "valid_at", F.concat(F.lit("r"), ref).alias("ref"), F.md5(norm_text(F.col("content"))).alias("norm"),
                      has_negation(F.col("content")).alias("denies"), F.when(fine, v).alias("v"))
    key = F.md5(F.to_json(F.struct("namespace", "norm", "denies", "v")))
    return out.withColumn("class", F.when(norm(F.col("v")) > 0, F.concat(F.lit("c"), key)))


def _near(new: DataFrame, rows: DataFrame) -> tuple[DataFrame, int]:
    """a, b, similarity, same, crowded: classes of the batch and those at ``SUPERSEDE`` or more, themselves included; whether texts are equal; and whether pairs of that kind are left out.  And the vectors' length."""
    classes = rows.filter("class is not null").dropDuplicates(["class"]).select(F.col("class").alias("id"), "namespace", F.col("v").alias("embedding"), "norm", "denies")
    classes = staged(classes, "write-classes")
    asked = classes.join(new.filter("ref is null and class is not null").select(F.col("class").alias("id")).distinct(), "id", "left_semi")
    index = vector_index.build(classes)
    pairs = vector_index.linked(index, asked, SUPERSEDE, CROWD).select(F.col("id").alias("a"), F.col("top_id").alias("b"), "similarity", "crowded")
    pairs = pairs.unionByName(asked.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"), F.lit(False).alias("crowded")))
    of = lambda side: classes.select(F.col("id").alias(side), F.col("norm").alias(f"norm_{side}"), F.col("denies").alias(f"denies_{side}"))
    out = pairs.join(of("a"), "a").join(of("b"), "b")
    return staged(out.select("a", "b", "similarity", "crowded", (F.col("norm_a") == F.col("norm_b")).alias("same"), F.col("denies_a").alias("denies")), "write-near"), index.centroids.shape[1]


def _touched(near: DataFrame, rows: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """g, what: all that the writes of a key may read or change, or what keeps its component together; the rows that are among it; and g, keys that share anything with a crowded one."""
    refs = new.select("ref").filter("ref is not null").distinct()
    own = near.select(F.col("b").alias("class")).distinct()
    some = rows.join(own, "class", "left_semi").unionByName(rows.join(refs, "ref", "left_semi").join(own, "class", "left_anti"))
    some = staged(some.select("id", "seq", "class", "ref", "valid_at", "norm", "denies", "v"), "write-rows")
    both = some.filter("class is not null and ref is not null").select("class", "ref").distinct()
    touched = near.select(F.col("a").alias("g"), F.col("b").alias("what"))
    touched = touched.unionByName(near.select(F.col("a").alias("g"), F.col("b").alias("class")).join(both, "class").select("g", F.col("ref").alias("what")))
    touched = touched.unionByName(refs.select(F.col("ref").alias("g"), F.col("ref").alias("what")))
    touched = touched.unionByName(both.join(refs, "ref", "left_semi").select(F.col("ref").alias("g"), F.col("class").alias("what")))
    touched = staged(touched.distinct(), "write-touched")
    # Each class that a crowded one is near has a pair, with that one or another.
    crowded = near.filter("crowded").select("a").distinct()
    held = near.filter("crowded").select("b").unionByName(near.join(crowded, "a", "left_semi").select("b")).select(F.col("b").alias("what")).distinct()
    held = held.unionByName(both.join(held.withColumnRenamed("what", "class"), "class", "left_semi").select(F.col("ref").alias("what")))
    return touched, some, staged(touched.join(held, "what", "left_semi").select("g").distinct(), "write-crowded")


def _ready(undecided: DataFrame, touched: DataFrame) -> DataFrame:
    """g, head, limit: keys whose first write has no other before it, and the next write that shares something with them."""
    first = undecided.groupBy("g").agg(F.min("seq").alias("m"))
    on = staged(touched.join(first, "g"), "write-round")
    least = on.groupBy("what").agg(F.min("m").alias("m1"), F.min_by("g", "m").alias("g1"))
    others = on.join(least, "what").filter("g <> g1").groupBy("what").agg(F.min("m").alias("m2"))
    seen = on.join(least, "what").join(others, "what", "left")
    ends = seen.groupBy("g").agg(F.min("m").alias("head"), F.min("m2").alias("limit"), F.bool_and(F.col("g") == F.col("g1")).alias("free"))
    return ends.filter("free").drop("free")


def _live(some: DataFrame, done: DataFrame) -> DataFrame:
    """The rows among ``some`` that are live after the writes that are decided."""
    added = done.filter(F.col("decision").isin(*CHANGES)).select("id")
    gone = done.filter("decision in ('update', 'invalidate')").select(F.col("target_id").alias("id"))
    return some.filter("seq is null").unionByName(some.filter("seq is not null").join(added, "id", "left_semi")).join(gone, "id", "left_anti")


def _round(undecided: DataFrame, done: DataFrame, near: DataFrame, touched: DataFrame, some: DataFrame, crowded: DataFrame) -> DataFrame:
    """The writes that are decided now: seq, id, decision, target_id, similarity."""
    ready = staged(_ready(undecided, touched).join(crowded, "g", "left_anti"), "write-ready")
    run = undecided.join(ready, "g").filter("limit is null or seq < limit")
    live = _live(some, done)
    # By similarity: a class's live row with the smallest id stands for it.
    classes = live.filter("class is not null").groupBy(F.col("class").alias("b")).agg(F.min("id").alias("top"))
    found = near.join(ready.select(F.col("g").alias("a")), "a", "left_semi").join(classes, "b")
    best = found.groupBy(F.col("a").alias("g")).agg(F.min(F.struct((-F.col("similarity")).alias("d"), "top", "same", "denies")).alias("t"))
    best = best.select("g", F.col("t.top").alias("top"), (-F.col("t.d")).alias("similarity"), F.col("t.same").alias("same"), F.col("t.denies").alias("denies"))
    decision = (
        F.when(F.col("top").isNull(), "add").when(F.col("same"), "noop").when(F.col("denies"), "invalidate").when(F.col("similarity") >= DUPLICATE, "noop").otherwise("update")
    )
    texts = run.filter("ref is null").join(best, "g", "left").withColumn("decision", decision)
    # A change is made alone; what follows it is decided on what it leaves.
    texts = texts.filter("decision = 'noop' or seq = head").select("seq", "id", "decision", F.col("top").alias("target_id"), "similarity")
    # By ref: the newest live row; where there is one at most, each write of the run replaces the one before.
    newest = live.filter("ref is not null").groupBy(F.col("ref").alias("g")).agg(F.max_by("id", F.struct("valid_at", "id")).alias("top"), F.count(F.lit(1)).alias("n"))
    named = run.filter("ref is not null").join(newest, "g", "left").filter("seq = head or coalesce(n, 0) < 2")
    before = F.coalesce(F.lag("id").over(Window.partitionBy("g").orderBy("seq")), F.col("top"))
    named = named.withColumn("target_id", before).select("seq", "id", F.when(F.col("target_id").isNull(), "add").otherwise("update").alias("decision"), "target_id", F.lit(None).cast("double").alias("similarity"))
    return texts.unionByName(named)


def _components(touched: DataFrame, undecided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """g, part of the keys of undecided writes, and what, part: keys that share anything, by however many steps, are of one part."""
    on = staged(touched.join(undecided.select("g").distinct(), "g", "left_semi"), "write-open")
    # A link to the smallest key that shares a thing, in place of all pairs of keys that do.
    links = on.join(on.groupBy("what").agg(F.min("g").alias("c")), "what").select("g", "c").distinct()
    links = staged(links.unionByName(links.select(F.col("c").alias("g"), F.col("g").alias("c"))).distinct(), "write-links")
    parts, moved = staged(links.groupBy("g").agg(F.min("c").alias("part")), "write-parts"), True
    while moved:
        heard = links.join(parts.select(F.col("g").alias("c"), "part"), "c").groupBy("g").agg(F.min("part").alias("part"))
        jumps = parts.select(F.col("g").alias("part"), F.col("part").alias("further"))
        now = staged(heard.join(jumps, "part").select("g", F.least("part", "further").alias("part")), "write-parts")
        moved = not now.join(parts.withColumnRenamed("part", "was"), "g").filter("part <> was").isEmpty()
        parts = now
    return parts, staged(on.join(parts, "g").groupBy("what").agg(F.min("part").alias("part")), "write-whats")


class _Part:
    """The live rows of one component, as its writes change them."""

    def __init__(self, key: str, dimension: int):
        self.key, self.n = key, 0
        self.x, self.length, self.alive = np.zeros((4, dimension)), np.ones(4), np.zeros(4, dtype=bool)
        self.place: dict[str, int] = {}  # of a class
        self.norms: list[str | None] = []
        self.ids: list[list[str]] = []  # of a class, a heap; retired ones go when they come up
        self.live: dict[str, int | None] = {}
        self.refs: dict[str, list[tuple]] = {}

    def add(self, row) -> None:
        i = None
        if row.cls is not None:
            i = self.place.setdefault(row.cls, self.n)
            if i == self.n:
                if i == len(self.x):
                    self.x, self.length, self.alive = np.concatenate([self.x, np.zeros_like(self.x)]), np.concatenate([self.length, np.ones(i)]), np.concatenate([self.alive, np.zeros(i, dtype=bool)])
                if len(row.v) == self.x.shape[1]:  # others are near none but their own class
                    self.x[i], self.length[i] = row.v, np.linalg.norm(row.v)
                self.n += 1
                self.norms.append(row.norm)
                self.ids.append([])
            heapq.heappush(self.ids[i], row.id)
            self.alive[i] = True
        if row.ref is not None:
            insort(self.refs.setdefault(row.ref, []), (row.dated, row.at, row.id))
        self.live[row.id] = i

    def retire(self, key: str) -> None:
        i = self.live.pop(key)
        if i is not None:
            heap = self.ids[i]
            while heap and heap[0] not in self.live:
                heapq.heappop(heap)
            self.alive[i] = bool(heap)

    def newest(self, ref: str) -> str | None:
        rows = self.refs.get(ref, [])
        while rows and rows[-1][2] not in self.live:
            rows.pop()
        return rows[-1][2] if rows else None

    def nearest(self, cls: str, v: np.ndarray) -> tuple[float, int] | None:
        """Similarity and place of the best live class: the most similar, then that of the smallest id."""
        own, best = self.place.get(cls, -1), []
        if len(v) == self.x.shape[1]:
            length = np.linalg.norm(v)
            j = np.flatnonzero(self.alive[: self.n] & (self.x[: self.n] @ (v / length) >= (SUPERSEDE - vector_index.SLACK) * self.length[: self.n]))
            found = np.round(np.einsum("j,ij->i", v, self.x[j]) / (length * self.length[j]), 6)
            found[j == own] = 1.0
            if len(j) and (top := found.max()) >= SUPERSEDE:
                best = [(-top, self.ids[i][0], i) for i in j[found == top]]
        elif own >= 0 and self.alive[own]:
            best = [(-1.0, self.ids[own][0], own)]
        return (-min(best)[0], min(best)[2]) if best else None

    def decide(self, row) -> tuple[str, str | None, float | None]:
        """decision, target_id, similarity of a write, and what it changes."""
        target = similarity = None
        if row.ref is not None:
            target = self.newest(row.ref)
            decision = "add" if target is None else "update"
        elif (near := self.nearest(row.cls, row.v)) is None:
            decision = "add"
        else:
            similarity, target = float(near[0]), self.ids[near[1]][0]
            if row.norm is not None and row.norm == self.norms[near[1]]:
                decision = "noop"
            else:
                decision = "invalidate" if row.denies else "noop" if similarity >= DUPLICATE else "update"
        if decision in ("update", "invalidate"):
            self.retire(target)
        if decision != "noop":
            self.add(row)
        return decision, target, similarity


def _plays(dimension: int):
    """Rows in order of part, live ones before writes, and those by seq: one part is held at a time, its writes pass by."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for pdf in batches:
            out = []
            texts = {c: pdf[c].astype(object).where(pdf[c].notna(), None) for c in ("cls", "ref", "norm")}
            for row in pdf.assign(**texts).itertuples(index=False):
                if now is None or now.key != row.part:
                    now = _Part(row.part, dimension)
                if row.writes:
                    out.append((row.seq, row.id, *now.decide(row)))
                else:
                    now.add(row)
            if out:
                yield pd.DataFrame(out, columns=["seq", "id", "decision", "target_id", "similarity"])

    return run


def _played(undecided: DataFrame, batch: DataFrame, done: DataFrame, touched: DataFrame, some: DataFrame, dimension: int) -> DataFrame:
    """All writes that are left, a component after the other in a task: seq, id, decision, target_id, similarity."""
    parts, whats = _components(touched, undecided)
    by = lambda key: whats.select(F.col("what").alias(key), F.col("part").alias(f"by_{key}"))
    live = _live(some, done).join(by("class"), "class", "left").join(by("ref"), "ref", "left").withColumn("part", F.coalesce("by_class", "by_ref")).filter("part is not null")
    writes = batch.join(undecided.select("seq", "g"), "seq").join(parts, "g")
    at = F.expr("cast(cast(cast(valid_at - timestamp_ntz'1970-01-01' as interval second) as decimal(18, 6)) * 1000000 as bigint)")
    row = lambda is_write: (
        "part", F.lit(is_write).alias("writes"), F.coalesce("seq", F.lit(0)).alias("seq"), "id", F.col("class").alias("cls"), "ref", F.col("valid_at").isNotNull().alias("dated"),
        F.coalesce(at, F.lit(0)).alias("at"), "norm", F.coalesce("denies", F.lit(False)).alias("denies"), "v",
    )
    rows = live.select(*row(False)).unionByName(writes.select(*row(True)))
    rows = rows.repartition("part").sortWithinPartitions("part", "writes", "seq")
    return rows.mapInPandas(_plays(dimension), "seq long, id string, decision string, target_id string, similarity double")


def write_batch_ordered(new: DataFrame, current: DataFrame) -> DataFrame:
    """seq, id, decision, target_id, similarity of each write; ``new`` has seq, id, namespace, source_ref, content, embedding, valid_at, and ``current`` the same but seq.

    ``current`` are the rows that are live before the batch.
    """
    batch = staged(_described(new, F.col("seq").cast("long")), "writes")
    # Texts are read once.
    rows = staged(_described(current, F.lit(None).cast("long")), "write-current").unionByName(batch)
    near, dimension = _near(batch, rows)
    touched, some, crowded = _touched(near, rows, batch)
    described, batch = batch, batch.select("seq", "id", "ref", F.coalesce("ref", "class").alias("g"))
    # Without a vector and a ref a write is near none.
    none = F.lit(None).cast("string")
    done = staged(batch.filter("g is null").select("seq", "id", F.lit("add").alias("decision"), none.alias("target_id"), F.lit(None).cast("double").alias("similarity")), "decided")
    left = batch.filter("g is not null")
    for turn in range(ROUNDS + 1):
        if (undecided := left.join(done, "seq", "left_anti")).isEmpty():
            break
        more = _round(undecided, done, near, touched, some, crowded) if turn < ROUNDS else _played(undecided, described, done, touched, some, dimension)
        done = staged(done.unionByName(more), "decided")
    return done


def state_after(new: DataFrame, current: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of the store after the batch: id, live, superseded_by, importance.

    A repetition makes its row a little more important; an update leaves a pointer to its successor.  Rows are derived, never changed in place.
    """
    hits = decisions.filter("target_id is not null").groupBy(F.col("target_id").alias("id")).agg(
        F.count_if(F.col("decision") == "noop").alias("noops"),
        F.max(F.when(F.col("decision") == "update", F.col("id"))).alias("superseded_by"),
        F.count_if(F.col("decision").isin("update", "invalidate")).alias("retirements"),
    )
    base = F.when(F.col("importance") > 0, F.col("importance")).otherwise(0.5)
    added = new.join(decisions.filter(F.col("decision").isin(*CHANGES)).select("id"), "id", "left_semi").select("id", base.alias("importance"))
    rows = current.select("id", F.col("importance").cast("double").alias("importance")).unionByName(added)
    return rows.join(hits, "id", "left").select(
        "id",
        (F.coalesce("retirements", F.lit(0)) == 0).alias("live"),
        "superseded_by",
        F.round(F.least(F.lit(1.0), F.col("importance") + NOOP_BUMP * F.coalesce("noops", F.lit(0))), 6).alias("importance"),
    )
