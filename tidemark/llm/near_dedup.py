"""Operator 3, near dedup: ProbMinHash signatures, banding, exact verification, components.

* A document's weighted set: its runs of five lower-cased words (a shorter text is one run),
  weight 1 + log2(times it occurs).
* ProbMinHash: every element has a Poisson process of arrivals with its weight as rate, drawn
  from the element's hash alone.  An arrival carries a time and a register; a register keeps
  the element that came first.  An element whose next arrival is later than the latest of the
  document's registers can change nothing and is done (early termination).  Two documents
  agree in a register with the probability Jaccard similarity of their weighted sets.
* Banding: ``bands`` keys of ``rows`` registers each.  A document in which a run recurs has the keys of
  its unweighted set as well: links are decided by plain Jaccard similarity, which a much repeated
  run leaves high and the weighted one doesn't.  Where no run recurs the two sets of keys are one.
* Verification: candidate pairs are compared by the exact Jaccard similarity of their sets of
  five-word runs; links are pairs of ``threshold`` or more.
* Classes are the connected components of the links.

Equal word sequences are folded first, so a text with a third of all rows is one candidate.
Within a bucket not all pairs are made.  First every member is compared with the bucket's head.
While a bucket still holds members of several classes, leaders, taken from its smaller
classes, are compared with all members of other classes and then retire; their number per
bucket is sixteen times larger each round, and rounds end when no bucket has an open pair.  So each
candidate pair is compared, or is in one class already, or is ruled out by an exact bound
(``_bounds``, ``_in_reach``): no cap, no loss.

Hot keys: a bucket or a text with over a ``HOT``-th of the documents is split into ``PARTS`` parts by its members' ids
before a join, and what it is joined with is copied to each; there are at most ``HOT`` such texts and ``HOT`` x keys such
buckets, whatever the size of the corpus, so they are broadcast.  A bucket's leaders are ranked in parts first.

``links`` of a document are the other texts that it was compared with and found similar to; two documents that were in one class
already are not compared, so a class is connected by these links but does not list all its pairs.

Links, labels and keys stay in tables; the driver sees counts only.

Null and empty texts (no words) are equal word sequences, so one class.  Rows that repeat an id
are one document.  A row with a null id is its own class, with null class_id and no links, and is kept.
An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, process_cache, staged, text_or_empty

#: Words whose hashes a process remembers.
CACHED_WORDS = 300_000
#: Characters of text and documents that are sketched at a time (a longer document alone).
CHUNK_CHARS, CHUNK_DOCS = 2_000_000, 4_000
#: A key is hot if it has over a ``HOT``-th of the documents, and is then dealt out in so many parts.
HOT, PARTS = 1_000, 32
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(0x100000001B3)


def _steps(k: int) -> np.uint64:
    return np.uint64(k * int(_GOLDEN) % (1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def words_of(text: str) -> list[str]:
    return text.lower().split()


def shingle_hashes(words: list[list[str]], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """All runs of ``width`` words: their hashes, and how many each document has."""
    cache = process_cache("near-dedup").setdefault("word-hashes", _WordHashes())
    n = np.array([len(w) for w in words], dtype=np.int64)
    full = np.where(n > 0, np.maximum(n, width), 0)
    hashes = np.zeros(int(full.sum()), dtype=np.uint64)
    at = 0
    for w, k in zip(words, full, strict=True):
        hashes[at : at + len(w)] = np.fromiter((cache[x] for x in w), dtype=np.uint64, count=len(w))
        at += int(k)
    counts = np.where(full > 0, full - width + 1, 0)
    first = np.repeat(np.cumsum(full) - full, counts) + _within(counts)
    out = np.zeros(len(first), dtype=np.uint64)
    for k in range(width):
        out = out * _PRIME + _mix(hashes[first + k] + _steps(k))
    return _mix(out), counts


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0]-1, 0, 1, ..."""
    return np.arange(int(counts.sum()), dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)


def weighted_sets(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs per document: document number, 44-bit element, weight 1 + log2(times)."""
    bits = np.uint64(44)
    doc = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    key = np.sort((doc << bits) | (hashes >> np.uint64(20)))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.r_[first, len(key)])
    key = key[first]
    element = _mix((key & np.uint64((1 << 44) - 1)) + _GOLDEN)
    return (key >> bits).astype(np.int64), element, 1 + np.log2(np.maximum(times, 1))


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """Signatures (docs x registers, 32-bit elements) of documents that each have an element."""
    low = np.uint64(0xFFFFFFFF)
    best = np.full(docs * registers, np.uint64(0xFFFFFFFFFFFFFFFF))
    state, time = element.copy(), np.zeros(len(element))
    while len(doc):
        state = state + _GOLDEN
        draw = _mix(state)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weight
        register = (_mix(draw ^ _GOLDEN) % np.uint64(registers)).astype(np.int64)
        stamp = time.astype(np.float32).view(np.uint32).astype(np.uint64)
        np.minimum.at(best, doc * registers + register, (stamp << np.uint64(32)) | (element & low))
        latest = best.reshape(docs, registers).max(axis=1) >> np.uint64(32)
        on = np.flatnonzero(stamp <= latest[doc])
        doc, element, weight, state, time = doc[on], element[on], weight[on], state[on], time[on]
    return (best & low).astype(np.uint32).reshape(docs, registers)


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    docs, registers = signatures.shape
    rows = registers // bands
    parts = signatures.reshape(docs, bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _GOLDEN, (docs, bands)).copy()
    for j in range(rows):
        key = _mix(key ^ (parts[:, :, j] + _steps(j + 1)))
    return key.view(np.int64)


def _unit_keys(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the documents in which a run recurs, and their band keys with all weights 1."""
    plain = np.unique(doc[weight > 1])
    some = np.isin(doc, plain)
    at = np.searchsorted(plain, doc[some])
    signatures = prob_minhash(at, element[some], np.ones(len(at)), len(plain), bands * rows)
    return plain, band_keys(signatures, bands)


def _sketcher(bands: int, rows: int, width: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int32()), ("keys", pa.list_(pa.int64()))]
    )

    def sketch(ids: list, texts: list[str]) -> pa.RecordBatch:
        import xxhash

        words = [words_of(t) for t in texts]
        digests = [xxhash.xxh3_128_digest(" ".join(w)) for w in words]
        hashes, counts = shingle_hashes(words, width)
        doc, element, weight = weighted_sets(hashes, counts)
        n = np.bincount(doc, minlength=len(texts))
        some = np.flatnonzero(n)
        number = np.cumsum(n > 0) - 1
        at = number[doc]
        keys = band_keys(prob_minhash(at, element, weight, len(some), bands * rows), bands)
        plain, unit = _unit_keys(at, element, weight, bands, rows)
        new = unit != keys[plain]
        owner = np.r_[np.repeat(np.arange(len(some)), bands), np.repeat(plain, bands)[new.reshape(-1)]]
        keys = np.r_[keys.reshape(-1), unit[new]][np.argsort(owner, kind="stable")]
        many = np.zeros(len(texts), dtype=np.int64)
        many[some] = np.bincount(owner, minlength=len(some))
        offsets = np.r_[0, np.cumsum(many)].astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(n.astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys)),
            ],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py()
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= CHUNK_CHARS or len(ids) >= CHUNK_DOCS:
                    yield sketch(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield sketch(ids, texts)

    return run


def _comparer(width: int):
    """Exact comparison of the pairs: the size of what both have, the similarity, and, as bits over the
    first document's runs in the order of their hashes, which of them the second one has."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("both", pa.int64()), ("similarity", pa.float64()), ("bits", pa.list_(pa.int64()))])

    def distinct(text: str) -> np.ndarray:
        return np.unique(shingle_hashes([words_of(text)], width)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for a, b, text_a, text_b in zip(*(batch.column(k) for k in range(4)), strict=True):
                if a != at:  # pairs come sorted by their first document
                    at, left = a, distinct(text_a.as_py())
                right = distinct(text_b.as_py())
                has = np.isin(left, right, assume_unique=True)
                both = int(has.sum())
                bits = np.zeros(-(-len(left) // 64) * 64, dtype=np.uint8)
                bits[: len(left)] = has
                row = a.as_py(), b.as_py(), both, both / max(1, len(left) + len(right) - both), np.packbits(bits).view(np.int64)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return run


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, label): the smallest node of each node's component, for all nodes with an edge.

    Smallest labels spread along the edges and then jump along themselves, so a path of n
    nodes takes about log2(n) rounds.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    both = both.unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y")))
    nodes = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")).withColumnRenamed("x", "node")
    if labels is not None:
        old = labels.withColumnRenamed("label", "old")
        nodes = nodes.join(old, "node", "left").select("node", F.least("label", "old").alias("label"))
    now = staged(nodes, "labels")
    while True:
        near = both.join(now.select(F.col("node").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("near"))
        spread = now.join(near, now.node == near.x).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # The jump: the label's own label of the round before.
        up = now.select(F.col("node").alias("label"), F.col("label").alias("up"))
        then = staged(
            spread.join(up, "label", "left").select("node", "old", F.least("label", "up").alias("label")), "labels"
        )
        changed = not then.filter("label < old").isEmpty()
        now = then.select("node", "label")
        if not changed:
            return now


def near_classes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    threshold: float = 0.8,
    bands: int = 32,
    rows: int = 6,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest id of its class), n_shingles, links, kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    sketches = staged(
        texts.mapInArrow(_sketcher(bands, rows, width), "doc_id long, digest binary, n int, keys array<long>"),
        "sketches",
    )
    known = sketches.filter("doc_id is not null")
    many = known.count() // HOT + 1
    folded = staged(
        known.groupBy("digest").agg(
            F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("copies")
        ),
        "folded",
    )
    member = _shared(folded.select("rep", F.explode("keys").alias("bucket")), many)
    member = staged(member, "bucket-members")
    wanted = member.select(F.col("rep").alias("doc_id")).distinct()
    sources = staged(texts.join(wanted, "doc_id", "left_semi"), "candidate-texts")
    bounds = staged(_bounds(sources, width).filter(f"u >= {threshold} * n"), "bounds")
    members = staged(_shared(member.join(bounds, "rep").select("bucket", "rep", "n", "u"), many), "bounded-members")

    # First every member meets its bucket's head: of its members the one that shares most of its runs.
    order = F.struct((-F.col("u") / F.col("n")).alias("o"), "rep")
    heads = members.groupBy("bucket").agg(F.min_by(F.struct("rep", "n", "u"), order).alias("h"), F.count(F.lit(1)).alias("size"))
    headed = _dealt(members, heads, "bucket", "rep", F.col("size") > many).select(
        "bucket", "rep", "n", "u", F.col("h.rep").alias("head"), F.col("h.n").alias("hn"), F.col("h.u").alias("hu")
    ).filter("rep <> head")
    first = headed.filter(f"least(u, hu) >= {threshold} * (n + hn - least(u, hu))").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    met = staged(_compared(staged(first, "pairs"), sources, width), "compared")
    found = met.filter(F.col("similarity") >= threshold).select("a", "b")
    labels, all_links = components(found), found
    seen = met.select(F.col("a").alias("head"), F.col("b").alias("rep"), F.col("both").alias("i"), "bits")
    members = _open(headed.select("bucket", "rep", "n", "u", "head").join(seen, ["head", "rep"], "left"), labels, many)
    tested, leaders = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), 16
    while not members.isEmpty():
        lead = staged(_leaders(members.filter("minor"), leaders), "leaders")
        # What is still open is small; there a pair is made in one bucket that it shares, and not in each.
        reps = members.select(F.col("rep").alias("doc_id")).distinct()
        keys = staged(folded.select(F.col("rep").alias("doc_id"), "keys").join(reps, "doc_id", "left_semi"), "open-keys")
        names = ("rep", "n", "u", "i", "bits", "label")
        left = lead.select("bucket", "size", *[F.col(c).alias(f"{c}_x") for c in names])
        left = left.join(keys.select(F.col("doc_id").alias("rep_x"), F.col("keys").alias("keys_x")), "rep_x")
        right = members.drop("size").join(keys.select(F.col("doc_id").alias("rep"), "keys"), "rep")
        made = (
            _dealt(right, left, "bucket", "rep", F.col("size") > many)
            .filter("rep_x <> rep and label_x <> label")
            .filter(f"least(u_x, u) >= {threshold} * (n_x + n - least(u_x, u))")
            .filter(_in_reach(threshold))
            .filter(_least_shared())
            .select(F.least("rep_x", "rep").alias("a"), F.greatest("rep_x", "rep").alias("b"))
            .distinct()
        )
        pairs = staged(made.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.unionByName(pairs)
        links = staged(_compared(pairs, sources, width).filter(F.col("similarity") >= threshold).select("a", "b"), "links")
        all_links = all_links.unionByName(links)
        labels = _joined(labels, links)
        retired = lead.select("bucket", "rep")
        members = _open(members.drop("label", "minor", "size").join(retired, ["bucket", "rep"], "left_anti"), labels, many)
        leaders *= 16
    ends = all_links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    of = folded.select("digest", "rep", "copies").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").join(ends, "rep", "left")
    of = of.select("digest", "copies", F.coalesce("label", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    out = _dealt(known.select("doc_id", "digest", "n"), of, "digest", "doc_id", F.col("copies") > many)
    nameless = sketches.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), "n", F.lit(0).cast("long").alias("links"))
    return (
        out.select("doc_id", "class_id", "n", "links")
        .unionByName(nameless)
        .select(
            "doc_id", "class_id", F.col("n").alias("n_shingles"), "links", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")
        )
    )


def _part(spread: str) -> Column:
    return F.pmod(F.xxhash64(spread), F.lit(PARTS)).cast("int")


def _dealt(rows: DataFrame, few: DataFrame, key: str, spread: str, hot: Column) -> DataFrame:
    """``rows`` joined with ``few``, which has few rows a key; where ``few`` says that a key is hot, its rows are dealt out by ``spread``."""
    names = F.broadcast(few.filter(hot).select(key, F.lit(1).alias("_hot")).distinct())
    part = F.when(F.col("_hot").isNotNull(), _part(spread)).otherwise(0)
    left = rows.join(names, key, "left").withColumn("_part", part).drop("_hot")
    copies = F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0))))
    return left.join(few.withColumn("_part", copies), [key, "_part"]).drop("_part")


def _shared(members: DataFrame, many: int) -> DataFrame:
    """Members of buckets that hold more than one document."""
    several = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return _dealt(members, several, "bucket", "rep", F.col("size") > many).drop("size")


def _leaders(minor: DataFrame, leaders: int) -> DataFrame:
    """Each bucket's first few members: first of its parts, then of what they leave, so no task sees a whole bucket."""
    order = [-F.col("u") / F.col("n"), F.col("rep")]
    for keys in (["bucket", "_part"], ["bucket"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        minor = minor.withColumn("_part", _part("rep")).withColumn("rank", rank).filter(F.col("rank") <= leaders).drop("rank")
    return minor.drop("_part")


def _bounds(sources: DataFrame, width: int) -> DataFrame:
    """Per candidate document its number of runs, n, and of those that another candidate has too, u.

    Two documents share at most min(u, u') runs, so their similarity is at most
    min(u, u') / (n + n' - min(u, u')): an exact bound that rules out most pairs of a large
    family of edited copies, and of documents that only share a passage, without comparing them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [np.unique(shingle_hashes([words_of(t.as_py())], width)[0]).view(np.int64) for t in part.column(1)]
                offsets = np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))],
                    names=["rep", "runs"],
                )

    sets = staged(
        sources.select("doc_id", "text").mapInArrow(run, "rep long, runs array<long>"), "candidate-runs"
    )
    lonely = (
        sets.select("rep", F.explode("runs").alias("run"))
        .groupBy("run")
        .agg(F.count(F.lit(1)).alias("docs"), F.min("rep").alias("rep"))
        .filter("docs = 1")
        .groupBy("rep")
        .agg(F.count(F.lit(1)).alias("lonely"))
    )
    n = F.size("runs").cast("long")
    return sets.select("rep", n.alias("n")).join(lonely, "rep", "left").select(
        "rep", "n", (F.col("n") - F.coalesce("lonely", F.lit(0))).alias("u")
    )


def _compared(pairs: DataFrame, sources: DataFrame, width: int) -> DataFrame:
    b = pairs.join(sources.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = b.join(sources.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(
        _comparer(width), "a long, b long, both long, similarity double, bits array<long>"
    )


def _in_reach(threshold: float) -> Column:
    """Whether two members may be similar, by what each shares with their bucket's head.

    Of the head's runs both have those whose bits both have set; of other runs that any candidate
    shares, the first has u_x - i_x and the second u - i, so both have at most the smaller number.
    Without bits (not compared with the head) nothing is ruled out.
    """
    common = F.aggregate(F.zip_with("bits_x", "bits", lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda acc, c: acc + c)
    most = common + F.least(F.col("u_x") - F.col("i_x"), F.col("u") - F.col("i"))
    return F.coalesce(most >= threshold * (F.col("n_x") + F.col("n") - most), F.lit(True))


def _least_shared() -> Column:
    """Whether this bucket is the one with the smallest key of those that both members share."""
    return F.array_min(F.array_intersect("keys_x", "keys")) == F.col("bucket")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links: the links, as edges between labels, are a small graph of their own."""
    of = labels.select(F.col("node"), "label")
    ends = links.join(of.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(
        of.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left"
    )
    ends = staged(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b").distinct(), "label-links")
    if ends.isEmpty():
        return labels
    merged = components(ends)
    moved = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    moved = moved.select("node", F.coalesce("to", "label").alias("label"))
    new = merged.join(labels.select("node"), "node", "left_anti").select("node", "label")
    return staged(moved.unionByName(new), "labels")


def _open(members: DataFrame, labels: DataFrame, many: int) -> DataFrame:
    """Members of buckets that hold several classes, with label, minor (not of its largest class) and the bucket's size."""
    at = members.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn(
        "label", F.coalesce("label", "rep")
    )
    by_class = at.groupBy("bucket", "label").count()
    of = by_class.groupBy("bucket").agg(
        F.max_by("label", F.struct("count", "label")).alias("major"), F.count(F.lit(1)).alias("classes"), F.sum("count").alias("size")
    )
    several = _dealt(at, of.filter("classes > 1").select("bucket", "major", "size"), "bucket", "rep", F.col("size") > many)
    several = several.withColumn("minor", F.col("label") != F.col("major"))
    return staged(several.drop("major"), "open-members")


def op3_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir))
