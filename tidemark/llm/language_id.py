"""Operator 9, language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: lower-cased letters and single spaces; all runs of 1 to 3 characters, hashed to
2**bits buckets; log(1 + count) times the bucket's inverse document frequency, to unit length.
Training: follow-the-regularised-leader (FTRL-proximal) with L1 and L2 penalties.  Then one
temperature is fitted to a fold of its own, so that scores are calibrated probabilities.

Document frequencies count all learnable documents, in one distributed pass.  Weights are
fitted to a bounded sample: per language the rows with the smallest id hashes, at most
``train_rows`` over all languages, and at most a quarter as many for the temperature.  Only their
sparse features reach the driver.  Predictions read every whole text.

Rows whose crc32(id as text) mod 5 is 0 are never learnt from; of the others, remainder 1 gives the
temperature, the rest the weights.  Text alone is an input of a prediction.

A null text or one without a letter gets ``und`` and score 0.  A row with a null id is not learnt
from and not held out.  Without any learnable row all rows get ``und``.  Rows may repeat.  An empty
table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, process_cache

BITS = 14
_CHUNK_DOCS = 128


def _letters() -> np.ndarray:
    cache = process_cache("language")
    if "letters" not in cache:
        cache["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return cache["letters"]


def char_counts(text: str | None, bits: int = BITS) -> tuple[np.ndarray, bool]:
    """Counts of hashed character runs, and whether there is any letter."""
    size = 1 << bits
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(size, dtype=np.int64), False
    points = np.where(letter, points, np.uint32(32))
    points = points[letter | np.r_[True, letter[:-1]]]
    points = np.r_[np.uint32(32), points, np.uint32(32)].astype(np.uint32)
    shift = np.uint32(32 - bits)
    one = points * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + one[1:]
    three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(0xC2B2AE35) + one[2:]
    mixed = [(x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift for x in (one, two, three)]
    return np.bincount(np.concatenate(mixed), minlength=size), True


class Ftrl:
    """FTRL-proximal with elastic-net penalties; one weight vector per class."""

    def __init__(self, size: int, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def step(self, at: np.ndarray, w: np.ndarray, gradient: np.ndarray) -> None:
        n = self.n[at]
        sigma = (np.sqrt(n + gradient**2) - np.sqrt(n)) / self.alpha
        self.z[at] += gradient - sigma * w
        self.n[at] = n + gradient**2


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.sqrt((x**2).sum(axis=-1, keepdims=True)), 1e-12)


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, from a fixed grid."""
    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 120))
    loss = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _sparse(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(2):
            counts, _ = char_counts(text.as_py(), bits)
            at = np.flatnonzero(counts)
            rows.append((at.astype(np.int32), counts[at].astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                pa.array([r[1] for r in rows], pa.list_(pa.int32())),
            ],
            names=["lang", "fold", "at", "times"],
        )


def _frequencies(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    seen, docs = np.zeros(1 << bits, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            counts, any_letter = char_counts(text.as_py(), bits)
            seen += counts > 0
            docs += any_letter
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.r_[-1, at]), pa.array(np.r_[docs, seen[at]])], names=["bucket", "docs"]
    )


class LanguageModel:
    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float, bits: int):
        self.langs, self.idf, self.weights, self.temperature, self.bits = langs, idf, weights, temperature, bits

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        counts = np.zeros((len(texts), 1 << self.bits), dtype=np.float32)
        any_letter = np.zeros(len(texts), dtype=bool)
        for i, text in enumerate(texts):
            counts[i], any_letter[i] = char_counts(text, self.bits)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        p = softmax(tfidf(counts, self.idf) @ self.weights / self.temperature)
        best = p.argmax(axis=1)
        names = [self.langs[k] if ok else "und" for k, ok in zip(best, any_letter, strict=True)]
        return names, np.where(any_letter, p.max(axis=1).astype(np.float64), 0.0)


def fit(
    rows: DataFrame,
    *,
    bits: int = BITS,
    train_rows: int = 3000,
    epochs: int = 3,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 0.002,
    l2: float = 0.001,
) -> LanguageModel:
    """``rows``: id, text, lang, fold (1: temperature, others: weights), learnable rows only."""
    spark = rows.sparkSession
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not langs:
        return LanguageModel([], np.zeros(0), np.zeros((0, 0)), 1.0, bits)
    seen = (
        rows.select("text")
        .mapInArrow(lambda b: _frequencies(b, bits), "bucket long, docs long")
        .groupBy("bucket")
        .agg(F.sum("docs").alias("docs"))
        .toPandas()
    )
    total = int(seen.loc[seen["bucket"] < 0, "docs"].sum())
    frequency = np.zeros(1 << bits)
    kept = seen[seen["bucket"] >= 0]
    frequency[kept["bucket"].to_numpy()] = kept["docs"].to_numpy()
    idf = np.log((1 + total) / (1 + frequency)) + 1

    each = max(1, train_rows // len(langs))
    part = (F.col("fold") == 1).cast("int")
    sizes = {(r["lang"], r["part"]): r["n"] for r in rows.groupBy("lang", part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    # A share of each language by hash, a little over what is wanted, so that only about the sample is ranked.
    span = 1 << 30
    shares, limits = [], []
    for (lang, p), n in sorted(sizes.items()):
        limit = max(1, each // 4) if p else each
        name = F.lit(f"{lang}|{p}")
        shares += [name, F.lit(min(span, int(span * (1.3 * limit + 20) / n)))]
        limits += [name, F.lit(limit)]
    key = F.concat(F.col("lang"), F.lit("|"), part.cast("string"))
    head = rows.select("id", key.alias("key")).filter(F.pmod(F.xxhash64("id"), F.lit(span)) < F.create_map(*shares)[F.col("key")])
    by = Window.partitionBy("key").orderBy(F.pmod(F.xxhash64("id"), F.lit(span)), "id")
    ids = head.withColumn("k", F.row_number().over(by)).filter(F.col("k") <= F.create_map(*limits)[F.col("key")])
    picked = [(r["id"],) for r in ids.select("id").distinct().collect()]
    # At most train_rows * 5 / 4 ids, and a language at least one.
    sample = rows.join(F.broadcast(spark.createDataFrame(picked, "id long")), "id")
    sparse = (
        sample.select("lang", "fold", "text", "id")
        .mapInArrow(lambda b: _sparse_with_id(b, bits), "lang string, fold int, at array<int>, times array<int>, id long")
        .toPandas()
        .sort_values("id", key=lambda x: (x * 2654435761) % (1 << 31), kind="stable")
    )
    number = {lang: k for k, lang in enumerate(langs)}

    def vector(r) -> tuple[np.ndarray, np.ndarray]:
        at = np.asarray(r.at, dtype=np.int64)
        x = np.log1p(np.asarray(r.times, dtype=np.float64)) * idf[at]
        return at, x / max(np.sqrt((x**2).sum()), 1e-12)

    model = Ftrl(1 << bits, len(langs), alpha, beta, l1, l2)
    train = [(*vector(r), number[r.lang]) for r in sparse[sparse["fold"] != 1].itertuples() if len(r.at)]
    for _ in range(epochs):
        for at, x, y in train:
            w = model.weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            model.step(at, w, np.outer(x, p))
    weights = model.weights()
    held = [(*vector(r), number[r.lang]) for r in sparse[sparse["fold"] == 1].itertuples() if len(r.at)]
    temperature = 1.0
    if held:
        temperature = fit_temperature(np.array([x @ weights[at] for at, x, _ in held]), np.array([y for *_, y in held]))
    return LanguageModel(langs, idf.astype(np.float32), weights.astype(np.float32), temperature, bits)


def _sparse_with_id(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for out in _sparse(iter([batch.select([0, 1, 2])]), bits):
            yield pa.RecordBatch.from_arrays([*out.columns, batch.column(3)], names=[*out.schema.names, "id"])


def language_of(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK_DOCS):
                part = batch.slice(at, _CHUNK_DOCS)
                names, score = model.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array(score)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def learnable(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)).cast("int")
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
        fold.alias("fold"),
    ).filter("fold <> 0 and lang is not null and text is not null")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language_of(docs, fit(learnable(docs)))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
