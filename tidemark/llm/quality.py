"""Operator 10, quality classifier: ordinal cumulative-link regression on graded ratings.

A text's score is s = w . x with one weight vector for all grades; grade k or less has the
probability sigmoid(t_k - s), with ordered thresholds t_0 < t_1 < ...  The thresholds are a
first one and positive steps, so they stay ordered; the weights are fitted by FTRL with
elastic-net penalties, the thresholds by adaptive gradient steps.

Features, hashed to 2**bits buckets: which words and beginnings of words occur (lower case, outer
punctuation cut off), and, as shares of all words, their shapes (case, digits, trailing sign) and how
many are repeats.

Grades come from the labels: 0 for quality 0, 1 for toxic text of quality 1, 2 for the rest.
The weights are fitted to a bounded sample: the ``train_rows`` labelled documents with the
smallest id hashes; a fifth of it sets the cut.  Only its sparse features reach the driver.
Every whole text is scored: expected grade, probability of the top grade (the tail), and kept
where the tail reaches the cut.  The cut is the one, up to 0.5, that keeps at least
``keep_clean`` of the sample's top-graded documents held back.

Null and empty texts have no word: they get the score of an empty vector and are kept, as nothing
speaks against them.  Unlabelled rows are scored like others; labels of unknown documents or with a
null are ignored; without any label all rows get the top grade.  Rows may repeat.  An empty table
gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, process_cache

BITS = 18
CACHED_WORDS = 200_000
#: Lengths of the beginnings of words that are features, too: inflected and compound forms share them.
BEGINNINGS = (4, 5)
_CORE = re.compile(r"^[\W_]+|[\W_]+$")


class _Buckets(dict):
    """Word to (bucket of its shape, buckets of the word and of its beginnings)."""

    def __init__(self, bits: int):
        self.mask = (1 << bits) - 1

    def _bucket(self, name: str) -> int:
        return zlib.crc32(name.encode("utf-8", "replace")) & self.mask

    def __missing__(self, word: str) -> tuple[int, tuple[int, ...]]:
        if len(self) > CACHED_WORDS:
            self.clear()
        core = _CORE.sub("", word)
        last = "" if word[-1].isalnum() else word[-1]
        case = "U" if len(core) > 1 and core.isupper() else "n" if any(c.isdigit() for c in core) else "w" if core else "-"
        core = core.lower()
        parts = ["w:" + core, *(f"p:{core[:k]}" for k in BEGINNINGS if len(core) > k)]
        self[word] = out = self._bucket(f"s:{case}{last}"), tuple(map(self._bucket, parts))
        return out


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    known = process_cache("quality").setdefault(("buckets", bits), _Buckets(bits))
    counted = Counter(words)
    seen: set[int] = set()
    shapes: dict[int, int] = {}
    for word, times in counted.items():
        shape, parts = known[word]
        seen.update(parts)
        shapes[shape] = shapes.get(shape, 0) + times
    n = len(words)
    repeats = zlib.crc32(b"r:repeats") & ((1 << bits) - 1)
    at = [*seen, *shapes, repeats]
    value = [1.0] * len(seen) + [2 * c / n for c in shapes.values()] + [2 * (1 - len(counted) / n)]
    return np.array(at, dtype=np.int64), np.array(value)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class OrdinalModel:
    """Shared weights, ordered thresholds."""

    def __init__(self, bits: int, grades: int):
        self.bits, self.grades = bits, grades
        self.weights = np.zeros(1 << bits, dtype=np.float32)
        self.thresholds = np.arange(grades - 1, dtype=np.float64) - (grades - 2) / 2
        self.cut = 0.5

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            at, x = features(text, self.bits)
            out[i] = float(x @ self.weights[at])
        return out

    def tails(self, s: np.ndarray) -> np.ndarray:
        """Probability of grade k or more, k = 1 ... grades - 1."""
        return sigmoid(s[:, None] - self.thresholds[None, :])

    def fit(self, rows, *, epochs: int, alpha: float, beta: float, l1: float, l2: float, rate: float) -> None:
        z, n = np.zeros(1 << self.bits), np.zeros(1 << self.bits)
        first, steps = self.thresholds[0], np.log(np.diff(self.thresholds))
        g2 = np.full(len(self.thresholds), 1e-6)
        last = self.grades - 1
        for _ in range(epochs):
            for at, x, y in rows:
                x = x.astype(np.float64)
                shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
                w = -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)
                t = first + np.r_[0, np.cumsum(np.exp(steps))]
                s = float(x @ w)
                upper = 1.0 if y == last else sigmoid(t[y] - s)
                lower = 0.0 if y == 0 else sigmoid(t[y - 1] - s)
                p = max(upper - lower, 1e-9)
                du = 0.0 if y == last else upper * (1 - upper)
                dl = 0.0 if y == 0 else lower * (1 - lower)
                # Loss -log p; p falls with s by du - dl.
                grad = (du - dl) / p * x
                sigma = (np.sqrt(n[at] + grad**2) - np.sqrt(n[at])) / alpha
                z[at] += grad - sigma * w
                n[at] += grad**2
                dt = np.zeros(len(t))
                if y < last:
                    dt[y] -= du / p
                if y > 0:
                    dt[y - 1] += dl / p
                # Through the first threshold and the logs of the steps.
                d = np.r_[dt.sum(), np.cumsum(dt[::-1])[::-1][1:] * np.exp(steps)]
                g2 += d**2
                move = rate * d / np.sqrt(g2)
                first, steps = first - move[0], steps - move[1:]
        self.thresholds = first + np.r_[0, np.cumsum(np.exp(steps))]
        self.weights = (-np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((beta + np.sqrt(n)) / alpha + l2)).astype(np.float32)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade."""
    return labels.filter("doc_id is not null and quality is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2).alias("grade"),
    )


def fit(
    docs: DataFrame,
    grades: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits: int = BITS,
    train_rows: int = 8_000,
    epochs: int = 8,
    alpha: float = 1.0,
    beta: float = 1.0,
    noise: float = 0.09,
    l2: float = 0.0,
    rate: float = 0.3,
    keep_clean: float = 0.998,
) -> OrdinalModel:
    # A share of the labels by hash, a little over what is wanted, so that only about the sample is ranked.
    span, n = 1 << 30, grades.count()
    at = F.pmod(F.xxhash64("doc_id"), F.lit(span))
    head = grades.filter(at < min(span, int(span * (1.3 * train_rows + 20) / max(1, n))))
    picked = head.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(at, "doc_id").limit(train_rows)
    sample = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(picked), "doc_id"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py(), bits) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([r[0].astype(np.int32).tobytes() for r in rows], pa.binary()),
                    pa.array([r[1].astype(np.float16).tobytes() for r in rows], pa.binary()),
                ],
                names=["doc_id", "grade", "at", "x"],
            )

    # Six bytes a feature; rows are widened one at a time, when they are learnt from.
    got = sample.select("doc_id", "grade", "text").mapInArrow(run, "doc_id long, grade int, at binary, x binary").collect()
    rows = sorted((zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], bytes(r["at"]), bytes(r["x"]), r["grade"]) for r in got)
    del got
    model = OrdinalModel(bits, 3)
    if not len(rows):
        model.thresholds, model.cut = np.array([-40.0, -39.0]), 0.0
        return model
    data = [(h % 5 == 0, np.frombuffer(at, dtype=np.int32), np.frombuffer(x, dtype=np.float16), int(y)) for h, _, at, x, y in rows]
    held = [d[1:] for d in data if d[0]]
    train = [d[1:] for d in data if not d[0]]
    # Gradients that carry nothing add up to about the root of their number: so does the L1 penalty.
    l1 = noise * max(1, len(train)) ** 0.5
    model.fit(train, epochs=epochs, alpha=alpha, beta=beta, l1=l1, l2=l2, rate=rate)
    clean = np.array([x.astype(np.float64) @ model.weights[at] for at, x, y in held if y == model.grades - 1])
    if len(clean):
        model.cut = float(min(0.5, np.quantile(model.tails(clean)[:, -1], 1 - keep_clean)))
    return model


def scored(docs: DataFrame, model: OrdinalModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail_probability, kept of every row."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail_probability", pa.float64()), ("kept", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tails = model.tails(model.scores(texts))
            wordless = np.array([not (t or "").strip() for t in texts], dtype=bool)
            kept = (tails[:, -1] >= model.cut) | wordless
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(kept)], schema=schema
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, kept boolean")


def accepted(docs: DataFrame, model: OrdinalModel, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the model keeps."""

    @F.pandas_udf("boolean")
    def keep(text):
        import pandas as pd

        texts = list(text)
        tails = model.tails(model.scores(texts))
        return pd.Series((tails[:, -1] >= model.cut) | np.array([not (t or "").strip() for t in texts], dtype=bool))

    return docs.filter(keep(F.col(f"`{text_col}`").cast("string")))


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, fit(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))))
