"""A stored term index with a life: postings in buckets of terms, kept up by batches of new and retired rows.

``{path}/postings`` has a folder per batch and bucket, sorted by term: lists of ids, tfs and lengths by term, namespace and a sign, +1 for rows that came and -1 for those that
went.  ``{path}/figures`` has, per batch and namespace, the change in rows and terms; it is written last, and a batch counts once it is
there.  A batch that is written again replaces itself.  Nothing is ever rewritten in place; ``compacted`` folds all batches into one, elsewhere.

A query reads the row groups of its own terms in their buckets, and a few rows of figures: no text and no other term.  Signs add up, so a retired row's postings
cancel out, as do those of a row's earlier text.

A null text counts as a row, but not for the mean length.  A row that is retired must come with the text that it was added with.  Namespaces may be null.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..plans.staging import fresh_dir
from . import posting_blocks as pb

BUCKETS = 64
LISTS = "namespace string, term string, sign int, ids array<string>, tfs array<long>, lengths array<int>"
POSTINGS = "namespace string, id string, sign int, n_terms int, term string, tf long"
K1, B = 1.2, 0.75


def score(tf: Column, df: Column, n_terms: Column, rows: Column, mean_length: Column) -> Column:
    """One term's part of Okapi BM25."""
    idf = F.log(1 + (rows - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_terms / mean_length))


@dataclass(frozen=True)
class TermIndex:
    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def add(self, batch: str, new: DataFrame | None = None, retired: DataFrame | None = None) -> TermIndex:
        """A batch of rows (id, namespace, content) that came, and of rows that went."""
        if not re.fullmatch(r"[\w-]+", batch):
            raise ValueError(f"not a name of a batch: {batch!r}")
        sides = [(rows, sign) for rows, sign in ((new, 1), (retired, -1)) if rows is not None]
        words = None
        for rows, sign in sides:
            one = rows.select(F.col("namespace").cast("string"), F.col("id").cast("string"), F.lit(sign).alias("sign"), tokens(F.col("content")).alias("words"))
            words = one if words is None else words.unionByName(one)
        if words is None:
            return self
        to = f"{self.path}/postings/batch={batch}"
        self._merged(words.mapInArrow(pb.counted(self.buckets, self._parts()), pb.BLOCKS), net=False).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(to)
        # The figures come from the same pass over the texts.
        made = f"{to}/bucket={pb.FIGURES}"
        at, files = self._path(made)
        sums = self.spark.read.schema("namespace string, tfs array<long>").parquet(made) if files.exists(at) else self.spark.createDataFrame([], "namespace string, tfs array<long>")
        change = sums.groupBy("namespace").agg(*[F.sum(F.get("tfs", F.lit(i))).alias(n) for i, n in enumerate(("rows", "texts", "terms"))])
        change.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/figures/batch={batch}")
        return self

    def _parts(self) -> int:
        """Each bucket is in so many parts by a hash of the ids, so a frequent term of a large batch is several files; a row's terms of a bucket stay together."""
        return -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)

    def _merged(self, blocks: DataFrame, net: bool) -> DataFrame:
        """Lists of postings from blocks, which are all that is shuffled; a bucket's terms are sorted."""
        parts, width = self._parts(), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = blocks.repartitionById(min(width, self.buckets * parts), F.col("bucket") * parts + F.col("part"))
        return dealt.sortWithinPartitions("bucket", "part").mapInArrow(pb.merged(net), pb.LISTS).sortWithinPartitions("bucket", "term")

    def figures(self, namespaces: Sequence[str] = ()) -> DataFrame:
        """batch, namespace, rows, texts (rows that have one), terms."""
        out = self.spark.read.schema("namespace string, rows long, texts long, terms long, batch string").parquet(f"{self.path}/figures")
        return out.filter(F.col("namespace").isin(*namespaces)) if namespaces else out

    def _path(self, text: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(text)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        at, files = self._path(f"{self.path}/figures")
        return files.exists(at)

    def batches(self) -> list[str]:
        """The batches whose figures are written; a listing of a folder with one entry a batch."""
        at, files = self._path(f"{self.path}/figures")
        names = [s.getPath().getName() for s in files.listStatus(at)]
        return sorted(n.removeprefix("batch=") for n in names if files.exists(self._path(f"{self.path}/figures/{n}/_SUCCESS")[0]))

    def postings(self, terms: Sequence[str], namespaces: Sequence[str] = ()) -> DataFrame:
        """namespace, id, term, tf, n_terms, sign of these terms, in batches that are whole: only their buckets' folders are listed."""
        buckets = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        folders = [self._path(f"{self.path}/postings/batch={b}/bucket={k}") for b in self.batches() for k in buckets]
        there = [at.toString() for at, files in folders if files.exists(at)]
        if not there:
            return self.spark.createDataFrame([], POSTINGS)
        lists = self.spark.read.schema(LISTS).parquet(*there).filter(F.col("term").isin(*terms))
        if namespaces:
            lists = lists.filter(F.col("namespace").isin(*namespaces))
        each = lists.select("namespace", "term", "sign", F.inline(F.arrays_zip("ids", "tfs", "lengths")))
        return each.select("namespace", F.col("ids").alias("id"), "sign", F.col("lengths").alias("n_terms"), "term", F.col("tfs").alias("tf"))

    def ranking(self, terms: Sequence[str], k: int, namespaces: Sequence[str] = ()) -> DataFrame:
        """The k best rows of the namespaces (or all): id, score, rank; equal scores by id."""
        terms = sorted({t.lower() for t in terms})
        at = range(len(terms))
        hits = self.postings(terms, namespaces)
        some = hits.withColumn("at", F.array_position(F.lit(terms), F.col("term")) - 1)
        # Written as SQL: a column call per number would take longer to build than the query takes to run.
        sums = [F.expr(f"sum(if(at = {i}, {x} * sign, 0)) as {n}{i}") for i in at for x, n in (("tf", "tf"), ("n_terms", "n"))]
        rows = some.groupBy("namespace", "id").agg(*sums).filter(" or ".join(f"tf{i} > 0" for i in at))
        # A row and term that is live adds up to one.
        found = some.agg(*[F.expr(f"sum(if(at = {i}, sign, 0)) as df{i}") for i in at])
        corpus = self.figures(namespaces).agg(F.expr("sum(rows) as rows"), F.expr("try_divide(sum(terms), sum(texts)) as mean_length"))
        length = f"greatest(0, {', '.join(f'n{i}' for i in at)})"
        part = "if(tf{i} > 0, ln(1 + (rows - df{i} + 0.5D) / (df{i} + 0.5D)) * tf{i} * {k1}D / (tf{i} + {k}D * (1 - {b}D + {b}D * {length} / mean_length)), 0D)"
        total = " + ".join(part.format(i=i, k1=K1 + 1, k=K1, b=B, length=length) for i in at)
        one = corpus.join(F.broadcast(found))  # one row each
        best = rows.join(F.broadcast(one)).select("id", F.expr(f"round({total}, 6) as score")).orderBy(F.desc("score"), "id").limit(k)
        # k rows
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))

    def compacted(self, path: str | None = None) -> TermIndex:
        """The same index as one batch, in another folder; rows that cancelled out are gone."""
        path = path or fresh_dir(self.spark, "term-index")
        lists = self.spark.read.schema(f"{LISTS}, batch string, bucket int").parquet(f"{self.path}/postings")
        lists = lists.filter(F.col("batch").isin(*self.batches()) & (F.col("bucket") != pb.FIGURES)).drop("batch")
        # One posting of a row and term is left, that of its last text.
        self._merged(lists.mapInArrow(pb.unlisted(self._parts()), pb.BLOCKS), net=True).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings/batch=folded")
        figures = self.figures().groupBy("namespace").agg(*[F.sum(c).alias(c) for c in ("rows", "texts", "terms")])
        figures.coalesce(1).write.mode("overwrite").parquet(f"{path}/figures/batch=folded")
        return TermIndex(self.spark, path, self.buckets)


def stored(rows: DataFrame, path: str | None = None, buckets: int = BUCKETS) -> TermIndex:
    """A new index of ``rows`` (id, namespace, content) in a folder."""
    return TermIndex(rows.sparkSession, path or fresh_dir(rows.sparkSession, "term-index"), buckets).add("first", rows)
