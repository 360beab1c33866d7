"""What the training-data operators share: the shared folder, staged tables, text defaults."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import fresh_dir, shared_dir, staged

__all__ = ["documents", "fresh_dir", "process_cache", "shared_dir", "shuffle_width", "staged", "text_or_empty"]


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def process_cache(owner: str) -> dict:
    """One dictionary per Python process, which an operator's tasks share; another operator's tasks empty it.

    Workers outlive stages, so what one stage remembers must not stay beside what the next one does.
    """
    cache = sys.__dict__.setdefault("_tidemark_cache", {})
    if cache.get("owner") != owner:
        cache.clear()
        cache["owner"] = owner
    return cache
