"""Connectors: named readers that turn outside material into documents, and the export and import of memories.

A document has ref, title, content, event_time and metadata (JSON).  ``REGISTRY`` maps a kind to a
reader ``(spark, config) -> DataFrame``; ``register`` adds one.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import decoded, html_to_text
from ..operators.chunking import chunk_text, chunked
from ..plans.staging import staged

Reader = Callable[[SparkSession, dict], DataFrame]
REGISTRY: dict[str, Reader] = {}

MEMORY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("owner_agent_id", T.StringType()),
        T.StructField("visibility", T.StringType()),
        T.StructField("network", T.StringType()),
        T.StructField("memory_type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("source_kind", T.StringType()),
        T.StructField("source_ref", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("importance", T.DoubleType()),
        T.StructField("valid_at", T.TimestampNTZType()),
        T.StructField("invalid_at", T.TimestampNTZType()),
        T.StructField("tier", T.StringType()),
        T.StructField("metadata", T.StringType()),
    ]
)
# What a repository reader leaves out, by part of the path and by file name.
SKIPPED_PATHS = (
    "node_modules/", "vendor/", "/dist/", "dist/", "build/", ".next/", "out/", "testdata/", "__pycache__/", ".venv/", "coverage/", "third_party/", ".git/",
    "public/build/", "storage/framework/", "__snapshots__/",
)
SKIPPED_NAMES = r"(?:\.lock|-lock\.json|pnpm-lock\.yaml|go\.sum|\.generated\.ts|_test\.go|\.d\.ts)$|\.min\.[^/]*$|\.gen\.[^/]*$"


def register(kind: str, reader: Reader) -> None:
    REGISTRY[kind] = reader


def _typed(kind: str) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("type")))


def text_source(spark: SparkSession, config: dict) -> DataFrame:
    """Whole files under a path; an empty file is no document."""
    raw = spark.read.text(config["path"], wholetext=True).select("value", F.col("_metadata.file_path").alias("ref"), F.col("_metadata.file_modification_time").alias("at"))
    name = F.element_at(F.split("ref", "/"), -1)
    return raw.filter(F.col("value").rlike(r"\S")).select(
        "ref", name.alias("title"), F.col("value").alias("content"), F.col("at").cast("timestamp_ntz").alias("event_time"), _typed("doc").alias("metadata")
    )


def page_documents(pages: DataFrame, cap: int | None = 4 << 20) -> DataFrame:
    """Pages as documents: the title tag (else the url), and the text without markup; a page is read up to the cap
    (whole without one), and one without text is no document."""
    page = F.coalesce("html", F.lit(""))
    page = page if cap is None else F.substring(page, 1, cap)
    title = F.trim(decoded(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    rows = pages.select(
        F.col("url").alias("ref"), F.coalesce(F.nullif(title, F.lit("")), F.col("url")).alias("title"), html_to_text(page).alias("content"),
        F.lit(None).cast("timestamp_ntz").alias("event_time"), _typed("doc").alias("metadata"),
    )
    return rows.filter("content <> ''")


def crawler_source(spark: SparkSession, config: dict) -> DataFrame:
    """Fetched pages (url, html) in Parquet; fetching itself is not a query."""
    return page_documents(spark.read.parquet(config["path"]))


def skipped_file(path: Column) -> Column:
    """Lock, generated, minified and test files, and folders of built or foreign code."""
    low = F.lower(path)
    folders = "|".join(d.replace(".", r"\.") for d in SKIPPED_PATHS)
    return low.rlike(folders) | F.element_at(F.split(low, "/"), -1).rlike(SKIPPED_NAMES)


def repository_source(spark: SparkSession, config: dict) -> DataFrame:
    """Files of a checked-out tree: by suffix, prefix, parts of paths to leave out and size, at most ``max_docs``, smallest path first.

    ``dates`` (a path to CSV with path, date) gives files their own event time, as a history would; others have the file's.  A file that is no UTF-8 has a null content.
    """
    root = config["path"].rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", rf"^.*?{root}/", "")
    keep = (F.col("length") <= config.get("max_bytes", 60_000)) & ~skipped_file(path)
    if config.get("suffixes"):
        keep = keep & F.lower(path).rlike("(?:" + "|".join(s.replace(".", r"\.") for s in config["suffixes"]) + ")$")
    if config.get("prefix"):
        keep = keep & path.startswith(config["prefix"])
    for part in config.get("exclude", ()):
        keep = keep & ~F.contains(F.lower(path), F.lit(part.lower()))
    rows = files.filter(keep).select(
        path.alias("ref"), path.alias("title"), F.try_validate_utf8(F.col("content").cast("string")).alias("content"), F.col("modificationTime").cast("timestamp_ntz").alias("event_time"),
        _typed("code").alias("metadata"),
    )
    if config.get("dates"):
        dates = spark.read.schema("path string, date timestamp_ntz").option("header", "true").csv(config["dates"]).groupBy(F.col("path").alias("ref")).agg(F.max("date").alias("own"))
        rows = rows.join(dates, "ref", "left").withColumn("event_time", F.coalesce("own", "event_time")).drop("own")
    return rows.orderBy("ref").limit(config.get("max_docs", 500))


def rows_as_documents(rows: DataFrame, ref: str, title: str | None = None, cap: int | None = None) -> DataFrame:
    """Any result set as documents: a line 'column: value' for each value that is there."""
    lines = [
        F.when(F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`").cast("string") != ""), F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string"))) for c in rows.columns
    ]
    out = rows.select(
        F.col(ref).cast("string").alias("ref"),
        (F.col(title).cast("string") if title else F.lit(None).cast("string")).alias("title"),
        F.concat_ws("\n", *lines).alias("content"),
        F.lit(None).cast("timestamp_ntz").alias("event_time"),
        _typed("row").alias("metadata"),
    )
    return out.orderBy("ref").limit(cap) if cap else out


def sql_source(spark: SparkSession, config: dict) -> DataFrame:
    """A query's rows, from a JDBC database where ``url`` is set, else from the session's tables."""
    if config.get("url"):
        rows = spark.read.format("jdbc").options(url=config["url"], query=config["query"], **config.get("options", {})).load()
    else:
        rows = spark.sql(config["query"])
    return rows_as_documents(rows, config["ref_column"], config.get("title_column"), config.get("cap", 5000))


def commit_log(lines: DataFrame) -> DataFrame:
    """Commits from a log of records 'hash 0x1f author 0x1f date 0x1f subject 0x1f body', ended by 0x1e."""
    records = lines.select(F.explode(F.split("value", "\x1e")).alias("r")).filter(F.col("r").rlike(r"\S"))
    f = F.split("r", "\x1f")
    sha = F.regexp_replace(f[0], r"\s", "")
    return records.select(
        F.concat(F.lit("commit:"), sha).alias("ref"),
        f[3].alias("title"),
        F.concat_ws("\n", F.concat(f[3], F.lit(" ("), f[1], F.lit(")")), F.nullif(F.trim(f[4]), F.lit(""))).alias("content"),
        F.try_to_timestamp(f[2]).cast("timestamp_ntz").alias("event_time"),
        _typed("commit").alias("metadata"),
    )


def commit_source(spark: SparkSession, config: dict) -> DataFrame:
    return commit_log(spark.read.text(config["path"], wholetext=True))


for _kind, _reader in (
    ("text", text_source), ("markdown", text_source), ("crawler", crawler_source), ("github", repository_source), ("sql", sql_source), ("commits", commit_source),
):
    register(_kind, _reader)


def fetch(spark: SparkSession, kind: str, config: dict) -> DataFrame:
    if kind not in REGISTRY:
        raise ValueError(f"unknown connector kind: {kind}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[kind](spark, config)


def sync(spark: SparkSession, kind: str, config: dict, path: str, since: dt.datetime | None = None) -> dict:
    """One run: fetch, append to ``path``, and the run's status.  The watermark is the clock at the start and
    moves only if the run succeeds."""
    started = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    try:
        docs = fetch(spark, kind, config)
        if since is not None:
            docs = docs.filter(F.col("event_time").isNull() | (F.col("event_time") > F.lit(since).cast("timestamp_ntz")))
        docs.write.mode("append").parquet(path)
    except Exception as error:
        return {"status": "error", "error": str(error).splitlines()[0], "watermark": since}
    return {"status": "ok", "error": None, "watermark": started}


def faults(docs: DataFrame) -> Column:
    """Why a document can't be taken: null if it can."""
    return (
        F.when(F.coalesce(F.trim("ref"), F.lit("")) == "", "no ref")
        .when(F.coalesce(F.regexp_replace("content", r"\s+", ""), F.lit("")) == "", "no content")
        .when(F.col("metadata").isNotNull() & F.try_parse_json("metadata").isNull(), "metadata is no JSON")
    )


def ingest(docs: DataFrame, path: str, run: str, *, now: dt.datetime, cut: Callable[[str | None], list[str]] = chunk_text, check: Column | None = None) -> DataFrame:
    """One run: documents in chunks under ``path/chunks``, those with a fault, whole and with its name, under ``path/quarantine``, counts under ``path/ledger``.

    A bad document costs itself and not the run.  ``check`` adds a fault of the caller's (null where there is none).  Each part has a folder of the run, which a
    repeated run replaces, the ledger last: so a run counts once, and not before it is whole.  A chunk's ref has its number if there are several.
    """
    if not re.fullmatch(r"[\w-]+", run):
        raise ValueError(f"not a name of a run: {run!r}")
    spark = docs.sparkSession
    fault = faults(docs) if check is None else F.coalesce(faults(docs), check)
    docs = staged(docs.withColumn("error", fault), "documents")
    docs.filter("error is not null").write.mode("overwrite").parquet(f"{path}/quarantine/run={run}")
    good = docs.filter("error is null").drop("error")
    # The chunks carry what they are of as JSON, so that equal refs stay apart.
    about = F.to_json(F.struct("ref", "title", "event_time", "metadata"))
    pieces = chunked(good.withColumn("about", about), "about", "content", cut)
    of = F.from_json(F.regexp_replace("ref", r"#\d+$", ""), "ref string, title string, event_time timestamp_ntz, metadata string")
    told = pieces.withColumn("of", of).select(
        F.when(F.col("n_chunks") > 1, F.concat("of.ref", F.lit("#"), F.col("chunk").cast("string"))).otherwise(F.col("of.ref")).alias("source_ref"), "of.title", "of.event_time", "of.metadata", "content"
    )
    told.write.mode("overwrite").parquet(f"{path}/chunks/run={run}")
    counts = docs.agg(F.count(F.lit(1)).alias("documents"), F.count("error").alias("failed")).join(
        spark.read.parquet(f"{path}/chunks/run={run}").agg(F.count(F.lit(1)).alias("ingested"))
    )  # one row each
    row = counts.select(F.lit("ok").alias("status"), "documents", "ingested", "failed", F.lit(now).cast("timestamp_ntz").alias("started_at"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/run={run}")
    return ledger(spark, path)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("status string, documents long, ingested long, failed long, started_at timestamp_ntz, run string").parquet(f"{path}/ledger")


def export_memories(memories: DataFrame, namespace: str, path: str) -> None:
    """Live rows of a namespace as JSON lines, by time; owner and validity included."""
    rows = memories.filter((F.col("namespace") == namespace) & F.col("invalid_at").isNull())
    rows.orderBy("valid_at", "id").write.mode("overwrite").json(path)


def import_memories(spark: SparkSession, path: str, namespace: str | None = None) -> DataFrame:
    """JSON lines back into memories: bad lines are skipped, absent fields get their defaults, the namespace may change."""
    rows = spark.read.schema(MEMORY_SCHEMA).option("mode", "DROPMALFORMED").json(path).filter("content is not null")
    out = rows.withColumns(
        {
            "visibility": F.coalesce("visibility", F.lit("private")),
            "network": F.coalesce("network", F.lit("experience")),
            "memory_type": F.coalesce("memory_type", F.lit("episodic")),
            "tier": F.coalesce("tier", F.lit("hot")),
            "importance": F.coalesce("importance", F.lit(0.5)),
        }
    )
    return out.withColumn("namespace", F.lit(namespace)) if namespace else out


def store_memories(memories: DataFrame, path: str) -> None:
    """Appends to an append-only log, one folder per namespace: a read of some namespaces lists and scans those alone.

    Rows are dealt out by namespace, and Spark splits a large one over tasks, so it is many files and a small one is few.
    """
    memories.hint("rebalance", "namespace").write.partitionBy("namespace").mode("append").parquet(path)


def checked(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) by the declared vocabularies and ranges."""
    ok = (
        F.coalesce(F.col("visibility").isin("private", "team", "global"), F.lit(False))
        & F.coalesce(F.col("network").isin("fact", "experience", "observation", "belief"), F.lit(False))
        & F.coalesce(F.col("memory_type").isin("episodic", "semantic", "procedural", "working"), F.lit(False))
        & F.coalesce(F.col("tier").isin("hot", "cold"), F.lit(False))
        & F.coalesce(F.col("importance").between(0, 1), F.lit(False))
    )
    return memories.filter(ok), memories.filter(~ok)


def graph_nodes(dto: DataFrame) -> DataFrame:
    """Distinct entity names of a graph document (nodes and edges in JSON).

    Structural types are left out wherever any node has a type at all.
    """
    schema = "nodes array<struct<id string, label string, type string, properties map<string,string>>>, edges array<struct<source string, target string, label string>>"
    parsed = dto.select(F.from_json("value", schema).alias("g")).filter("g is not null")
    nodes = parsed.select(F.explode("g.nodes").alias("n"), F.exists("g.nodes", lambda x: F.coalesce(x["type"], F.lit("")) != "").alias("typed"))
    keep = F.when(F.col("typed"), F.coalesce(F.col("n.type"), F.lit("")).isin("Entity", "EntityNode", "entity")).otherwise(F.coalesce(F.col("n.label"), F.lit("")) != "")
    return nodes.filter(keep & F.col("n.label").isNotNull()).select(F.col("n.label").alias("name")).distinct()


def memory_links(dto: DataFrame) -> DataFrame:
    """(memory_id, entity) for entities within two steps of a document node named 'mem-<id>'."""
    schema = "nodes array<struct<id string, label string, type string, properties map<string,string>>>, edges array<struct<source string, target string, label string>>"
    parsed = dto.select(F.from_json("value", schema).alias("g")).filter("g is not null")
    nodes = parsed.select(F.explode("g.nodes").alias("n")).select("n.*")
    edges = parsed.select(F.explode("g.edges").alias("e")).select("e.source", "e.target")
    walk = edges.select(F.col("source").alias("x"), F.col("target").alias("y")).unionByName(edges.select(F.col("target").alias("x"), F.col("source").alias("y"))).distinct()
    mark = F.regexp_extract(F.concat_ws(" ", "id", "label", F.col("properties")["name"]), r"mem-([0-9A-Za-z-]+)", 1)
    docs = nodes.select(F.col("id").alias("x"), mark.alias("memory_id")).filter("memory_id <> ''")
    one = docs.join(walk, "x").select("memory_id", F.col("y").alias("x"))
    two = one.join(walk, "x").select("memory_id", F.col("y").alias("x"))
    entity = nodes.filter(F.coalesce("type", F.lit("")).isin("Entity", "EntityNode", "entity")).select(F.col("id").alias("x"), F.col("label").alias("entity"))
    return one.unionByName(two).distinct().join(entity, "x").select("memory_id", "entity").distinct()
