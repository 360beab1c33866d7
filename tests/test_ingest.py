"""Best-effort ingest, repository files with exclusions and dates, roots of spines."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph
from tidemark.sources import connectors

NOW = dt.datetime(2024, 5, 1)
SCHEMA = "ref string, title string, content string, event_time timestamp_ntz, metadata string"


def test_one_bad_document_of_ten(spark, tmp_path):
    path = str(tmp_path)
    docs = [(f"d{i}", f"t{i}", f"text {i}", NOW, '{"n":1}') for i in range(9)] + [("d9", "t", " \t\n", None, None)]
    docs[4] = ("d4", "long", "a paragraph\n\n" * 400, None, None)
    rows = connectors.ingest(spark.createDataFrame(docs, SCHEMA), path, "r1", now=NOW)
    assert [(r["run"], r["documents"], r["ingested"], r["failed"]) for r in rows.collect()] == [("r1", 10, 12, 1)]
    chunks = spark.read.parquet(f"{path}/chunks")
    assert sorted(r["source_ref"] for r in chunks.collect()) == sorted([f"d{i}" for i in range(9) if i != 4] + [f"d4#{i}" for i in range(4)])
    assert chunks.filter("source_ref = 'd0'").select("title", "content", "event_time", "metadata").first()[:] == ("t0", "text 0", NOW, '{"n":1}')
    more = [("", "t", "x", None, None), (None, "t", "x", None, None), ("e", "t", "x", None, "{no"), ("f", "t", "forbidden", None, None), ("g", None, "fine", None, None), ("g", None, "fine", None, None)]
    check = F.when(F.contains("content", F.lit("forbidden")), "forbidden")
    for _ in range(2):  # a run that is repeated leaves one entry
        rows = connectors.ingest(spark.createDataFrame(more, SCHEMA), path, "r2", now=NOW, check=check)
    assert {(r["run"], r["documents"], r["ingested"], r["failed"], r["status"]) for r in rows.collect()} == {("r1", 10, 12, 1, "ok"), ("r2", 6, 2, 4, "ok")}
    errors = sorted((r["run"], r["error"]) for r in spark.read.parquet(f"{path}/quarantine").collect())
    assert errors == [("r1", "no content"), ("r2", "forbidden"), ("r2", "metadata is no JSON"), ("r2", "no ref"), ("r2", "no ref")]
    rows = connectors.ingest(spark.createDataFrame([], SCHEMA), path, "r3", now=NOW)
    assert rows.filter("run = 'r3' and documents = 0 and ingested = 0").count() == 1
    with pytest.raises(ValueError):
        connectors.ingest(spark.createDataFrame([], SCHEMA), path, "a/b", now=NOW)


def test_repository_files(spark, tmp_path):
    root = tmp_path / "tree"
    for name, body in {"a.md": b"one", "docs/b.md": b"two", "docs/Drafts/c.md": b"three", "bad.md": b"\xff\xfe\x00"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    (tmp_path / "dates.csv").write_text("path,date\ndocs/b.md,2023-02-03T04:05:06\n")
    docs = connectors.fetch(spark, "github", {"path": str(root), "suffixes": [".md"], "exclude": ["drafts/"], "dates": str(tmp_path / "dates.csv")})
    got = {r["ref"]: (r["content"], r["event_time"]) for r in docs.collect()}
    assert {k: v[0] for k, v in got.items()} == {"a.md": "one", "docs/b.md": "two", "bad.md": None}
    assert got["docs/b.md"][1] == dt.datetime(2023, 2, 3, 4, 5, 6) and got["a.md"][1].year > 2023
    assert connectors.ingest(docs, str(tmp_path / "out"), "r1", now=NOW).first()["failed"] == 1


def test_one_root(spark):
    e = spark.createDataFrame([("1", "X"), ("2", "x"), ("x", "other"), ("3", "Long"), ("4", "LONG"), ("5", None)], "id string, name string").withColumn("entity_type", F.lit("repo"))
    root = lambda text: [r["id"] for r in graph.root_of(e, text).collect()]
    assert [root(t) for t in ("X", "x", "other", "long", "5", "none")] == [["1"], ["2"], ["x"], ["3"], ["5"], []]
    assert [r["name"] for r in graph.root_candidates(e, "ON").collect()] == ["LONG", "Long"]
