"""The trace of a venture, the coverage report and repository overviews on small rows."""

import datetime as dt

from tidemark.operators import graph
from tidemark.operators import rollup_documents as rd

NOW = dt.datetime(2024, 5, 1)
OLD, NEW = dt.datetime(2024, 1, 1), dt.datetime(2024, 4, 20)


def test_venture_trace(spark):
    entities = spark.createDataFrame(
        [("v", "Harbour", "venture"), ("w", "Harbour two", "venture"), ("p", "harbour", "person"), ("r1", "a", "repo"), ("r2", "b", "repo"), ("m", "M", "person"), ("f", "F", "feed"), ("pf", "P", "portfolio"), ("n", None, "venture")],
        "id string, name string, entity_type string",
    )
    edges = [
        ("r1", "v", "REPO_OF", OLD, None), ("r1", "v", "REPO_OF", NEW, None), ("r2", "v", "REPO_OF", OLD, None), ("gone", "v", "REPO_OF", OLD, None), ("r1", "w", "REPO_OF", OLD, None),
        ("m", "v", "MEMBER_OF", OLD, None), ("p", "v", "MEMBER_OF", OLD, NEW), ("v", "pf", "BELONGS_TO", OLD, None), ("f", "v", "FEED_OF", OLD, None), ("g", "v", "GOAL_FOR", OLD, None),
        ("m", "r1", "COMMITS_TO", OLD, None), ("m", "r2", "COMMITS_TO", OLD, None), ("p", "r2", "COMMITS_TO", OLD, None), ("x", "gone", "COMMITS_TO", OLD, None), ("c", "r1", "CODE_IN", OLD, NEW),
        ("a1", "m", "ACTIVITY_OF", OLD, None), ("a2", "m", "ACTIVITY_OF", NEW, None), ("a2", "m", "ACTIVITY_OF", OLD, None), ("a3", "p", "ACTIVITY_OF", NEW, None), ("p", "f", "POSTED_IN", None, None),
        (None, "v", "REPO_OF", OLD, None), ("v", None, "BELONGS_TO", OLD, None),
    ]
    edges = spark.createDataFrame(edges, "src_id string, dst_id string, relation string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    mentions = spark.createDataFrame([("m1", "f"), ("m2", "f"), ("m3", "v"), ("m4", None)], "memory_id string, entity_id string")
    rows = graph.venture_trace(edges, entities, mentions, "HARB", NOW).collect()
    counts = {r["step"]: r["n"] for r in rows if r["n"]}
    assert counts == {
        "portfolio": 1, "repos": 2, "members": 1, "feed": 1, "committers": 2, "member_activity": 2, "recent_activity": 1, "feed_authors": 1, "feed_posts": 2,
    }
    assert sorted(r["place"] for r in rows) == list(range(19)) and {r["venture"] for r in rows} == {"Harbour"}
    assert graph.venture_trace(edges, entities, mentions, "nothing", NOW).count() == 0
    bare = graph.venture_trace(edges.limit(0), entities, mentions.limit(0), "two", NOW).collect()
    assert len(bare) == 19 and {(r["venture"], r["n"]) for r in bare} == {("Harbour two", 0)}


def test_coverage_report(spark):
    day = lambda d: dt.date(2024, 4, d)
    commits = [("o/A", "x", day(1)), ("o/A", "y", day(3)), ("o/A", None, day(2)), ("o/b", "x", day(20)), ("o/c", "x", dt.date(2023, 1, 1)), (None, "x", day(20)), ("", "x", day(20)), ("o/d", "x", day(4))]
    commits = spark.createDataFrame(commits, "repo_full_name string, author_login string, day date")
    registry = spark.createDataFrame([("O/B",), (None,)], "repo string")
    row = rd.coverage_report(commits, registry, NOW, k=1).first()
    assert row["content"] == (
        "2 repositories with commits in the 90 days up to 2024-04-20 are not registered for indexing, so nothing can be said from their code. "
        "The most active: o/A (3 commits by 2 people, last on 2024-04-03)."
    )
    assert row["metadata"] == '{"type":"code-coverage","unindexed":2,"window_days":90}' and row["valid_at"] == NOW
    whole = spark.createDataFrame([("o/a",), ("o/b",), ("o/d",)], "repo string")
    assert rd.coverage_report(commits, whole, NOW).first()["content"] == "All repositories with commits in the 90 days up to 2024-04-20 are registered for indexing."


def test_repository_overviews(spark):
    files = [("a", "main.go", "go", 10), ("a", "src/x.go", "go", 3000), ("a", "src/y", None, 3000), ("b", "z.py", "python", None)]
    files = spark.createDataFrame(files, "repo string, path string, language string, bytes long")
    readme = "\n\n# One\n\n\n\nTwo " + "ö" * 900
    docs = [("a", "zz.md", "text"), ("a", "docs/b.md", None), ("a", "sub/README.md", "other"), ("a", "Readme.md", readme), ("b", "README", None), ("c", "README.md", "no files")]
    docs = spark.createDataFrame(docs, "repo string, path string, content string")
    heads = spark.createDataFrame([("a", "0123456789abc", dt.date(2024, 2, 3)), ("a", "ffff", dt.date(2024, 2, 2)), ("a", None, None)], "repo string, sha string, date date")
    rows = {r["source_ref"]: r for r in rd.repository_overviews(files, docs, heads, listed=3).collect()}
    assert set(rows) == {"code:a:overview", "code:b:overview"}
    a, b = rows["code:a:overview"], rows["code:b:overview"]
    assert a["content"] == "\n\n".join([
        "a has 3 files of code, 6.0k bytes.", "Its head is 012345678 of 2024-02-03.", "Languages (files): go (2), other (1)", "Top folders (files): src (2), (root) (1)",
        "Largest files:\nsrc/x.go (3000 bytes)\nsrc/y (3000 bytes)\nmain.go (10 bytes)", "Documents: Readme.md, sub/README.md, docs/b.md and 1 more", "The README begins:\n" + ("# One\n\nTwo " + "ö" * 900)[:700],
    ])
    assert a["valid_at"] == dt.date(2024, 2, 3) and a["metadata"] == '{"type":"repository-overview","files":3,"documents":4}'
    assert b["content"].startswith("b has 1 files of code, 0 bytes.")
    assert "README begins" not in b["content"] and "head" not in b["content"] and b["valid_at"] is None


def test_provenance_folds_equal_refs_after_they_are_dealt_out(spark):
    """No task of the scan keeps a table of the refs that it reads."""
    from tidemark.operators import rollups as ro

    edges = spark.createDataFrame([("a", "b", "R", f"r{i % 30:02d}") for i in range(900)] + [("a", "c", "R", None)], "src string, dst string, relation string, ref string")
    out = ro.provenance(edges)
    assert {(r["dst"], r["kind"], r["records"], r["refs"]) for r in out.collect()} == {("b", "aggregate", 30, ",".join(f"r{i:02d}" for i in range(8))), ("c", "link", 1, "")}
    lines = [x.strip(" +-:*()0123456789") for x in ro.provenance(edges).select("records")._jdf.queryExecution().executedPlan().toString().split("\n")]
    scans = [i for i, x in enumerate(lines) if "Scan ExistingRDD" in x or "LocalTableScan" in x]
    for at in scans:
        above = next(x for x in reversed(lines[:at]) if x.startswith(("Exchange", "HashAggregate")))
        assert above.startswith("Exchange")
