"""Small cases with known answers, and invariants."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, text, vectors
from tidemark.operators import chunking, graph, memory, retrieval, rollups
from tidemark.sources import connectors, etl
from tidemark.streaming import refresh


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "top, content, similarity, decision",
    [
        (None, "new fact", None, "add"),
        ("The sky is blue", "the  sky is BLUE ", 0.99, "noop"),
        ("The sky is blue", "The sky is quite blue", 0.98, "noop"),
        ("Uses Postgres", "Uses Postgres 16", 0.9, "update"),
        ("Uses Postgres", "Likes tea", 0.3, "add"),
        ("Uses Postgres", "No longer uses Postgres", 0.92, "invalidate"),
        ("Uses Postgres", "That Postgres is used was wrong", 0.99, "invalidate"),
    ],
)
def test_write_decision(spark, top, content, similarity, decision):
    df = spark.createDataFrame([(top and "m1", content, top, similarity)], "top string, content string, top_content string, similarity double")
    got = memory.write_decision(F.col("top"), F.col("content"), F.col("top_content"), F.col("similarity"))
    assert df.select(got.alias("d")).first()["d"] == decision


def test_norm_text_and_negation(spark):
    assert one(spark, text.norm_text(F.lit("  A\t b\n\nC "))) == "a b c"
    for s in ("It is no longer so", "That is WRONG", "Correction: X", "never mind that"):
        assert one(spark, text.has_negation(F.lit(s)))
    for s in ("It is so", "a place"):
        assert not one(spark, text.has_negation(F.lit(s)))


def test_cache_key(spark):
    key = lambda *a: one(spark, retrieval.cache_key(*a))
    assert key("en", " Hello ", 8, 1) == key("en", "hello", 8, 1)
    assert len({key("en", "hello", 8, 1), key("en", "hello", 8, 2), key("fr", "hello", 8, 1), key("en", "hello", 9, 1)}) == 4


GRAPH = {
    "nodes": [
        {"id": "d1", "label": "mem-11-aa", "type": "Document", "properties": {}},
        {"id": "c1", "label": "chunk", "type": "DocumentChunk", "properties": {}},
        {"id": "e1", "label": "Postgres", "type": "Entity", "properties": {}},
        {"id": "e2", "label": "pgvector", "type": "Entity", "properties": {}},
        {"id": "e3", "label": "Postgres", "type": "Entity", "properties": {}},
    ],
    "edges": [
        {"source": "d1", "target": "c1", "label": "has"},
        {"source": "c1", "target": "e1", "label": "mentions"},
        {"source": "e1", "target": "e2", "label": "uses"},
    ],
}


def test_graph_documents(spark):
    dto = lambda g: spark.createDataFrame([(json.dumps(g) if isinstance(g, dict) else g,)], "value string")
    assert {r["name"] for r in connectors.graph_nodes(dto(GRAPH)).collect()} == {"Postgres", "pgvector"}
    bare = {"nodes": [{"id": "1", "label": "A"}, {"id": "2", "label": "B"}, {"id": "3"}], "edges": []}
    assert {r["name"] for r in connectors.graph_nodes(dto(bare)).collect()} == {"A", "B"}
    assert connectors.graph_nodes(dto("not json")).count() == 0
    # Two steps reach e1, not e2.
    assert [tuple(r) for r in connectors.memory_links(dto(GRAPH)).collect()] == [("11-aa", "Postgres")]


def test_bm25_ranks_the_matching_language_first(spark):
    rows = [("1", "The database stores vectors"), ("2", "Cats like milk"), ("3", "قاعدة البيانات سريعة"), ("4", "القطط تحب الحليب")]
    df = spark.createDataFrame(rows, "id string, content string")
    assert retrieval.bm25_ranking(df, ["database"], 4).first()["id"] == "1"
    assert retrieval.bm25_ranking(df, ["البيانات"], 4).first()["id"] == "3"


def test_rrf_is_bounded(spark):
    v = [[1.0, 0.0], [0.0, 1.0], [0.7, 0.7]]
    rows = [(str(i), "en", f"word{i}", x, 1.0, dt.datetime(2024, 1, 1)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id string, namespace string, content string, embedding array<double>, importance double, valid_at timestamp_ntz")
    out = retrieval.fused(df, F.array(F.lit(1.0), F.lit(0.0)), ["word0"]).collect()
    assert out[0]["id"] == "0" and out[0]["score"] == pytest.approx(2 / 61 + 0.01, abs=1e-6)
    assert all(r["score"] <= 2 / 61 + 0.01 + 1e-6 for r in out)


def test_search_limit():
    assert [retrieval.search_limit(x) for x in (None, 0, 5, 50, 51)] == [12, 12, 5, 50, 12]


def test_windows_of_time():
    assert dates.parse_window("24h") == dt.timedelta(hours=24)
    assert dates.parse_window("last 3m") == dt.timedelta(days=90)
    assert dates.parse_window("2w") == dt.timedelta(weeks=2)
    assert dates.parse_window("soon") is None


def test_boundary_minutes_and_weeks(spark):
    t = lambda s: F.lit(dt.datetime.fromisoformat(s)).cast("timestamp_ntz")
    assert one(spark, dates.boundary_minutes(t("2024-01-01 00:00:59"), t("2024-01-01 00:01:01"))) == 1
    assert one(spark, dates.iso_week_label(F.lit(dt.date(2024, 12, 30)))) == "2025-W01"
    assert one(spark, dates.week(F.lit(dt.date(2024, 1, 7)))) == dt.date(2024, 1, 1)
    assert one(spark, dates.sunday_first(F.lit(dt.date(2024, 1, 7)))) == 0
    got = one(spark, rollups.clamp_valid_at(F.lit(dt.date(2024, 1, 1)), "week", dt.datetime(2024, 1, 5)))
    assert got == dt.datetime(2024, 1, 5)


def test_html_to_text(spark):
    page = "<html><head><style>x{}</style></head><body><p>A &amp; B</p><script>var a = '<p>';</script><div>C&nbsp; D</div></body></html>"
    assert one(spark, text.html_to_text(F.lit(page))) == "A & B\n\n C D"


def test_classification(spark):
    kind = lambda d, s: one(spark, text.memory_type(F.lit(d), F.lit(s)))
    assert [kind("venture", "x"), kind("playbook", "x"), kind("post", "x"), kind("?", "learning:7"), kind("?", "howto/x"), kind("?", ":doc")] == [
        "semantic", "procedural", "episodic", "semantic", "procedural", "episodic",
    ]
    explicit = text.memory_type(F.lit("venture"), F.lit("x"), F.lit("working"))
    assert one(spark, explicit) == "working"


def test_number_formats(spark):
    scaled = lambda x: one(spark, text.scaled(F.lit(x)))
    assert [scaled(999), scaled(1200), scaled(3_400_000), scaled(5_600_000_000)] == ["999", "1.2k", "3.4M", "5.60B"]
    assert one(spark, text.thousands(F.lit(1234567))) == "1,234,567"


def test_screening_and_redaction(spark):
    assert one(spark, text.has_credential(F.lit("my PASSWORD: x")))
    assert not one(spark, text.has_credential(F.lit("the users pass by")))
    assert one(spark, text.redacted(F.lit("v"), F.lit("apiKey"))) == "••••"
    assert one(spark, text.redacted(F.lit(""), F.lit("token"))) == ""
    assert one(spark, text.redacted(F.lit("v"), F.lit("name"))) == "v"


def test_chunks():
    assert chunking.chunk_text("") == [] and chunking.chunk_text(None) == []
    assert chunking.chunk_text("short") == ["short"]
    long = "\n\n".join(["a" * 900, "b" * 900, "c" * 4000])
    parts = chunking.chunk_text(long)
    assert parts == ["a" * 900, "b" * 900, "c" * 1600, "c" * 1600, "c" * 800]
    # Bytes decide whether a paragraph fits, characters where a long one is cut.
    assert len(chunking.chunk_text("é" * 700 + "\n\n" + "é" * 900)) == 2
    sections = chunking.markdown_chunks("# A\n" + "x" * 2000 + "\n# B\n" + "y" * 2000 + "\n## C\nz")
    assert [s[:3] for s in sections] == ["# A", "# B"] and sections[1].endswith("z")
    assert [len(s) for s in chunking.markdown_chunks("# A\n" + "x" * 12_000)] == [5600, 5600, 804]
    assert chunking.markdown_chunks(None) == chunking.markdown_chunks(" \n") == []


def test_code_packs():
    big = "\n".join(f"line {i} " + "x" * 90 for i in range(100))
    pack = f"# intro\n## File: a/one.go\nsmall\n## File: b/two.go\n{big}\n## File: a/three.go\nsmaller\n"
    assert [p for p, _ in chunking.pack_sections(pack)] == ["a/one.go", "b/two.go", "a/three.go"]
    assert [p for p, _ in chunking.breadth_first(chunking.pack_sections(pack))] == ["b/two.go", "a/three.go", "a/one.go"]
    chunks = chunking.code_chunks(pack, "r")
    assert chunks[0].startswith("r — b/two.go  (part 1/3)\n\nline 0 ") and all(len(c) <= 4100 for c in chunks)
    assert chunks[-1] == "r — a/three.go\n\nsmaller\n\nr — a/one.go\n\nsmall"
    assert chunking.body_pieces("x" * 9000 + "\nend\n") == ["x" * 4000, "x" * 4000, "x" * 1000 + "\nend\n"]
    assert chunking.code_chunks(None) == []
    turns = chunking.breadth_first([(f"a/{i}", "x" * (10 - i)) for i in range(6)] + [("b/0", "y")], block=4)
    assert [p for p, _ in turns] == ["a/0", "a/1", "a/2", "a/3", "b/0", "a/4", "a/5"]


def test_chunked_refs(spark):
    df = spark.createDataFrame([("r", "x" * 2000), ("s", "y"), ("t", None)], "ref string, text string")
    assert [(r["ref"], r["n_chunks"]) for r in chunking.chunked(df, "ref", "text").collect()] == [("r#0", 2), ("r#1", 2), ("s", 1)]


def test_hashed_embedding_is_unit(spark):
    v = vectors.hashed_embedding(F.split(F.lit("a b c a"), " "))
    assert one(spark, F.round(vectors.norm(v), 6)) == pytest.approx(1, abs=1e-5)


EDGES = [("a", "b", "R", 1), ("b", "c", "R", 2), ("c", "d", "S", 3), ("a", "x", "S", 1), ("x", "d", "S", 9)]


@pytest.fixture
def small(spark):
    edges = spark.createDataFrame([(s, d, r, dt.datetime(2024, 1, k), None) for s, d, r, k in EDGES], "src_id string, dst_id string, relation string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    nodes = spark.createDataFrame([(x, x.upper(), "repo" if x in "bx" else "person") for x in "abcdxz"], "id string, name string, entity_type string")
    return edges, nodes


def test_walks(small):
    edges, nodes = small
    near = {r["name"]: r["depth"] for r in graph.traverse(edges, nodes, "A").collect()}
    assert near == {"B": 1, "X": 1, "C": 2, "D": 2}
    path = graph.shortest_path(edges, nodes, "A", "D").first()
    assert (path["path"], path["hops"]) == ("A > X > D", 2)
    assert tuple(graph.shortest_path(edges, nodes, "A", "Z").first()) == (None, -1)
    spine = graph.spine(edges, nodes, "a", hubs=("repo",)).collect()
    assert {r["name"] for r in spine} == {"B", "X", "C", "D"} and all(r["total"] >= r["rank"] for r in spine)


def test_as_of_is_half_open(spark):
    rows = [("1", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 5))]
    df = spark.createDataFrame(rows, "id string, valid_at timestamp_ntz, invalid_at timestamp_ntz").withColumn("tier", F.lit("hot"))
    seen = [memory.live(df, as_of=dt.datetime(2024, 1, d)).count() for d in (1, 4, 5)]
    assert seen == [1, 1, 0]


def test_propagation_keeps_components_apart(small):
    edges, nodes = small
    labels = {r["id"]: r["label"] for r in graph.label_propagation(edges, nodes, 8).collect()}
    assert labels["z"] == "z" and "z" not in {labels[x] for x in "abcdx"}


def test_export_and_import(spark, tmp_path):
    rows = [("m1", "en", "hello", 0.5, dt.datetime(2024, 1, 1), None), ("m2", "en", "gone", 0.5, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "id string, namespace string, content string, importance double, valid_at timestamp_ntz, invalid_at timestamp_ntz")
    connectors.export_memories(df, "en", str(tmp_path / "out"))
    (tmp_path / "out" / "part-bad.json").write_text("{broken\n")
    back = connectors.import_memories(spark, str(tmp_path / "out"), "fr").collect()
    assert [(r["id"], r["namespace"], r["visibility"], r["tier"], r["valid_at"]) for r in back] == [("m1", "fr", "private", "hot", dt.datetime(2024, 1, 1))]


def test_checked_routes_bad_rows(spark):
    good = ("private", "fact", "semantic", "hot", 0.5)
    df = spark.createDataFrame([good, ("public", *good[1:]), (*good[:4], 2.0), (None, *good[1:])], "visibility string, network string, memory_type string, tier string, importance double")
    valid, rejected = connectors.checked(df)
    assert (valid.count(), rejected.count()) == (1, 3)


def test_connectors(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.md").write_text("# Title\nbody")
    (tmp_path / "src" / "empty.md").write_text(" ")
    assert [r["title"] for r in connectors.fetch(spark, "markdown", {"path": str(tmp_path / "src")}).collect()] == ["a.md"]
    (tmp_path / "src" / "node_modules").mkdir()
    (tmp_path / "src" / "node_modules" / "x.py").write_text("x")
    (tmp_path / "src" / "b.py").write_text("print(1)")
    (tmp_path / "src" / "b_test.go").write_text("x")
    got = connectors.fetch(spark, "github", {"path": str(tmp_path / "src"), "suffixes": [".py", ".go"]}).collect()
    assert [(r["ref"], r["content"]) for r in got] == [("b.py", "print(1)")]
    got = connectors.fetch(spark, "sql", {"query": "select 1 id, 'x' name, cast(null as string) gone", "ref_column": "id"}).first()
    assert (got["ref"], got["content"]) == ("1", "id: 1\nname: x")
    (tmp_path / "log").write_text("h1\x1fAnn\x1f2024-01-01 10:00:00\x1fFix\x1fdetails\x1e\nh2\x1fBob\x1f2024-01-02 10:00:00\x1fAdd\x1f\x1e")
    got = connectors.fetch(spark, "commits", {"path": str(tmp_path / "log")}).orderBy("ref").collect()
    assert [(r["ref"], r["content"]) for r in got] == [("commit:h1", "Fix (Ann)\ndetails"), ("commit:h2", "Add (Bob)")]
    with pytest.raises(ValueError):
        connectors.fetch(spark, "nothing", {})


def test_sync_keeps_its_watermark_on_failure(spark, tmp_path):
    since = dt.datetime(2024, 1, 1)
    failed = connectors.sync(spark, "text", {"path": str(tmp_path / "absent")}, str(tmp_path / "to"), since)
    assert (failed["status"], failed["watermark"]) == ("error", since)
    (tmp_path / "a.txt").write_text("hello")
    done = connectors.sync(spark, "text", {"path": str(tmp_path / "a.txt")}, str(tmp_path / "to"))
    assert done["status"] == "ok" and spark.read.parquet(str(tmp_path / "to")).count() == 1


def test_incremental_load_is_idempotent(spark):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(i)) for i in range(100)]
    source = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, value double")
    mark = dt.datetime(2024, 1, 4)
    once = etl.incremental(source, source, "event_id", "ts", mark)
    twice = etl.incremental(once, source, "event_id", "ts", mark)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == sorted(rows)
    assert etl.without_private(source.withColumn("email", F.lit("x"))).columns == source.columns


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 40, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i % 40), "a") for i in range(80)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = refresh.event_stream(spark, str(tmp_path / "in"))
    assert refresh.once(refresh.deduplicated(stream), "append").count() == 40
    weekly = refresh.once(refresh.tumbling(refresh.event_stream(spark, str(tmp_path / "in")), "ts", "7 days", offset="4 days")).collect()
    assert [(r["start"], r["events"]) for r in weekly] == [(dt.datetime(2024, 1, 1), 80)]


def test_stream_upsert(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "a")], "event_id long, ts timestamp_ntz, event_type string").write.parquet(str(source))
    for batch in (None, [(1, dt.datetime(2024, 1, 1), "b"), (2, dt.datetime(2024, 1, 1), "c")]):
        if batch:
            spark.createDataFrame(batch, "event_id long, ts timestamp_ntz, event_type string").write.mode("append").parquet(str(source))
        stream = refresh.event_stream(spark, str(source))
        refresh.upserting(stream, refresh.file_upsert(str(tmp_path / "out"), "event_id", "ts"), str(tmp_path / "check")).awaitTermination()
    want = [(1, "b"), (2, "c")]
    last = refresh.upserted(spark, str(tmp_path / "out"), "event_id", "ts").orderBy("event_id").collect()
    assert [(r["event_id"], r["event_type"]) for r in last] == want
    refresh.compacted(spark, str(tmp_path / "out"), str(tmp_path / "compact"), "event_id", "ts")
    again = refresh.upserted(spark, str(tmp_path / "compact"), "event_id", "ts").orderBy("event_id").collect()
    assert [(r["event_id"], r["event_type"]) for r in again] == want
    assert refresh.once(refresh.calendar(refresh.event_stream(spark, str(source)), "ts", "month")).collect()[0]["events"] == 3


def test_code_chunks_of_a_whole_file_lose_nothing():
    body = "\n".join(f"line {i} of a long file" for i in range(3000))
    pack = f"## File: src/a.go\n{body}\n## File: b.go\nfunc b() {{}}\n"
    whole = "".join(chunking.code_chunks(pack, per_file=None))
    assert all(f"line {i} of" in whole for i in range(3000))
    assert len(chunking.code_chunks(pack)) < len(chunking.code_chunks(pack, per_file=None))
