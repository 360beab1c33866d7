"""Graph tending, access, loads and pushed documents."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.metadata import merged, value
from tidemark.operators import entity_documents, graph, knowledge, mappings, memory, retrieval, rollups
from tidemark.plans import staging
from tidemark.sources import connectors, etl
from tidemark.streaming import refresh

NOW = dt.datetime(2024, 1, 15)


def test_search_scope_is_denied_not_empty(spark):
    grants = spark.createDataFrame([("a", "en", True, False), ("a", "fr", False, True)], "agent_id string, namespace string, can_read boolean, can_write boolean")
    assert memory.searchable(grants, "a", ["en", "fr"]) == ["en"]
    with pytest.raises(PermissionError):
        memory.searchable(grants, "a", ["fr"])
    with pytest.raises(PermissionError):
        memory.searchable(grants, "b", [])


def test_share_needs_write_access(spark):
    grants = spark.createDataFrame([("a", "en", True, False), ("a", "fr", False, True)], "agent_id string, namespace string, can_read boolean, can_write boolean")
    rows = spark.createDataFrame([("1", "en", "private"), ("2", "fr", "private")], "id string, namespace string, visibility string")
    assert [(r["id"], r["visibility"]) for r in memory.shared(rows, rows, grants, "a").collect()] == [("2", "global")]


def test_edit_makes_a_new_version(spark):
    rows = spark.createDataFrame([("1", "old", [1.0], NOW, None)], "id string, content string, embedding array<float>, valid_at timestamp_ntz, invalid_at timestamp_ntz")
    got = memory.edited(rows, F.lit("new"), NOW + dt.timedelta(days=1)).first()
    assert (got["content"], got["embedding"], got["valid_at"]) == ("new", None, NOW + dt.timedelta(days=1))


def test_decisions_are_applied(spark):
    current = spark.createDataFrame([("a", 0.5), ("b", 0.99), ("c", 0.5), ("d", 0.5)], "id string, importance double")
    decisions = spark.createDataFrame(
        [("n1", "a", "update"), ("n2", "b", "noop"), ("n3", "b", "noop"), ("n4", "c", "invalidate"), ("n5", None, "add")], "id string, top_id string, decision string"
    )
    got = {r["id"]: (r["live"], r["superseded_by"], r["importance"]) for r in memory.applied(current, decisions).collect()}
    assert got == {
        "a": (False, "n1", 0.5), "b": (True, None, 1.0), "c": (False, None, 0.5), "d": (True, None, 0.5), "n1": (True, None, 0.5), "n5": (True, None, 0.5),
    }


def test_facts_are_embedded_once(spark):
    edges = spark.createDataFrame([("uses Postgres", None), ("likes tea", [9.0])], "fact string, embedding array<float>")
    got = {r["fact"]: r["embedding"] for r in knowledge.embedded_facts(edges).collect()}
    assert got["likes tea"] == [9.0] and len(got["uses Postgres"]) == 64


def test_relink_reads_all_fields(spark):
    metadata = json.dumps({"scope": "Studio", "person": " Ann ", "ranking": ["bob", "ann"], "zeroCommit": ["Cy"]})
    rollups_ = spark.createDataFrame([("r", metadata), ("s", None), ("t", "broken")], "source_ref string, metadata string")
    entities = spark.createDataFrame([("1", "ann"), ("2", "Bob"), ("3", "CY"), ("4", "studio")], "id string, name string")
    have = spark.createDataFrame([("r", "2")], "source_ref string, entity_id string")
    assert sorted(map(tuple, knowledge.relinked(rollups_, entities, have).collect())) == [("r", "1"), ("r", "3"), ("r", "4")]


def test_mirror_inserts_only_what_is_new_and_held(spark):
    parsed = spark.createDataFrame([("en", "A"), ("en", "A"), ("en", "B")], "namespace string, name string")
    entities = spark.createDataFrame([("en", "A")], "namespace string, name string")
    links = spark.createDataFrame([("en", "m1", "A"), ("en", "gone", "A")], "namespace string, memory_id string, entity string")
    new, held = knowledge.mirrored(parsed, links, entities, spark.createDataFrame([("en", "m1")], "namespace string, id string"))
    assert [r["name"] for r in new.collect()] == ["B"] and [r["memory_id"] for r in held.collect()] == ["m1"]


def test_every_mapping_has_a_type_and_a_source(spark):
    assert len(mappings.MAPPINGS) == 47 and set(mappings.CAPS) | set(mappings.IMPORTANCES) <= set(mappings.MAPPINGS)
    docs = spark.createDataFrame([(7, NOW, "x " * 2000)], "ref_id int, event_time timestamp_ntz, content string")
    got = mappings.as_memories(docs, "boards", "en").first()
    assert (got["source_ref"], len(got["content"]), got["importance"]) == ("db:board:7", 2500, 0.5)
    assert mappings.since(docs, F.lit(NOW).cast("timestamp_ntz")).count() == 0


def test_digest_of_actions_without_a_venture(spark):
    rows = spark.createDataFrame([("a", None, "k", NOW, "did it")] * 2, "agent_id string, venture_id string, kind string, created_at timestamp_ntz, summary string")
    assert [(r["actions"], r["content"]) for r in rollups.agent_week_digest(rows).collect()] == [(2, "did it")]


def test_extracts(spark, tmp_path):
    rows = [(i, NOW + dt.timedelta(days=i), "s") for i in range(5)]
    source = spark.createDataFrame(rows, "id int, at timestamp_ntz, email string")
    etl.extract(source, str(tmp_path / "v1"), "id", "at", None, None)
    old = spark.read.parquet(str(tmp_path / "v1"))
    assert old.columns == ["id", "at"] and old.count() == 5
    more = spark.createDataFrame([(4, NOW + dt.timedelta(days=4, hours=1), "s"), (9, NOW + dt.timedelta(days=9), "s")], source.schema)
    etl.extract(more, str(tmp_path / "v2"), "id", "at", old, NOW + dt.timedelta(days=4))
    got = {r["id"]: r["at"] for r in spark.read.parquet(str(tmp_path / "v2")).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 9} and got[4] == NOW + dt.timedelta(days=4, hours=1)
    etl.snapshot(source, str(tmp_path / "dim"))
    assert spark.read.parquet(str(tmp_path / "dim")).columns == ["id", "at"]


def test_pushed_documents_are_chunked(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"ref": "r", "content": "x" * 2000}) + "\n" + json.dumps({"content": "y"}) + "\n")
    refresh.pushed_documents(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r["ref"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["r#0", "r#1", "webhook"]


def test_staged_tables_are_released(spark):
    df = staging.staged(spark.range(3), "numbers")
    assert df.count() == 3 and df.columns == ["id"]
    path = df.inputFiles()[0].rpartition("/")[0]
    assert staging.release(spark) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_stored_memories_are_pruned_by_namespace(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), "en" if i % 3 else "fr", "x") for i in range(30)], "id string, namespace string, content string")
    for _ in range(2):
        connectors.store_memories(rows, str(tmp_path / "log"))
    one = spark.read.parquet(str(tmp_path / "log")).filter("namespace = 'fr'")
    assert one.count() == 20
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(namespace" in plan


def test_metadata_keeps_its_types_through_a_merge(spark):
    texts = ['{"a":"1","b":"2"}', None, "no json", "{}", '{"n":5,"tags":["a","b"],"b":true,"o":{"x":null,"d":1.5},"z":null,"big":123456789012345678901234567890,"e":1e3}',
             '{"k":1,"a":2,"k":[3]}', '{"o":{"k":1,"k":2}}', "[1,2]", "[]", "7", '"s"', "null", " ", '{"a":1} x', "{\'a\':1}", '{"q\\"\u00e9":"\u00fc\\n"}', '{"a":1,"c":{"d":1}}']
    df = spark.createDataFrame([(i, t, 0.5, i % 2 == 0) for i, t in enumerate(texts)], "k int, metadata string, w double, flag boolean")
    got = {r["k"]: json.loads(r["metadata"]) for r in merged(df, {"a": F.lit("x"), "c": F.col("w"), "f": F.col("flag"), "none": F.lit(None).cast("string")}).collect()}

    def want(i, text):
        new = {"a": "x", "c": 0.5, "f": i % 2 == 0, "none": None}
        try:
            old = json.loads((text or "").strip() or "{}")
        except ValueError:
            old = {"unparsed": text}
        return {**old, **new} if isinstance(old, dict) else [*(old if isinstance(old, list) else [old]), new]

    assert got == {i: want(i, t) for i, t in enumerate(texts)}
    order = merged(df.filter("k = 4"), {"tags": F.lit(1)}).first()["metadata"]
    assert order == '{"n":5,"b":true,"o":{"d":1.5,"x":null},"z":null,"big":123456789012345678901234567890,"e":1000.0,"tags":1}'
    assert df.filter("k = 4").select(value(F.col("metadata"), "n", "int"), value(F.col("metadata"), "o", "string"), value(F.col("metadata"), "tags", "int")).first()[:] == (5, '{"d":1.5,"x":null}', None)


def test_forgetting_without_a_reason_leaves_metadata(spark):
    m = spark.createDataFrame([("1", None, '{"a":1,"a":2}')], "id string, invalid_at timestamp_ntz, metadata string")
    assert memory.forgotten(m, m, "", dt.datetime(2024, 1, 1)).first()["metadata"] == '{"a":1,"a":2}'


def test_a_failing_mapping_keeps_the_watermark(spark):
    rows = spark.createDataFrame([("1", dt.datetime(2024, 1, 1), "x"), ("2", dt.datetime(2024, 1, 3), "y")], "ref_id string, event_time timestamp_ntz, content string")
    seen = {}
    builds = {"good": lambda: rows, "bad": lambda: rows.select("nothing"), "last": lambda: rows.limit(0)}
    errors, advance = mappings.run_since(builds, F.lit(dt.datetime(2024, 1, 2)).cast("timestamp_ntz"), lambda n, df: seen.setdefault(n, df.count()))
    assert seen == {"good": 1, "last": 0} and set(errors) == {"bad"} and not advance
    assert mappings.run_since({"good": lambda: rows}, F.lit(None).cast("timestamp_ntz"), lambda n, df: df.count())[1]


def test_recall_leaves_an_event_and_a_gap(spark):
    now = dt.datetime(2024, 1, 2)
    some = spark.createDataFrame([("m1",), ("m2",)], "id string")
    event, accesses, gap = retrieval.recall_effects(some, "en", "What  IS it", now)
    assert event.first()["outcome"] == "hit" and accesses.count() == 2 and gap.count() == 0
    event, accesses, gap = retrieval.recall_effects(some.limit(0), "en", "What  IS it", now)
    assert event.first()["outcome"] == "empty" and accesses.count() == 0 and gap.first()["query"] == "what is it"


def test_median_helpers_and_lists(spark):
    rows = spark.createDataFrame([("p", 3, "c"), ("p", 1, "a"), ("p", 2, "b"), ("q", 1, None)], "parent string, k int, name string")
    got = {r["parent"]: r["items"] for r in mappings.top_children(rows, "parent", [F.desc("k")], F.col("name"), 2).collect()}
    assert got == {"p": "c, b", "q": ""}
    dims = spark.createDataFrame([("p", "Parent")], "parent string, title string")
    out = mappings.with_dimension(rows, dims, "parent", F.concat(F.coalesce("title", F.lit("?")), F.lit(": "), F.coalesce("name", F.lit("-"))), "k", "k")
    assert sorted(r["content"] for r in out.collect()) == ["?: -", "Parent: a", "Parent: b", "Parent: c"]
    recalled = spark.createDataFrame([("m1", 0.5), ("m2", 0.9)], "id string, score double")
    memories = spark.createDataFrame([("m1", "one"), ("m2", "two"), ("m3", "three")], "id string, content string")
    assert [(r["n"], r["content"]) for r in sorted(retrieval.context_rows(recalled, memories).collect())] == [(1, "two"), (2, "one")]


def test_spine_is_that_of_all_simple_paths(spark):
    """Against an enumeration of paths: hubs only past the first step, a window on edges that reach a time role, self loops, parallel edges."""
    rng = random.Random(5)
    kinds = ["feed", "venture", "person", "meeting", "repo"]
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    nodes = [(f"e{i}", f"N{i}", kinds[i % 5]) for i in range(15)]
    edges = [(f"e{rng.randrange(15)}", f"e{rng.randrange(15)}", rng.choice("AB"), day(rng.randrange(30)), None) for _ in range(45)]
    entities = spark.createDataFrame(nodes, "id string, name string, entity_type string")
    table = spark.createDataFrame(edges, "src_id string, dst_id string, relation string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    kind, walk = {i: k for i, _, k in nodes}, [e[:4] for e in edges] + [(b, a, r, t) for a, b, r, t, _ in edges]

    def expected(window):
        best, level = {}, [("e0",)]
        for depth in range(1, 5):
            following = []
            for path in level:
                if depth > 1 and kind[path[-1]] not in graph.HUBS:
                    continue
                for x, y, relation, at in walk:
                    if x == path[-1] and y not in path:
                        following.append((*path, y))
                        if window and kind[y] in graph.TIME_ROLES and not window[0] <= at <= window[1]:
                            continue
                        best[y] = min(best.get(y, (9,)), (depth, -at.timestamp(), relation))
            level = following
        return {(i, b[0], b[2]) for i, b in best.items()}

    for window in (None, (day(3), day(12)), (day(20), day(22))):
        got = graph.spine(table, entities, "n0", depth=4, per_group=200, window=window).collect()
        ids = {n: i for i, n, _ in nodes}
        assert {(ids[r["name"]], r["depth"], r["relation"]) for r in got} == expected(window)
        assert all(r["total"] == sum(s["role"] == r["role"] for s in got) for r in got)


def test_sentences(spark):
    rows = spark.sql("select 7 id, cast(null as string) a, '' b, 'x' c, array('p', 'q') l, timestamp_ntz '2024-02-03 04:05:00' t, cast(null as timestamp_ntz) u")
    one = lambda s: rows.select(entity_documents.said(rows, s)).first()[0]
    assert one("#{id} {a|-} {a} {b|-}{b||none} {a,c|?} {l}") == "#7 -  none x p, q"
    assert one("{@t} {#t} {%t} {@u|never}«, till {@u}»«, by {a}»«, by {a|?} of {c}»") == "2024-02-03 04:05 2024-02-03 04:05 never, by ? of x"


def test_chunks_leave_a_task_in_parts(spark):
    """One batch of texts gives many batches of chunks, whole and in order."""
    from tidemark.operators import chunking as ch

    docs = spark.createDataFrame([(i, f"{i}" * 40) for i in range(9)] + [(9, None)], "doc_id long, text string").coalesce(1)
    whole = {(r["ref"], r["content"]) for r in ch.chunked(docs, "doc_id", "text").collect()}
    assert whole == {(str(i), f"{i}" * 40) for i in range(9)}
    sent, ch.SENT = ch.SENT, 100
    try:
        rows = ch.chunked(docs, "doc_id", "text", lambda t: [t[at : at + 30] for at in range(0, len(t or ""), 30)]).collect()
    finally:
        ch.SENT = sent
    assert [(r["ref"], r["chunk"], r["n_chunks"], len(r["content"])) for r in rows] == [(f"{i}#{c}", c, 2, n) for i in range(9) for c, n in ((0, 30), (1, 10))]
