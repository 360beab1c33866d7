"""The stored term index, through its life, against ranking by the texts."""

import zlib

import pytest

from tidemark.operators import retrieval, term_index

WORDS = "red green blue amber violet teal pink grey black white".split()
SCHEMA = "id string, namespace string, content string"


def text(i, salt):
    return " ".join(WORDS[(i * 7 + j * (salt + 1) + j * j) % (3 + (i + salt) % 8)] for j in range(3 + (i * salt) % 17))


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def same(spark, index, live, namespaces=()):
    rows = [r for r in live.values() if not namespaces or r[1] in namespaces]
    for terms in (["red"], ["teal", "WHITE", "amber"], ["missing"], ["missing", "grey"]):
        got = [tuple(r) for r in index.ranking(terms, 10, namespaces).select("id", "score", "rank").orderBy("rank").collect()]
        want = [tuple(r) for r in retrieval.bm25_ranking(frame(spark, rows), terms, 10).select("id", "score", "rank").orderBy("rank").collect()]
        assert got == want


def test_three_rounds_of_writes(spark, tmp_path):
    live = {f"m{i}": (f"m{i}", f"ns{i % 3}", text(i, 1)) for i in range(90)}
    live["none"] = ("none", "ns0", None)
    index = term_index.stored(frame(spark, list(live.values())), str(tmp_path / "a"), 5)
    same(spark, index, live)
    for batch in (2, 3, 4):
        gone = [r for i, r in enumerate(live.values()) if i % (batch + 1) == 0]
        new = [(f"b{batch}-{i}", f"ns{i % 4}", text(i, batch)) for i in range(25)]
        new += [(r[0], r[1], text(len(r[0]), 9)) for r in gone[:5]]  # rows that are there again with another text
        for r in gone:
            del live[r[0]]
        live |= {r[0]: r for r in new}
        index.add(f"b{batch}", frame(spark, new), frame(spark, gone))
        index.add(f"b{batch}", frame(spark, new), frame(spark, gone))  # run again: counts once
    same(spark, index, live)
    same(spark, index, live, ("ns1", "ns3"))
    folded = index.compacted(str(tmp_path / "b"))
    same(spark, folded, live, ("ns0", "ns2"))


def test_a_query_reads_its_buckets_and_no_text(spark, tmp_path):
    rows = [(f"m{i}", "a", text(i, 2)) for i in range(50)]
    index = term_index.stored(frame(spark, rows), str(tmp_path / "a"))
    plan = index.ranking(["red", "blue"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "In(term, [blue,red])" in plan
    files = index.postings(["red", "blue"]).inputFiles()
    assert files and all(any(f"bucket={zlib.crc32(t) % index.buckets}/" in f for t in (b"red", b"blue")) for f in files)


def test_a_batch_that_is_not_whole_counts_nothing(spark, tmp_path):
    index = term_index.stored(frame(spark, [("m1", "a", "red red"), ("m2", "a", "blue")]), str(tmp_path / "a"))
    other = term_index.stored(frame(spark, [("m3", "a", "red")]), str(tmp_path / "b"))
    (tmp_path / "b/postings/batch=first").rename(tmp_path / "a/postings/batch=half")
    assert [r["id"] for r in index.ranking(["red"], 5).collect()] == ["m1"] and other.path != index.path
    assert index.add("nothing") is index and index.exists()
    assert not term_index.TermIndex(spark, str(tmp_path / "nowhere")).exists()
    with pytest.raises(ValueError):
        index.add("../x", frame(spark, []))
