"""Blocks and lists of postings against counts in dictionaries, and what building an index shuffles and stores."""

from collections import Counter

import pyarrow as pa
import pytest

from tidemark.operators import posting_blocks as pb
from tidemark.operators import term_index
from tidemark.sources.adapters import Tables

WORDS = "red green blue amber violet teal pink grey Ärger 猫 x1 x2 x3".lower().split()


def rows():
    """(namespace, id, sign, words): repeated ids, rows that go, one that went with another text, null and empty ones."""
    out = []
    for i in range(120):
        words = [WORDS[(i * 7 + j * j) % (2 + i % 12)] for j in range(i % 17)]
        name, space = f"m{i % 90}" if i % 31 else None, f"n{i % 3}" if i % 11 else None
        out.append((space, name, 1, words if i % 23 else None))
        if i % 4 == 0:
            out.append((space, name, -1, words if i % 8 else words[: i % 5]))
    return out


def batches(some, size):
    columns = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())]
    for at in range(0, len(some), size):
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*some[at : at + size], strict=True), columns, strict=True)], ["namespace", "id", "sign", "words"])


def lists_of(blocks, net):
    got = [(bucket, part, block) for b in blocks for bucket, part, block in zip(*(b.column(c).to_pylist() for c in ("bucket", "part", "block")), strict=True)]
    got.sort(key=lambda x: x[:2])
    dealt = [pa.record_batch([pa.array([x[i]], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["bucket", "part", "block"]) for x in got]
    return list(pb.merged(net)(dealt))


def postings(lists):
    return [
        (r["bucket"], r["namespace"], i, r["term"], r["sign"], tf, n) for b in lists for r in b.to_pylist() if r["bucket"] != pb.FIGURES
        for i, tf, n in zip(r["ids"], r["tfs"], r["lengths"], strict=True)
    ]


@pytest.mark.parametrize("portion, listed, buckets, parts", [(1, 1, 1, 1), (40, 7, 5, 3), (10**6, 10**6, 4, 1), (90, 10**6, 64, 2)])
def test_blocks_and_lists_lose_nothing(monkeypatch, portion, listed, buckets, parts):
    monkeypatch.setattr(pb, "PORTION", portion)
    monkeypatch.setattr(pb, "LISTED", listed)
    some = rows()
    lists = lists_of(pb.counted(buckets, parts)(batches(some, 50)), net=False)
    each = [(space, name, t, sign, tf, len(words)) for space, name, sign, words in some if words for t, tf in Counter(words).items()]
    assert Counter(p[1:] for p in postings(lists)) == Counter(each)
    assert all(len(r["ids"]) <= listed for b in lists for r in b.to_pylist() if r["bucket"] != pb.FIGURES)
    figures = Counter()
    for r in (r for b in lists for r in b.to_pylist() if r["bucket"] == pb.FIGURES):
        figures.update({(r["namespace"], i): x for i, x in enumerate(r["tfs"])})
    want = Counter()
    for space, _, sign, words in some:
        want.update({(space, 0): sign, (space, 1): sign * (words is not None), (space, 2): sign * len(words or [])})
    assert figures == want
    # Folded, dealt out otherwise.
    again = [b.filter(pa.array([x != pb.FIGURES for x in b.column("bucket").to_pylist()])) for b in lists]
    folded = postings(lists_of(pb.unlisted(parts + 1)(again), net=True))
    tf, n = Counter(), Counter()
    for space, name, term, sign, k, length in each:
        tf[space, name, term] += k * sign
        n[space, name, term] += length * sign
    assert sorted(map(str, (p[1:] for p in folded))) == sorted(str((*at[:2], at[2], 1, x, n[at])) for at, x in tf.items() if x > 0)


def test_an_index_stores_lists_and_shuffles_neither_texts_nor_postings(spark, tmp_path):
    new = spark.createDataFrame([(f"m{i}", "a", "red green " * 20 + "blue") for i in range(300)], "id string, namespace string, content string")
    index = term_index.stored(new, str(tmp_path / "a"), 4)
    stored = spark.read.parquet(f"{index.path}/postings").filter(f"bucket <> {pb.FIGURES}")
    assert stored.count() == 3 and index.postings(["red", "blue"]).count() == 600
    texts = Tables(spark, "/root/testdata/sf0.001").memory_texts()
    plan = texts.select("id", "content")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_texts_of_vectors_that_recur(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    t.__dict__["embeddings"] = t.embeddings.unionAll(t.embeddings.filter("vec_id = 3"))
    both = [df.groupBy("id").count().filter("count > 1").count() for df in (t.memories, t.memory_texts())]
    assert both[0] == both[1] > 0 and "embedding" not in t.memory_texts().columns
