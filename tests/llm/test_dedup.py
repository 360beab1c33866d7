"""Operators 3 and 6 against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, near_dedup

SCHEMA = "doc_id long, text string, lang string, source string, digest string, keep_id string, _row string, bucket string"


def docs(spark, pairs):
    return spark.createDataFrame([(i, t, "en", None, "clash", "clash", "clash", "clash") for i, t in pairs], SCHEMA)


PAIRS = [(1, "a"), (2, "a"), (5, "a"), (3, None), (4, ""), (9, "b"), (9, "b"), (7, "A"), (None, "c"), (None, "c"), (None, "a"), (8, "long " * 30_000)]


def expected(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t or ""].append(i)
    out = Counter()
    for i, t in pairs:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out[(i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest())] += 1
    return out


def test_exact_dedup(spark):
    got = Counter(tuple(r) for r in exact_dedup.exact_dedup(docs(spark, PAIRS), salts=3).collect())
    assert got == expected(PAIRS)
    assert exact_dedup.exact_dedup(docs(spark, PAIRS).limit(0)).count() == 0


def test_exact_dedup_tells_apart_texts_of_one_digest(spark):
    rng = random.Random(2)
    pairs = [(i, rng.choice("abcdefghijklmnop") * rng.randint(0, 2)) for i in range(300)]
    weak = lambda text: F.substring(F.sha2(text, 256), 1, 1)
    got = exact_dedup.exact_dedup(docs(spark, pairs), digest=weak).collect()
    want = {(i, keep, n, kept) for (i, keep, n, kept, _) in expected(pairs)}
    assert {tuple(r)[:4] for r in got} == want and len(got) == len(pairs)


def test_winners_keep_one_row_and_all_columns(spark):
    df = docs(spark, PAIRS)
    kept = exact_dedup.exact_winners(df)
    assert kept.columns == df.columns
    rows = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert rows == Counter({(5, "a"): 1, (4, ""): 1, (9, "b"): 1, (7, "A"): 1, (None, "c"): 1, (8, "long " * 30_000): 1})


def test_exact_dedup_against_sql(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(con.execute(f"select doc_id, keep_id, group_size, kept, text_sha256 from ({exact_dedup.OP6_SQL})").fetchall())
    assert sorted(tuple(r) for r in exact_dedup.op6_exact_dedup(spark, "/root/testdata/sf0.001").collect()) == want


def runs(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else frozenset()


def brute_classes(pairs, threshold=0.8):
    sets = {}
    for i, t in pairs:
        sets.setdefault(i, runs(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j:
                a, b = sets[i], sets[j]
                if (not a and not b) or (a and b and len(a & b) / len(a | b) >= threshold):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def family(rng, words, copies, edits):
    out = []
    for k in range(copies):
        w = list(words)
        for _ in range(rng.randint(*edits)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_classes_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [" ".join(text(120)) for _ in range(40)]
    for edits in ((0, 1), (1, 3), (2, 5), (3, 8)):
        texts += family(rng, text(150), 40, edits)
    passage = text(60)
    texts += [" ".join(text(rng.randint(20, 80)) + passage + text(20)) for _ in range(40)]
    texts += ["one two", "one two", "ONE  two", "three four five six seven", "", None, " \n", "x", "long word list " * 3000]
    pairs = list(enumerate(texts))
    rng.shuffle(pairs)
    rows = near_dedup.near_classes(docs(spark, pairs)).collect()
    got = {r["doc_id"]: r["class_id"] for r in rows}
    assert got == brute_classes(pairs)
    # A document whose class holds another text has a link, and only such a one.
    words = {i: " ".join((t or "").lower().split()) for i, t in pairs}
    members = defaultdict(set)
    for i, c in got.items():
        members[c].add(words[i])
    assert {r["doc_id"] for r in rows if r["links"]} == {i for i, c in got.items() if len(members[c]) > 1}


@pytest.mark.parametrize("times", [2, 5, 16, 64, 100])
def test_keys_are_shared_by_copies_with_a_repeated_line(times):
    """Recall of the candidates at a plain similarity of 0.8 and above, whatever the weights are."""
    rng = random.Random(times)
    texts = []
    for k in range(100):
        words = [f"w{k}x{i}" for i in range(84)]
        line = [f"l{k}x{i}" for i in range(rng.choice([8, 12, 15]))]
        texts += [" ".join(words), " ".join(words + line * times)]
    batch = near_dedup.pa.RecordBatch.from_arrays([near_dedup.pa.array(range(len(texts))), near_dedup.pa.array(texts)], names=["doc_id", "text"])
    keys = [set(x) for out in near_dedup._sketcher(32, 6, 5)(iter([batch])) for x in out.column(3).to_pylist()]
    similar = [k for k in range(0, len(texts), 2) if len(runs(texts[k]) & runs(texts[k + 1])) >= 0.8 * len(runs(texts[k]) | runs(texts[k + 1]))]
    assert len(similar) > 50 and sum(bool(keys[k] & keys[k + 1]) for k in similar) >= 0.99 * len(similar)


def test_near_classes_of_copies_with_a_much_repeated_passage(spark):
    rng = random.Random(5)
    pairs = []
    for k in range(12):
        words = [f"w{k}x{i}" for i in range(104)]
        passage = [f"p{k}x{i}" for i in range(16)]
        pairs += [(4 * k, " ".join(words)), (4 * k + 1, " ".join(words + passage * 1000)), (4 * k + 2, " ".join([*words[:50], "x", *words[50:]] + passage * 30))]
    rng.shuffle(pairs)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs(spark, pairs)).collect()}
    assert got == brute_classes(pairs) and got[1] == 0


def test_near_classes_of_odd_rows(spark):
    pairs = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    got = sorted((tuple(r) for r in near_dedup.near_classes(docs(spark, pairs)).collect()), key=str)
    assert got == sorted([(1, 1, 2, 0, True), (1, 1, 2, 0, True), (2, 1, 2, 0, False), (None, None, 2, 0, True)], key=str)
    assert near_dedup.near_classes(docs(spark, pairs).limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in near_dedup.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def probability_jaccard(x, y):
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in x if i in y)


@pytest.mark.parametrize("seed", range(3))
def test_signatures_estimate_probability_jaccard(seed):
    rng = np.random.default_rng(seed)
    weights = [{int(e): float(w) for e, w in zip(rng.permutation(60)[:40], rng.integers(1, 6, 40), strict=True)} for _ in range(2)]
    doc = np.repeat([0, 1], 40)
    element = near_dedup._mix(np.array([e + 1 for w in weights for e in w], dtype=np.uint64) * near_dedup._GOLDEN)
    weight = np.array([v for w in weights for v in w.values()])
    signatures = near_dedup.prob_minhash(doc, element, weight, 2, 6000)
    assert abs((signatures[0] == signatures[1]).mean() - probability_jaccard(*weights)) < 0.03


def test_bounds_count_runs_that_others_have(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e x"), (3, "q")], "doc_id long, text string")
    assert sorted(map(tuple, near_dedup._bounds(df, 5).collect())) == [(1, 2, 1), (2, 2, 1), (3, 1, 0)]
