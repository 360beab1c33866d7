"""Operators 11 to 13 against plain Python twins, on odd rows, and against their SQL."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import catalogue, clustering, line_rules, manifest

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["op11_line_frequency", "op12_lloyd_clusters", "op13_merkle_manifest"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    got = catalogue.queries()[name](spark, DATA)
    want = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    columns = sorted(names)
    assert sorted(tuple(str(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in want.fetchall())


# -- operator 11


def plain_measures(text):
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            hit.update(range(i, i + 8))
    told = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(told) - len(set(told)), len(hit)


def normal(line):
    return re.sub("[0-9]+", "0", re.sub(r"[\x20\x09\x0B-\x0D]+", " ", line.lower())).strip(" ")


def plain_rules(rows, max_docs, min_left):
    """(measures, base_failed, depleted) per row; rows of (doc_id, text, source)."""
    rows = [(i, t or "", s or "") for i, t, s in rows]
    first, holders = {}, defaultdict(dict)
    for i, t, s in rows:
        known = first.get((s, t))
        first[s, t] = i if known is None else known if i is None else min(i, known)
    for (s, t), i in first.items():
        for line in {normal(x) for x in t.split("\n")} - {""}:
            holders[s, line][t] = i
    out = []
    for _, t, s in rows:
        m, lost = plain_measures(t), 0
        for line in filter(None, map(normal, t.split("\n"))):
            has = holders[s, line]
            least = min((i for i in has.values() if i is not None), default=None)
            if len(has) > max_docs and first[s, t] != least:
                lost += len(line.split(" "))
        out.append((m, m[0] < 20 or 100 * m[4] > 30 * m[0], lost > 0 and m[0] - lost < min_left * m[0]))
    return out


ODD_TEXTS = [
    None, "", " \t\n\n ", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 40, "a\x0bb\x0cc\r\nd", "ünï Çödé # * $$ %&|<>", "l1\nl1\n\nl1 \n l1",
    " w x y", "r s t u v w x y z\n" * 3 + "tail", "😀 😀\n😀", " ".join(str(i % 11) for i in range(60)),
]


def test_measures_of_odd_and_very_long_texts(spark):
    long_text = " ".join(f"w{i * i % 4999}" for i in range(60_000)) + "\nsame line\nsame line"
    texts = [*ODD_TEXTS, long_text, "z" * 3_000_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("text", F.coalesce("text", F.lit("")))
    got = {r["k"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in line_rules.measured(rows).drop("text").collect()}
    assert got == {k: plain_measures(t or "") for k, t in enumerate(texts)}


def planted():
    rng = np.random.default_rng(5)
    body = lambda n: " ".join("".join(chr(97 + c) for c in x) for x in rng.integers(0, 26, (n, 5)))
    rows = [(i, t, "odd") for i, t in enumerate(ODD_TEXTS)]
    for i in range(60):  # a notice on each page of a host, as half or nearly all of it; another host has it twice
        rows.append((100 + i, body(25) + f"\nAll  rights reserved {i}.\n" + ("Subscribe to our news letter now and here\n" * (9 if i % 3 else 1)), "big" if i < 58 else "small"))
    rows += [(300 + i % 5, "copied words " * 20, "big") for i in range(30)]  # copies count once
    rows += [(None, body(25) + "\nall rights reserved 7.", None), (400, body(30), None), (400, body(30), "big"), (101, rows[15][1], "big")]
    return rows


@pytest.mark.parametrize("max_docs", [0, 1, 5, 58])
def test_line_rules_equal_a_plain_twin(spark, max_docs):
    rows = planted()
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, source string, digest int, `lines` string")
    got = line_rules.line_rules(docs, max_docs=max_docs, min_left=0.5, salts=3).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    have = Counter((r["doc_id"], tuple(r[c] for c in names), r["base_failed"], r["depleted"], r["kept"]) for r in got)
    want = plain_rules(rows, max_docs, 0.5)
    assert have == Counter((r[0], m, b, d, not b and not d) for r, (m, b, d) in zip(rows, want, strict=True))
    assert any(d for _, _, d in want) or max_docs == 58


def test_common_lines_are_removed_but_from_one_document_of_the_host(spark):
    docs = spark.createDataFrame([(*r, "clash") for r in planted()], "doc_id long, text string, source string, host string")
    out = line_rules.without_common_lines(docs, max_docs=5, salts=3)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.filter("doc_id between 100 and 157").collect()}
    assert [i for i, t in texts.items() if "rights" in t] == [100]
    assert all(re.fullmatch(r"([a-z]{5} ?){25}\n", t) for i, t in texts.items() if i != 100)
    same = lambda d: Counter((r["doc_id"], r["text"], r["source"]) for r in d.filter("doc_id not between 100 and 157 or source = 'small'").collect())
    assert same(out) == same(docs)
    empty = spark.createDataFrame([], docs.schema)
    assert line_rules.without_common_lines(empty).count() == line_rules.line_rules(empty).count() == 0


def test_rules_have_no_python_on_their_path(spark):
    plan = catalogue.queries()["op11_line_frequency"](spark, DATA)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- operator 12


def plain_lloyd(vectors, k, rounds):
    kept = {i: [math.floor(256 * x) for x in v] for i, v in vectors.items()}
    order = sorted(kept, key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())
    centroids = [kept[i] for i in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = defaultdict(list)
        for v in kept.values():
            groups[near(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    return {i: near(v)[::-1] for i, v in kept.items()}, centroids


@pytest.mark.parametrize("k", [1, 7, 200])
def test_lloyd_equals_plain_integers(spark, k):
    rng = np.random.default_rng(k)
    vectors = {int(i): [float(x) for x in np.round(v, 2)] for i, v in enumerate(rng.normal(size=(120, 4)))}
    vectors |= {500 + i: vectors[3] for i in range(40)}  # ties: many equal vectors, and empty clusters
    data = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors.items()], "vec_id long, embedding array<double>, cluster int, q int").repartition(5)
    placed, centroids = clustering.lloyd(data, k, 3, dimension=4)
    want, ends = plain_lloyd(vectors, k, 3)
    assert {r["vec_id"]: (r["cluster"], r["distance"]) for r in placed.collect()} == want
    assert centroids.tolist() == ends


def test_odd_vectors(spark):
    ok = [0.5, -0.001]
    rows = [(1, ok), (1, ok), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 0.0]), (7, [1.0, 2.0, 3.0]), (None, ok), (8, [3e30, 0.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    placed, centroids = clustering.lloyd(data, 3, 2, dimension=2)
    assert centroids.tolist() == [[128, -1], [128, -1]]  # both rows of the id 1; null ids start none
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in placed.collect()) == Counter({(1, 0, 0): 2, (None, 0, 0): 1, (8, None, None): 1})
    placed, centroids = clustering.lloyd(data.limit(0), 3, 2, dimension=2)
    assert placed.count() == 0 and len(centroids) == 0
    only = data.filter("vec_id = 8")
    assert [tuple(r) for r in clustering.lloyd(only, 3, 2, dimension=2)[0].collect()] == [(8, None, None)]


# -- operator 13


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fanout):
    """The top of a list of digests, and for each the (left, right) siblings on its way."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            run = nodes[p // fanout * fanout : p // fanout * fanout + fanout]
            paths[i].append(("".join(run[: p % fanout]), "".join(run[p % fanout + 1 :])))
            place[i] = p // fanout
        nodes = [sha(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def plain_manifest(rows, fanout):
    """Counter of (doc_id, leaf, subroot, root, path); rows of (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, plain_leaf(r), r[0]))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    tops = [climb([x[2] for x in sorted(groups[n])], fanout) for n in names]
    root, ups = climb([t for t, _ in tops], fanout)
    out = []
    for n, (sub, paths), up in zip(names, tops, ups, strict=True):
        out += [(x[3], x[2], sub, root, tuple(p + up)) for x, p in zip(sorted(groups[n]), paths, strict=True)]
    return Counter(out)


def manifest_rows():
    rows = [(i, f"s{i % 3}", lang, i if i % 5 else None, f"Text {i} É" * (i % 4)) for lang, n in (("en", 90), ("de", 9), ("fr", 8), ("es", 1), (None, 3), ("", 65), ("é", 2)) for i in range(n)]
    rows += [(None, None, None, None, None), (None, None, "en", None, ""), (None, None, "en", None, None), (5, "a", "en", 1, "other"), (5, "a", "en", 1, "other"), (2**62, "x" * 70_000, "fr", -3, "T" * 2_000_000)]
    return rows


def frame(spark, rows):
    data = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], "clash", 0, 0) for r in rows], f"{SCHEMA}, `key` string, `index` int, `digest` int")
    return data.repartition(7)


@pytest.mark.parametrize("fanout", [2, 8])
def test_manifest_equals_a_plain_tree(spark, fanout):
    rows = manifest_rows()
    out = manifest.manifest(frame(spark, rows), fanout=fanout)
    hexed = lambda b: bytes(b).hex()
    got = Counter(
        (r["doc_id"], hexed(r["leaf"]), hexed(r["subroot"]), hexed(r["root"]), tuple((hexed(s["left"]), hexed(s["right"])) for s in r["path"])) for r in out.collect()
    )
    assert got == plain_manifest(rows, fanout)
    roots = out.select(manifest.folded(F.col("leaf"), F.col("path")).alias("f"), manifest.text_of(F.col("root")).alias("r"), manifest.proof(F.col("path")).alias("p"), "path").collect()
    assert all(r["f"] == r["r"] and r["p"] == sha("".join(hexed(s["left"]) + hexed(s["right"]) for s in r["path"])) for r in roots)


def test_manifest_of_one_row_and_of_none(spark):
    row = (7, "s", "en", 1, "t")
    got = manifest.manifest(frame(spark, [row])).first()
    assert bytes(got["leaf"]).hex() == bytes(got["subroot"]).hex() == bytes(got["root"]).hex() == plain_leaf(row) and got["path"] == []
    assert manifest.manifest(frame(spark, [row]).limit(0)).count() == 0


def test_changed_rows_are_found(spark):
    rows = [(i, "s", "en", i, f"text {i}") for i in range(40)] + [(3, "s", "en", 3, "text 3")]
    entries = manifest.manifest(frame(spark, rows))
    now = [r for r in rows[1:40]] + [(50, "s", "en", 1, "new")]
    now[9] = (10, "s", "de", 10, "text 10")
    assert {tuple(r) for r in manifest.changed(entries, frame(spark, now)).collect()} == {(0, "missing"), (3, "missing"), (10, "changed"), (50, "new")}
    assert manifest.changed(entries, frame(spark, rows)).count() == 0
