"""Operator 10 and the whole pipeline against plain twins, on the smallest tables."""

import math
import re
import zlib
from collections import Counter, defaultdict
from decimal import Decimal, getcontext

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup import brute_classes
from tests.llm.test_packing_sharding_mixing import brute_edf, ids_of
from tidemark.llm import quality

getcontext().prec = 50
SF = "/root/testdata/sf0.001"


def plain_features(text):
    """{bucket: value}, from the operator's description."""
    words = (text or "").split()
    bucket = lambda name: zlib.crc32(name.encode("utf-8", "replace")) % 2**18
    out, shapes = {}, Counter()
    for w in words:
        core = re.sub(r"^[\W_]+|[\W_]+$", "", w)
        case = "-" if not core else "U" if len(core) > 1 and core.isupper() else "n" if re.search(r"\d", core) or any(c.isdigit() for c in core) else "w"
        shapes[bucket("s:" + case + ("" if w[-1].isalnum() else w[-1]))] += 1
        for name in ["w:" + core.lower()] + ["p:" + core.lower()[:k] for k in (4, 5) if len(core.lower()) > k]:
            out[bucket(name)] = [1.0]
    for b, n in shapes.items():
        out.setdefault(b, []).append(2 * n / len(words))
    if words:
        out.setdefault(bucket("r:repeats"), []).append(2 * (1 - len(set(words)) / len(words)))
    # A bucket of two features holds both; they act as one feature each.
    return [(b, v) for b, values in out.items() for v in values]


def probability(s, first, logs, y, last):
    """Of grade y, the definition itself, in 50 digits."""
    t = [first]
    for step in logs:
        t.append(t[-1] + step.exp())
    below = lambda k: Decimal(0) if k < 0 else Decimal(1) if k >= last else 1 / (1 + (s - t[k]).exp())
    return below(y) - below(y - 1)


def slopes(s, first, logs, y, last, h=Decimal("1e-12")):
    """-dp / p by differences: by the score, the first threshold and each step; p is taken as 1e-9 at least."""
    s, first, logs = Decimal(s), Decimal(first), [Decimal(x) for x in logs]
    p = max(probability(s, first, logs, y, last), Decimal("1e-9"))
    moved = lambda k, d: [x + d if i == k else x for i, x in enumerate(logs)]
    pairs = [(probability(s + h, first, logs, y, last), probability(s - h, first, logs, y, last)), (probability(s, first + h, logs, y, last), probability(s, first - h, logs, y, last))]
    pairs += [(probability(s, first, moved(k, h), y, last), probability(s, first, moved(k, -h), y, last)) for k in range(len(logs))]
    return [float((down - up) / (2 * h * p)) for up, down in pairs]


def twin_fit(rows, size, *, epochs, alpha, beta, l1, l2, rate, grades=3):
    """FTRL on one weight at a time, with gradients by differences."""
    last = grades - 1
    z, n = defaultdict(float), defaultdict(float)
    first, logs, g2 = -(grades - 2) / 2, [0.0] * (grades - 2), [1e-6] * last
    weight = lambda b: 0.0 if abs(z[b]) <= l1 else -math.copysign(abs(z[b]) - l1, z[b]) / ((beta + math.sqrt(n[b])) / alpha + l2)
    for _ in range(epochs):
        for x, y in rows:
            w = {b: weight(b) for b, _ in x}
            s = sum(v * w[b] for b, v in x)
            slope, *moves = slopes(s, first, logs, y, last)
            for b, v in x:
                g = slope * v
                sigma = (math.sqrt(n[b] + g * g) - math.sqrt(n[b])) / alpha
                z[b] += g - sigma * w[b]
                n[b] += g * g
            g2 = [a + m * m for a, m in zip(g2, moves, strict=True)]
            steps = [rate * m / math.sqrt(a) for m, a in zip(moves, g2, strict=True)]
            first, logs = first - steps[0], [a - m for a, m in zip(logs, steps[1:], strict=True)]
    thresholds = [first]
    for step in logs:
        thresholds.append(thresholds[-1] + math.exp(step))
    return {b: weight(b) for b in list(z)}, thresholds


@pytest.mark.parametrize("grades", [2, 3, 5])
def test_ordinal_fit_equals_gradients_by_differences(grades):
    rng = np.random.default_rng(grades)
    rows = []
    for _ in range(60):
        at = rng.choice(64, size=8, replace=False)
        x = np.round(rng.random(8), 2)
        rows.append((at, x, int(min(grades - 1, max(0, round(float(x.sum()) + (at < 20).sum() - 4 + rng.normal()))))))
    options = {"epochs": 3, "alpha": 1.0, "beta": 1.0, "l1": 0.05, "l2": 0.1, "rate": 0.3}
    model = quality.OrdinalModel(6, grades)
    model.fit(rows, **options)
    weights, thresholds = twin_fit([(list(zip(at.tolist(), x.tolist(), strict=True)), y) for at, x, y in rows], 64, grades=grades, **options)
    assert np.allclose(model.weights, [weights.get(b, 0.0) for b in range(64)], atol=1e-4) and np.allclose(model.thresholds, thresholds, atol=1e-4)
    assert np.abs(model.weights).max() > 0.1 and (np.diff(model.thresholds) > 0).all()


def tables():
    con = duckdb.connect()
    docs = con.execute(f"select doc_id, text, source from '{SF}/documents.parquet'").fetchall()
    labels = con.execute(f"select doc_id, quality, toxic from '{SF}/labels.parquet' where doc_id is not null and quality is not null").fetchall()
    return docs, labels


@pytest.fixture(scope="module")
def grades_of():
    """doc_id -> (expected grade, tail probability, kept), by the twin: all labels, as they are fewer than the sample's bound."""
    docs, labels = tables()
    grade = {}
    for i, q, toxic in labels:
        g = 0 if q == 0 else 1 if toxic == 1 else 2
        grade[i] = min(grade.get(i, 2), g)
    assert len(grade) < 8000
    halves = lambda x: [(b, float(np.float16(v))) for b, v in x]
    held, train = [], []
    for h, i, x in sorted((zlib.crc32(str(i).encode()), i, halves(plain_features(t))) for i, t, _ in docs if i in grade):
        (held if h % 5 == 0 else train).append((x, grade[i]))
    weights, thresholds = twin_fit(train, 2**18, epochs=8, alpha=1.0, beta=1.0, l1=0.09 * max(1, len(train)) ** 0.5, l2=0.0, rate=0.3)
    tails = lambda x: [1 / (1 + math.exp(t - sum(v * weights.get(b, 0.0) for b, v in x))) for t in thresholds]
    clean = [tails(x)[-1] for x, y in held if y == 2]
    cut = min(0.5, float(np.quantile(clean, 0.002))) if clean else 0.5
    out = {}
    for i, t, _ in docs:
        p = tails(plain_features(t))
        out[i] = (sum(p), p[-1], p[-1] >= cut or not (t or "").strip())
    return out


def test_op10_equals_its_twin(spark, grades_of):
    rows = {r["doc_id"]: r for r in quality.op10_ordinal_quality(spark, SF).collect()}
    assert set(rows) == set(grades_of)
    for i, (expected, tail, _) in grades_of.items():
        assert abs(rows[i]["expected_grade"] - expected) < 2e-3 and abs(rows[i]["tail_probability"] - tail) < 2e-3
    assert {i for i, r in rows.items() if r["kept"]} == {i for i, x in grades_of.items() if x[2]}


def test_pipeline_equals_its_twin(spark, grades_of):
    """Each stage on the whole of what its predecessor kept; the rows of ``run`` at the end."""
    docs, _ = tables()
    kept = [d for d in docs if grades_of[d[0]][2]]
    newest = {}
    for i, t, _ in kept:
        newest[t or ""] = max(i, newest.get(t or "", i))
    distinct = [d for d in kept if newest[d[1] or ""] == d[0]]
    classes = brute_classes([(i, t) for i, t, _ in distinct])
    want = [d for d in distinct if classes[d[0]] == d[0]]

    at = corpus_pipeline.documents(spark, SF)
    stages = [kept, distinct, want]
    for (_, stage), rows in zip(corpus_pipeline.STAGES[:3], stages, strict=True):
        at = corpus_pipeline.staged(stage(spark, at, SF), "twin")
        assert sorted(r["doc_id"] for r in at.select("doc_id").collect()) == sorted(d[0] for d in rows)

    # The mixture: the sources of its places are those of a schedule in which every slot looks at every source.
    sizes = Counter(s or "" for *_, s in want)
    turns = [(s, block) for s, block, _ in brute_edf(sizes, {s: n**0.5 for s, n in sizes.items()}, 32)]
    places = [s for s, block in turns for _ in range(min(32, sizes[s] - 32 * block))]
    mixed = corpus_pipeline.mix_sources(spark, at, SF)
    order = mixed.select("doc_id", "source", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")).collect()
    order = sorted(order, key=lambda r: (r["part"], r["row"]))
    assert [r["source"] or "" for r in order] == places and sorted(r["doc_id"] for r in order) == sorted(d[0] for d in want)

    # Its sequences hold each kept document's ids once, in pieces without gaps, and nothing else.
    texts, pieces = {i: t for i, t, _ in want}, defaultdict(list)
    filled = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for i, parts in pieces.items():
        data, begin = np.array(ids_of(texts[i]), dtype="<u4").tobytes(), 0
        for start, length, crc, tokens in sorted(parts):
            assert start == begin and tokens == len(data) // 4 and crc == zlib.crc32(data[4 * begin : 4 * (begin + length)])
            begin += length
        assert begin == len(data) // 4
    for parts in filled.values():
        begin = 0
        for offset, length in sorted(parts):
            assert offset == begin
            begin += length
        assert begin <= 4096
