"""Operators 1, 2 and 4 against brute force and their laws."""

import itertools
import math
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import mixing, packing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, size long, shard string, slot string, _row string"
TEXTS = [None, "", "a", "Hello, World's  é ñ 123", "x " * 9000, "same", "same", "same", "İstanbul <|endoftext|> ​ \x1c z", "ß" * 50]


def docs(spark, texts, sources=("s0", "s1", None)):
    rows = [(i, t, "en", sources[i % len(sources)], 0, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def ids_of(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_ids_of_remembered_words_are_the_tokenizers():
    encode = packing.word_encoder(packing.tokenizer_path())
    for text in [*TEXTS, "don't I'LL we've '' 'sx ''s x_y --- ½ 3²", "École ÉCOLE naïve Œuvre", "tab\tnew\nline nbsp", "日本語 text", "a" * 300]:
        for _ in range(2):
            got = np.frombuffer(encode(text or ""), "<u4").tolist()
            assert got == ids_of(text)[:-1], text


def test_packing_is_gapless_and_whole(spark):
    df = docs(spark, TEXTS * 3).repartition(3)
    rows = packing.pack(df).collect()
    texts = dict(enumerate(TEXTS * 3))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        data = np.array(ids_of(texts[d]), dtype="<u4").tobytes()
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(data) // 4
            assert r["ids_crc32"] == zlib.crc32(data[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(data) // 4
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and at & (at - 1) == 0  # full, or a power of two


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=40))
def test_packer_places_every_token_once(lengths):
    packer = packing.Packer((256, 512, 1024, 2048, 4096), 0, 8192, 10_000)
    for i, n in enumerate(lengths):
        packer.add(i, np.arange(n, dtype="<u4").tobytes())
    packer.finish()
    spans = defaultdict(list)
    groups = Counter()
    for d, at, n, _, total, _, _, size, group in packer.rows:
        spans[d].append((at, n))
        groups[(size, group)] += n
        assert total == lengths[d]
    assert {d: sum(n for _, n in s) for d, s in spans.items()} == dict(enumerate(lengths))
    for s in spans.values():
        at = 0
        for start, n in sorted(s):
            assert start == at
            at += n
    assert all(n <= max(8192, size) for (size, _), n in groups.items())


def test_packing_of_nothing_and_of_bad_tiers(spark):
    assert packing.pack(docs(spark, ["a"]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs(spark, ["a"]), tiers=(1000,))


def test_lpt_is_longest_processing_time():
    sizes = sorted([7, 7, 6, 6, 5, 4, 4, 4, 3], reverse=True)
    loads = Counter()
    for size, b in zip(sizes, sharding.lpt(sizes, 3), strict=True):
        assert loads[b] == min(loads[x] for x in range(3))
        loads[b] += size
    assert max(loads.values()) <= 4 / 3 * sum(sizes) / 3


def test_sharding_balances_bytes_and_keeps_groups_together(spark):
    rng = np.random.default_rng(1)
    texts = ["x" * int(n) + str(i) for i, n in enumerate(rng.integers(1, 300, 2000))] + ["copy"] * 900 + [None, "", "", "é"]
    rows = sharding.lpt_shards(docs(spark, texts), 8).collect()
    assert len(rows) == len(texts)
    where, loads, slots = {}, Counter(), defaultdict(list)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data)
        assert where.setdefault(data, r["shard"]) == r["shard"]
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) - min(loads.values()) <= 0.02 * sum(loads.values()) / 8
    assert {r["group_rows"] for r in rows if texts[r["doc_id"]] == "copy"} == {900}


def test_sharding_of_little(spark):
    assert sharding.lpt_shards(docs(spark, ["a"]).limit(0)).count() == 0
    rows = sharding.lpt_shards(spark.createDataFrame([(None, "a"), (1, None), (1, None)], "doc_id long, text string")).collect()
    assert len(rows) == 3 and len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=8))
def test_pfair_deviates_by_less_than_one_block(counts):
    share = {f"s{i}": n for i, n in enumerate(counts)}
    turn = mixing.pfair_period(share)
    period, done = sum(counts), Counter()
    assert Counter(turn) == share
    for t, s in enumerate(turn, 1):
        done[s] += 1
        assert all(abs(done[x] - t * n / period) < 1 for x, n in share.items())


def brute_edf(sizes, weights, block_rows):
    """Every slot looks at every source: of those whose next block is released the one with the earliest deadline, then by name."""
    left = {s: -(-n // block_rows) for s, n in sizes.items() if n}
    done, slot, out = dict.fromkeys(left, 0), 0, []
    while left:
        live = {s: Fraction(weights[s]) for s in left if weights.get(s, 0) > 0} or {s: Fraction(sizes[s]) for s in left}
        total, had, t = sum(live.values()), dict.fromkeys(live, 0), 0
        while all(done[s] < left[s] for s in live):
            w = {s: x / total for s, x in live.items()}
            s = min((s for s in live if math.floor(had[s] / w[s]) <= t), key=lambda s: (math.ceil((had[s] + 1) / w[s]), s))
            out.append((s, done[s], slot))
            had[s], done[s], slot, t = had[s] + 1, done[s] + 1, slot + 1, t + 1
        left = {s: n for s, n in left.items() if done[s] < n}
    return out


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 90), min_size=1), st.integers(1, 9), st.integers(1, 4))
def test_schedule_is_that_of_a_brute_force(sizes, w, block_rows):
    weights = {s: (i + w) / 3 for i, s in enumerate(sorted(sizes)) if s != "f"}
    got = list(mixing.pfair_schedule(sizes, weights, block_rows))
    assert [x[:3] for x in got] == brute_edf(sizes, weights, block_rows)
    # Positions are gapless.
    at = 0
    for s, j, _, _, first in got:
        assert first == at
        at += min(block_rows, sizes[s] - j * block_rows)
    assert at == sum(sizes.values())


def test_a_million_slots_of_ten_thousand_sources_keep_to_the_given_weights():
    rng = np.random.default_rng(7)
    weight = {f"s{i:05d}": float(x) for i, x in enumerate(np.exp(rng.normal(0, 2, 10_000)))}
    total, names = math.fsum(weight.values()), sorted(weight)
    share = mixing.whole_weights(weight)
    assert share["s00001"] * Fraction(weight["s00002"]) == share["s00002"] * Fraction(weight["s00001"])
    turn = np.fromiter((int(s[1:]) for s in itertools.islice(mixing.pfair_slots(share), 1_000_000)), dtype=np.int64)
    w = np.array([weight[s] / total for s in names])
    order = np.argsort(turn, kind="stable")  # slots of each source, in order
    rank = np.arange(len(turn)) - np.repeat(np.searchsorted(turn[order], np.arange(10_000)), np.bincount(turn, minlength=10_000))
    # Deviation is largest just before and just after a block: j blocks at slot t, j + 1 at slot t + 1.
    t, s = order.astype(np.float64), turn[order]
    assert np.abs(rank - w[s] * t).max() < 1 + 1e-6 and np.abs(rank + 1 - w[s] * (t + 1)).max() < 1 + 1e-6
    assert np.abs(np.bincount(turn, minlength=10_000) - w * 1_000_000).max() < 1 + 1e-6


def test_mixing_positions(spark):
    texts = [f"t{i}" for i in range(700)]
    df = docs(spark, texts, ("hot", "hot", "hot", "a", None))
    rows = sorted(mixing.mix_positions(df, {"hot": 1, "a": 1, "": 2}, block_rows=10).collect(), key=lambda r: r["_position"])
    assert [r["_position"] for r in rows] == list(range(700))
    assert sorted(r["_row"]["doc_id"] for r in rows) == list(range(700))
    first = [r for r in rows if r["_phase"] == 0]
    n = Counter(r["_source"] for r in first)
    assert abs(n[""] - len(first) / 2) <= 10 and abs(n["hot"] - len(first) / 4) <= 10
    mixed = mixing.mixed(df, {"hot": 1, "a": 1, "": 2}, block_rows=10)
    assert mixed.columns == df.columns and [r["doc_id"] for r in mixed.collect()] == [r["_row"]["doc_id"] for r in rows]


def test_packing_keeps_the_order_of_the_mixture_from_buffer_to_buffer(spark):
    """Within ``buffer_tokens`` of the order pieces are sorted into sequences; from one buffer to the next the order holds."""
    df = docs(spark, [f"{'word ' * 40}{i}" for i in range(600)], ("hot", "hot", "a")).repartition(1)
    ordered = mixing.mixed(df).coalesce(1)
    place = {r["doc_id"]: k for k, r in enumerate(ordered.collect())}
    pieces = packing.pack(ordered, buffer_tokens=8192).collect()
    first = defaultdict(lambda: 10**9)
    last = defaultdict(int)
    for r in pieces:
        first[r["sequence_id"]], last[r["sequence_id"]] = min(first[r["sequence_id"]], place[r["doc_id"]]), max(last[r["sequence_id"]], place[r["doc_id"]])
    spread = max(last[q] - first[q] for q in first)
    tokens = sum(r["length"] for r in pieces) / 600
    assert len(first) > 6 and spread <= 3 * 8192 / tokens < 600


def test_mixing_of_little(spark):
    assert mixing.mix_positions(docs(spark, ["a"]).limit(0)).count() == 0
    same = spark.createDataFrame([(None, None, None)] * 3 + [(1, "x", "s")] * 2, "doc_id long, text string, source string")
    assert sorted(r["_position"] for r in mixing.mix_positions(same).collect()) == list(range(5))
