"""What the tasks of the term index do, on Arrow batches with NumPy: counting terms, dealing postings out in blocks, and making lists of them.

A block is all postings of some rows that fall to one bucket and part, as one binary: its terms, its rows (id, namespace, sign, n_terms), and per posting
a row's place and tf.  So a posting takes a few bytes in a shuffle, and the shuffle moves a row per block.  ``merged`` turns the blocks of a bucket and part into lists: a row per term,
namespace and sign with ids, tfs and lengths.

A task that packs holds the postings of ``PORTION`` words (or of one longer text); one that merges holds those of one bucket and part, at some 40 bytes each and more while they are sorted.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCKS = "bucket int, part int, block binary"
LISTS = "bucket int, namespace string, term string, sign int, ids array<string>, tfs array<long>, lengths array<int>"
#: The bucket of a batch's figures: rows without a term, whose tfs are the change in rows, texts and terms of a namespace.
FIGURES = -1
PORTION, LISTED = 1_000_000, 100_000


def _listed(values: pa.Array, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


def _small(x: np.ndarray) -> pa.Array:
    """Of the narrowest type."""
    return pa.array(x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8))


def _packed(**columns: pa.Array) -> bytes:
    one = pa.record_batch([_listed(c, np.zeros(1, np.int64)) for c in columns.values()], list(columns))
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, one.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(one)
    return out.getvalue().to_pybytes()


def _coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes from 0, a null's too, and the values they stand for."""
    d = pc.dictionary_encode(values, null_encoding="encode")
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def _combined(*codes: np.ndarray) -> np.ndarray:
    """One code for each combination of codes."""
    key = codes[0].astype(np.int64)
    for c in codes[1:]:
        width = int(c.max(initial=0)) + 1
        if int(key.max(initial=0)) + 1 > 2**62 // width:
            key = np.unique(key, return_inverse=True)[1]
        key *= width
        key += c
    return key


def _hashed(values: pa.StringArray, n: int) -> np.ndarray:
    """CRC-32 of the bytes, as ``zlib`` has it, modulo ``n``; a null's is that of an empty text."""
    if n == 1:
        return np.zeros(len(values), np.int64)
    values = pc.fill_null(values, "")
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1].tolist()
    text = memoryview(data or b"")
    return np.array([zlib.crc32(text[a:b]) for a, b in pairwise(ends)], np.int64) % n


def _portions(batches: Iterable[pa.RecordBatch], lists: str) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``PORTION`` elements of the column ``lists``."""
    held, n = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(lists)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < len(sizes):
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + PORTION - n, "right")))
            held.append(batch.slice(at, to - at))
            n += int(ends[to - 1]) - before
            at = to
            if n >= PORTION or at < len(sizes):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _blocks(rows: dict[str, pa.Array], terms: pa.Array, bucket: np.ndarray, term: np.ndarray, row: np.ndarray, tf: np.ndarray, parts: int) -> pa.RecordBatch:
    """A block per bucket and part; ``term``, ``row`` and ``tf`` are those of the postings, in the order of ``term``."""
    to = bucket[term] * parts + _hashed(rows["ids"], parts)[row]
    order = np.argsort(to.astype(np.min_scalar_type(int(to.max(initial=0)))), kind="stable")
    to, term, row, tf = to[order], term[order], row[order], tf[order]
    starts = np.flatnonzero(np.diff(to, prepend=-1))
    blocks = []
    for start, end in zip(starts, np.append(starts[1:], len(to)), strict=True):
        t, r = term[start:end], row[start:end]
        new = np.flatnonzero(np.diff(t, prepend=-1))
        there = np.zeros(len(rows["ids"]), bool)
        there[r] = True
        own = pa.array(np.flatnonzero(there))
        blocks.append(_packed(
            terms=terms.take(pa.array(t[new])), sizes=_small(np.diff(np.append(new, len(t)))), rows=_small((np.cumsum(there) - 1)[r]), tfs=_small(tf[start:end]),
            **{name: values.take(own) for name, values in rows.items()},
        ))
    at = to[starts]
    return pa.record_batch([pa.array(at // parts, pa.int32()), pa.array(at % parts, pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "part", "block"])


def counted(buckets: int, parts: int) -> Callable:
    """Rows (namespace, id, sign, words) to blocks, and to one with their figures."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}
        for b in _portions(batches, "words"):
            words, sign = b.column("words"), b.column("sign").to_numpy()
            n = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            space, spaces = _coded(b.column("namespace"))
            change = np.zeros((len(spaces), 3), np.int64)
            np.add.at(change, space, np.stack([sign, sign * pc.is_valid(words).to_numpy(zero_copy_only=False), sign * n], 1))
            for name, more in zip(spaces.to_pylist(), change, strict=True):
                sums[name] = sums.get(name, 0) + more
            code, terms = _coded(words.flatten())
            if not len(code):
                continue
            key, tf = np.unique(code * np.int64(len(n)) + np.repeat(np.arange(len(n)), n), return_counts=True)
            rows = {"ids": b.column("id"), "namespaces": b.column("namespace"), "signs": b.column("sign"), "lengths": pa.array(n, pa.int32())}
            yield _blocks(rows, terms, _hashed(terms, buckets), key // len(n), key % len(n), tf, parts)
        if sums:
            figures = _packed(namespaces=pa.array(list(sums), pa.string()), sums=pa.array(np.concatenate(list(sums.values()))))
            yield pa.record_batch([pa.array([FIGURES], pa.int32()), pa.array([0], pa.int32()), pa.array([figures], pa.binary())], ["bucket", "part", "block"])

    return run


def unlisted(parts: int) -> Callable:
    """Lists of one index to blocks, dealt out in so many parts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _portions(batches, "ids"):
            n = pc.list_value_length(b.column("ids")).to_numpy(zero_copy_only=False).astype(np.int64)
            ids, length = b.column("ids").flatten(), b.column("lengths").flatten().to_numpy().astype(np.int64)
            if not len(ids):
                continue
            of_list = np.repeat(np.arange(len(n)), n)
            space, sign = _coded(b.column("namespace"))[0], b.column("sign").to_numpy()
            _, first, row = np.unique(_combined(_coded(ids)[0], space[of_list], (sign > 0)[of_list].astype(np.int64), length), return_index=True, return_inverse=True)
            at = pa.array(of_list[first])
            rows = {"ids": ids.take(pa.array(first)), "namespaces": b.column("namespace").take(at), "signs": b.column("sign").take(at), "lengths": pa.array(length[first], pa.int32())}
            code, terms = _coded(b.column("term"))
            bucket = np.empty(len(terms), np.int64)
            bucket[code] = b.column("bucket").to_numpy()
            term = code[of_list]
            order = np.argsort(term, kind="stable")
            yield _blocks(rows, terms, bucket, term[order], row[order], b.column("tfs").flatten().to_numpy()[order], parts)

    return run


def merged(net: bool) -> Callable:
    """Blocks in the order of bucket and part to lists; ``net``: postings of a row and term add up, and those that cancelled out are gone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            for bucket, part, block in zip(b.column("bucket").to_pylist(), b.column("part").to_pylist(), b.column("block"), strict=True):
                if held and (bucket, part) != at:
                    yield from _made(at[0], held, net)
                    held = []
                at = (bucket, part)
                held.append(block.as_py())
        if held:
            yield from _made(at[0], held, net)

    return run


def _made(bucket: int, blocks: list[bytes], net: bool) -> Iterator[pa.RecordBatch]:
    read = [pa.ipc.open_stream(x).read_next_batch() for x in blocks]
    strings = lambda name: pa.concat_arrays([x.column(name).flatten() for x in read])
    numbers = lambda name: np.concatenate([x.column(name).flatten().to_numpy() for x in read])
    if bucket == FIGURES:
        spaces, sums = strings("namespaces"), numbers("sums")
        tfs = pa.array(sums, pa.int64())
        yield _batch(bucket, spaces, pa.nulls(len(spaces), pa.string()), np.ones(len(spaces), np.int64), np.arange(0, len(sums), 3), pa.nulls(len(sums), pa.string()), tfs, pa.nulls(len(sums), pa.int32()))
        return
    ids, sign, sizes = strings("ids"), numbers("signs"), numbers("sizes")
    space, spaces = _coded(strings("namespaces"))
    code, terms = _coded(strings("terms"))
    in_order = pc.sort_indices(terms)
    rank = np.empty(len(terms), np.int32)
    rank[in_order.to_numpy()] = np.arange(len(terms), dtype=np.int32)
    terms = terms.take(in_order)
    counts = [len(x.column("rows").flatten()) for x in read]
    bases = np.cumsum([0, *(len(x.column("ids").flatten()) for x in read[:-1])], dtype=np.int32)
    term, row, tf = np.repeat(rank[code], sizes), numbers("rows").astype(np.int32) + np.repeat(bases, counts), numbers("tfs")
    length = numbers("lengths")[row]
    del read, code, sizes
    if net:
        _, who = np.unique(_combined(_coded(ids)[0], space), return_inverse=True)
        _, first, same = np.unique(_combined(term, who[row]), return_index=True, return_inverse=True)
        # Doubles hold such sums exactly.
        tf, length = (np.bincount(same, x * sign[row], len(first)).astype(np.int64) for x in (tf, length))
        live = tf > 0
        term, row, tf, length, sign = term[first][live], row[first][live], tf[live], length[live], np.ones_like(sign)
        del first, same
    key = _combined(term, space[row], (sign > 0)[row].astype(np.int64))
    order = np.argsort(key, kind="stable")
    key, term, row, tf, length = key[order], term[order], row[order], tf[order], length[order]
    del order
    for start in range(0, len(key), LISTED):
        end = start + LISTED
        new = np.flatnonzero(np.diff(key[start:end], prepend=-1))
        t, r = term[start:end], row[start:end]
        yield _batch(
            bucket, spaces.take(pa.array(space[r[new]])), terms.take(pa.array(t[new])), sign[r[new]], new,
            ids.take(pa.array(r)), pa.array(tf[start:end], pa.int64()), pa.array(length[start:end], pa.int32()),
        )


def _batch(bucket: int, spaces: pa.Array, terms: pa.Array, sign: np.ndarray, starts: np.ndarray, ids: pa.Array, tfs: pa.Array, lengths: pa.Array) -> pa.RecordBatch:
    lists = [_listed(x, starts) for x in (ids, tfs, lengths)]
    return pa.record_batch([pa.array(np.full(len(starts), bucket), pa.int32()), spaces, terms, pa.array(sign, pa.int32()), *lists], ["bucket", "namespace", "term", "sign", "ids", "tfs", "lengths"])
