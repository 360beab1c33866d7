"""Operator 1, packing: hierarchical multi-length packing of token sequences.

Tiers are context sizes, each a power of two, the longest 4096.  A document's tokens (its ids
and an end id) are routed so:

* whole long windows are cut from documents longer than the longest tier;
* what is left goes to the shortest tier that holds it;
* tier by tier, longest first, items are packed best fit, largest first, and the gap that
  remains in a window is filled from the shorter tiers, longest filler first; the last filler
  is cut at the window's end, its rest returns to its own tier.

So every window is full.  What a task has left at its end, less than one longest window, is
cut into sequences of power-of-two lengths.  Windows of one tier make step groups of equal
tokens; within a run of groups, windows go by attention cost (sum of squared piece lengths),
heaviest first, to the lightest group that has room.

No row is shuffled: each task tokenises and packs the rows it reads and holds at most
``buffer_tokens`` tokens and one document at a time.  Sequence ids carry the task's number.

Null text counts as empty and is one end id.  Texts of any length are tokenised whole.  Rows may
repeat; each is packed.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, process_cache, text_or_empty

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)
#: Words whose ids a process remembers.
CACHED_WORDS = 600_000


class _Words:
    """Word to its ids as little-endian 32-bit numbers; the first ``CACHED_WORDS`` are remembered."""

    def __init__(self, tokenizer):
        self.tokenizer, self.known = tokenizer, {}
        self.ends = {i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")}

    def ids(self, words: list[str]) -> bytes:
        found = list(map(self.known.get, words))
        if None in found:
            new = list(dict.fromkeys(w for w, f in zip(words, found, strict=True) if f is None))
            made = dict(zip(new, self._encode(new), strict=True))
            found = [made[w] if f is None else f for w, f in zip(words, found, strict=True)]
            if len(self.known) < CACHED_WORDS:
                self.known.update(made)
        return b"".join(found)

    def _encode(self, words: list[str]) -> list[bytes]:
        """All words in one call; a word's last id is one that ends a word."""
        out, at, n = [], 0, 0
        data = _bytes(ids := self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids)
        for n, i in enumerate(ids, 1):
            if i in self.ends:
                out.append(data[4 * at : 4 * n])
                at = n
        if len(out) != len(words) or at != len(ids):
            return [_bytes(self.tokenizer.encode(w, add_special_tokens=False).ids) for w in words]
        return out


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _class(first: str) -> str:
    return "".join(re.escape(c) for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == first)


def word_encoder(path: str):
    """text -> ids as bytes, by the tokenizer file at ``path``.

    The file's own splitting makes words that are encoded each by itself, so ids of known words
    are remembered.  That holds for text whose characters lower and split alike here and in
    the tokenizer; any other text goes to the tokenizer whole.
    """
    cache = process_cache("packing")
    if path not in cache:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        letter, number = _class("L"), _class("N")
        other = re.compile(r"[^\t\n\r -įı-ſ]|<\|")
        split = re.compile(rf"[{letter}]+|'(?:s|t|re|ve|m|ll|d)|[{number}]|[^\s{letter}{number}]+").findall
        words = _Words(tokenizer)

        def encode(text: str) -> bytes:
            if other.search(text):
                return _bytes(tokenizer.encode(text, add_special_tokens=False).ids)
            return words.ids(split(text.lower()))

        cache[path] = encode
    return cache[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Packer:
    """Packs documents given one by one; ``rows`` are finished pieces."""

    def __init__(self, tiers: tuple[int, ...], base: int, step_tokens: int, buffer_tokens: int):
        self.tiers, self.next, self.base, self.step_tokens = sorted(tiers), 0, base, step_tokens
        self.buffer_tokens, self.held, self.groups = buffer_tokens, 0, 0
        self.items: list[list] = [[] for _ in self.tiers]  # per tier, sorted by length: (length, n, piece)
        self.n = 0
        self.windows: list[tuple[int, list]] = []
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        total, at, longest = len(ids) // 4, 0, self.tiers[-1]
        while total - at >= longest:
            self.windows.append((longest, [(doc_id, at, longest, zlib.crc32(ids[4 * at : 4 * (at + longest)]), total)]))
            at += longest
        if at < total:
            self._put((doc_id, at, total - at, ids[4 * at :], total))
        if self.held > self.buffer_tokens:
            self.pack()

    def _put(self, piece: tuple) -> None:
        """To the shortest tier that holds it.  A piece keeps its ids until it is placed."""
        self.n += 1
        bisect.insort(self.items[bisect.bisect_left(self.tiers, piece[2])], (piece[2], self.n, piece))
        self.held += piece[2]

    def _take(self, tier: int, room: int, cut: bool) -> tuple | None:
        """The longest piece of at most ``room`` tokens from ``tier`` or a shorter one; with
        ``cut``, else the shortest longer one, cut to ``room``."""
        for t in range(tier, -1, -1):
            k = bisect.bisect_left(self.items[t], (room + 1,)) - 1
            if k >= 0:
                _, _, piece = self.items[t].pop(k)
                self.held -= piece[2]
                return piece
        if not cut:
            return None
        for t in range(len(self.tiers)):
            if self.items[t]:
                _, _, (doc_id, at, n, ids, total) = self.items[t].pop(0)
                self.held -= n
                self._put((doc_id, at + room, n - room, ids[4 * room :], total))
                return doc_id, at, room, ids[: 4 * room], total
        return None

    def _close(self, size: int, pieces: list[tuple]) -> None:
        self.windows.append((size, [(d, at, n, zlib.crc32(ids), total) for d, at, n, ids, total in pieces]))

    def pack(self) -> None:
        """Fills windows while any tier holds one's worth of tokens, then deals step groups."""
        for t in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[t]
            while self.items[t] and self.held >= size:
                _, _, piece = self.items[t].pop()
                self.held -= piece[2]
                pieces, room = [piece], size - piece[2]
                while room:
                    pieces.append(self._take(t, room, cut=True))
                    room -= pieces[-1][2]
                self._close(size, pieces)
        self._groups()

    def finish(self) -> None:
        self.pack()
        size = 1 << 62
        while self.held:
            size = min(1 << (self.held.bit_length() - 1), self.tiers[-1])
            pieces, room = [], size
            while room:
                pieces.append(self._take(len(self.tiers) - 1, room, cut=True))
                room -= pieces[-1][2]
            self._close(size, pieces)
        self._groups()

    def _groups(self) -> None:
        by_size: dict[int, list] = {}
        for size, pieces in self.windows:
            by_size.setdefault(size, []).append((-sum(p[2] ** 2 for p in pieces), len(by_size.get(size, ())), pieces))
        self.windows = []
        for size in sorted(by_size, reverse=True):
            windows, room = sorted(by_size[size]), max(1, self.step_tokens // size)
            heap = [(0, g, 0) for g in range(-(-len(windows) // room))]
            full = 0
            for cost, _, pieces in windows:
                load, g, n = heapq.heappop(heap)
                self._emit(size, pieces, self.groups + g)
                if n + 1 < room:
                    heapq.heappush(heap, (load - cost, g, n + 1))
                else:
                    full += 1
            self.groups += full + len(heap)

    def _emit(self, size: int, pieces: list[tuple], group: int) -> None:
        offset = 0
        for d, at, n, crc, total in pieces:
            self.rows.append((d, at, n, crc, total, self.base + self.next, offset, size, self.base + group))
            offset += n
        self.next += 1


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = (256, 512, 1024, 2048, 4096),
    end_id: int = 2,
    tokenizer: str | None = None,
    step_tokens: int = 32_768,
    buffer_tokens: int = 4_000_000,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group."""
    if any(t & (t - 1) or t < 1 for t in tiers):
        raise ValueError("tiers are powers of two")
    path, end = tokenizer or tokenizer_path(), end_id.to_bytes(4, "little")
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = word_encoder(path)
        packer = Packer(tiers, TaskContext.get().partitionId() << 33, step_tokens, buffer_tokens)

        def done():
            rows, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=schema.field(n).type) for n, c in zip(names, zip(*rows, strict=True), strict=True)],
                schema=schema,
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(doc_id, encode(text) + end)
            if packer.rows:
                yield done()
        packer.finish()
        if packer.rows:
            yield done()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
