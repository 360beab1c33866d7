"""Operator 8, media columns: content-addressed payloads in tar shards.

A payload (here a text's UTF-8 bytes, zero bytes up to a positive multiple of 64) is stored
as a lossless 8-bit grayscale PNG, 64 samples wide, under its digest as the member's name.  Each
task appends to tar shards of its own in the shared folder; equal payloads of one task are stored
once.  Rows carry digest (32 bytes), shard, offset and length.  Over all shards one place per digest, the first
in (shard, offset) order, is the address that all rows with that digest get; so equal texts
have equal addresses, no text is shuffled, and a text with a third of all rows is stored at most once a task.

Metadata columns (width, height, bit depth) come from range reads of each image's header alone.
Features come from reading the stored bytes back.

The index is a written table: a shard whose task was lost or repeated has no row in it, and
``unused_shards`` lists such files.  Shards are written under a temporary name and renamed when
complete.  Any store that pyarrow can open by URI will do as the shared folder.

Null text counts as empty (64 zero bytes).  Rows may repeat.  Texts of any length are stored
whole.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh_dir, staged, text_or_empty

WIDTH = 64
HEADER = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _store(uri: str):
    """(file system, path) of a folder; a plain path is local."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def payload_of(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_of(payload: bytes, level: int = 6) -> bytes:
    """8-bit grayscale, one row of samples per 64 bytes, no filter."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth, colour type, from an image's first 33 bytes."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIBB", data[16:26])


def png_payload(data: bytes) -> bytes:
    at, packed = 8, []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged image")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(-1, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return lines[:, 1:].tobytes()


def features_of(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and how many values occur."""
    times = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
    p = times / times.sum()
    mean = float((p * np.arange(256)).sum())
    deviation = float(np.sqrt((p * (np.arange(256) - mean) ** 2).sum()))
    some = p[p > 0]
    return f"mean={mean:.4f};deviation={deviation:.4f};entropy={abs(float(-(some * np.log2(some)).sum())):.4f};values={len(some)}"


class _Shards:
    """Appends members to tar files in a folder and says where they lie."""

    def __init__(self, folder: str, part: int, most_bytes: int):
        self.store, self.path = _store(folder)
        self.folder, self.part, self.most, self.number, self.out = folder, part, most_bytes, 0, None
        self.mark = uuid.uuid4().hex[:12]

    def _open(self) -> None:
        self.store.create_dir(self.path, recursive=True)
        self.name = f"shard-{self.part:06d}-{self.number:05d}-{self.mark}.tar"
        self.number += 1
        self.out, self.at = self.store.open_output_stream(f"{self.path}/{self.name}.tmp"), 0

    def add(self, name: str, data: bytes) -> tuple[str, int, int]:
        if self.out is None:
            self._open()
        info = tarfile.TarInfo(name)
        info.size, info.mtime, info.mode = len(data), 0, 0o644
        head = info.tobuf(format=tarfile.USTAR_FORMAT)
        where = self.name, self.at + len(head), len(data)
        fill = bytes(-len(data) % tarfile.BLOCKSIZE)
        self.out.write(head + data + fill)
        self.at += len(head) + len(data) + len(fill)
        if self.at >= self.most:
            self.close()
        return where

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * tarfile.BLOCKSIZE))
            self.out.close()
            self.store.move(f"{self.path}/{self.name}.tmp", f"{self.path}/{self.name}")
            self.out = None


def stored(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 256 << 20) -> DataFrame:
    """Writes the shards; doc_id, n_bytes, digest, shard, offset, length of every row (its own task's copy)."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.binary()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shards = _Shards(folder, TaskContext.get().partitionId(), shard_bytes)
        placed: dict[bytes, tuple[str, int, int]] = {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                payload = payload_of(data)
                digest = hashlib.sha256(payload).digest()
                if digest not in placed:
                    placed[digest] = shards.add(f"{digest.hex()}.png", png_of(payload))
                rows.append((doc_id, len(data), digest, *placed[digest]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema],
                schema=schema,
            )
        shards.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return staged(
        rows.mapInArrow(run, "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"), "media-index"
    )


def addresses(index: DataFrame) -> DataFrame:
    """One place per digest: digest, shard, offset, length."""
    first = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    return first.select("digest", "at.*")


def _by_shard(places: DataFrame) -> DataFrame:
    """Reads are dealt by ranges of (shard, offset), so each task reads few shards, forwards."""
    return places.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")


class _Reader:
    def __init__(self, folder: str, most: int = 4):
        self.store, self.path = _store(folder)
        self.open, self.most = OrderedDict(), most

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard not in self.open:
            self.open[shard] = self.store.open_input_file(f"{self.path}/{shard}")
            if len(self.open) > self.most:
                self.open.popitem(last=False)[1].close()
        return self.open[shard].read_at(length, offset)


def with_headers(places: DataFrame, folder: str) -> DataFrame:
    """``places`` with width, height, bit_depth, by range reads of the headers alone."""
    names = places.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(folder)
        for batch in batches:
            shard, offset = (batch.column(names.index(c)).to_pylist() for c in ("shard", "offset"))
            heads = [png_header(reader.read(s, o, HEADER)) for s, o in zip(shard, offset, strict=True)]
            own = [pa.array([h[k] for h in heads], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*names, "width", "height", "bit_depth"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in places.schema)
    return _by_shard(places).mapInArrow(run, f"{kinds}, width int, height int, bit_depth int")


def with_features(places: DataFrame, folder: str) -> DataFrame:
    """``places`` with what the stored bytes hold: payload_bytes, payload_digest, tail_crc32, media_bytes, media_digest, feature."""
    names = places.schema.names
    own = [("payload_bytes", pa.int64()), ("payload_digest", pa.binary()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_digest", pa.binary()), ("feature", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(folder)
        for batch in batches:
            rows = []
            for s, o, n in zip(*(batch.column(names.index(c)).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                image = reader.read(s, o, n)
                payload = png_payload(image)
                rows.append(
                    (len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-WIDTH:]), len(image), hashlib.sha256(image).digest(), features_of(payload))
                )
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in own]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, kind) for c, (_, kind) in zip(columns, own, strict=True))],
                names=[*names, *(n for n, _ in own)],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in places.schema)
    return places.mapInArrow(
        run, f"{kinds}, payload_bytes long, payload_digest binary, tail_crc32 long, media_bytes long, media_digest binary, feature string"
    )


def unused_shards(index: DataFrame, folder: str) -> list[str]:
    """Files in the folder that no row of the index names: leftovers of lost or repeated tasks."""
    from pyarrow import fs

    store, path = _store(folder)
    used = {r["shard"] for r in index.select("shard").distinct().collect()}
    return sorted(x.base_name for x in store.get_file_info(fs.FileSelector(path)) if x.base_name not in used)


def media_columns(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with address, metadata and feature columns."""
    index = stored(docs, folder, id_col=id_col, text_col=text_col)
    seen = staged(with_features(with_headers(addresses(index), folder), folder), "media-features")
    return index.select("doc_id", "n_bytes", "digest").join(seen, "digest")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_columns(documents(spark, sf_dir), fresh_dir(spark, "media-shards"))
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", F.lower(F.hex("payload_digest")).alias("payload_sha256"), "tail_crc32", "media_bytes",
        F.lower(F.hex("media_digest")).alias("media_sha256"), "feature", "offset", "length", "width", "height", "bit_depth",
    )
