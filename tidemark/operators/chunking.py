"""Cutting documents into chunks: paragraphs packed to a size, markdown sections, code packs.

Packing is sequential within a document, so it runs in Arrow batches, one document at a time;
nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1600
#: Characters that are gathered before they are sent on.
SENT = 1 << 20
MARKDOWN_CHUNK = 2800
CODE_MOST, CODE_LEAST, CODE_PER_FILE = 4000, 1500, 6


class _Filling:
    """Pieces gathered into a chunk; ``close`` ends it, blank chunks are dropped."""

    def __init__(self, join: str = "", strip: bool = True):
        self.join, self.strip, self.done, self.now, self.size = join, strip, [], [], 0

    def add(self, piece: str, size: int) -> None:
        self.now.append(piece)
        self.size += size

    def emit(self, chunk: str) -> None:
        self.done.append(chunk.strip() if self.strip else chunk)

    def close(self) -> None:
        if self.size:
            chunk = self.join.join(self.now)
            if self.strip or chunk.strip():
                self.emit(chunk)
        self.now, self.size = [], 0


def chunk_text(text: str | None, size: int = CHUNK) -> list[str]:
    """Whole if at most ``size`` characters, else paragraphs packed up to ``size``; a longer paragraph is cut.

    Whether a paragraph and the two line ends after it still fit is asked of UTF-8 bytes, how a long one is cut
    of characters.
    """
    text = (text or "").strip()
    if len(text) <= size:
        return [text] if text else []
    chunk = _Filling("\n\n")
    for paragraph in text.split("\n\n"):
        weight = len(paragraph.encode("utf-8", "surrogatepass")) + 2
        if chunk.size + weight > size or len(paragraph) > size:
            chunk.close()
        if len(paragraph) > size:
            for at in range(0, len(paragraph), size):
                chunk.emit(paragraph[at : at + size])
        else:
            chunk.add(paragraph, weight)
    chunk.close()
    return chunk.done


def markdown_chunks(text: str | None, size: int = MARKDOWN_CHUNK) -> list[str]:
    """Sections from heading to heading, packed up to ``size``; nothing is longer than twice that."""
    chunk = _Filling(strip=False)
    for section in re.split(r"(?m)^(?=#{1,3} )", text or ""):
        if chunk.size + len(section) > size:
            chunk.close()
        chunk.add(section, len(section))
    chunk.close()
    cut = [c[at : at + 2 * size] for c in chunk.done for at in range(0, len(c), 2 * size)]
    return [c for c in cut if c.strip()]


def pack_sections(pack: str | None) -> list[tuple[str, str]]:
    """(path, body) of a code pack, whose files begin at headings 'File: path'."""
    parts = re.split(r"(?m)^#{1,6}[ \t]+File:[ \t]+(\S.*?)[ \t]*$", pack or "")
    return [(path, body.strip()) for path, body in zip(parts[1::2], parts[2::2], strict=True) if body.strip()]


def breadth_first(sections: list[tuple[str, str]], block: int = 4) -> list[tuple[str, str]]:
    """Files in an order that any prefix covers many folders with: folders by size take turns, ``block`` of their
    largest files at a time."""
    folders: dict[str, list[tuple[str, str]]] = {}
    for path, body in sections:
        folders.setdefault(path.rpartition("/")[0] or "(root)", []).append((path, body))
    queues = [sorted(files, key=lambda f: -len(f[1])) for files in folders.values()]
    queues.sort(key=lambda files: -sum(len(body) for _, body in files))
    turns = -(-max(map(len, queues), default=0) // block)
    return [f for turn in range(turns) for files in queues for f in files[turn * block : (turn + 1) * block]]


def body_pieces(body: str, least: int = CODE_LEAST, most: int = CODE_MOST) -> list[str]:
    """A file cut at line ends into pieces of ``least`` to ``most`` characters; a longer line is cut itself."""
    if len(body) <= most:
        return [body]
    chunk = _Filling(strip=False)
    for line in body.splitlines(keepends=True):
        if chunk.size >= least and chunk.size + len(line) > most:
            chunk.close()
        whole = len(line) // most * most if len(line) > most else 0
        whole -= most if whole and whole == len(line) else 0
        for at in range(0, whole, most):
            chunk.emit(line[at : at + most])
        chunk.add(line[whole:], len(line) - whole)
    chunk.close()
    return chunk.done


def code_chunks(pack: str | None, repo: str = "repo", *, least: int = CODE_LEAST, most: int = CODE_MOST, per_file: int | None = CODE_PER_FILE) -> list[str]:
    """A code pack's chunks, breadth first: large files in pieces (the first ``per_file``, all without it), small neighbours of one folder together."""
    out: list[str] = []
    small: list[tuple[str, str]] = []

    def close() -> None:
        if small:
            out.append("\n\n".join(f"{repo} — {path}\n\n{body}" for path, body in small))
            small.clear()

    for path, body in breadth_first(pack_sections(pack)):
        folder = path.rpartition("/")[0]
        if len(body) >= least:
            close()
            pieces = body_pieces(body, least, most)[:per_file]
            for i, piece in enumerate(pieces, 1):
                part = f"  (part {i}/{len(pieces)})" if len(pieces) > 1 else ""
                out.append(f"{repo} — {path}{part}\n\n{piece}")
            continue
        held = sum(len(b) for _, b in small)
        if small and (small[0][0].rpartition("/")[0] != folder or held + len(body) > most):
            close()
            held = 0
        small.append((path, body))
        if held + len(body) >= least:
            close()
    close()
    return out


def chunked(docs: DataFrame, ref: str, text: str, cut: Callable[[str | None], list[str]] = chunk_text) -> DataFrame:
    """ref, chunk, n_chunks, content: one row per chunk; the ref has a suffix only if there are several.

    Chunks leave the task ``SENT`` characters at a time, and a text is a Python object only while it is cut.
    """

    kind = pa.schema([("ref", pa.string()), ("chunk", pa.int32()), ("n_chunks", pa.int32()), ("content", pa.string())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for r, t in zip(batch.column("ref"), batch.column("text"), strict=True):
                r, parts = r.as_py(), cut(t.as_py())
                for i, p in enumerate(parts):
                    rows.append((f"{r}#{i}" if len(parts) > 1 else r, i, len(parts), p))
                    held += len(p)
                    if held >= SENT:
                        yield table(rows)
                        rows, held = [], 0
            if rows:
                yield table(rows)

    rows = docs.select(F.col(ref).cast("string").alias("ref"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "ref string, chunk int, n_chunks int, content string")
