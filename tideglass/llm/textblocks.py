"""NumPy helpers used inside Spark tasks: text blocks, rolling hashes, packed columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


@dataclass
class Block:
    """Some documents' UTF-8 bytes laid end to end; document i is data[off[i]:off[i + 1]]."""

    doc: np.ndarray
    tag: np.ndarray
    off: np.ndarray
    data: np.ndarray

    def __len__(self) -> int:
        return len(self.doc)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column; nulls count as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def spans_of_rows(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about limit bytes in total, one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def blocks(batches: Iterable[pa.RecordBatch], limit: int = BLOCK_BYTES, text: str = "text") -> Iterator[tuple[Block, pa.RecordBatch]]:
    """Blocks of the columns doc, tag (zeros where they are missing) and text, each with the rows it was made of."""
    for batch in batches:
        off, data = text_buffer(batch.column(text))
        doc, tag = (batch.column(c).to_numpy(zero_copy_only=False) if c in batch.schema.names else np.zeros(len(batch), np.int64) for c in ("doc", "tag"))
        for i, j in spans_of_rows(off, limit):
            yield Block(doc[i:j], tag[i:j], off[i : j + 1] - off[i], data[off[i] : off[j]]), batch.slice(i, j - i)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads what polynomial hashes leave in the low bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash base, or of its inverse modulo 2**64."""
    name = "inverse" if inverse else "base"
    if name not in _powers or len(_powers[name]) < n:
        size = 1 << max(21, int(n).bit_length())
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        out = np.full(size, base, np.uint64)
        out[0] = 1
        _powers[name] = np.multiply.accumulate(out)
    return _powers[name][:n]


class RollingHash:
    """Rabin-Karp prefix sums over symbols; hash of any span in O(1)."""

    def __init__(self, symbols: np.ndarray):
        codes = _BYTE_CODES[symbols] if symbols.dtype == np.uint8 else symbols
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * powers(len(codes)), out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * powers(len(self.sums), True)[start] + (end - start).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        n = max(0, len(self.sums) - width)
        return mix((self.sums[width:] - self.sums[:n]) * powers(n, True) + np.uint64(width)) if n else np.zeros(0, np.uint64)


def table_of(chars: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SPACES = table_of([0x20, *range(0x09, 0x0E)])


def runs_inside(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of member bytes that stay inside one document: starts, ends."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = member[:-1]
    inner = off[(off > 0) & (off < n)]
    before[inner] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = member[1:]
    after[inner - 1] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def union_of_ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges covered by [start, end); ranges that touch become one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    fresh = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    return start[fresh], reach[np.append(fresh[1:] - 1, len(reach) - 1)]


def pack(*columns: np.ndarray) -> bytes:
    """Equally long integer columns as byte planes of their differences, under Zstandard."""
    out = [np.array([len(columns[0])], "<u8").tobytes()]
    for c in columns:
        d = np.diff(c.astype(np.uint64), prepend=np.uint64(0))
        if c.dtype != np.uint64:
            d = (d << np.uint64(1)) ^ (np.uint64(0) - (d >> np.uint64(63)))  # small for falls as for rises
        out.append(d.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(payload: bytes, *kinds: type) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)
    n = int(raw[:8].view("<u8")[0])
    out = []
    for i, kind in enumerate(kinds):
        d = np.ascontiguousarray(raw[8 + i * 8 * n : 8 + (i + 1) * 8 * n].reshape(8, n).T).view("<u8").ravel()
        if kind is not np.uint64:
            d = (d >> np.uint64(1)) ^ (np.uint64(0) - (d & np.uint64(1)))
        out.append(np.cumsum(d, dtype=np.uint64).astype(kind))
    return out


def binary_column(buffer: bytes, off: np.ndarray) -> pa.Array:
    """Pieces of a buffer as a binary column."""
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(np.asarray(off, np.int64)), pa.py_buffer(buffer)]).cast(pa.binary())


def document_order(doc: np.ndarray, tag: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.lexsort((place, tag, doc))


def by_document(doc: np.ndarray, tag: np.ndarray, place: np.ndarray, n: int) -> list[tuple[int, bytes]]:
    """Packed (doc, tag, place) rows, dealt into n buckets of documents."""
    order = document_order(doc, tag, place)
    doc, tag, place = doc[order], tag[order], place[order]
    dealt = (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
    by = np.argsort(dealt, kind="stable")
    cut = np.searchsorted(dealt[by], np.arange(n + 1, dtype=np.uint64))
    return [(int(b), pack(doc[s], tag[s], place[s])) for b in np.flatnonzero(np.diff(cut)) for s in [by[cut[b] : cut[b + 1]]]]
