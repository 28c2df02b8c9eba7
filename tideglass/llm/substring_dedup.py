"""Removal of repeated word passages by Rabin-Karp window hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import tables as t
from .textblocks import SPACES, RollingHash, blocks, by_document, document_order, pack, runs_inside, union_of_ranges, unpack

WINDOW = 20
PACKED = "bucket long, payload binary"  # bucket: a range of hashes, or -1 less a range of documents for windows known to go


def _windows(block, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document in the block and first word of every window."""
    start, end = runs_inside(~SPACES[block.data], block.off)
    words = RollingHash(block.data).spans(start, end)
    first = np.searchsorted(start, block.off)
    hashes = RollingHash(words).windows(width)
    owner = np.repeat(np.arange(len(block)), np.diff(first))
    at = np.arange(len(hashes))
    inside = owner[: len(hashes)] == owner[width - 1 :] if len(hashes) else np.zeros(0, bool)
    at = at[inside]
    return hashes[at], owner[at], at - first[owner[at]]


def _later(h: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which of the windows, sorted by hash, document and start, are not at their hash's first place; rows alike in id and text have the same places."""
    head = np.maximum.accumulate(np.where(np.concatenate(([True], h[1:] != h[:-1])), np.arange(len(h)), 0))
    return (doc != doc[head]) | (tag != tag[head]) | (start != start[head])


def _ship(n_buckets: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _ in blocks(batches):
            hashes, owner, start = _windows(block, width)
            if not len(hashes):
                continue
            rank = np.empty(len(block), np.int64)
            rank[np.lexsort((block.tag, block.doc))] = np.arange(len(block))
            order = np.lexsort((start, rank[owner], hashes)) if (np.diff(rank) < 0).any() else np.argsort(hashes, kind="stable")
            hashes, owner, start = hashes[order], owner[order], start[order]
            head = np.concatenate(([True], hashes[1:] != hashes[:-1]))
            out = list(_dealt(hashes[head], block, owner[head], start[head], n_buckets))
            goes = _later(hashes, block.doc[owner], block.tag[owner], start)
            if goes.any():  # repeats inside the block are known to go; of each hash only the first has to meet other blocks
                out += [(-1 - b, p) for b, p in by_document(block.doc[owner[goes]], block.tag[owner[goes]], start[goes], n_buckets)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.binary()))], ["bucket", "payload"])

    return run


def _dealt(hashes, block, owner, start, n: int):
    bucket = ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    cut = np.searchsorted(bucket, np.arange(n + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(cut)):
        s = slice(cut[b], cut[b + 1])
        used, local = np.unique(owner[s], return_inverse=True)
        yield int(b), _join(pack(hashes[s]), pack(local, start[s]), pack(block.doc[used], block.tag[used]))


def _join(*parts: bytes) -> bytes:
    return np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)


def _split(payload: bytes, n: int) -> list[bytes]:
    sizes = np.frombuffer(payload, "<u4", n)
    at = 4 * n + np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    return [payload[i:j] for i, j in zip(at, at[1:])]


def _count(n_buckets: int):
    def run(group: pa.Table) -> pa.Table:
        """All windows with hashes in one range: each but the first of its hash goes."""
        out, found = [], []
        for bucket, payload in zip(group.column("bucket").to_pylist(), group.column("payload").to_pylist()):
            if bucket < 0:
                out.append((-1 - bucket, payload))
            else:
                a, b, c = _split(payload, 3)
                (h,), (local, start), (doc, tag) = unpack(a, np.uint64), unpack(b, np.int64, np.int64), unpack(c, np.int64, np.int64)
                found.append((h, doc[local], tag[local], start))
        if found:
            h, doc, tag, start = (np.concatenate(c) for c in zip(*found))
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            many = np.zeros(len(h), bool)
            many[1:] |= same
            many[:-1] |= same
            pick = order[many]
            pick = pick[np.lexsort((start[pick], tag[pick], doc[pick], h[pick]))]
            later = pick[_later(h[pick], doc[pick], tag[pick], start[pick])] if len(pick) else pick
            out += by_document(doc[later], tag[later], start[later], n_buckets) if len(later) else []
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int64()), "payload": pa.array([p for _, p in out], pa.binary())})

    return run


def _merged(width: int):
    def run(group: pa.Table) -> pa.Table:
        doc, tag, start = (np.concatenate(c) for c in zip(*(unpack(p, np.int64, np.int64, np.int64) for p in group.column("payload").to_pylist())))
        order = document_order(doc, tag, start)
        doc, tag, start = doc[order], tag[order], start[order]
        cut = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]), [True])))
        spans = [pack(*union_of_ranges(start[i:j], start[i:j] + width)) for i, j in zip(cut, cut[1:])]
        return pa.table({"doc": doc[cut[:-1]], "tag": tag[cut[:-1]].astype(np.int32), "spans": pa.array(spans, pa.binary())})

    return run


KEPT = "doc_id long, n_words long, starts array<long>, ends array<long>, kept binary"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
            words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
            start, end = unpack(spans, np.int64, np.int64) if spans else (np.zeros(0, np.int64),) * 2
            edges = [0, *np.column_stack((start, end)).ravel().tolist(), len(words)]
            rows.append((len(words), start, end, b" ".join(w for i in range(0, len(edges), 2) for w in words[edges[i] : edges[i + 1]])))
        n, start, end, kept = zip(*rows) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(start, pa.list_(pa.int64())), pa.array(end, pa.list_(pa.int64())), pa.array(kept, pa.binary())], ["doc_id", "n_words", "starts", "ends", "kept"])


def substring_dedup(docs: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a window of width words whose words also start earlier.

    Earlier means a smaller id, or the same document and an earlier start; a null id comes first. Words are
    runs of bytes other than space and \\t to \\r. Windows are judged on the input. Every window's 64-bit
    Rabin-Karp hash goes to the range of hashes it falls in, with all equal ones of a task's block first
    reduced to one, so a passage held by a third of all rows costs a row a block - of some 150,000 windows that
    every block sends - in the buckets of its windows, each of which has a hash of its own. Buckets are as many as the bytes of
    text ask for (see tables.buckets_for). Windows are compared by hash alone. Null and empty texts have
    no words. Rows alike in id and text count as one document. Other columns are ignored.

    Returns doc_id, n_words, starts and ends (removed word ranges, maximal), kept (words joined by a space).
    """
    rows = t.keyed(docs, id_col, text_col)
    n = t.buckets_for(rows)
    shipped = rows.where(F.octet_length("text") >= 2 * width - 1).mapInArrow(_ship(n, width), PACKED)
    doomed = shipped.groupBy("bucket").applyInArrow(_count(n), PACKED)
    spans = doomed.groupBy("bucket").applyInArrow(_merged(width), "doc long, tag int, spans binary")
    joined = rows.join(spans, ["doc", "tag"], "left").select(t.id_back().alias("doc_id"), "text", "spans")
    return joined.mapInArrow(_apply, KEPT)
