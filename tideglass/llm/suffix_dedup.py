"""Removal of byte strings that occur twice, by suffix arrays over the passages where that can happen."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import tables as t
from .suffix_array import repeated_starts
from .textblocks import RollingHash, blocks, mix, pack, text_buffer, union_of_ranges, unpack

WIDTH, ANCHOR = 400, 40
HOT_ANCHOR = 1024  # distinct passages around one anchor from which its windows are dealt by their common core as well
CORE_STEP = 60
CHUNK_BYTES = 1 << 20
RUNS = "doc long, tag int, first long, n int, gap int, anchor long, run long"


def _sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Least of every width neighbours."""
    n = len(key)
    whole = -(-n // width) * width
    padded = np.concatenate((key, np.full(whole - n, np.iinfo(key.dtype).max, key.dtype))).reshape(-1, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def _runs(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of neighbouring windows that share the anchor: the k bytes with the least hash inside the window."""
        for block, _ in blocks(batches):
            size = np.diff(block.off)
            if not (size >= width).any():
                continue
            rolling = RollingHash(block.data)
            anchors = rolling.windows(k)
            least = _sliding_least((anchors & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(anchors), dtype=np.uint64), width - k + 1)
            owner = np.repeat(np.arange(len(block)), np.maximum(0, size - width + 1))
            start = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(0, size - width + 1)) - np.maximum(0, size - width + 1), np.maximum(0, size - width + 1)) + block.off[owner]
            anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            head = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))))
            n = np.diff(np.append(head, len(start)))
            first, anchor, owner = start[head], anchor[head], owner[head]
            passage = rolling.spans(first, first + n + width - 1)
            cols = (block.doc[owner], block.tag[owner].astype(np.int32), first - block.off[owner], n.astype(np.int32), (anchor - first).astype(np.int32), anchors[anchor].view(np.int64), passage.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [c.split()[0] for c in RUNS.split(", ")])

    return run


def _passages(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the wanted runs, with the group that all equal windows share."""
        for batch in batches:
            off, data = text_buffer(batch.column("text"))
            wanted = batch.column("wanted")
            owner = np.repeat(np.arange(len(wanted)), np.diff(wanted.offsets.to_numpy()))
            flat = wanted.flatten()
            first, n, gap, anchor, run_, hot = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("first", "n", "gap", "anchor", "run", "hot"))
            out: list[tuple] = []
            held = 0
            for i in range(len(flat)):
                at = off[owner[i]] + first[i]
                if not hot[i]:
                    pieces = [(int(anchor[i]), 0, int(n[i]))]
                else:
                    pieces = []
                    lo = 0
                    while lo < n[i]:  # windows whose distance to the anchor lies in one step share these bytes
                        step = (gap[i] - lo) // CORE_STEP
                        hi = int(min(n[i], gap[i] - step * CORE_STEP + 1))
                        core = at + gap[i] - step * CORE_STEP
                        group = mix(RollingHash(data[core : core + width - CORE_STEP + 1]).spans(np.array([0]), np.array([width - CORE_STEP + 1])) ^ np.uint64(int(anchor[i]) & (2**64 - 1)) ^ np.uint64(int(step) + 1))
                        pieces.append((int(group.view(np.int64)[0]), int(lo), hi - int(lo)))
                        lo = hi
                for group, lo, count in pieces:
                    out.append((group, int(run_[i]), lo, count, data[at + lo : at + lo + count + width - 1].tobytes()))
                    held += count + width
                if held > CHUNK_BYTES:
                    yield _pieces(out)
                    out, held = [], 0
            if out:
                yield _pieces(out)

    return run


PIECES = "grp long, run long, lo int, n int, passage binary"


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in PIECES.split(", ")])


def _repeats(width: int):
    def search(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        text = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        off = np.concatenate(([0], np.cumsum([len(r[3]) for r in rows])))
        valid = np.zeros(len(text), bool)
        for (_, _, n, _), at in zip(rows, off):
            valid[at : at + n] = True
        found = np.sort(repeated_starts(text, valid, width))
        owner = np.searchsorted(off, found, "right") - 1
        cut = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True]))) if len(found) else np.zeros(1, int)
        run_, spans = [], []
        for i, j in zip(cut, cut[1:]):
            r = rows[owner[i]]
            start = found[i:j] - off[owner[i]] + r[1]
            run_.append(r[0])
            spans.append(pack(*union_of_ranges(start, start + 1)))
        return pa.RecordBatch.from_arrays([pa.array(run_, pa.int64()), pa.array(spans, pa.binary())], ["run", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by group; suffix arrays over some whole groups at a time."""
        rows: list[tuple] = []
        held, group = 0, None
        for batch in batches:
            for g, r, lo, n, passage in zip(*(c.to_pylist() for c in batch.columns)):
                if g != group and held >= CHUNK_BYTES:
                    yield search(rows)
                    rows, held = [], 0
                group = g
                rows.append((r, lo, n, passage))
                held += len(passage)
        if rows:
            yield search(rows)

    return run


def _apply(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = text_buffer(batch.column("text"))
            starts, ends, kept = [], [], []
            for i, hits in enumerate(batch.column("hits").to_pylist()):
                b = data[off[i] : off[i + 1]].tobytes()
                ranges = [np.zeros((2, 0), np.int64)]
                for h in hits or ():
                    lo, hi = unpack(h["spans"], np.int64, np.int64) if h["spans"] is not None else (np.array([0]), np.array([h["n"]]))
                    ranges.append(np.stack((lo, hi + width - 1)) + h["first"])
                start, end = union_of_ranges(*np.concatenate(ranges, axis=1))
                edges = [0, *np.column_stack((start, end)).ravel().tolist(), len(b)]
                starts.append(start)
                ends.append(end)
                kept.append(b"".join(b[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2)))
            ints = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(off)), pa.array(starts, ints), pa.array(ends, ints), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "starts", "ends", "kept"])

    return run


def suffix_array_dedup(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte inside a string of width bytes that also starts at another place.

    Texts are UTF-8 bytes; null counts as empty, and shorter texts than width keep everything. Matches never
    cross documents; overlaps count; strings are judged on the input. Rows alike in id and text count as one
    document. Other columns are ignored.

    Equal windows choose the same anchor (the least hash of anchor bytes inside), so windows are kept as runs
    that share one. Runs whose anchor is found once can't match. Equal runs match as a whole and go on as one
    row, whatever their number. The distinct passages around each anchor go through a two-stage suffix array
    per task, where adjacent common prefixes of width bytes show the repeats. Anchors with very many distinct
    passages are dealt further by the bytes that all windows at a like distance share.

    Returns doc_id, n_bytes, starts and ends (maximal removed byte ranges), kept (the bytes that stay).
    """
    rows = t.keyed(docs, id_col, text_col)
    runs = t.staged(rows.where(F.octet_length("text") >= width).mapInArrow(_runs(width, anchor), RUNS), "runs")
    often = t.staged(runs.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "often")  # a table of its own: Spark then splits a frequent anchor's side of the join
    runs = t.staged(runs.join(often, "anchor"), "runs")
    place = F.struct("doc", "tag", "first")  # rows alike in id and text have the same places
    distinct = runs.groupBy("anchor", "run").agg((F.min(place) != F.max(place)).alias("again"), F.min(F.struct("doc", "tag", "first", "n", "gap")).alias("at"))
    distinct = t.staged(distinct.select("anchor", "run", "again", "at.*"), "passages")
    mixed = distinct.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor", (F.col("kinds") > HOT_ANCHOR).alias("hot"))
    mixed = t.staged(mixed, "mixed")
    wanted = distinct.join(mixed, "anchor").groupBy("doc", "tag").agg(F.collect_list(F.struct("first", "n", "gap", "anchor", "run", "hot")).alias("wanted"))
    pieces = rows.join(wanted, ["doc", "tag"]).dropDuplicates(["doc", "tag"]).select("text", "wanted").mapInArrow(_passages(width), PIECES)
    found = pieces.repartition(t.buckets(docs.sparkSession), "grp").sortWithinPartitions("grp").mapInArrow(_repeats(width), "run long, spans binary")
    whole = distinct.where("again").select("run", F.lit(None).cast("binary").alias("spans"))
    found = whole.union(found.join(whole.select("run"), "run", "left_anti"))
    hits = runs.join(found, "run").groupBy("doc", "tag").agg(F.collect_list(F.struct("first", "n", "spans")).alias("hits"))
    joined = rows.join(hits, ["doc", "tag"], "left").select(t.id_back().alias("doc_id"), "text", "hits")
    return joined.mapInArrow(_apply(width), "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")
