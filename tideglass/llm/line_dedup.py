"""Removal of lines that many documents share, as bitmaps of the lines to keep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import tables as t
from .textblocks import SPACES, RollingHash, blocks, by_document, document_order, unpack

MIN_POINTS, MIN_DOCS = 20, 3
LINES = "h long, doc long, tag int, line long"


def _lower_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


LOWER = _lower_table()


def _keys(min_points: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hash of every line's key that is long enough."""
        for block, _ in blocks(batches):
            n = len(block.data)
            breaks = block.data == 10
            inner = np.flatnonzero(breaks)
            start = np.concatenate((block.off[:-1], inner + 1))
            start.sort(kind="stable")
            end = np.concatenate((block.off[1:], inner))
            end.sort(kind="stable")
            owner = np.repeat(np.arange(len(block)), np.diff(np.searchsorted(inner, block.off)) + 1)
            line = np.arange(len(start)) - (np.searchsorted(inner, block.off[:-1]) + np.arange(len(block)))[owner]
            solid = ~SPACES[block.data]
            places = np.flatnonzero(solid)
            lo, hi = np.searchsorted(places, start), np.searchsorted(places, end)
            some = lo < hi
            if not some.any():
                continue
            lo, hi, owner, line = lo[some], hi[some], owner[some], line[some]
            start, end = places[lo], places[hi - 1] + 1
            points = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))
            long = points[end] - points[start] >= min_points
            start, end, owner, line = start[long], end[long], owner[long], line[long]
            h = RollingHash(LOWER[block.data]).spans(start, end).view(np.int64) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(block.doc[owner]), pa.array(block.tag[owner].astype(np.int32)), pa.array(line)], ["h", "doc", "tag", "line"])

    return run


def _stream(min_docs: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by key, then largest document first. A key's first document keeps its lines; the next ones
        lose theirs once min_docs documents have been seen, until when their rows are held (few documents' worth)."""
        held = np.zeros((4, 0), np.int64)  # the last key so far: h, doc, tag, line
        docs_before = 0  # of that key, before the held rows
        for batch in batches:
            h, doc, tag, line = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h", "doc", "tag", "line"))
            keeper = batch.column("keeper")
            known = keeper.is_valid().to_numpy(zero_copy_only=False)
            gone = [np.stack((doc, tag, line))[:, known & (keeper.fill_null(0).to_numpy() != doc)]] if known.any() else []
            rows = np.stack((h, doc, tag, line))[:, ~known]
            rows = np.concatenate((held, rows), axis=1)
            if rows.shape[1]:
                h, doc = rows[0], rows[1]
                new_key = np.concatenate(([True], h[1:] != h[:-1]))
                new_doc = new_key | np.concatenate(([True], doc[1:] != doc[:-1]))
                key = np.cumsum(new_key) - 1
                at = np.cumsum(new_doc)
                nth = at - at[np.flatnonzero(new_key)][key]  # of its key, from 0
                nth[key == 0] += docs_before
                total = np.zeros(key[-1] + 1, np.int64)
                np.maximum.at(total, key, nth + 1)
                drop = (total[key] >= min_docs) & (nth > 0)
                last = key == key[-1]
                # of the last key go on: all rows while it is undecided, else those of its last document
                stay = last & (nth == nth[-1]) if total[-1] >= min_docs else last
                gone.append(rows[1:, drop & ~stay])
                docs_before, held = int(nth[stay][0]), rows[:, stay]
            if gone:
                yield _packed(np.concatenate(gone, axis=1), n_buckets)
        if held.shape[1]:
            doc = held[1]
            nth = docs_before + np.cumsum(np.concatenate(([False], doc[1:] != doc[:-1])))
            if nth[-1] + 1 >= min_docs:
                yield _packed(held[1:, nth > 0], n_buckets)

    return run


def _packed(gone: np.ndarray, n: int) -> pa.RecordBatch:
    out = by_document(*gone, n) if gone.shape[1] else []
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([p for _, p in out], pa.binary())], ["bucket", "payload"])


def _bitmaps(group: pa.Table) -> pa.Table:
    doc, tag, line = (np.concatenate(c) for c in zip(*(unpack(p, np.int64, np.int64, np.int64) for p in group.column("payload").to_pylist())))
    order = document_order(doc, tag, line)
    doc, tag, line = doc[order], tag[order], line[order]
    cut = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]), [True])))
    squeeze = zstandard.ZstdCompressor(level=1).compress
    maps = []
    for i, j in zip(cut, cut[1:]):
        keep = np.ones(int(line[j - 1]) + 1, np.uint8)
        keep[line[i:j]] = 0
        maps.append(squeeze(np.packbits(np.append(keep, np.ones(-len(keep) % 8, np.uint8))).tobytes()))
    return pa.table({"doc": doc[cut[:-1]], "tag": tag[cut[:-1]].astype(np.int32), "keep": pa.array(maps, pa.binary())})


def kept_lines(keep: bytes | None, n: int) -> np.ndarray:
    """Which of n lines a bitmap keeps; lines past its end, and all if there is none, stay."""
    out = np.ones(n, bool)
    if keep is not None:
        bits = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(keep), np.uint8))[:n].astype(bool)
        out[: len(bits)] = bits
    return out


def line_bitmaps(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which lines of each document go: doc, tag and keep, for documents that lose any.

    A line's key is the line without space and \\t to \\r at both ends, A-Z lower-cased. Keys of min_points code
    points or more found in min_docs documents or more keep their lines only in the largest document that
    holds them. Null and empty texts are one empty line. Rows alike in id and text count as one document.

    Hashes of keys are range-partitioned with a secondary sort by document (largest first) and line, and
    streamed. Keys with more rows than a quarter of a partition's share - at most four for each partition -
    are counted with map-side sums beforehand; their rows are salted and carry the outcome along.
    """
    rows = t.keyed(docs, id_col, text_col)
    n = t.buckets_for(rows)
    lines = t.staged(rows.mapInArrow(_keys(min_points), LINES), "lines")
    share = max(1000, lines.count() // (4 * n))
    hot = lines.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > share).select("h")
    hot = t.staged(hot, "hot")  # fewer rows than 4 n
    by_doc = lines.join(F.broadcast(hot), "h").groupBy("h", "doc").agg(F.lit(1).alias("one"))
    fate = by_doc.groupBy("h").agg(F.count("*").alias("held_by"), F.max("doc").alias("most"))
    fate = fate.select("h", F.when(F.col("held_by") >= min_docs, F.col("most")).alias("keeper"), F.lit(True).alias("is_hot"))
    rows = lines.join(F.broadcast(fate), "h", "left").where("is_hot is null or keeper is not null")
    salted = rows.withColumn("salt", F.when(F.col("is_hot"), F.xxhash64("doc", "line")).otherwise(F.lit(0)))
    sorted_rows = salted.repartitionByRange(n, "h", "salt").sortWithinPartitions("h", "salt", F.desc("doc"), "tag", "line")
    gone = sorted_rows.select("h", "doc", "tag", "line", "keeper").mapInArrow(_stream(min_docs, n), "bucket long, payload binary")
    return gone.groupBy("bucket").applyInArrow(_bitmaps, "doc long, tag int, keep binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, keep in zip(batch.column("_text"), batch.column("_keep").to_pylist()):
            lines = (text.as_py() or "").split("\n")
            stay = kept_lines(keep, len(lines))
            out.append((len(lines), int((~stay).sum()), "\n".join([x for x, k in zip(lines, stay) if k])))
        n, dropped, kept = zip(*out) if out else ((),) * 3
        names = [c for c in batch.schema.names if c not in ("_text", "_keep")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], [*names, "n_lines", "n_dropped", "kept"])


def line_dedup(docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """line_bitmaps applied to the texts: id_col and the columns to carry, n_lines (before), n_dropped, kept (the other lines, joined by \\n)."""
    own = [id_col, *carry]
    maps = line_bitmaps(docs, min_points, min_docs, id_col, text_col)
    text = F.col(text_col).cast("string")
    tag = F.pmod(F.xxhash64(text), F.lit(1 << 15)).cast("int")
    rows = docs.select(*own, text.alias("_text"), F.coalesce(F.col(id_col).cast("long"), F.lit(t.NO_ID)).alias("_doc"), tag.alias("_tag"))
    maps = maps.select(F.col("doc").alias("_doc"), F.col("tag").alias("_tag"), F.col("keep").alias("_keep"))
    joined = rows.join(maps, ["_doc", "_tag"], "left").select(*own, "_text", "_keep")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema.fields)
    return joined.mapInArrow(_apply, f"{fields}, n_lines long, n_dropped long, kept string")
