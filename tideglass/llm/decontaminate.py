"""Benchmark passages in documents, by an Aho-Corasick automaton over normalised words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import tables as t

WINDOW = 10
CODE, BASE, FIRST_LETTER = 3, 100, 0x100  # so an automaton can have BASE ** CODE words
UNKNOWN = "\x01" * CODE
MAX_WORDS = BASE**CODE  # in the windows of one automaton: some 200 MB; a larger benchmark is dealt into several


def _table() -> bytes:
    out = bytearray(b" " * 128 + bytes(range(128, 256)))
    out[48:58] = bytes(range(48, 58))
    out[97:123] = out[65:91] = bytes(range(97, 123))
    return bytes(out)


NORMAL = _table()


def words_of(text: bytes) -> list[bytes]:
    """Words: digits, letters and all beyond ASCII, with A-Z lower-cased."""
    return text.translate(NORMAL).split()


def windows_of(text: bytes, width: int) -> list[tuple[bytes, ...]]:
    """An item's windows; an item of fewer words, but not none, is one."""
    words = words_of(text)
    return [tuple(words[j : j + width]) for j in range(max(1, len(words) - width + 1))] if words else []


class Machine:
    """One automaton over words, each written as CODE letters of which every place has BASE of its own, and the items of each window."""

    def __init__(self, windows: list[tuple[bytes, list[str]]]):
        self.codes: dict[bytes, str] = {}
        self.found = ahocorasick.Automaton()
        for window, items in windows:
            words = window.split()
            for w in words:
                if w not in self.codes:
                    n = len(self.codes)
                    self.codes[w] = "".join(chr(FIRST_LETTER + i * BASE + n // BASE**i % BASE) for i in range(CODE))
            self.found.add_word("".join([self.codes[w] for w in words]), (len(words), items))
        self.empty = not windows
        if windows:
            self.found.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges [first, end) hit, joined where they touch, and the items found; one pass over the words."""
        if self.empty or not words:
            return [], set()
        get = self.codes.get
        out: list[tuple[int, int]] = []
        items: set[str] = set()
        hits = []
        for last, (size, of) in self.found.iter("".join([get(w, UNKNOWN) for w in words])):
            items.update(of)
            end = (last + 1) // CODE
            hits.append((end - size, end))
        for a, b in sorted(hits):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out, items


_built: dict[str, Machine] = {}


def machine_of(name: str, windows) -> Machine:
    """The automaton of a broadcast table of windows, built once in each worker; a worker keeps the last one."""
    if name not in _built:
        _built.clear()
        _built[name] = Machine(windows.value)
    return _built[name]


def original_offsets(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of the text for ranges of its words."""
    if not ranges:
        return []
    solid = np.frombuffer(text.translate(NORMAL), np.uint8) != 32
    edge = np.diff(np.concatenate(([False], solid, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(int(starts[a]), int(ends[b - 1])) for a, b in ranges]


def _scanner(name: str, windows, only_hits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(name, windows)
        for batch in batches:
            rows, n, starts, ends, froms, tos, found = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column("_scanned")):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                words = words_of(raw)
                ranges, items = machine.scan(words)
                if only_hits and not ranges:
                    continue
                places = original_offsets(raw, ranges)
                rows.append(i)
                n.append(len(words))
                starts.append([a for a, _ in ranges])
                ends.append([b for _, b in ranges])
                froms.append([a for a, _ in places])
                tos.append([b for _, b in places])
                found.append(sorted(items))
            if len(rows) < len(batch):
                batch = batch.take(pa.array(rows, pa.int64()))
            ints = pa.list_(pa.int64())
            own = [c for c in batch.schema.names if c != "_scanned"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(n, pa.int64()), *(pa.array(x, ints) for x in (starts, ends, froms, tos)), pa.array(found, pa.list_(pa.string()))], [*own, "n_words", "starts", "ends", "byte_starts", "byte_ends", "items"])

    return run


FOUND = "n_words long, starts array<long>, ends array<long>, byte_starts array<long>, byte_ends array<long>, items array<string>"


def _item_windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(b" ".join(w), i) for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()) for w in windows_of(text.encode(), width)]
            window, item = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(window, pa.binary()), pa.array(item, pa.string())], ["words", "item"])

    return run


def _united(starts: str, ends: str) -> tuple[Column, Column]:
    """Starts and ends of the union of ranges of several parts; ranges that touch become one."""
    ranges = F.array_sort(F.flatten(F.transform("parts", lambda p: F.arrays_zip(p[starts].alias("a"), p[ends].alias("b")))))
    kind = "array<struct<a:bigint,b:bigint>>"

    def add(done: Column, r: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], r["b"]).alias("b"))).cast(kind)
        touches = (F.size(done) > 0) & (r["a"] <= last["b"])
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), longer)).otherwise(F.concat(done, F.array(F.struct(r["a"].alias("a"), r["b"].alias("b"))).cast(kind)))

    united = F.aggregate(ranges, F.array().cast(kind), add)
    return F.transform(united, lambda r: r["a"]), F.transform(united, lambda r: r["b"])


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", carry: tuple[str, ...] = (), max_words: int = MAX_WORDS) -> DataFrame:
    """Where windows of benchmark items occur in documents.

    Words are runs of digits, letters (A-Z lower-cased) and everything beyond ASCII. A window is width
    consecutive words of an item; an item of fewer words, but not none, is one window. A null or empty text has
    no words, and rows may repeat; an empty benchmark hits nothing. A null item id is written as the empty string. Other
    columns are ignored.

    The distinct windows are made and counted by Spark. If their words come to max_words at most, one automaton holds
    all, and documents are read once and not shuffled. A larger benchmark is dealt by hashes of its windows into as many
    automata as it needs, each of which reads the documents; only hits are kept of all but the first, and are joined to it
    by id and hash of the text. So the driver and each worker hold one automaton's windows at a time, whatever the benchmark.

    Returns id_col, the columns to carry, n_words, starts and ends (word ranges hit, joined where they touch),
    byte_starts and byte_ends (the same in the text's UTF-8 bytes), items (ids, sorted).
    """
    if not 0 < max_words <= MAX_WORDS:
        raise ValueError(f"an automaton takes 1 to {MAX_WORDS} words")
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    windows = items.mapInArrow(_item_windows(width), "words binary, item string").groupBy("words").agg(F.collect_set("item").alias("items"))
    windows = t.staged(windows, "windows")
    total = windows.agg(F.coalesce(F.sum(F.size(F.split(F.decode("words", "ISO-8859-1"), " "))), F.lit(0))).first()[0]
    parts = max(1, -(-total // max_words))
    own = docs.select(id_col, *carry)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    scanned = F.col(text_col).cast("string").alias("_scanned")

    def hits_of(part: int, rows: DataFrame, kinds: str) -> DataFrame:
        mine = windows.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == part) if parts > 1 else windows
        held = mine.select("words", "items").toArrow()  # about max_words words
        shared = spark.sparkContext.broadcast(list(zip(held.column("words").to_pylist(), held.column("items").to_pylist())))
        return rows.mapInArrow(_scanner(uuid.uuid4().hex, shared, part > 0), f"{kinds}, {FOUND}")

    if parts == 1:
        return hits_of(0, docs.select(*own.columns, scanned), fields)
    key = F.struct(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col).cast("string")).alias("h")).alias("_key")
    kind = "`_key` struct<doc:bigint,h:bigint>"
    first = t.staged(hits_of(0, docs.select(*own.columns, key, scanned), f"{fields}, {kind}"), "part")
    found = [t.staged(hits_of(p, docs.select(key, scanned), kind).dropDuplicates(["_key"]), "part") for p in range(1, parts)]
    names = ("starts", "ends", "byte_starts", "byte_ends", "items")
    several = reduce(DataFrame.union, (f.select("_key", *names) for f in found)).groupBy("_key").agg(F.collect_list(F.struct(*names)).alias("_more"))
    same = first["_key"].eqNullSafe(several["_key"])
    both = first.join(several, same, "left").select(*(first[f"`{c}`"] for c in own.columns), first["n_words"], F.concat(F.array(F.struct(*(first[c].alias(c) for c in names))), F.coalesce("_more", F.array())).alias("parts"))
    (starts, ends), (froms, tos) = _united("starts", "ends"), _united("byte_starts", "byte_ends")
    return both.select(
        *(F.col(f"`{c}`") for c in own.columns), "n_words", starts.alias("starts"), ends.alias("ends"), froms.alias("byte_starts"), tos.alias("byte_ends"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("parts", lambda p: p["items"])))).alias("items"),
    )
