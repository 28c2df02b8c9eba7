"""SentencePiece ids by a table of distinct marked words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from .tables import staged
from .textblocks import Block, blocks

MARK = "▁"
TABLE_WORDS = 200_000  # marked words beyond the shared table that a task remembers between blocks; past that it starts anew
SHARED_TABLE_BYTES = 48 << 20  # of the table that all tasks get; bounds what the driver gathers
SHARED_WORD_BYTES = 256
ROW_BYTES = 150  # what a row weighs besides its bytes


@lru_cache(maxsize=2)
def processor(model: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model)


def check_model(model: str) -> None:
    """Raise unless words can be segmented one by one: no piece has a mark after another character, the text is
    taken as it is, and a mark is put in front."""
    sp = processor(model)
    for i in range(sp.get_piece_size()):
        if MARK in sp.id_to_piece(i).lstrip(MARK):
            raise ValueError(f"piece {i} crosses a whitespace marker")
    if sp.encode("a  b", out_type=str)[:1] != sp.encode("a", out_type=str) or "".join(sp.encode("a  b ", out_type=str)) != f"{MARK}a{MARK}{MARK}b{MARK}":
        raise ValueError("the model changes whitespace")


class WordTable:
    """Ids (as int32 bytes) and decoded bytes of marked words. Words that the shared table lacks are segmented here and remembered."""

    def __init__(self, model: str, shared: dict[bytes, tuple[bytes, bytes]] | None = None):
        self.sp = processor(model)
        self.alone = self.sp.piece_to_id(MARK)
        self.before = self.sp.encode("a")
        self.shared = shared or {}
        self.known: dict[bytes, tuple[bytes, bytes]] = {}

    def look_up(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """words: each with its first space. Without it the library puts the mark there itself."""
        if len(self.known) > TABLE_WORDS:
            self.known.clear()
        fresh = [w for w in words if w not in self.shared and w not in self.known]
        ids = self.sp.encode([w[1:].decode() for w in fresh], num_threads=1)
        ids = [x if w != b" " else [self.alone] for w, x in zip(fresh, ids)]
        texts = self.sp.decode([self.before + x for x in ids], num_threads=1) if ids else []
        for w, x, text in zip(fresh, ids, texts):
            self.known[w] = np.array(x, np.int32).tobytes(), text[1:].encode()
        return [self.shared.get(w) or self.known[w] for w in words]


def _marked_words(block: Block) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Every text with a space before it, cut before each run of spaces: bytes, word limits, each text's first word."""
    raw = b"".join(b" " + block.data[i:j].tobytes() for i, j in zip(block.off, block.off[1:]) if j > i)
    raw_mark = MARK.encode()
    size = np.diff(block.off)
    off = np.concatenate(([0], np.cumsum(size + (size > 0))))
    if raw_mark in raw:
        parts = [raw[i:j].replace(raw_mark, b" ") for i, j in zip(off, off[1:])]
        raw, off = b"".join(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    space = np.frombuffer(raw, np.uint8) == 32
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[off[:-1][np.diff(off) > 0]] = True
    cut = np.append(np.flatnonzero(begins), len(raw))
    return raw, cut, np.searchsorted(cut, off)


def _distinct(block: Block) -> tuple[pa.DictionaryArray, np.ndarray]:
    """A block's marked words as codes of its distinct ones, and each text's first word."""
    raw, cut, first = _marked_words(block)
    words = pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(raw)])
    return words.dictionary_encode(), first


def _words_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, _ in blocks(batches):
        found = _distinct(block)[0].dictionary
        yield pa.RecordBatch.from_arrays([found.filter(pc.less_equal(pc.binary_length(found), SHARED_WORD_BYTES)).cast(pa.binary())], ["word"])


def _segmenter(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(model)
        for batch in batches:
            ids, texts = zip(*table.look_up(batch.column("word").to_pylist())) if len(batch) else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(ids, pa.binary()), pa.array(texts, pa.binary())], ["word", "n", "ids", "decoded"])

    return run


def word_table(texts: DataFrame, model: str) -> DataFrame:
    """word, n, ids, decoded: the marked words that n blocks of texts (of about 1 MB) hold, n > 1, each segmented once.

    Words of one block only are left to the task that has that block, and so are those of over SHARED_WORD_BYTES.
    """
    counted = texts.mapInArrow(_words_of_blocks, "word binary").groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    return staged(counted.mapInArrow(_segmenter(model), "word binary, n long, ids binary, decoded binary"), "words")


def most_shared(table: DataFrame) -> DataFrame:
    """The rows of at least 2, 4, 8, 16... blocks, whichever is the least that SHARED_TABLE_BYTES has room for."""
    power = F.floor(F.log2("n")).cast("int")
    weight = F.sum(ROW_BYTES + F.octet_length("word") + F.octet_length("ids") + F.octet_length("decoded"))
    weights = dict(map(tuple, table.groupBy(power).agg(weight).collect()))  # at most 63 rows
    least, room = max(weights, default=0) + 1, SHARED_TABLE_BYTES
    while least > 1 and (room := room - weights.get(least - 1, 0)) >= 0:
        least -= 1
    return table.where(power >= least)


def _encoder(model: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, all_ids, texts = shared.value
        table = WordTable(model, dict(zip(words, zip(all_ids, texts))))
        for block, batch in blocks(batches):
            words, first = _distinct(block)
            code = words.indices.to_numpy()
            known = table.look_up(words.dictionary.to_pylist())
            n_ids = np.array([len(k[0]) // 4 for k in known], np.int64)
            flat = np.frombuffer(b"".join([k[0] for k in known]), np.int32)
            begin = np.concatenate(([0], np.cumsum(n_ids)))
            per_word = n_ids[code]
            upto = np.concatenate(([0], np.cumsum(per_word)))
            ids = flat[np.repeat(begin[code] - upto[:-1], per_word) + np.arange(upto[-1])]
            parts = [k[1] for k in known]
            whole = [b"".join([parts[c] for c in code[i:j]]) for i, j in zip(first, first[1:])]
            decoded = [(w[1:] if w[:1] == b" " else w).decode() for w in whole]  # the mark put in front is taken off
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(upto[first].astype(np.int32)), pa.array(ids)), pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    return run


def piece_ids(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text as the sentencepiece library gives them (no begin or end, no sampling), and their decoding.

    Null counts as empty, which has no ids. Each row is worked on by itself; other columns are ignored. model
    is a path that every executor has. Pieces must not cross whitespace markers (checked). Then a text is a row of marked
    words. A first pass over docs, when this is called, counts the distinct ones and segments those that are shared
    (word_table); tasks get that table, whose size is checked before it is gathered, and join ids back by position. Words
    that it lacks are segmented by the task that meets them. docs is read twice.

    Returns id, ids, decoded.
    """
    check_model(model)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    table = word_table(rows.select("text").where("text is not null"), model)
    held = most_shared(table).toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(tuple(held.column(c).to_pylist() for c in ("word", "ids", "decoded")))
    return rows.mapInArrow(_encoder(model, shared), "id long, ids array<int>, decoded string")
