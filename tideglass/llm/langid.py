"""Language identification by bit-sliced Bloom filters of frequent n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import tables as t
from .textblocks import blocks, mix

GRAM = 4  # bytes of lower-cased text; longer ones are parts of words only
LEAST_SHARE = 2e-5  # of a language's n-grams; so a language has at most 1 / LEAST_SHARE n-grams in the filter
MAX_LANGUAGES = 64
BITS_PER_GRAM, HASHES = 12, 2
UNKNOWN = "und"


def _fold() -> np.ndarray:
    """ASCII letters in lower case, bytes of other alphabets as they are, all else a space."""
    out = np.full(256, 32, np.uint8)
    out[128:] = np.arange(128, 256)
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    return out


FOLD = _fold()


def _grams(block) -> tuple[np.ndarray, np.ndarray]:
    """n-grams as numbers, with their document, for all places but two blanks; a text has a blank before it and GRAM - 1 behind it, so that one letter is enough."""
    data = FOLD[block.data]
    # upper-case letters of the two-byte Latin, Greek and Cyrillic blocks that differ from the lower case by 32 in the second byte
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1 if len(data) > 1 else np.zeros(0, np.int64)
    data[upper] += 32
    sizes = np.diff(block.off)
    padded = np.full(len(data) + GRAM * len(block), 32, np.uint8)
    padded[np.arange(len(data)) + np.repeat(np.arange(len(block)) * GRAM + 1, sizes)] = data
    data = padded
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = np.zeros(n, np.uint64)
    for j in range(GRAM):
        g = (g << np.uint64(8)) | data[j : n + j]
    owner = np.repeat(np.arange(len(block)), sizes + GRAM)
    inside = owner[:n] == owner[GRAM - 1 :]
    blank = (data[:n] == 32) & (data[1 : n + 1] == 32)
    inside &= ~blank
    return g[inside], owner[:n][inside]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each n-gram for each language, summed over a good part of the task before they leave it."""
    held: dict[str, list] = {}
    size = 0

    def flush():
        for lang, parts in held.items():
            g, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            u, at = np.unique(g, return_inverse=True)
            n = np.bincount(at, weights=c).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    for block, batch in blocks(batches):
        g, owner = _grams(block)
        langs, code = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
        by = code[owner]
        for i, lang in enumerate(langs):
            u, c = np.unique(g[by == i], return_counts=True)
            held.setdefault(lang, []).append((u, c))
            size += len(u)
        if size > 1 << 20:
            yield from flush()
            held, size = {}, 0
    yield from flush()


@dataclass
class LanguageFilter:
    """One word of language bits for each slot; the languages of an n-gram are those all its slots have in common."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray  # of each language: how often a foreign n-gram seems to be in it
    coverage: np.ndarray  # of each language: the share of its own n-grams that the filter has

    @classmethod
    def build(cls, languages: list[str], code: np.ndarray, gram: np.ndarray, coverage: np.ndarray) -> LanguageFilter:
        size = 1 << max(10, int(BITS_PER_GRAM * max(1, len(np.unique(gram)))).bit_length())
        slots = np.zeros(size, np.uint64)
        bits = np.uint64(1) << code.astype(np.uint64)
        for at in cls._places(gram.astype(np.uint64), size):
            np.bitwise_or.at(slots, at, bits)
        fill = np.array([(slots >> np.uint64(i) & np.uint64(1)).mean() for i in range(len(languages))])
        return cls(languages, slots, fill**HASHES, coverage)

    @staticmethod
    def _places(gram: np.ndarray, size: int) -> Iterator[np.ndarray]:
        for i in range(HASHES):
            yield (mix(gram * np.uint64(2) + np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) & np.uint64(size - 1)).astype(np.int64)

    def languages_of(self, gram: np.ndarray) -> np.ndarray:
        out = np.full(len(gram), 0xFFFFFFFFFFFFFFFF, np.uint64)
        for at in self._places(gram, len(self.slots)):
            out &= self.slots[at]
        return out

    def scores(self, gram: np.ndarray, owner: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Best language of each document, and the share of its n-grams that belongs to it, false positives taken off."""
        mask = self.languages_of(gram)
        total = np.bincount(owner, minlength=n_docs)
        share = np.zeros((n_docs, len(self.languages)))
        for i in range(len(self.languages)):
            hits = np.bincount(owner, weights=(mask >> np.uint64(i) & np.uint64(1)).astype(np.float64), minlength=n_docs)
            true = (hits - total * self.false_rate[i]) / max(1e-9, 1 - self.false_rate[i])
            share[:, i] = np.clip(true / np.maximum(total, 1), 0, 1)
        best = share.argmax(axis=1) if len(self.languages) else np.zeros(n_docs, np.int64)
        return best, np.round(share.max(axis=1), 6) if len(self.languages) else np.zeros(n_docs)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least_share: float = LEAST_SHARE) -> LanguageFilter:
    """Learn from all rows with a text and a language.

    n-grams are counted for each language over all the rows given, and those that make up least_share of a
    language or more go into the filter - at most 1 / least_share for each language, so what reaches the driver
    is bounded however large the input. More than 64 languages are an error.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = t.staged(rows.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(totals)
    spark = docs.sparkSession
    sums = spark.createDataFrame([(k, float(v)) for k, v in totals.items()], "lang string, total double")
    often = counts.join(F.broadcast(sums), "lang").where(F.col("n") >= F.col("total") * least_share).select("lang", "gram", "n").toArrow()
    code = np.searchsorted(np.array(languages, dtype=object), np.array(often.column("lang").to_pylist(), dtype=object)) if len(often) else np.zeros(0, np.int64)
    n = often.column("n").to_numpy()
    covered = np.bincount(code, weights=n, minlength=len(languages)) / np.maximum(1, [totals[x] for x in languages]) if languages else np.zeros(0)
    return LanguageFilter.build(languages, code, often.column("gram").to_numpy(), covered)


def _predict(model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for block, batch in blocks(batches, text="_text"):
            g, owner = _grams(block)
            best, score = m.scores(g, owner, len(block))
            known = batch.column("_has_letter").to_numpy(zero_copy_only=False) & bool(m.languages)
            lang = [m.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
            names = [c for c in batch.schema.names if c not in ("_text", "_has_letter")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), batch.column("_text"), pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0))], [*names, text_col, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: LanguageFilter, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1) put on its right.

    Only the text is looked at, all of it. und, with score 0, if it is null, empty or without a letter, or if
    the model knows no language. Ties go to the language first by name. Columns of docs named lang_pred or score
    are replaced; those named _text or _has_letter are dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the model's parameters
    text = F.col(text_col).cast("string")
    kept = docs.drop("lang_pred", "score", *(x for x in ("_text", "_has_letter") if x != text_col))
    rows = kept.select("*", text.alias("_text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_has_letter"))
    if text_col in kept.columns:
        rows = rows.drop(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text", "_has_letter").schema.fields)
    return rows.mapInArrow(_predict(shared, text_col), f"{fields}, `{text_col}` string, lang_pred string, score double")
