"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
import sentencepiece  # noqa: F401
from pyspark.sql import functions as F

from tideglass.llm import langid, licences, line_dedup as ld, minhash, pieces, queries as q, substring_dedup as sd, suffix_dedup as xd, syncmers

from . import brute

CLASH = ("doc", "tag", "h", "line", "bucket", "payload", "keep", "node", "anchor", "run", "spans", "hits", "range", "copy", "score", "salt", "_text", "id")
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ROWS = [(1, None), (2, ""), (3, "   \n\n "), (4, LONG), (5, LONG), (5, LONG), (None, "alone here " * 60), (6, "é" * 900), (7, "a" * 2500), (8, "one two"), (9, "ONE  two"), (10, "x\n" * 400), (-3, LONG[: len(LONG) // 2])]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def operators():
    return {
        "op1": lambda d: xd.suffix_array_dedup(d), "op2": lambda d: sd.substring_dedup(d), "op3": lambda d: ld.line_dedup(d), "op5": lambda d: minhash.near_duplicates(d),
        "op6": lambda d: licences.licence_scan(d.withColumn("path", F.lit(None).cast("string"))), "op7": lambda d: langid.predict(d, langid.fit(d.withColumn("lang", F.lit("en")))),
        "op9": lambda d: syncmers.edited_neighbours(d), "op10": lambda d: pieces.piece_ids(d, q.piece_model()),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op5", "op6", "op7", "op9", "op10"])
def test_odd_rows_and_empty_tables(odd, operators, name):
    assert operators[name](odd).count() == len(ROWS)
    assert operators[name](odd.where("false")).count() == 0
    assert operators[name](odd.where("text is null")).count() == 1


def test_odd_rows_have_the_defined_results(spark, odd):
    rows = [(d, t) for d, t in dict.fromkeys(ROWS) if d is not None]
    known = spark.createDataFrame(ROWS, "doc_id long, text string").where("doc_id is not null")
    got = {r.doc_id: (r.n_words, sum(r.ends) - sum(r.starts), brute.sha(bytes(r.kept))) for r in sd.substring_dedup(known).collect()}
    assert got == brute.substring_dedup([(d, t) for d, t in rows])
    got = {r.doc_id: (r.n_bytes, sum(r.ends) - sum(r.starts), len(r.starts), brute.sha(bytes(r.kept))) for r in xd.suffix_array_dedup(known.where("length(text) < 5000 or text is null")).collect()}
    assert got == brute.suffix_dedup([(d, t) for d, t in rows if len(t or "") < 5000])
    got = {r.doc_id: (r.n_lines, r.n_dropped, brute.sha(r.kept)) for r in ld.line_dedup(known).collect()}
    assert got == brute.line_dedup(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(known).collect()}
    assert got == brute.near_dups(rows)


def test_a_line_in_most_documents(spark):
    rows = [(i, f"a very common line that all share\nown line number {i} of its document") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_lines, r.n_dropped, brute.sha(r.kept)) for r in ld.line_dedup(df).collect()}
    assert got == brute.line_dedup(rows)


@pytest.mark.parametrize("parts", [1, 7])
def test_a_repeated_row_with_a_text_of_its_own(spark, parts):
    own, twice = " ".join(f"own{i}" for i in range(300)), " ".join(f"again{i % 100}" for i in range(300))
    rows = [(1, own), (2, twice), (3, " ".join(f"other{i}" for i in range(300))), (4, twice + " and more")]
    df = spark.createDataFrame([*rows, *rows[:3], *rows[:3]], "doc_id long, text string").repartition(parts)
    out = sd.substring_dedup(df).collect()
    assert len(out) == 10 and {r.doc_id: (r.n_words, sum(r.ends) - sum(r.starts), brute.sha(bytes(r.kept))) for r in out} == brute.substring_dedup(rows)
    out = xd.suffix_array_dedup(df).collect()
    assert len(out) == 10 and {r.doc_id: (r.n_bytes, sum(r.ends) - sum(r.starts), len(r.starts), brute.sha(bytes(r.kept))) for r in out} == brute.suffix_dedup(rows)
