"""Ranked lexical search: the best documents for each of many queries, by whole-number scores of the BM25 kind."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import tables as t
from .line_dedup import LOWER
from .textblocks import RollingHash, blocks, pack, runs_inside, table_of, unpack

LETTERS = table_of([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
TOP = 10
PART_TERMS = 2_000_000  # query terms (one for each query that has it) that a worker holds at once: about 80 MB
SEGMENT = 2_000_000  # postings of a segment, beyond which a new one is begun: about 60 MB
SEGMENT_KIND = "docs binary, postings binary"
UNIT = 1_000_000_000


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every term of a block of texts."""
    start, end = runs_inside(LETTERS[data], off)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return RollingHash(LOWER[data]).spans(start, end).view(np.int64), np.searchsorted(off, start, "right") - 1


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, rows in blocks(batches):
        h, doc = terms(block.data, block.off)
        yield pa.RecordBatch.from_arrays([rows.column("item").take(pa.array(doc)), pa.array(h)], ["item", "h"])


def _indexer(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments: the documents that have terms, with how many, and postings (term, place in docs, count) by term, for terms of the vocabulary."""
        known = vocabulary.value
        docs, postings, n_docs, n_postings = [], [], 0, 0

        def segment() -> pa.RecordBatch:
            doc, length = (np.concatenate(x) for x in zip(*docs))
            term, at, tf = (np.concatenate(x) for x in zip(*postings))
            order = np.lexsort((at, term))
            return pa.RecordBatch.from_arrays([pa.array([pack(doc, length)], pa.binary()), pa.array([pack(term[order], at[order], tf[order])], pa.binary())], ["docs", "postings"])

        for block, _ in blocks(batches):
            h, of = terms(block.data, block.off)
            if not len(h):
                continue
            length = np.bincount(of, minlength=len(block))
            some = np.flatnonzero(length)
            place = np.searchsorted(known, h)
            hit = known[np.minimum(place, len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
            pair, tf = np.unique(of[hit] * len(known) + place[hit], return_counts=True)
            at = np.searchsorted(some, pair // max(1, len(known)))
            docs.append((np.asarray(block.doc)[some].astype(np.int64), length[some]))
            postings.append((pair % max(1, len(known)), n_docs + at, tf))
            n_docs, n_postings = n_docs + len(some), n_postings + len(pair)
            if n_postings >= SEGMENT or n_docs >= SEGMENT:
                yield segment()
                docs, postings, n_docs, n_postings = [], [], 0, 0
        if docs:
            yield segment()

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment: term -1 with documents and their terms, then each term with its documents."""
    for batch in batches:
        for docs, postings in zip(batch.column("docs"), batch.column("postings")):
            _, length = unpack(docs.as_py(), np.int64, np.int64)
            term, _, _ = unpack(postings.as_py(), np.int64, np.int64, np.int64)
            seen, n = np.unique(term, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(n, len(length))), pa.array(np.append(np.zeros(len(n), np.int64), length.sum()))], ["term", "df", "total"])


def _kth(scores: np.ndarray, k: int) -> int:
    """The k-th largest score, 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def best_of(postings: list[tuple[np.ndarray, np.ndarray, int]], n_docs: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the documents that can be among the k best, term at a time.

    postings are (documents in order, scores, highest score) by term, rarest first. A document gets an accumulator as long as the terms
    still to come could lift a new one to the k-th partial score (or to `least`, that of k documents found before); from then on only documents with an accumulator are updated,
    by looking them up in the terms' documents. Ties count as reached.
    """
    rest = np.cumsum([p[2] for p in postings][::-1])[::-1]
    score, i = np.zeros(n_docs, np.int64), 0
    made = np.zeros(0, np.int64)
    while i < len(postings) and rest[i] >= max(least, _kth(score[made], k)):
        docs, s, _ = postings[i]
        made = np.concatenate((made, docs[score[docs] == 0])) if len(made) else docs
        score[docs] += s
        i += 1
    made = np.sort(made)
    for docs, s, _ in postings[i:]:
        if len(made) * 8 < len(docs):
            at = np.minimum(np.searchsorted(docs, made), len(docs) - 1)
            both = docs[at] == made
            score[made[both]] += s[at[both]]
        else:
            both = score[docs] > 0
            score[docs[both]] += s[both]
    return made, score[made]


def _searcher(shipped, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best documents of this task's segments for each query; the k-th score of the segments before is a bound in the next ones."""
        n_all, l_all, weight, names, off, query_terms = shipped.value
        best_doc: list[np.ndarray] = [np.zeros(0, np.int64)] * len(names)
        best_score = list(best_doc)
        for batch in batches:
            for docs, packed in zip(batch.column("docs"), batch.column("postings")):
                doc, length = unpack(docs.as_py(), np.int64, np.int64)
                term, at, tf = unpack(packed.as_py(), np.int64, np.int64, np.int64)
                m = 10 + (90 * length * n_all) // l_all
                score = weight[term] * ((UNIT * tf) // (1000 * tf + 8 * m[at]))
                term, at, score = (x[score > 0] for x in (term, at, score))
                cut = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
                here, ends = term[cut], np.append(cut[1:], len(term))
                top = np.maximum.reduceat(score, cut) if len(cut) else cut
                for q in range(len(names)):
                    own = query_terms[off[q] : off[q + 1]]  # rarest first
                    where = np.searchsorted(here, own)
                    where = where[(where < len(here)) & (here[np.minimum(where, len(here) - 1)] == own)] if len(here) else where[:0]
                    if not len(where):
                        continue
                    least = _kth(best_score[q], k)
                    found, s = best_of([(at[cut[j] : ends[j]], score[cut[j] : ends[j]], int(top[j])) for j in where], len(doc), k, least)
                    d, s = np.concatenate((best_doc[q], doc[found])), np.concatenate((best_score[q], s))
                    order = np.lexsort((d, -s))[:k]
                    best_doc[q], best_score[q] = d[order], s[order]
        query = np.repeat(names, [len(d) for d in best_doc])
        if len(query):
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate(best_doc)), pa.array(np.concatenate(best_score))], ["query", "doc", "score"])

    return run


def _part(docs: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """query, doc and score: candidates of every task for the queries of own(query, h), of bounded size."""
    spark = docs.sparkSession
    rows = own.toArrow()
    query, h = (rows.column(c).to_numpy() for c in ("query", "h"))
    vocabulary = np.unique(h)
    shipped = spark.sparkContext.broadcast(vocabulary)
    index = t.staged(docs.mapInArrow(_indexer(shipped), SEGMENT_KIND), "segments")
    counts = index.mapInArrow(_counts, "term long, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    counts = t.staged(counts, "counts")
    shipped.unpersist()
    whole = counts.where("term = -1").first()
    n_all, l_all = (whole["df"], whole["total"]) if whole else (0, 0)
    weights = counts.where("term >= 0").select("term", "df", F.floor(1000 * F.log(F.lit(2.0 * n_all + 2) / (2.0 * F.col("df") + 1))).cast("long").alias("w")).toArrow()
    term = weights.column("term").to_numpy()
    weight, df = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    weight[term], df[term] = weights.column("w").to_numpy(), weights.column("df").to_numpy()
    ids = np.searchsorted(vocabulary, h)
    query, ids = query[df[ids] > 0], ids[df[ids] > 0]
    order = np.lexsort((ids, df[ids], query))
    query, ids = query[order], ids[order]
    some, first = np.unique(query, return_index=True)
    shipped = spark.sparkContext.broadcast((n_all, l_all, weight, some, np.append(first, len(query)), ids))
    found = t.staged(index.mapInArrow(_searcher(shipped, k), "query long, doc long, score long"), "found")
    shipped.unpersist()
    return found


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score: the k documents with the highest scores above 0 for each query, ties by the lesser id.

    Terms are runs of ASCII letters, digits and all characters beyond ASCII, A-Z in lower case. A term found in df of N documents
    weighs w = floor(1000 ln((2N+2)/(2df+1))), and one with tf occurrences in a document of n terms adds w * ((10**9 tf) div (1000 tf + 8 m)), m = 10 + (90 n N) div L, where
    L is all documents' terms. N counts documents with at least one term.

    Documents become segments: inverted lists of the queries' terms for as many documents as make SEGMENT postings, staged. They are counted (df, N, L), then each task goes
    through its segments term at a time with limited accumulators (best_of), keeping k documents for each query, and Spark ranks what the tasks found. Neither
    documents nor postings are shuffled. Queries are dealt into parts of PART_TERMS terms, which is what the driver and a worker hold; each part reads the documents.

    Null or empty texts have no terms; such queries have no rows. Rows of documents are documents of their own, also if alike; a null id is the least one and comes back null.
    Query rows that share an id are one query (the terms of both); a null id is one too. Terms are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    items = queries.select(F.col(query_id).alias("item"), F.col(query_text).cast("string").alias("text"))
    kind = items.schema["item"].dataType.simpleString()
    own = t.staged(items.mapInArrow(_query_terms, f"item {kind}, h long").distinct(), "query_terms")
    items = t.staged(own.groupBy("item").agg(F.count("*").alias("terms")), "items")
    items = t.summed(items, ["terms"], F.asc("item")).withColumn("part", F.expr(f"terms_before div {PART_TERMS}"))
    items = t.staged(items.withColumn("query", F.monotonically_increasing_id()), "items")
    own = t.staged(own.withColumnRenamed("item", "_item").join(items, F.col("_item").eqNullSafe(F.col("item"))).select("part", "query", "h"), "query_terms")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(t.NO_ID)).alias("doc"), F.col(text_col).cast("string").alias("text"))
    found = None
    for part in range((items.agg(F.max("part")).first()[0] or 0) + 1):
        some = _part(rows, own.where(F.col("part") == part).select("query", "h"), k)
        found = some if found is None else found.union(some)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("doc"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(items.select("query", "item"), "query").select(F.col("item").alias(query_id), F.col("rank").cast("int").alias("rank"), t.id_back("doc").alias("doc_id"), "score")
