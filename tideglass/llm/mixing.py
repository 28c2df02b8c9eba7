"""Mixing sources to target weights by systematic sampling of whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import tables as t

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)  # of the sources in the order of their names, over and over
SHARE, MOST, SEED = 1.5, 2, 11
ONE = 1 << 24  # expected copies are counted in parts of this size, so that prefix sums are whole numbers


def words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: str | Column) -> Column:
    """A source's name after a letter that puts null behind all names."""
    return F.coalesce(F.concat(F.lit("a"), source), F.lit("b"))


def weighted(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """key, source_size and weight: sources in the order of their keys take the weights in turn."""
    in_order = t.numbered(sizes.withColumn("_all", F.lit(0)), "_all", F.col("key"))
    return in_order.select("key", "source_size", F.array(*(F.lit(float(w)) for w in weights))[(F.col("pos") % len(weights)).cast("int")].alias("weight"))


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """key, source_size, weight and target: how many words each source of (key, source_size, weight) should give.

    share times all words is dealt by weight; what a source can't take, because its target stops at most times its size, is dealt
    again to the others. With sources ordered by size for their weight those that stop come first: a source stops if its limit is no
    more than its part of what those before it leave. Both running sums go over ranges, so sources may be many. Weights are above 0.
    """
    total = sources.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    all_words, all_weights = (total[0] or 0.0), (total[1] or 0.0)
    limit = F.lit(float(most)) * F.col("source_size")
    rows = t.summed(sources.withColumn("limit", limit), ["limit", "weight"], F.col("limit") / F.col("weight"), F.col("key"))
    level = (F.lit(share * all_words) - F.col("limit_before")) / (F.lit(all_weights) - F.col("weight_before"))
    rows = t.staged(rows.withColumn("level", F.when(F.col("limit") > level * F.col("weight"), level)), "levels")  # null: the source stops
    level = rows.agg(F.max("level")).first()[0]  # that of the first which doesn't stop; levels fall from there on
    return rows.select("key", "source_size", "weight", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, size (words), source_size, target (words that the document's source should give), copies, and taken = copies * size.

    Systematic sampling: a document's expected copies are its source's target over its source's size. Within the source they are summed
    up in the order of size (largest first), id and text, a random offset below 1 is added (from the seed and the source's name), and a
    document is emitted once for each whole number that its stretch of the sum crosses. So a source's copies are within one of what is
    expected, no document is taken more than ceil(most) times, and because sizes fall, words taken are within the size of one largest document of the
    target. Sums are whole multiples of 2**-24, so reruns agree. To draw the mix itself, repeat each document `copies` times.

    Null texts and texts without a word have size 0: they take their turn, but no words. Null sources are one source, the last. A source without words
    has target 0 and gives nothing. Null ids come first among equal sizes; rows alike in id, size and text are interchangeable. Nothing but these three columns is read.
    """
    text = F.col(text_col).cast("string")
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(text).alias("size"), F.xxhash64(text).alias("_text"))
    sizes = t.staged(sizes.withColumn("key", source_key("source")), "sizes")
    sources = targets(weighted(t.staged(sizes.groupBy("key").agg(F.sum("size").alias("source_size")), "sources"), weights), share, most)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col("key")).cast("binary")), 1, 6), 16, 10).cast("long")  # below ONE
    rate = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.lit(ONE))).otherwise(F.lit(0)).cast("long")
    sources = t.staged(sources.select("key", "source_size", "target", offset.alias("_offset"), rate.alias("_rate")), "targets")
    rows = t.numbered(sizes, "key", F.desc("size"), F.asc("doc_id"), F.asc("_text"), carry=sources)
    rows = rows.withColumn("copies", F.expr(f"(_offset + _rate * (pos + 1)) div {ONE} - (_offset + _rate * pos) div {ONE}"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
