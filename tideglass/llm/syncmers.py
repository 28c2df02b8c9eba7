"""Document fingerprints from closed syncmers and their places, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import tables as t

K, S = 5, 2  # words in a k-mer and in its inner substrings
PLACE_BITS = 24  # of an anchor, below the bits of its hash
MAX_PLACE = (1 << PLACE_BITS) - 1
RANGES_EACH = 8  # ranges of ids for each shuffle partition


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _least(parts: list[Column]) -> Column:
    return F.least(*parts) if len(parts) > 1 else parts[0]


def hash_of(anchor: Column) -> Column:
    return F.shiftrightunsigned(anchor, PLACE_BITS)


def place_of(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit(MAX_PLACE))


def _anchor(h: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(h, PLACE_BITS), PLACE_BITS).bitwiseOR(F.least(place, F.lit(MAX_PLACE)).cast("long"))


def syncmers(text: Column, k: int = K, s: int = S) -> Column:
    """A text's closed syncmers, in order: k-mers of words whose least s-mer (by hash) is the first or the last.

    Whether a k-mer is one depends on its own words only, so an edit moves no anchor elsewhere. Each is a long: the
    upper 40 bits of its hash, then the number of the word at which it begins (from MAX_PLACE on, MAX_PLACE). Words are
    what lies between runs of space and \\t to \\r. A text of fewer than k words has one anchor, all its words; null and
    the empty text have none.
    """
    spread = k - s  # from the first inner s-mer to the last

    def of_words(w: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(0), F.size(w) - s), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(s))))
        whole = lambda i: _anchor(F.xxhash64(*(F.get(w, i + j) for j in range(k))), i)

        def pick(h: Column) -> Column:
            edge = lambda i: F.least(F.get(h, i), F.get(h, i + spread)) <= _least([F.get(h, i + j) for j in range(1, spread)])
            return F.transform(F.filter(F.sequence(F.lit(0), F.size(w) - k), edge), whole)

        return F.when(F.size(w) < k, F.array(_anchor(F.xxhash64(w), F.lit(0)))).otherwise(let(inner, pick))

    words = F.transform(F.split(text, "[ \\t-\\r]+"), lambda w: F.xxhash64(w))
    return F.when(F.length(text) > 0, let(words, of_words)).otherwise(F.array().cast("array<bigint>"))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """All distinct syncmers, each at its first place, sorted by hash."""
    first = lambda a: F.filter(a, lambda x, i: (i == 0) | (hash_of(x) != hash_of(F.get(a, i - 1))))
    return let(F.sort_array(syncmers(text, k, s)), first)


def as_text(found: Column) -> Column:
    """16 hexadecimal digits for each anchor, in text order: 10 of its hash and 6 of its place."""
    in_order = F.array_sort(F.transform(found, lambda a: F.struct(place_of(a).alias("place"), a.alias("a"))))
    return F.lower(F.array_join(F.transform(in_order, lambda x: F.lpad(F.hex(x["a"]), 16, "0")), ""))


def _pairs(a: Column, b: Column) -> Column:
    """(place in a, place in b) of the anchors that both have, by place in a."""
    sided = lambda x, n: F.transform(x, lambda v: F.struct(hash_of(v).alias("h"), F.lit(n).alias("side"), place_of(v).alias("p")))

    def neighbours(m: Column) -> Column:
        both = F.filter(F.sequence(F.lit(1), F.size(m) - 1), lambda i: F.get(m, i)["h"] == F.get(m, i - 1)["h"])
        return F.transform(both, lambda i: F.struct(F.get(m, i - 1)["p"].alias("a"), F.get(m, i)["p"].alias("b")))

    return F.array_sort(let(F.array_sort(F.concat(sided(a, 0), sided(b, 1))), neighbours))


def _runs(pairs: Column) -> Column:
    """Stretches of pairs that follow each other at one offset: where each begins and ends in b, and its number of pairs."""
    n = F.size(pairs)
    offset = lambda i: F.get(pairs, i)["a"] - F.get(pairs, i)["b"]
    heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (offset(i) != offset(i - 1)))

    def cut(h: Column) -> Column:
        def run(i: Column, j: Column) -> Column:
            end = F.coalesce(F.get(h, j + 1), n)
            return F.struct(F.get(pairs, i)["b"].alias("first"), F.get(pairs, end - 1)["b"].alias("last"), (end - i).alias("n"))

        return F.transform(h, run)

    return let(heads, cut)


def in_order(pairs: Column) -> Column:
    """The most pairs, in whole stretches of one offset, that stand in the same order in both texts."""
    kind = "array<struct<last:bigint,n:bigint>>"

    def add(chains: Column, run: Column) -> Column:
        before = F.array_max(F.transform(F.filter(chains, lambda c: c["last"] < run["first"]), lambda c: c["n"]))
        longer = F.struct(run["last"].cast("long").alias("last"), (F.coalesce(before, F.lit(0)) + run["n"]).cast("long").alias("n"))
        return F.concat(chains, F.array(longer)).cast(kind)

    def best(runs: Column) -> Column:
        chains = F.aggregate(runs, F.array().cast(kind), add, lambda c: F.array_max(F.transform(c, lambda x: x["n"])))
        return F.when(F.size(runs) == 1, F.get(runs, 0)["n"].cast("long")).otherwise(chains)

    return F.when(F.size(pairs) < 2, F.size(pairs).cast("long")).otherwise(let(_runs(pairs), best))


def likeness(a: Column, b: Column) -> Column:
    """Share of two texts' anchors that match in order: twice the matched ones over all; 1 for two texts without anchors.

    Anchors are matched by hash and then by place: pairs that follow each other at the same offset form stretches, and the
    heaviest chain of stretches that is in order in both texts counts. Parts that were moved elsewhere don't.
    """
    common = F.size(F.array_intersect(F.transform(a, hash_of), F.transform(b, hash_of)))
    matched = F.when(common > 0, let(_pairs(a, b), in_order)).otherwise(F.lit(0).cast("long"))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * matched / total)


def _range_of(doc: Column, bounds: Column) -> Column:
    """How many of the sorted bounds are at most doc, by bisection."""
    step = lambda at, width: F.when(F.coalesce(F.get(bounds, at + width - 1) <= doc, F.lit(False)), at + width).otherwise(at)
    widths = F.array(*(F.lit(1 << i) for i in range(20, -1, -1)))
    return F.aggregate(widths, F.lit(0), step)


def with_next(rows: DataFrame) -> DataFrame:
    """rows(doc, tag, text) with anchors, next_text and next_anchors of the row that follows in descending doc; after the last comes the first.

    Ids are dealt into ranges of about equally many rows, whatever their values: bounds are quantiles of all ids. Each range
    is ordered by itself; its first row is copied to the end of the range above it, and that of the highest to the end of the lowest.
    """
    n = RANGES_EACH * t.buckets(rows.sparkSession)
    fractions = F.array(*(F.lit(i / n) for i in range(1, n)))
    bounds = rows.agg(F.array_sort(F.array_distinct(F.coalesce(F.percentile_approx("doc", fractions, F.lit(10 * n + 10_000)), F.array().cast("array<bigint>")))).alias("bounds"))
    bounds = t.staged(bounds, "bounds")  # one row of fewer values than ranges
    dealt = rows.crossJoin(F.broadcast(bounds)).withColumn("range", _range_of(F.col("doc"), F.col("bounds"))).drop("bounds")
    heads = dealt.groupBy("range").agg(F.max(F.struct("doc", (-F.col("tag")).alias("minus"))).alias("head"))
    heads = t.staged(heads.select("range", F.col("head.doc").alias("doc"), (-F.col("head.minus")).alias("tag")), "heads")  # a row for each range
    by_range = Window.orderBy("range")
    lowest = heads.agg(F.min("range").alias("lowest"))
    above = heads.withColumn("above", F.lead("range").over(by_range)).crossJoin(F.broadcast(lowest)).select("doc", "tag", F.coalesce("above", "lowest").alias("range"))
    copies = rows.join(F.broadcast(above), ["doc", "tag"]).dropDuplicates(["doc", "tag"]).select("doc", "tag", "text", "range", F.lit(True).alias("copy"))
    both = dealt.select("doc", "tag", "text", "range", F.lit(False).alias("copy")).union(copies).repartition("range")
    order = Window.partitionBy("range").orderBy("copy", F.desc("doc"), "tag")
    both = both.withColumn("anchors", anchors(F.col("text")))
    return both.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in ("text", "anchors"))).where(~F.col("copy")).drop("range", "copy")


def fingerprints(docs: DataFrame, k: int = K, s: int = S, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and anchors (see anchors()) of every whole text.

    Null and empty texts have no anchors; equal texts have equal ones. Each row is worked on by itself, so rows may repeat,
    and an empty table gives none. Other columns are ignored.
    """
    return t.keyed(docs, id_col, text_col).select(t.id_back().alias("doc_id"), anchors(F.coalesce("text", F.lit("")), k, s).alias("anchors"))


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text beside an edited one: its last floor(n / 2) code points replaced by the first as many (or all) of the next document's.

    The next document is the one that follows in descending id; after the last comes the first (a table of one row has itself), and
    a null id stands below all others. Rows with equal ids follow each other, by a hash of the text. Null counts as empty.
    Returns doc_id, n_chars, edited, anchors, edited_anchors, next_anchors.
    """
    rows = t.keyed(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    both = with_next(rows)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    both = both.select(t.id_back().alias("doc_id"), n.cast("long").alias("n_chars"), edited.alias("edited"), "anchors", "next_anchors")
    return both.withColumn("edited_anchors", anchors(F.col("edited")))
