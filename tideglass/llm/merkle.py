"""A Merkle tree over the rows of a data set, with a proof for each row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import tables as t

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 8
STEP = "struct<left:string,right:string>"


def sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def record(fields: tuple[str | Column, ...]) -> Column:
    """What a leaf hashes: each field as its UTF-8 length, a colon and the value, or - where it is null."""
    texts = [(F.col(f"`{c}`") if isinstance(c, str) else c).cast("string") for c in fields]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in texts))


def lower_ascii(c: str | Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _joined(parts: list[Column]) -> Column:
    return F.concat(*(F.coalesce(p, F.lit("")) for p in parts))


def siblings(nodes: DataFrame) -> DataFrame:
    """nodes(g, pos, n, digest, ...) with run, and the digests of the other nodes of their run of FAN: left and right.

    Lags and leads of 1 to FAN - 1 rows, of which a node's slot in its run masks the lags and the run's length the leads.
    """
    nodes = nodes.withColumn("run", F.expr(f"pos div {FAN}"))
    among = Window.partitionBy("g", "run").orderBy("pos")
    slot, length = F.col("pos") % FAN, F.least(F.lit(FAN), F.col("n") - F.col("run") * FAN)
    left = [F.when(slot >= k, F.lag("digest", k).over(among)) for k in range(FAN - 1, 0, -1)]
    right = [F.when(slot + k < length, F.lead("digest", k).over(among)) for k in range(1, FAN)]
    return nodes.withColumn("left", _joined(left)).withColumn("right", _joined(right))


def parents(nodes: DataFrame) -> DataFrame:
    """The next level of siblings(): the first child of each run hashes itself and those to its right."""
    return nodes.where(F.col("pos") % FAN == 0).select("g", F.col("run").alias("pos"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), sha(F.concat("digest", "right")).alias("digest"))


def levels(nodes: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """The levels of the trees of all groups g over nodes(g, pos, n, digest), from the nodes up: groups' last nodes, and the others with their siblings. Parents are staged."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    out = [(nodes.where("n = 1"), siblings(nodes.where("n > 1")))]
    while most > 1:
        made = t.staged(siblings(parents(out[-1][1])), "level")
        out.append((made.where("n = 1").select("g", "pos", "n", "digest"), made.where("n > 1")))
        most = -(-most // FAN)
    return out


def roots(tree: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """g and digest: what remains of each group."""
    return reduce(DataFrame.unionByName, (last.select("g", "digest") for last, _ in tree))


def paths(tree: list[tuple[DataFrame, DataFrame]], top: DataFrame) -> DataFrame:
    """The lowest level's rows with path, the siblings level by level up to the group's root and on by top(g, subroot, root, path).

    Goes from the roots down, so that the rows, of which there are most, are joined once: with the level above them.
    """
    above = None
    for last, others in reversed(tree):
        own = last.join(top, "g")
        if above is not None:
            up = above.select("g", F.col("pos").alias("run"), "subroot", "root", F.col("path").alias("_up"))
            rest = others.join(up, ["g", "run"]).withColumn("path", F.concat(F.array(F.struct("left", "right")), "_up"))
            own = own.unionByName(rest.drop("_up", "run", "left", "right"))
        above = own
    return above


def folded(leaf: str, path: str = "path") -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, F.col(leaf), lambda at, step: sha(F.concat(step["left"], at, step["right"])))


def proof(path: str = "path") -> Column:
    return sha(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def manifest(rows: DataFrame, also: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang") -> DataFrame:
    """id, leaf, subroot (of the row's group), root (of all subroots), path (array of left and right: what siblings' digests, concatenated, lie beside it) and what `also` names.

    Leaves are SHA-256 of the fields' record. In each group (null first, then bytewise) leaves ascend by id; those with equal ids by
    leaf, null ids first. Runs of FAN nodes become their hash, level by level, until one is left; the groups' roots go on likewise. Rows that are alike are leaves of their own.
    Texts are read once: what is staged is ids and digests, and columns of `also` (expressions of the rows' own columns). No window holds more than FAN rows.
    An empty table has no rows and no root.
    """
    also = also or {}
    group = F.col(f"`{group_col}`").cast("string")
    leaves = rows.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.concat(F.lit("g"), group), F.lit("-")).alias("g"), sha(record(fields)).alias("digest"), *(c.alias(name) for name, c in also.items()))
    nodes = t.numbered(t.staged(leaves, "leaves"), "g", F.asc("id"), F.asc("digest"))
    tree = levels(t.staged(nodes, "nodes"))
    subroots = t.staged(roots(tree), "subroots")
    tops = t.numbered(subroots.select(F.lit("-").alias("g"), "digest", F.col("g").alias("of")), "g", F.asc("of"))
    tops = levels(t.staged(tops, "nodes"))
    root = roots(tops).select("g", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), F.array().cast(f"array<{STEP}>").alias("path"))
    top = t.staged(paths(tops, root).select(F.col("of").alias("g"), F.col("digest").alias("subroot"), "root", "path"), "tops")
    return paths(tree, top).select("id", F.col("digest").alias("leaf"), "subroot", "root", "path", *also)
