"""Spark helpers shared by the corpus operators: row keys, staged tables, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

NO_ID = -(1 << 63)
_own: list[tempfile.TemporaryDirectory] = []
_made: list[str] = []


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns doc, tag and text.

    doc is the id (null: the least long). tag is taken from the text, so that rows that share an id
    but not a text stay apart; rows alike in both count as one document.
    """
    text = F.col(text_col).cast("string")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.pmod(F.xxhash64(text), F.lit(1 << 15)).cast("int").alias("tag"), text.alias("text"))


def id_back(doc: str | Column = "doc") -> Column:
    c = F.col(doc) if isinstance(doc, str) else doc
    return F.when(c != NO_ID, c)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where it is unset, on a local master only, one of our own that goes with the driver."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not found:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.TemporaryDirectory(prefix="spark-tideglass-", ignore_cleanup_errors=True))
            atexit.register(_own[0].cleanup)
        found = "file://" + _own[0].name
    return found


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends there and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/tideglass/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep_away(spark: SparkSession) -> int:
    """Delete all that this driver has staged, once no result that reads it is needed any more; returns how many tables."""
    n = len(_made)
    for path in _made:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _made.clear()
    return n


def make_folder(spark: SparkSession, path: str) -> None:
    """A folder for files of tasks, which sweep_away deletes too."""
    _made.append(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)


def buckets(spark: SparkSession) -> int:
    """Ranges of hash values to deal work into; follows spark.sql.shuffle.partitions, which is set by the size of the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


BUCKET_BYTES = 64 << 20


def buckets_for(rows: DataFrame) -> int:
    """As many buckets as there are shuffle partitions, or more, so that each has BUCKET_BYTES of text at most whatever that setting is. rows is read once for it."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(buckets(rows.sparkSession), -(-size // BUCKET_BYTES))


def _ranged(rows: DataFrame, *order: Column) -> DataFrame:
    """A staged table of rows with _range and _at, whose order is the given one: sorted ranges that follow each other."""
    ranged = rows.repartitionByRange(buckets(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return staged(ranged.withColumn("_range", F.shiftright("_at", 33)), "ranged")


def numbered(rows: DataFrame, group: str, *order: Column, carry: DataFrame | None = None) -> DataFrame:
    """rows with pos (from 0, in the given order within each group) and n, the group's rows; group has no nulls.

    Rows are range-partitioned by group and order, so a group with very many rows takes many tasks. A row's place in its sorted range
    is stored with it; one row for each group and range then says where the group starts in the range and how many of it came before.
    carry, a row for each group, adds its columns by that row, so that no join is by the group alone. rows are read twice, so they should be staged or cheap.
    """
    ranged = _ranged(rows, F.col(group), *order)
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    starts = starts.select(group, "_range", (F.col("_first") - F.coalesce(F.sum("_rows").over(before), F.lit(0))).alias("_zero"), F.sum("_rows").over(Window.partitionBy(group)).alias("n"))
    starts = staged(starts if carry is None else starts.join(carry, group), "starts")
    return ranged.join(starts, [group, "_range"]).withColumn("pos", F.col("_at") - F.col("_zero")).drop("_at", "_zero", "_range")


def summed(rows: DataFrame, terms: list[str], *order: Column) -> DataFrame:
    """rows with <term>_before: the sum of each term over all rows that come before in the given order, worked out range by range."""
    ranged = _ranged(rows, *order)
    before, inside = (Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1) for by, at in (("_all", "_range"), ("_range", "_at")))
    carried = ranged.groupBy("_range").agg(*(F.sum(x).alias(f"_{x}") for x in terms)).withColumn("_all", F.lit(0))
    carried = carried.select("_range", *(F.coalesce(F.sum(f"_{x}").over(before), F.lit(0)).alias(f"_{x}") for x in terms))
    own = ranged.select("*", *(F.coalesce(F.sum(x).over(inside), F.lit(0)).alias(f"{x}_before") for x in terms))
    return own.join(carried, "_range").select(*rows.columns, *((F.col(f"{x}_before") + F.col(f"_{x}")).alias(f"{x}_before") for x in terms))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The least node that each node of edges(u, v) can reach: node, component.

    Alternating star contractions: every round hangs each node's larger neighbours, then its smaller ones, on
    the least node near it. Rounds grow with the logarithm of the longest path; each ends in a staged table. So are both sides of
    its joins, so that Spark can split the rows of a node with very many neighbours (they lie in one partition, and it sees their size).
    """
    def larger(e: DataFrame) -> DataFrame:
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()

    def smaller(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = staged(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        hung = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return hung.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    now = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    digest = None
    for _ in range(max_rounds):
        now = staged(smaller(staged(larger(now), "links")), "links")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == digest:
            break
        digest = seen
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return now.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component"))
