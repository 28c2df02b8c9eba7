"""Sequences from tables and files, and the bundle: data by mode, manifest, checks, profile, digest."""

from __future__ import annotations

import csv
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window, functions as F, types as T

from ..functions.staging import staged

META_COLUMNS = ("Time", "Anomaly")
LINEITEM_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
FEATURES = ("quantity", "extendedprice", "discount", "tax")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def in_order(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """df with t: the place of each row inside its sequence, by an order that has to be complete."""
    return df.withColumn("t", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)


def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_key, sequence_id, t, score, label, kind: each user's events in time; errors are the anomalies."""
    e = read(spark, sf_dir, "events").select(F.lit("events").alias("run_key"), F.col("user_id").alias("sequence_id"), "ts", "event_id", F.col("value").alias("score"), (F.col("event_type") == "error").cast("long").alias("label"), F.col("event_type").alias("kind"))
    return in_order(e, ["run_key", "sequence_id"], "ts", "event_id").select("run_key", "sequence_id", "t", "score", "label", "kind", "ts")


def lineitem_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_key, sequence_id, t, four features, label: each supplier's line items by date; returns are the anomalies."""
    li = in_order(read(spark, sf_dir, "lineitem"), ["l_suppkey"], *LINEITEM_ORDER)
    return li.select(F.lit("lineitem").alias("run_key"), F.col("l_suppkey").alias("sequence_id"), "t", *(F.col(f"l_{f}").alias(f) for f in FEATURES), (F.col("l_returnflag") == "R").cast("long").alias("label"))


@dataclass(frozen=True)
class Layouts:
    """The distinct headers of some CSV files: header lines, the names in each, and a table (file, layout) of which file has which."""

    lines: list[str]
    names: list[list[str]]
    files: DataFrame


def _csv(spark: SparkSession, glob: str) -> DataFrameReader:
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)


def csv_layouts(spark: SparkSession, path: str | list[str], glob: str = "*.csv") -> Layouts:
    """Every file's first line, which its first block has; only distinct ones reach the driver."""
    lines = _csv(spark, glob).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")).where(F.col("_metadata.file_block_start") == 0)
    first = staged(lines.groupBy("file").agg(F.min_by("value", "at").alias("line")))
    found = sorted(r.line for r in first.select("line").distinct().collect())  # as many as layouts
    names = [next(csv.reader([line.removeprefix("\ufeff").rstrip("\r")]), []) for line in found]
    layout = F.create_map(*(x for i, line in enumerate(found) for x in (F.lit(line), F.lit(i))))[F.col("line")] if found else F.lit(0)
    return Layouts(found, names, first.select("file", layout.alias("layout")))


def read_csv_sequences(spark: SparkSession, path: str | list[str], features: list[str], label: str | list[str] = "Anomaly", glob: str = "*.csv", order: str = "Time", agree: bool = False) -> DataFrame:
    """Sequences from CSV files: sequence_id (the file's path), t, the features and label(s).

    Each file is read by its own header: columns are found by name, in any order, and one that a file doesn't have is null there. With agree, files of several layouts are
    an error; a feature that no file has always is. Values that aren't numbers are null. t is the row's place by `order`, then by its place in the file;
    files without that column keep their order. One label column comes back as label, several under their own names; a missing or faulty label is 0. Nothing is inferred,
    and one scan reads the files of all layouts, after one that looks for their headers.
    """
    found = csv_layouts(spark, path, glob)
    if agree and len(found.lines) > 1:
        raise ValueError(f"the files have {len(found.lines)} layouts: {'; '.join(found.lines[:5])}")
    known = {c for names in found.names for c in names}
    if found.lines and (missing := [c for c in features if c not in known]):
        raise ValueError(f"no file has the columns {missing}")
    width = max((len(n) for n in found.names), default=1)
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])
    meta = (F.col("_metadata.file_path").alias("sequence_id"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    labels = [label] if isinstance(label, str) else list(label)
    raw = _csv(spark, glob).schema(schema).option("header", len(found.lines) == 1).csv(path).select("*", *meta)
    if len(found.lines) > 1:
        raw = raw.join(found.files, F.col("sequence_id") == F.col("file"))
        heads = [F.array(*(F.col(f"_c{i}") for i in range(len(n)))) == F.array(*map(F.lit, n)) for n in found.names]  # header lines are rows of this scan
        raw = raw.where(~F.coalesce(F.get(F.array(*heads), F.col("layout")), F.lit(False)))
    else:
        raw = raw.withColumn("layout", F.lit(0))

    def column(name: str) -> Column:
        at = [F.col(f"_c{n.index(name)}") if name in n else F.lit(None).cast("string") for n in found.names]
        return F.get(F.array(*at), F.col("layout")) if at else F.lit(None).cast("string")

    number = {c: column(c).try_cast("double") for c in dict.fromkeys((order, *features, *labels))}
    rows = raw.select("sequence_id", "_block", "_line", number[order].alias("_order"), *(number[c].alias(c) for c in features), *(F.coalesce(number[c].cast("long"), F.lit(0)).alias("label" if isinstance(label, str) else c) for c in labels))
    return in_order(rows, ["sequence_id"], "_order", "_block", "_line").drop("_order", "_block", "_line")


def header_variants(spark: SparkSession, path: str) -> DataFrame:
    """header, files, rows: the distinct first lines of the files; more than one row means that they disagree."""
    lines = spark.read.text(path, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    files = lines.groupBy("file").agg(F.min_by("value", "at").alias("header"), (F.count("*") - 1).alias("rows"))
    return files.groupBy("header").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"))


def one_header(spark: SparkSession, path: str, glob: str = "*.csv") -> list[str]:
    """The column names that all files share; an error if they disagree or there are none."""
    found = csv_layouts(spark, path, glob)
    if len(found.lines) != 1 or not found.names[0]:
        raise ValueError(f"the files have {len(found.lines)} layouts: {'; '.join(found.lines[:5])}")
    return found.names[0]


def feature_names(df: DataFrame, meta: tuple[str, ...] = META_COLUMNS) -> list[str]:
    return [c for c in df.columns if c not in meta and not c.startswith("Label (")]


def train_files(files: DataFrame) -> DataFrame:
    """The files(path, ...) of training data: those named train_normal*, or where there are none those named train*."""
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.when(name.startswith("train_normal"), 0).when(name.startswith("train"), 1)
    ranked = files.withColumn("_rank", rank).where("_rank is not null")
    best = ranked.agg(F.min("_rank").alias("_best"))  # one row
    return ranked.crossJoin(F.broadcast(best)).where("_rank = _best").drop("_rank", "_best")


EXTENSION = "*_styled_features.csv"  # fixed value: names of extension files
JUNK = r"(^|/)(__MACOSX|\.[^/]*|Thumbs\.db)(/|$)"  # what operating systems leave in folders


def extension_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modification time of the extension files anywhere below path."""
    found = provenance(spark, path, EXTENSION)
    return found.where(~F.regexp_replace("path", "^[a-z]+:/+", "").rlike(JUNK))


def extension_rows(spark: SparkSession, path: str, features: list[str], own: list[str] | None = None) -> DataFrame:
    """Sequences from the extension files below path: of the features those that the files have (or of `own`), label 0, mode train_ext. Files of several layouts are an error unless own is given."""
    files = [r.path for r in extension_files(spark, path).select("path").collect()]  # paths of files
    if not files:
        raise ValueError(f"no extension files below {path}")
    both = shared_features(one_header(spark, files, EXTENSION) if own is None else own, features)
    if not both:
        raise ValueError("no feature is shared with the extension")
    rows = read_csv_sequences(spark, files, both, [], EXTENSION)
    return rows.select("sequence_id", "t", *both, F.lit(0).cast("long").alias("label"), F.lit("train_ext").alias("mode"))


def shared_features(first: list[str], second: list[str]) -> list[str]:
    """Names found in both, in the order of the second."""
    return [c for c in second if c in set(first)]


VARIANTS = ("ext", "red")  # fixed values: data with extension sequences; data reduced to the features these have


def variant_of(dataset: Column) -> Column:
    """ext, red or base, by the suffix of a data set's name."""
    out = F.lit("base")
    for v in VARIANTS:
        out = F.when(dataset.endswith(f"_{v}"), v).otherwise(out)
    return out


def base_of(dataset: Column) -> Column:
    return F.regexp_replace(dataset, f"_({'|'.join(VARIANTS)})$", "")


def resolved_variant(name: str, features: list[str], extension: list[str]) -> tuple[str, list[str], bool]:
    """Base name, features and whether extension data is added: of x_ext and x_red the features shared with the extension, in the data set's order, else all."""
    base, _, suffix = name.rpartition("_")
    if suffix not in VARIANTS or not base:
        return name, list(features), False
    both = shared_features(extension, features)
    if not both:
        raise ValueError(f"{name}: no feature is shared with the extension")
    return base, both, suffix == "ext"


def provenance(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length and modification time of raw files; their content isn't read. Empty files have no row."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length", "modificationTime")


def write_bundle(series: DataFrame, path: str) -> None:
    """Parquet by mode; each sequence's rows stand together and in order. What is there already stays as it is."""
    series.repartitionByRange("mode", "sequence_id").sortWithinPartitions("mode", "sequence_id", "t").write.mode("ignore").partitionBy("mode").parquet(path)


def convert_new(spark: SparkSession, source: str, bundle: str, features: list[str], label: str | list[str] = "Anomaly", glob: str = "*.csv") -> int:
    """Convert the CSV files below source that aren't in the bundle yet; returns how many.

    A ledger of files (path, length, modification time, batch) stands beside the data. What it has is left out by an anti-join, new files become a batch of
    their own, and the ledger is written last: a conversion that broke off leaves rows that no ledger row names, which converted() doesn't show and the next call does again.
    """
    there = ledger(spark, bundle)
    new = provenance(spark, source, glob).join(there.select("path"), "path", "left_anti")
    files = staged(new.withColumn("batch", F.lit(uuid.uuid4().hex)))
    paths = [r.path for r in files.select("path").collect()]  # names of new files
    if paths:
        batch = files.first()["batch"]
        rows = read_csv_sequences(spark, paths, features, label, glob)
        rows.withColumn("batch", F.lit(batch)).repartitionByRange("sequence_id", "t").sortWithinPartitions("sequence_id", "t").write.mode("append").partitionBy("batch").parquet(f"{bundle}/rows")
        files.coalesce(1).write.mode("append").parquet(f"{bundle}/ledger")
    return len(paths)


LEDGER = "path string, length long, modificationTime timestamp, batch string"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def ledger(spark: SparkSession, bundle: str) -> DataFrame:
    """The files that a bundle has, one row each."""
    at = f"{bundle}/ledger"
    return spark.read.schema(LEDGER).parquet(at) if _exists(spark, at) else spark.createDataFrame([], LEDGER)


def converted(spark: SparkSession, bundle: str) -> DataFrame:
    """The rows of all batches that the ledger names."""
    whole = ledger(spark, bundle).select("batch").distinct()  # a row for each conversion
    return spark.read.parquet(f"{bundle}/rows").join(F.broadcast(whole), "batch", "left_semi").drop("batch")


def upsert(results: DataFrame, path: str, keys: list[str], *newest: str, parts: int = 64) -> DataFrame:
    """Merge results into the table at path, the newest row of each key; returns the table.

    Keys are dealt into parts; only those that new rows fall into are read, merged and overwritten (dynamic partition overwrite), the others stay as they are.
    Of equally new rows the given ones win. Writers have to take turns.
    """
    spark = results.sparkSession
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    new = results.withColumns({"_part": part, "_given": F.lit(1)})
    if _exists(spark, path):
        touched = [r["_part"] for r in new.select("_part").distinct().collect()]  # at most `parts`
        old = spark.read.parquet(path).where(F.col("_part").isin(touched)).withColumn("_given", F.lit(0))
        new = new.unionByName(old.select(new.columns))
    merged = staged(latest(new, keys, *newest, "_given").drop("_given"))
    merged.repartition("_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(path)
    return spark.read.parquet(path).drop("_part")


def manifest(series: DataFrame) -> DataFrame:
    """mode, item_count, rows, lengths (of each sequence, by its id)."""
    by_seq = series.groupBy("mode", "sequence_id").agg(F.count("*").alias("n"))
    lengths = F.transform(F.array_sort(F.collect_list(F.struct("sequence_id", "n"))), lambda x: x["n"])
    return by_seq.groupBy("mode").agg(F.count("*").alias("item_count"), F.sum("n").alias("rows"), F.to_json(lengths).alias("lengths"))


def faulty_sequences(series: DataFrame, claimed: DataFrame) -> DataFrame:
    """Sequences whose length isn't the one claimed(mode, sequence_id, n), or whose t has gaps."""
    real = series.groupBy("mode", "sequence_id").agg(F.count("*").alias("rows"), F.max("t").alias("last_t"))
    both = real.join(claimed, ["mode", "sequence_id"], "full")
    bad = F.col("n").isNull() | F.col("rows").isNull() | (F.col("n") != F.col("rows")) | (F.col("last_t") + 1 != F.col("rows"))
    return both.where(bad).select("mode", "sequence_id", "rows", "last_t", "n")


def digest(series: DataFrame, columns: list[str], chunk: int = 4096) -> DataFrame:
    """One md5 for each run, over md5s of pieces of bounded size.

    Rows are taken in order, chunk of them a piece, pieces by sequence, and sequences by the first five, then two digits of their
    id's md5; the md5s of one level, in order, make that of the next.
    """
    def level(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
        of = F.array_sort(F.collect_list(F.struct(order, "h")))
        return rows.groupBy("run_key", *keys).agg(F.md5(F.array_join(F.transform(of, lambda r: r["h"]), "")).alias("h"))

    row = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)))
    rows = series.select("run_key", "sequence_id", "t", F.floor(F.col("t") / chunk).alias("piece"), row.alias("h"))
    by_seq = level(level(rows, ["sequence_id", "piece"], "t"), ["sequence_id"], "piece")
    by_five = level(by_seq.withColumn("five", F.substring(F.md5(F.col("sequence_id").cast("string")), 1, 5)), ["five"], "sequence_id")
    by_two = level(by_five.withColumn("two", F.substring("five", 1, 2)), ["two"], "five")
    return level(by_two, [], "two").withColumnRenamed("h", "digest")


def profile(series: DataFrame) -> DataFrame:
    """Sequences, steps, anomalies (events) and share of anomalous steps of each run."""
    starts = (F.col("label") != 0) & (F.coalesce(F.lag("label").over(Window.partitionBy("run_key", "sequence_id").orderBy("t")), F.lit(0)) == 0)
    marked = series.withColumn("starts", starts.cast("long"))
    return marked.groupBy("run_key").agg(F.countDistinct("sequence_id").alias("series"), F.count("*").alias("steps"), F.sum("starts").alias("anomalies"), F.round(F.avg((F.col("label") != 0).cast("double")) * 100, 6).alias("anomaly_pct"))


def latest(results: DataFrame, keys: list[str], *newest: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in newest))
    return results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
