"""Tables in the folder that all executors share, and exact running totals and quantiles that need them."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .columns import INF


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, on a local master only, under one of our own.

    What is staged there is needed until results have been read, so it is left for sweep_away() or the cluster's own cleaning.
    """
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not base:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + _own_folder()
    path = f"{base}/tideglass/{uuid.uuid4().hex}"
    _made.append(path)
    return path


_made: list[str] = []
_owned: list[tempfile.TemporaryDirectory] = []


def _own_folder() -> str:
    if not _owned:
        _owned.append(tempfile.TemporaryDirectory(prefix="spark-tideglass-", ignore_cleanup_errors=True))
        atexit.register(_owned[0].cleanup)
    return _owned[0].name


def sweep_away(spark: SparkSession) -> int:
    """Delete all that this driver has staged, once no result that reads it is needed any more; returns how many folders."""
    n = len(_made)
    for path in _made:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _made.clear()
    return n


def staged(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again; lost executors cost nothing before it."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SMALL = 1_000_000  # rows of one key that a single sorted window may have
ACCURACY = 1000  # of the sketch that brackets quantiles: ranks are within 1/ACCURACY of the rows
MARGIN = 3 / ACCURACY  # a bracket is this much wider on either side


def _same(keys: list[str], prefix: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return out


def local(df: DataFrame) -> DataFrame:
    """df's rows by way of the driver, for tables with a row for each feature or run: no job and no file for what starts from them."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


FEW = {"feature", "run_key"}  # keys of which there are few, whatever the rows


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, fractions: Iterable[float], more: dict[str, Column] | None = None) -> DataFrame:
    """keys and q: the exact quantiles at the fractions (see bracketed); more are further aggregates of the keys' rows."""
    return bracketed(rows, keys, value, fractions, more)[0]


def bracketed(rows: DataFrame, keys: list[str], value: str, fractions: Iterable[float], more: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact quantiles, and the counts that they were found in, which are staged.

    A mergeable sketch brackets each quantile, in one pass that shuffles sketches only. A second pass counts: values inside a bracket one by one, all others by the
    bracket they follow, so that of each key only some thousandths of its rows are shuffled and sorted (all, of keys with a few hundred). If a place should fall outside its bracket, which the
    sketch's bound rules out, all values are counted instead. A quantile lies between two values as far as its place falls between their rows. Nulls don't
    count; keys without a value have no row. rows are read twice: stage them if they are dear.

    Counts are keys, v, out and n: rows with the value v, or with out = 1 outside all brackets, above v and below the next bracket.
    """
    fractions = [float(f) for f in fractions]
    some = rows.select(*keys, F.col(value).cast("double").alias("_v"), *(F.col(c) for c in rows.columns if more and c not in keys))
    ends = [x for f in fractions for x in (max(0.0, f - MARGIN), min(1.0, f + MARGIN))]
    keep = local if set(keys) <= FEW else staged
    sketch = keep(some.groupBy(*keys).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", F.array(*map(F.lit, ends)), F.lit(ACCURACY)).alias("_b"), *(c.alias(n) for n, c in (more or {}).items())).where("_n > 0"))
    bounds = sketch.select(*(F.col(k).alias(f"_of_{k}") for k in keys), *(F.when(F.lit(0.0 < e < 1.0) & (F.col("_n") * MARGIN >= 2), F.col("_b")[i]).otherwise(F.lit(INF if i % 2 else -INF)).alias(f"_b{i}") for i, e in enumerate(ends)))
    v, b = F.col("_v"), [F.col(f"_b{i}") for i in range(len(ends))]
    inside = F.lit(False)
    for low, high in zip(b[::2], b[1::2]):
        inside = inside | ((v >= low) & (v <= high))
    after = F.greatest(F.lit(-INF), F.lit(-INF), *(F.when(high < v, high) for high in b[1::2]))
    met = some.select(*keys, "_v").where("_v is not null").join(F.broadcast(bounds) if keep is local else bounds, _same(keys, "_of_"))
    counts = met.select(*keys, F.when(inside, v).otherwise(after).alias("v"), (~inside).cast("int").alias("out"))
    counts = staged(counts.groupBy(*keys, "v", "out").agg(F.count("*").alias("n")))
    found = keep(_picked(counts, keys, fractions))
    if not found.where("_missed").isEmpty():
        counts = staged(some.where("_v is not null").groupBy(*keys, F.col("_v").alias("v"), F.lit(0).alias("out")).agg(F.count("*").alias("n")))
        found = keep(_picked(counts, keys, fractions))
    if more:
        names = sketch.select(*(F.col(k).alias(f"_of_{k}") for k in keys), *more)
        found = found.join(names, _same(keys, "_of_")).select(*keys, "q", *more, "_missed")
    return found.drop("_missed"), counts


COLUMNS = 64  # sketched in one pass
HELD = 1 << 18  # distinct values of a column that a task holds before it hands them on


def column_counts(table: DataFrame, columns: list[str], brackets: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """feature, v, out and n, of each column of doubles: values inside a bracket one by one, all others by the bracket they follow (see bracketed). Tasks add up before anything is shuffled."""
    apart = {}
    for c in columns:
        merged: list[list[float]] = []
        for low, high in sorted(brackets[c]):
            if merged and low <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], high)
            else:
                merged.append([low, high])
        apart[c] = (np.array([x[0] for x in merged]), np.array([-INF, *(x[1] for x in merged)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {c: [] for c in columns}
        size = dict.fromkeys(columns, 0)
        beyond = {c: np.zeros(len(apart[c][1]), np.int64) for c in columns}

        def together(c: str) -> None:
            v, at = np.unique(np.concatenate([x for x, _ in held[c]]), return_inverse=True)
            n = np.bincount(at, np.concatenate([x for _, x in held[c]])).astype(np.int64)
            held[c], size[c] = [(v, n)], len(v)

        def out(c: str) -> pa.RecordBatch:
            v, n = (np.concatenate(x) for x in zip(*held[c], (np.zeros(0), np.zeros(0, np.int64))))
            some = beyond[c] > 0
            values, kinds = np.concatenate((v, apart[c][1][some])), np.repeat([0, 1], [len(v), some.sum()]).astype(np.int32)
            n = np.concatenate((n, beyond[c][some]))
            held[c], size[c], beyond[c][:] = [], 0, 0
            return pa.RecordBatch.from_arrays([pa.array([c] * len(values), pa.string()), pa.array(values, pa.float64()), pa.array(kinds), pa.array(n, pa.int64())], ["feature", "v", "out", "n"])

        for batch in batches:
            for i, c in enumerate(columns):
                v = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                lows, highs = apart[c]
                at = np.searchsorted(lows, v, side="right")
                inside = (at > 0) & (v <= highs[at])
                beyond[c] += np.bincount(at[~inside], minlength=len(highs))
                if inside.any():
                    held[c].append(np.unique(v[inside], return_counts=True))
                    size[c] += len(held[c][-1][0])
                    if size[c] > HELD:
                        together(c)
                        if size[c] > HELD // 2:
                            yield out(c)
        for c in columns:
            if held[c]:
                together(c)
            yield out(c)

    found = table.select(*(F.col(f"`{c}`") for c in columns)).mapInArrow(run, "feature string, v double, out int, n long")
    return found.groupBy("feature", "v", "out").agg(F.sum("n").alias("n"))


def column_quantiles(table: DataFrame, columns: list[str], fractions: Iterable[float], more: Callable[[str], dict[str, Column]] | None = None) -> tuple[DataFrame, DataFrame]:
    """bracketed for the columns (finite doubles or null) of a table side by side: feature, q and more(column), and counts by feature. No row is made of a cell."""
    fractions = [float(f) for f in fractions]
    spark = table.sparkSession
    ends = [x for f in fractions for x in (max(0.0, f - MARGIN), min(1.0, f + MARGIN))]
    aggregates = lambda c: {"_n": F.count(f"`{c}`"), "_b": F.percentile_approx(f"`{c}`", F.array(*map(F.lit, ends)), F.lit(ACCURACY)), **(more(c) if more else {})}
    sketch = {}  # a row for each column
    for i in range(0, len(columns), COLUMNS):
        some = columns[i : i + COLUMNS]
        row = table.agg(*(F.struct(*(x.alias(n) for n, x in aggregates(c).items())).alias(f"_{j}") for j, c in enumerate(some))).first()
        sketch |= {c: row[j] for j, c in enumerate(some) if row[j]["_n"] > 0}
    names = list(aggregates(columns[0]))[2:] if columns else []
    edge = lambda r, i: r["_b"][i] if 0.0 < ends[i] < 1.0 and r["_n"] * MARGIN >= 2 else (INF if i % 2 else -INF)
    brackets = {c: [(edge(r, i), edge(r, i + 1)) for i in range(0, len(ends), 2)] for c, r in sketch.items()}
    counts = staged(column_counts(table, list(sketch), brackets))
    found = local(_picked(counts, ["feature"], fractions))
    if not found.where("_missed").isEmpty():
        counts = staged(column_counts(table, list(sketch), {c: [(-INF, INF)] for c in sketch}))
        found = local(_picked(counts, ["feature"], fractions))
    found = found.drop("_missed")
    if names:
        kinds = "feature string, " + ", ".join(f"{n} long" for n in names)
        found = found.join(F.broadcast(spark.createDataFrame([(c, *(r[n] for n in names)) for c, r in sketch.items()], kinds)), "feature")
    return found, counts


def _picked(counts: DataFrame, keys: list[str], fractions: list[float]) -> DataFrame:
    """keys, q and _missed (whether a quantile wasn't among the values counted one by one).

    Running totals give each value its place. Those of keys with few rows of counts (checked) are one sorted window each; else they are
    range-partitioned and the totals go over the ranges, so that no task holds all rows of a key.
    """
    rows = counts.select(F.struct(*keys).alias("_keys"), F.struct("v", "out").alias("_v"), F.col("n").cast("double").alias("n"))
    if counts.count() <= SMALL or (rows.groupBy("_keys").agg(F.count("*").alias("_c")).agg(F.max("_c")).first()[0] or 0) <= SMALL:
        upto = Window.partitionBy("_keys").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        all_ = Window.partitionBy("_keys")
        placed = rows.select("_keys", "_v", (F.sum("n").over(upto) - F.col("n")).alias("_first"), F.sum("n").over(all_).alias("total"))
    else:
        above = running_totals(rows, "_keys", "_v", ["n"])
        total = above.groupBy("_keys").agg(F.max("n").alias("total")).withColumnRenamed("_keys", "_of")
        placed = above.join(total, F.col("_keys").eqNullSafe(F.col("_of"))).withColumn("_first", F.col("total") - F.col("n"))  # place of a value's first row, from below
    picks = []
    for i, f in enumerate(fractions):
        at = f * (F.col("total") - 1)
        picks += [F.max(F.when(F.col("_first") <= side(at), F.col("_v"))).alias(f"_{name}{i}") for name, side in (("low", F.floor), ("high", F.ceil))]
    out = placed.groupBy("_keys").agg(F.max("total").alias("total"), *picks)
    q, missed = [], F.lit(False)
    for i, f in enumerate(fractions):
        at, low, high = f * (F.col("total") - 1), F.col(f"_low{i}"), F.col(f"_high{i}")
        part = at - F.floor(at)
        q.append(F.when(low["v"] == high["v"], low["v"]).otherwise((1 - part) * low["v"] + part * high["v"]))
        missed = missed | (low["out"] == 1) | (high["out"] == 1)
    return out.select("_keys.*", F.array(*q).alias("q"), missed.alias("_missed"))


def running_totals(df: DataFrame, key: str, value: str, terms: list[str], own: bool = False) -> DataFrame:
    """key, value and, for each term, its total over the key's rows with at least this value; with own, the totals are term_ and the row's own terms stay.

    Takes one row for each key and value. Rows are range-partitioned by key and falling value, so that a key
    with very many values takes many tasks: each range sums its own rows, and the totals of the ranges before it
    (one row for each key and range) are added. Equal to a running sum by key but for the order of additions.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = staged(df.select(key, value, *terms).repartitionByRange(n, F.col(key), F.desc(value)).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy(key, "_range").agg(*(F.sum(x).alias(x) for x in terms))
    carried = ranges.select(key, F.col("_range").alias("_of"), *(F.coalesce(F.sum(x).over(before), F.lit(0.0)).alias(f"_{x}") for x in terms))
    inside = Window.partitionBy(key, "_range").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.select(key, "_range", value, *(terms if own else ()), *(F.sum(x).over(inside).alias(f"{x}_") for x in terms))
    both = summed.join(carried.withColumnRenamed(key, "_key"), (F.col("_range") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")))
    return both.select(key, value, *(terms if own else ()), *((F.col(f"{x}_") + F.col(f"_{x}")).alias(f"{x}_" if own else x) for x in terms))
