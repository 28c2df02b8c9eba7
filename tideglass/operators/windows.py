"""Windows over sequences, as frames wherever no array is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import INF, KEYS, along, finite, trailing


def sliding_windows(df: DataFrame, features: list[str], width: int, stride: int = 1) -> DataFrame:
    """Complete windows of width rows: t_end and w, an array of the rows' features."""
    w = F.collect_list(F.struct(*features)).over(trailing(width))
    return df.withColumn("w", w).where((F.size("w") == width) & ((F.col("t") - width + 1) % stride == 0)).select(*KEYS, F.col("t").alias("t_end"), "w")


def last_elements(windows: DataFrame) -> DataFrame:
    """The last row of each window of sliding_windows, as columns again."""
    return windows.select(*KEYS, "t_end", F.element_at("w", -1).alias("_last")).select(*KEYS, "t_end", "_last.*")


def causal_windows(df: DataFrame, feature: str, width: int) -> DataFrame:
    """A window for every row; before the start the first row is repeated."""
    seen = F.collect_list(feature).over(trailing(width))
    first = F.first(feature).over(along())
    return df.select(*KEYS, "t", F.concat(F.array_repeat(first, F.lit(width) - F.size(seen)), seen).alias("w"))


def patches(df: DataFrame, feature: str, length: int, stride: int) -> DataFrame:
    """Patches of a feature from every stride-th row; sequences shorter than a patch are filled up in front."""
    n = F.count("*").over(Window.partitionBy(*KEYS))
    ahead = F.collect_list(feature).over(along().rowsBetween(0, length - 1))
    first = F.first(feature).over(along())
    out = df.select(*KEYS, "t", n.alias("n"), ahead.alias("v"), first.alias("f")).where((F.col("t") % stride == 0) & ((F.size("v") == length) | ((F.col("n") < length) & (F.col("t") == 0))))
    return out.select(*KEYS, F.col("t").alias("patch_start"), F.concat(F.array_repeat("f", F.lit(length) - F.size("v")), "v").alias("values"))


def difference(df: DataFrame, features: list[str]) -> DataFrame:
    """First differences; the first row of each sequence goes."""
    w = along()
    return df.select(*KEYS, "t", *((F.col(c) - F.lag(c).over(w)).alias(c) for c in features), "label").where("t > 0")


def drop_faulty_windows(df: DataFrame, features: list[str], width: int) -> DataFrame:
    """Ends of complete windows without a missing value."""
    bad = F.lit(0)
    for c in features:
        bad = bad + F.when(finite(c), 0).otherwise(1)
    rows = df.withColumn("_bad", F.sum(bad).over(trailing(width))).withColumn("_n", F.count("*").over(trailing(width)))
    return rows.where((F.col("_n") == width) & (F.col("_bad") == 0)).drop("_bad", "_n")


def window_report(df: DataFrame, features: list[str], width: int) -> DataFrame:
    """run_key, kept and dropped: complete windows without and with missing values."""
    all_ = df.groupBy(*KEYS).agg(F.count("*").alias("n")).groupBy("run_key").agg(F.sum(F.greatest(F.col("n") - (width - 1), F.lit(0))).alias("_all"))
    kept = drop_faulty_windows(df, features, width).groupBy("run_key").agg(F.count("*").alias("_kept"))
    return all_.join(kept, "run_key", "left").select("run_key", F.coalesce("_kept", F.lit(0)).alias("kept"), (F.col("_all") - F.coalesce("_kept", F.lit(0))).alias("dropped"))


def standardised(df: DataFrame, feature: str, width: int, ddof: int = 1, least: float = 1e-6) -> DataFrame:
    """The last value of each complete window in units of the window's own mean and deviation."""
    w = trailing(width)
    spread = (F.stddev_samp if ddof else F.stddev_pop)(feature).over(w)
    rows = df.select(*KEYS, "t", feature, F.avg(feature).over(w).alias("mean"), spread.alias("std"), F.count("*").over(w).alias("n")).where(F.col("n") == width)
    return rows.select(*KEYS, "t", ((F.col(feature) - F.col("mean")) / F.greatest("std", F.lit(least))).alias("z"), "mean", "std")


def reversible_norm(df: DataFrame, feature: str, width: int, eps: float = 1e-5) -> DataFrame:
    w = trailing(width)
    return df.select(*KEYS, "t", ((F.col(feature) - F.avg(feature).over(w)) / F.sqrt(F.var_pop(feature).over(w) + eps)).alias("normed"))


def normalised(df: DataFrame, features: list[str], least: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Rows with features in units of their own mean and deviation (least at least), and these: one row of m_<feature>, s_<feature>."""
    stats = df.agg(*(F.avg(c).alias(f"m_{c}") for c in features), *(F.greatest(F.stddev_pop(c), F.lit(least)).alias(f"s_{c}") for c in features))
    rows = df.crossJoin(F.broadcast(stats)).withColumns({c: (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") for c in features})
    return rows.select(*df.columns), stats


def denormalised(df: DataFrame, stats: DataFrame, features: list[str]) -> DataFrame:
    """The inverse of normalised."""
    return df.crossJoin(F.broadcast(stats)).withColumns({c: F.col(c) * F.col(f"s_{c}") + F.col(f"m_{c}") for c in features}).select(*df.columns)


def prediction_target(df: DataFrame, feature: str, ahead: int) -> DataFrame:
    return df.select(*KEYS, "t", feature, F.lead(feature, ahead).over(along()).alias("target")).where("target is not null")


def trend_and_season(df: DataFrame, feature: str, width: int) -> DataFrame:
    """Centred moving mean with the edge rows repeated, and what is left."""
    left = (width - 1) // 2
    right = width - 1 - left
    w, whole = along(), Window.partitionBy(*KEYS).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count("*").over(Window.partitionBy(*KEYS))
    before, after = F.greatest(F.lit(left) - F.col("t"), F.lit(0)), F.greatest(F.col("t") + right - (n - 1), F.lit(0))
    total = F.sum(feature).over(w.rowsBetween(-left, right)) + before * F.first(feature).over(whole) + after * F.last(feature).over(whole)
    trend = total / width
    return df.select(*KEYS, "t", trend.alias("trend"), (F.col(feature) - trend).alias("season"))


def window_summary(df: DataFrame, feature: str, width: int) -> DataFrame:
    w = trailing(width)
    n = F.count("*").over(w)
    slope = F.when(n > 1, (F.col(feature) - F.first(feature).over(w)) / (n - 1)).otherwise(0.0)
    return df.select(*KEYS, "t", F.avg(feature).over(w).alias("mean"), F.stddev_pop(feature).over(w).alias("std"), slope.alias("slope"))


def pad_scores(df: DataFrame, prefix: int, suffix: int) -> DataFrame:
    """Scores for every step from 0: the first prefix and last suffix rows of each sequence have none (-inf)."""
    n = F.count("*").over(Window.partitionBy(*KEYS))
    out = (F.col("t") < prefix) | (F.col("t") >= n - suffix)
    return df.withColumn("score", F.when(out, F.lit(-INF)).otherwise(F.col("score")))


def aligned(df: DataFrame, width: int, ahead: int = 0, offset: int = 0) -> DataFrame:
    """Where a detector with windows of width rows and targets ahead has no score."""
    return pad_scores(df, width + ahead - 1 + offset, max(0, ahead - 1))


def running(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(value).over(along().rowsBetween(Window.unboundedPreceding, 0)))
