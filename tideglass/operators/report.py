"""From metric rows to leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import numeric
from ..functions.staging import exact_quantiles
from .metrics import METRICS

LOWER = [m.name for m in METRICS.values() if m.lower_is_better]


def lower_is_better(metric: Column) -> Column:
    return metric.isin(*LOWER)


def over_seeds(results: DataFrame) -> DataFrame:
    """Mean, deviation (0 for one seed) and best of each (model, dataset, metric)."""
    best = F.when(lower_is_better(F.col("metric")), F.min("value")).otherwise(F.max("value"))
    return results.groupBy("model", "dataset", "metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), best.alias("best"), F.count("*").alias("seeds"))


def best_seed(results: DataFrame, metric: str) -> DataFrame:
    order = F.col("value") if METRICS[metric].lower_is_better else F.desc("value")
    w = Window.partitionBy("model", "dataset").orderBy(order, "seed")
    return results.where(F.col("metric") == metric).withColumn("n", F.row_number().over(w)).where("n = 1").select("model", "dataset", "seed", "value")


def ranked_trials(trials: DataFrame, least_seeds: int) -> DataFrame:
    """Trials with enough seeds by alarm score (falling), then aaf (missing last), time and id; place within their dataset."""
    w = Window.partitionBy("dataset").orderBy(F.desc("alarm_score"), F.asc_nulls_last("aaf"), "time", "trial")
    return trials.where(F.col("seeds") >= least_seeds).withColumn("place", F.row_number().over(w))


def mark_extrema(results: DataFrame, value: str = "mean") -> DataFrame:
    """is_best: the best of each (dataset, metric); ties are all marked."""
    w = Window.partitionBy("dataset", "metric")
    return results.withColumn("is_best", F.col(value) == F.when(lower_is_better(F.col("metric")), F.min(value).over(w)).otherwise(F.max(value).over(w)))


def leaderboard(results: DataFrame, columns: list[str], value: str = "mean") -> DataFrame:
    """model by dataset_metric; the columns are given, so no job looks for them."""
    return results.withColumn("c", F.concat_ws("_", "dataset", "metric")).groupBy("model").pivot("c", columns).agg(F.first(value))


def complete_grid(results: DataFrame, value: str = "mean") -> DataFrame:
    """Every (model, dataset), missing where there is no result. Models and datasets are few, whatever the results."""
    models, datasets = results.select("model").distinct(), results.select("dataset").distinct()
    return models.crossJoin(datasets).join(results.select("model", "dataset", value), ["model", "dataset"], "left").withColumn("status", F.when(F.col(value).isNull(), "missing").otherwise("ok"))


def top_models(results: DataFrame, n: int, value: str = "mean") -> DataFrame:
    w = Window.partitionBy("dataset").orderBy(F.desc(value), "model")
    return results.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def canonical(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Names through aliases(alias, name), looked up in lower case without anything but letters and digits."""
    key = F.regexp_replace(F.lower(column), "[^a-z0-9]", "")
    return df.withColumn("_k", key).join(F.broadcast(aliases.select(F.col("alias").alias("_k"), "name")), "_k", "left").withColumn(column, F.coalesce("name", column)).drop("_k", "name")


def migrated_labels(results: DataFrame) -> DataFrame:
    """Metrics named upper_bound_x or best_x become theory_best_x, where the row isn't there under that name."""
    old = F.col("metric").rlike("^(best_|upper_bound_)")
    moved = results.where(old).withColumn("metric", F.concat(F.lit("theory_best_"), F.regexp_replace("metric", "^(best_|upper_bound_)", "")))
    now = results.where(~old)
    return now.unionByName(moved.join(now.select("model", "dataset", "metric"), ["model", "dataset", "metric"], "left_anti").dropDuplicates(["model", "dataset", "metric"]))


def around_first_event(series: DataFrame, events: DataFrame, rows: int) -> DataFrame:
    """The rows of each sequence near its first event."""
    first = events.groupBy("run_key", "sequence_id").agg(F.min(F.struct("start_t", "end_t")).alias("e"))
    return series.join(first, ["run_key", "sequence_id"]).where((F.col("t") >= F.col("e.start_t") - rows) & (F.col("t") < F.col("e.end_t") + rows)).drop("e")


def channel_effects(series: DataFrame, features: list[str], top: int) -> DataFrame:
    """Channels by how far their median in anomalies lies from the one outside, in interquartile ranges. Exact, and counted when this is called."""
    x = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features)))
    cells = series.select((F.col("label") != 0).alias("y"), x.alias("c")).select("y", "c.*")
    q = exact_quantiles(cells, ["feature", "y"], "v", [0.25, 0.5, 0.75])
    q = q.groupBy("feature").agg(F.max(F.when(F.col("y"), F.col("q")[1])).alias("a"), F.max(F.when(~F.col("y"), F.col("q"))).alias("q"))
    effect = F.abs(F.col("a") - F.col("q")[1]) / F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(1e-12))
    w = Window.orderBy(F.desc("effect"), "feature")  # one row for each feature
    return q.select("feature", effect.alias("effect")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def search_grid(spark, **ranges: tuple[int, int, int]) -> DataFrame:
    """Every combination of the values from lo to hi by step, with a number."""
    out = spark.range(1).drop("id")
    for name, (lo, hi, step) in ranges.items():
        out = out.crossJoin(spark.range(1).select(F.explode(F.sequence(F.lit(lo), F.lit(hi), F.lit(step))).alias(name)))
    return out


def model_pairs(models: DataFrame, datasets: DataFrame, more: DataFrame) -> DataFrame:
    """Every (model, dataset) of two short lists, and those given besides; each once."""
    return models.select("model").crossJoin(datasets.select("dataset")).union(more.select("model", "dataset")).distinct()


def with_diagnostics(alarms: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Complete rows of both tables for the same (model, dataset)."""
    other = diagnostics.where("status = 'complete'").select("model", "dataset", "metric", F.col("mean").alias("metric_mean"))
    return alarms.where("status = 'complete'").select("model", "dataset", "mean").join(other, ["model", "dataset"])


def one_layout(results: DataFrame) -> DataFrame:
    """model, dataset, mean, std, status from either layout of result files, all as text.

    The one has mean, std and status; the other normalized_alarm_score_pct_mean and, if it likes, _std.
    """
    if {"model", "dataset", "mean", "std", "status"} <= set(results.columns):
        return results.select("model", "dataset", *(F.col(c).cast("string").alias(c) for c in ("mean", "std", "status")))
    wide = "normalized_alarm_score_pct"
    if not {"model", "dataset", f"{wide}_mean"} <= set(results.columns):
        raise ValueError(f"no known layout of results: {results.columns}")
    std = F.col(f"{wide}_std") if f"{wide}_std" in results.columns else F.lit(None)
    return results.select("model", "dataset", F.col(f"{wide}_mean").cast("string").alias("mean"), std.cast("string").alias("std"), F.lit(None).cast("string").alias("status"))


def checked_results(results: DataFrame, models: DataFrame, datasets: DataFrame) -> DataFrame:
    """Rows of known models and datasets with mean and std as numbers, and status complete or missing.

    What isn't a finite number is null. A row is missing if it says so or has no mean; its mean and std are null then.
    """
    known = results.join(F.broadcast(models.select("model").distinct()), "model", "left_semi").join(F.broadcast(datasets.select("dataset").distinct()), "dataset", "left_semi")  # names of models and datasets: short lists
    missing = (F.trim(F.lower(F.coalesce("status", F.lit("")))) == "missing") | numeric("mean").isNull()
    return known.select("model", "dataset", *(F.when(~missing, numeric(c)).alias(c) for c in ("mean", "std")), F.when(missing, "missing").otherwise("complete").alias("status"))


def result_faults(results: DataFrame) -> DataFrame:
    """Rows of a result table that can't be: missing with a mean, complete without one, another status, or a negative deviation."""
    fault = (
        F.when((F.col("status") == "missing") & F.col("mean").isNotNull(), "missing with a mean")
        .when((F.col("status") == "complete") & F.col("mean").isNull(), "complete without a mean")
        .when(~F.coalesce(F.col("status").isin("missing", "complete"), F.lit(False)), "unknown status")
        .when(F.col("std") < 0, "negative deviation")
    )
    return results.withColumn("fault", fault).where("fault is not null")


def pair_summaries(results: DataFrame) -> DataFrame:
    """One row for each (model, dataset): means of its metrics as a map, and the values of all seeds as JSON."""
    by = results.groupBy("model", "dataset", "metric").agg(F.avg("value").alias("mean"), F.transform(F.array_sort(F.collect_list(F.struct("seed", "value"))), lambda s: s["value"]).alias("values"))
    cells = F.array_sort(F.collect_list(F.struct("metric", "mean", "values")))
    pairs = lambda name: F.map_from_entries(F.transform("cells", lambda c: F.struct(c["metric"], c[name])))
    return by.groupBy("model", "dataset").agg(cells.alias("cells")).select("model", "dataset", pairs("mean").alias("means"), F.to_json(pairs("values")).alias("seeds"))
