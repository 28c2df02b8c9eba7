"""Event-level metrics of predictions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import KEYS
from ..functions.scans import PIECE, Sequences, Total


@dataclass(frozen=True)
class Metric:
    name: str
    lower_is_better: bool = False
    binary: bool = True


METRICS = {m.name: m for m in (Metric("alarm_score"), Metric("aaf", True), Metric("event_recall"), Metric("event_detection_delay", True))}


def evaluate(pred: DataFrame, size: int | None = PIECE) -> DataFrame:
    """All metrics of rows(run_key, sequence_id, t, pred, label), for each run.

    alarm_score: detected - false alarms / 2 - (1 - 1 / false points) + mean nominal - 3/4 early - 1/4 late; 0 without
    a prediction. A run of alarms credits only the anomaly that it hits first. aaf: mean number of alarms inside
    detected anomalies. event_detection_delay (our definition): first hit's offset over length, mean over
    anomalies hit. One shuffle by pieces of sequences, then sums.
    """
    rows = pred.select(*KEYS, "t", F.col("pred").cast("int").alias("p"), (F.coalesce("label", F.lit(0)) != 0).cast("int").alias("y"))
    rows = Sequences(rows, size).near(1, 0, lambda w: {"p0": F.coalesce(F.lag("p").over(w), F.lit(0)), "y0": F.coalesce(F.lag("y").over(w), F.lit(0))})
    fresh = (F.col("y") == 1) & (F.col("y0") == 0)
    rows = rows.scan(k=Total("sum", fresh.cast("long")), r=Total("sum", ((F.col("p") == 1) & (F.col("p0") == 0)).cast("long")), start=Total("max", F.when(fresh, F.col("t")))).done()
    borders = rows.groupBy("run_key").agg(
        F.sum("p").alias("predicted"), F.sum((F.col("p") * (1 - F.col("y"))).cast("double")).alias("fp"),
        F.sum((F.col("p") * F.col("p0") * F.col("y") * (1 - F.col("y0"))).cast("double")).alias("early"), F.sum((F.col("p") * F.col("p0") * F.col("y0") * (1 - F.col("y"))).cast("double")).alias("late"),
    )
    runs = rows.where("p = 1").groupBy(*KEYS, "r").agg(F.min(F.when(F.col("y") == 1, F.col("k"))).alias("k"))
    false = runs.where("k is null").groupBy("run_key").agg(F.count("*").cast("double").alias("false_alarms"))
    credited = runs.where("k is not null").select(*KEYS, "k", F.lit(1.0).alias("credited")).distinct()
    weight = F.pow(F.lit(2.0), -(F.col("t") - F.col("start") + 1).cast("double"))
    opens = (F.col("p") == 1) & ((F.col("p0") == 0) | (F.col("y0") == 0))
    events = rows.where("y = 1").groupBy(*KEYS, "k").agg(F.sum(opens.cast("double")).alias("alarms"), F.sum(F.col("p") * weight).alias("w"), F.max("p").alias("hit"), F.count("*").alias("length"), (F.min(F.when(F.col("p") == 1, F.col("t"))) - F.min("t")).alias("delay"))
    events = events.join(credited, [*KEYS, "k"], "left")
    nominal = F.when(F.col("credited") == 1, (1 + F.col("w")) * F.pow(F.lit(2.0), -F.col("alarms")))
    by_run = events.groupBy("run_key").agg(
        F.coalesce(F.sum("credited"), F.lit(0.0)).alias("detected"), F.coalesce(F.avg(nominal), F.lit(0.0)).alias("nominal"), F.avg(F.when(F.col("hit") == 1, F.col("alarms"))).alias("aaf"),
        F.avg(F.col("hit").cast("double")).alias("event_recall"), F.avg(F.col("delay") / F.col("length")).alias("event_detection_delay"),
    )
    all_ = borders.join(by_run, "run_key", "left").join(false, "run_key", "left").na.fill(0.0, ["detected", "nominal", "false_alarms"])
    points = F.when(F.col("fp") > 0, 1 - 1 / F.col("fp")).otherwise(0.0)
    score = F.when(F.col("predicted") > 0, F.col("detected") - F.col("false_alarms") / 2 - points + F.col("nominal") - 0.75 * F.col("early") - 0.25 * F.col("late")).otherwise(0.0)
    return all_.select("run_key", F.round(score, 9).alias("alarm_score"), *(F.round(c, 9).alias(c) for c in ("aaf", "event_recall", "event_detection_delay")))


def reference_values(rows: DataFrame) -> DataFrame:
    """The metrics with the labels as predictions: the most that can be reached."""
    return evaluate(rows.withColumn("pred", (F.coalesce("label", F.lit(0)) != 0).cast("int")))
