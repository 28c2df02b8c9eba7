"""Sequences in pieces give what whole sequences give."""

import random

import pytest
from pyspark.sql import Window, functions as F

from tideglass.functions.scans import Sequences, Total, fits
from tideglass.operators import alarms, metrics, scores, sweep

INF = float("inf")
KIND = "run_key string, sequence_id long, t long, score double, label int, pred int"
SIZES = (4, 50)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    out = []
    for s, n in enumerate((1, 2, 3, 49, 50, 51, 120, 307)):
        y = 0
        for t in range(n):
            y = 1 - y if rng.random() < 0.08 else y
            x = rng.choice([None, -INF]) if rng.random() < 0.03 else rng.choice([0.1, 0.4, 0.9, 1.2, 1.5]) + 0.4 * y
            out.append((f"r{s % 2}", s, t, x, y, int((x or 0) > 0.8)))
    return spark.createDataFrame(out, KIND).repartition(5)


def sparse(df):
    """The same rows with gaps in t."""
    return df.withColumn("t", F.col("t") * 7 + F.col("t") % 3 + 1_000_000)


def same(a, b, digits=9):
    cut = lambda r: tuple(round(v, digits) if isinstance(v, float) and abs(v) < INF else v for v in r)
    a, b = (sorted((cut(r) for r in df.select(*sorted(df.columns)).collect()), key=str) for df in (a, b))
    assert a == b and a


@pytest.mark.parametrize("size", SIZES)
def test_totals_and_frames(rows, size):
    def both(s):
        s = s.near(3, 2, lambda w: {"mean": F.avg("score").over(w.rowsBetween(-3, 2)), "n": F.count("*").over(w.rowsBetween(-3, 2))})
        totals = {f"{kind}{b:d}{o:d}": Total(kind, F.col("score"), b, o) for kind in ("sum", "min", "max", "last") for b in (False, True) for o in (False, True)}
        return s.scan(**totals).columns(d=F.col("sum01") - F.col("min01")).scan(e=Total("max", F.col("d"))).done()

    finite = rows.withColumn("score", F.when(F.col("score") > -INF, F.col("score")))
    same(both(Sequences(finite, size)), both(Sequences(finite, None)))
    same(both(Sequences(sparse(finite), size)), both(Sequences(sparse(finite), None)))


@pytest.mark.parametrize("size", SIZES)
def test_alarms(rows, size):
    for df in (rows,) if size == 50 else (sparse(rows),):
        parts = [alarms.decision_scores(df, 4, 3, n) for n in (size, None)]
        same(*parts)
        done = [alarms.hysteresis(d, 1.2, 0.8, 2, 3, size=n) for d, n in zip(parts, (size, None))]
        same(*done)
        same(*(alarms.merge_events(d, 2, 3, n) for d, n in zip(done, (size, None))))
    same(alarms.merge_events(rows, 2, 3, size), alarms.merge_events(rows, 2, 3, None))
    same(alarms.segments(rows, "label", size), alarms.segments(rows, "label", None))
    flat = rows.where("sequence_id = 7").drop("sequence_id")
    same(alarms.sequences_of(flat, size=size), alarms.sequences_of(flat, size=None))


@pytest.mark.parametrize("size", SIZES)
def test_metrics_sweep_and_cusum(rows, size):
    same(metrics.evaluate(rows, size), metrics.evaluate(rows, None))
    same(sweep.best_threshold(rows, size), sweep.best_threshold(rows, None))
    same(sweep.sweep_curve(rows, size), sweep.sweep_curve(rows, None))
    finite = rows.withColumn("score", F.when(F.col("score") > -INF, F.col("score")).otherwise(0.0))
    stats = scores.train_stats(finite, ["score"])
    same(scores.cusum(finite, stats, ["score"], 0.3, size=size), scores.cusum(finite, stats, ["score"], 0.3, size=None))


def test_channels_side_by_side_are_each_alone(spark):
    """Rows stay whole: each sequence is put in order once for all channels, and a task adds up what it changes; any cut of the task's rows, and pieces of sequences, give the same."""
    rng, rows = random.Random(5), []
    for s, n in enumerate((1, 2, 9, 40, 41, 120)):
        y = 0
        for t in range(n):
            y = 1 - y if rng.random() < 0.2 else y
            rows.append(("r", f"s{s}", 3 * t, rng.choice([None, float("nan"), -INF, INF, 0.0, -0.0, 0.5, 1.5 * y]), rng.random() + y, y if rng.random() < 0.9 else None))
    df = spark.createDataFrame(rows, "run_key string, sequence_id string, t long, a double, b double, label int").repartition(3)
    each = [df.select(F.lit(c).alias("run_key"), "sequence_id", "t", F.col(c).alias("score"), "label") for c in ("a", "b")]
    want = sweep.best_threshold(each[0].union(each[1]), 4)
    same(sweep.best_thresholds(df, ["a", "b"]), want)
    same(sweep.best_thresholds(df, ["a", "b"], 4), want)
    same(sweep.best_threshold(each[0].union(each[1])), want)
    summed = lambda size: sweep._by_task(df.coalesce(1), ["a", "b"], True, size)[0].groupBy("run_key", "value").agg(*(F.sum(c).alias(c) for c in sweep.TERMS))
    same(summed(1), summed(1000))


@pytest.mark.parametrize("span", [1, 2, 9])
def test_the_weighted_mean_by_its_recurrence(spark, span):
    rng = random.Random(span)
    values = [rng.random() * 10 if rng.random() > 0.004 else None for _ in range(2500)]
    df = spark.createDataFrame([("r", 0, t, v) for t, v in enumerate(values)], "run_key string, sequence_id long, t long, score double")
    want, m, a = [], None, 2 / (span + 1)
    for v in values:
        m = None if v is None else v if m is None else a * v + (1 - a) * m
        want.append(m)
    for size in (None, 64):
        got = [r.ewma for r in alarms.ewma(alarms.finite_stretches(df, size), span, size).orderBy("t").collect()]
        assert got == [w if w is None else pytest.approx(w) for w in want]


def test_one_long_sequence_takes_many_tasks(spark):
    n, size = 400_000, 20_000
    df = spark.range(n).select(F.lit("r").alias("run_key"), F.lit(0).alias("sequence_id"), F.col("id").alias("t"), (F.col("id") % 1000 / 1000).alias("score"), (F.col("id") % 977 < 9).cast("int").alias("label"))
    assert not fits(df, size) and fits(df, n)
    out = Sequences(df, size).near(9, 0, lambda w: {"top": F.max("score").over(w.rowsBetween(-9, 0))}).scan(total=Total("sum", F.col("label"))).done()
    per_task = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
    assert per_task.agg(F.max("n")).first()[0] < n / 2
    assert out.agg(F.max("total")).first()[0] == df.agg(F.sum("label")).first()[0]
    best = sweep.best_threshold(df, size).first()
    assert best.num_steps == 1001 and best == sweep.best_threshold(df, None).first()


def test_empty_tables(spark):
    none = spark.createDataFrame([], KIND)
    assert fits(none, 1)
    assert alarms.merge_events(alarms.hysteresis(alarms.decision_scores(none, 2, 2), 1.0, 0.5), 1, 2).count() == 0
    assert metrics.evaluate(none).count() == sweep.best_threshold(none).count() == alarms.segments(none, "pred").count() == 0


def test_scores_are_worked_out_once_and_rows_stay_whole(spark):
    df = spark.createDataFrame([("r", s, t, float(t % 5 + s), float(t * t % 7), 0) for s in range(3) for t in range(40)], "run_key string, sequence_id long, t long, a double, b double, label int")
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    normed = scores.robust_normalised(scores.cusum(df, scores.train_stats(df, ["a"]), ["a"], 0.5), ["run_key"])
    assert "Window" not in plan(normed)
    slow = scores.slow_channels(df, ["a", "b"])
    assert plan(slow).index("explode") < plan(slow).index("Aggregate")  # channels come apart after the sums, not before
    assert slow.count() == 2 and scores.slow_channels(df.where("t < 0"), ["a", "b"]).count() == 0


def test_fits_sorts_nothing(spark, monkeypatch):
    """Sequences are counted by key, without the window that t comes from."""
    df = spark.range(50).select(F.lit("r").alias("run_key"), (F.col("id") % 2).alias("sequence_id"), F.rand(1).alias("x"))
    rows = df.withColumn("t", F.row_number().over(Window.partitionBy("sequence_id").orderBy("x")).cast("long") - 1)
    rows = rows.withColumn("t", F.when(F.col("t") < 0, F.raise_error(F.lit("t was worked out"))).otherwise(2 * F.col("t")))
    assert fits(rows, 25) and not fits(rows, 24)
