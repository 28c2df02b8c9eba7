import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideglass.functions.sql import alarm_score_of
from tideglass.functions.staging import running_totals
from tideglass.operators import alarms, metrics, sweep

INF = float("inf")


def series(spark, values, **more):
    rows = [("r", 1, i, float(v), *(m[i] for m in more.values())) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "run_key string, sequence_id long, t long, score double" + "".join(f", {k} int" for k in more))


def column(df, name):
    return [r[name] for r in df.orderBy("sequence_id", "t").collect()]


def test_smoothing(spark):
    df = alarms.ewma(alarms.rolling_max(alarms.finite_stretches(series(spark, [1, 3, 2, 5])), 2), 3)
    assert column(df, "rolling_max") == [1, 3, 3, 5]
    assert column(df, "ewma") == [1, 2, 2, 3.5]
    d = column(alarms.decision_scores(series(spark, [-INF, 1, 3, -INF, 2, 1]), 2, 2), "decision")
    assert d[0] == d[3] == -INF and d[1:3] == [1, 3] and d[4:] == [2, 2]


def test_hysteresis_and_events(spark):
    df = alarms.decision_scores(series(spark, [0.4, 1.1, 1.2, 0.3, 0.2, 0.1]))
    assert column(alarms.hysteresis(df, 1.0, 0.5, 2, 2), "pred") == [0, 1, 1, 1, 1, 0]
    for pred, want in (([1, 0, 1, 0, 1, 1, 0], [1, 1, 1, 1, 1, 1, 0]), ([0, 1, 0, 0, 1, 1, 0], [0, 0, 0, 0, 1, 1, 0])):
        assert column(alarms.merge_events(series(spark, pred, pred=pred), 1, 2), "pred") == want
    events = alarms.segments(series(spark, [0] * 6, m=[1, 1, 0, 1, 0, 1]), "m").orderBy("start_t").collect()
    assert [(r.event_id, r.start_t, r.end_t) for r in events] == [(0, 0, 2), (1, 3, 4), (2, 5, 6)]


def brute_hysteresis(s, on, off, enter, leave):
    """Alarm after alarm: from the first place where enter scores in a row are high to the end of the next leave scores in a row that are low."""
    out, at = [0] * len(s), 0
    while True:
        begin = next((i for i in range(at, len(s) - enter + 1) if min(s[i : i + enter]) >= on), None)
        if begin is None:
            return out
        end = next((j for j in range(begin + enter + leave - 1, len(s)) if max(s[j - leave + 1 : j + 1]) < off), len(s) - 1)
        out[begin : end + 1] = [1] * (end + 1 - begin)
        at = end + 1


@pytest.mark.parametrize("enter,leave", [(1, 1), (2, 3), (3, 2)])
def test_hysteresis_equals_state_machine(spark, enter, leave):
    rng = random.Random(enter * 10 + leave)
    rows = [("r", s, t, rng.choice([0.1, 0.4, 0.6, 0.9, 1.2, 1.5]), 0) for s in range(60) for t in range(rng.randrange(1, 25))]
    df = alarms.decision_scores(spark.createDataFrame(rows, "run_key string, sequence_id long, t long, score double, label int"))
    got = {(r.sequence_id, r.t): r.pred for r in alarms.hysteresis(df, 1.0, 0.5, enter, leave).collect()}
    for s in range(60):
        mine = [r[3] for r in rows if r[1] == s]
        assert [got[s, t] for t in range(len(mine))] == brute_hysteresis(mine, 1.0, 0.5, enter, leave)


def brute_score(seqs, limit):
    """The alarm score over sequences laid end to end with a row without score between them."""
    p, y = [], []
    for scores, labels in seqs:
        p += [limit == -INF, *(s >= limit for s in scores)]
        y += [0, *labels]
    return alarm_score_of(pd.Series(range(len(p))), pd.Series(p), pd.Series(y))


def test_sweep_equals_trying_every_threshold(spark):
    rng = random.Random(11)
    runs = [[([0.1, 0.8, 0.2, 0.9, 0.1, 0.7, 0.3], [0, 1, 1, 0, 0, 1, 1])], [([0.5, 0.5, 0.2, 0.9, 0.9, 0.1, 0.3, 0.5], [0, 1, 1, 0, 1, 1, 0, 0])], [([0.2, 0.8, 0.3, 0.4], [0, 0, 0, 0])], [([1.0, 1.0], [1, 1])]]
    for _ in range(120):
        runs.append([([rng.choice([0.1, 0.2, 0.3, 0.5, -INF]) if rng.random() < 0.8 else rng.random() for _ in range(n)], [int(rng.random() < 0.4) for _ in range(n)]) for n in [rng.randrange(1, 12) for _ in range(rng.randrange(1, 4))]])
    rows = [(f"r{i}", s, t, x, y) for i, run in enumerate(runs) for s, (xs, ys) in enumerate(run) for t, (x, y) in enumerate(zip(xs, ys))]
    df = spark.createDataFrame(rows, "run_key string, sequence_id long, t long, score double, label int")
    got = {r.run_key: r for r in sweep.best_threshold(df).collect()}
    for i, run in enumerate(runs):
        values = sorted({-INF, *(x for xs, _ in run for x in xs)}, reverse=True)
        best, at = 0.0, INF
        for v in values:
            if (s := round(brute_score(run, v), 9)) > best + 1e-10:
                best, at = s, v
        r = got[f"r{i}"]
        assert math.isclose(r.best_score, best, abs_tol=1e-8) and r.threshold == at and r.num_steps == len(values), (i, run, r, best, at)


def test_metrics_equal_the_sequence_function(spark):
    rng = random.Random(3)
    rows = [(f"r{i}", 1, t, int(rng.random() < 0.4), int(rng.random() < 0.4)) for i in range(200) for t in range(rng.randrange(1, 20))]
    df = spark.createDataFrame(rows, "run_key string, sequence_id long, t long, pred int, label int")
    for r in metrics.evaluate(df).collect():
        mine = pd.DataFrame([x for x in rows if x[0] == r.run_key], columns=["r", "s", "t", "pred", "label"])
        assert math.isclose(r.alarm_score, alarm_score_of(mine.t, mine.pred, mine.label), abs_tol=1e-8)
    one = metrics.reference_values(df.where("run_key = 'r0'")).first()
    assert one.event_recall == 1 and one.event_detection_delay == 0


def test_quantile_counts_sentinels(spark):
    df = series(spark, [1, 2, 3, 4], label=[0, 0, 0, 0])
    got = sweep.quantile_thresholds(df, [0.25, 0.5]).orderBy(F.desc("fraction")).collect()
    assert [r.threshold for r in got] == [2.0, 3.0]
    assert [r.threshold for r in sweep.quantile_thresholds(df, [0.1, 1.0]).orderBy("fraction").collect()] == [pytest.approx(3.6), -INF]


def test_running_totals_of_one_large_and_many_small_keys(spark):
    rng = random.Random(5)
    rows = [("hot", float(v), float(rng.randrange(9)), 1.0) for v in range(3000)] + [(f"k{i}", float(v), float(rng.randrange(9)), 1.0) for i in range(40) for v in range(i % 4 + 1)]
    rows += [("hot", -INF, 1.0, 1.0), ("hot", INF, 2.0, 1.0), (None, 1.0, 3.0, 1.0), (None, 0.0, 4.0, 1.0)]
    df = spark.createDataFrame(rows, "run_key string, value double, a double, b double").repartition(7)
    got = {(r.run_key, r.value): (r.a, r.b) for r in running_totals(df, "run_key", "value", ["a", "b"]).collect()}
    want, so_far = {}, {}
    for k, v, a, b in sorted(rows, key=lambda r: -r[1]):
        so_far[k] = tuple(x + y for x, y in zip(so_far.get(k, (0.0, 0.0)), (a, b)))
        want[k, v] = so_far[k]
    assert got == want
    assert running_totals(df.limit(0), "run_key", "value", ["a", "b"]).count() == 0
