"""The search against a plain one, flat runs as sequences, and online alarms against those of all rows at once."""

import itertools
import random

import pandas as pd
import pytest

from tideglass.operators import alarms, search
from tideglass.streaming import alarms as stream

INF = float("inf")


def scored(spark, n=6, seed=2):
    rng = random.Random(seed)
    rows = [(f"r{s % 2}", s, t, rng.random() + (0.6 if 10 < t < 16 else 0.0), int(10 < t < 16)) for s in range(n) for t in range(25)]
    return spark.createDataFrame(rows, "run_key string, sequence_id long, t long, score double, label int")


def test_search_is_the_plain_greedy_one(spark):
    scores = scored(spark)
    space = {"width": [1, 3], "enter": [1, 2]}
    grid = [search.Settings(width=w, enter=e) for w, e in itertools.product(*space.values())]
    runs = search.evaluation(scores, grid).runs.toPandas()
    value = {g: runs[runs.setting == i][list(search.METRICS)].mean().to_dict() for i, g in enumerate(grid)}
    best = search.Settings()
    for _ in range(3):
        before = best
        for name, values in space.items():
            for c in [search.replace(best, **{name: v}) for v in values]:
                if search.rank_key(value[c], "alarm_score") > search.rank_key(value[best], "alarm_score"):
                    best = c
        if best == before:
            break
    found = search.coordinate_search(scores, space)
    assert found.best == best and found.values == pytest.approx(value[best]) and found.default == pytest.approx(value[search.Settings()])
    assert len({s for s, _ in found.history}) == len(found.history) and found.history[0][0] == search.RAW


def test_many_settings_are_as_each_alone(spark):
    scores = scored(spark)
    settings = [search.RAW, search.Settings(), search.Settings(3, 5, 0.5, 2, 2, 1, 2), search.Settings(3, 5, 1.0, 1, 3)]
    together = search.evaluation(scores, settings).runs.orderBy("setting", "run_key").toPandas()
    alone = pd.concat([search.evaluated(scores, s).orderBy("run_key").toPandas().assign(setting=i) for i, s in enumerate(settings)], ignore_index=True)
    pd.testing.assert_frame_equal(together, alone[together.columns], check_dtype=False)
    fixed = search.evaluated(scores, search.Settings(), 0.05).toPandas()
    assert (fixed.threshold_on < INF).all()


def test_ranks_break_ties():
    base = {"alarm_score": 1.0, "event_recall": 0.5, "aaf": 2.0, "event_detection_delay": None}
    assert search.rank_key({**base, "aaf": 1.0}, "alarm_score") > search.rank_key(base, "alarm_score")
    assert search.rank_key({**base, "event_detection_delay": 0.3}, "alarm_score") > search.rank_key(base, "alarm_score")
    assert search.rank_key({**base, "alarm_score": None, "event_recall": 1.0}, "alarm_score") < search.rank_key(base, "alarm_score")


def test_flat_runs_as_sequences(spark):
    flat = spark.createDataFrame([("r", t, s, t % 2) for t, s in enumerate([-INF, 0.1, 0.2, -INF, 0.3])], "run_key string, t long, score double, label int")
    got = [(r.sequence_id, r.t, r.score, r.label) for r in alarms.sequences_of(flat).orderBy("sequence_id", "t").collect()]
    assert got == [(0, 0, 0.1, 1), (0, 1, 0.2, 0), (1, 0, 0.3, 0)]


@pytest.mark.parametrize("width,span,enter,leave", [(1, 1, 1, 1), (3, 4, 3, 2), (2, 5, 2, 3)])
def test_online_alarms_over_any_cut(spark, width, span, enter, leave):
    rng = random.Random(width * 100 + enter)
    rows, got = [], {}
    for s in range(80):
        values = [rng.choice([0.1, 0.4, 0.6, 0.9, 1.2, 1.5, None]) if rng.random() < 0.9 else None for _ in range(rng.randrange(1, 30))]
        rows += [("r", s, t, v) for t, v in enumerate(values)]
        held, at, out = None, 0, []
        while at < len(values):
            to = min(len(values), at + rng.randrange(1, 9))
            a = stream._Alarms(width, span, 1.0, 0.5, enter, leave, held)
            a.add(pd.Series(range(at, to)).to_numpy(), pd.Series(values[at:to], dtype=float).to_numpy())
            if to == len(values):
                a.flush()
            held, at = a.held(), to
            out += a.out
        assert [r[0] for r in out] == list(range(len(values)))
        got |= {(s, t): (d, p) for t, _, d, p in out}
    df = alarms.decision_scores(spark.createDataFrame(rows, "run_key string, sequence_id long, t long, score double"), width, span)
    for r in alarms.hysteresis(df, 1.0, 0.5, enter, leave).collect():
        d, p = got[r.sequence_id, r.t]
        assert p == r.pred and (d is None) == (r.decision == -INF) and (d is None or d == pytest.approx(r.decision))


def test_rows_that_come_late_are_an_error():
    a = stream._Alarms(2, 2, 1.0, 0.5, 1, 1, None)
    a.add(pd.Series([0, 1]).to_numpy(), pd.Series([0.0, 2.0]).to_numpy())
    with pytest.raises(ValueError):
        stream._Alarms(2, 2, 1.0, 0.5, 1, 1, a.held()).add(pd.Series([1]).to_numpy(), pd.Series([0.5]).to_numpy())
