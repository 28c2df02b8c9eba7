"""Preprocessing rules on a small table of known values, and exact quantiles both ways."""

import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.functions import staging
from tideglass.operators import preprocess as pp, scores as sc
from tideglass.sources import tables

FEATURES = ["const", "sparse", "spike", "long"]
TRAIN = [(1, 0, 1, 1), (1, 0, 1, 2), (1, 0, 1, 3), (1, 5, 1, 4), (1, 0, 1, 5), (1, 6, 1, 20), (1, 0, 1, 30), (1, 7, 100, 40)]
APPLY = [(1, 0, 1, 2), (1, 9, 200, 6), (1, 0, 1, 25), (1, 8, 1, 45)]
POLICY = pp.Policy(zero_frac=0.4, asinh_tail=1.1, side="upper", q_ref=0.75, q_top=0.95, max_tail_mass=0.4, min_jump_ratio=0.2, min_jump=0.1)


def frame(spark, rows):
    return spark.createDataFrame([("r", 1, i, *map(float, x)) for i, x in enumerate(rows)], "run_key string, sequence_id long, t long, " + ", ".join(f"{c} double" for c in FEATURES))


def test_rules_of_every_kind(spark):
    rules = {r.feature: r for r in pp.fit(frame(spark, TRAIN), FEATURES, POLICY)}
    assert [rules[c].kind for c in FEATURES] == ["almost_constant", "zero_inflated", "almost_constant", "extreme"]
    assert (rules["long"].low, rules["long"].high, rules["long"].asinh_scale) == (None, 22.5, None)
    filled = np.array([1, 2, 3, 4, 5, 20, 20, 20.0])
    assert rules["long"].center == pytest.approx(filled.mean()) and rules["long"].scale == pytest.approx(filled.std())
    squeezed = np.arcsinh(np.array([5, 6, 7]) / 6)
    assert rules["sparse"].asinh_scale == 6 and rules["sparse"].center == pytest.approx(squeezed.mean()) and rules["sparse"].scale == pytest.approx(squeezed.std())
    out = pp.apply(frame(spark, APPLY), list(rules.values()), clip_at=8.0).orderBy("t").collect()
    assert [r.const for r in out] == [0, 0, 0, 0] and [r.sparse__is_nonzero for r in out] == [0, 1, 0, 1]
    want = (np.arcsinh(np.array([0, 9, 0, 8]) / 6) - squeezed.mean()) / squeezed.std()
    assert [r.sparse__mag for r in out] == pytest.approx(np.clip(want, -8, 8).tolist())
    assert [r.long for r in out] == pytest.approx(((np.array([2, 6, 6, 6]) - filled.mean()) / filled.std()).tolist())
    assert [r.spike for r in out] == pytest.approx(np.clip(np.array([1, 200, 1, 1]) - 13.375, -8, 8).tolist())
    test = pp.apply(frame(spark, APPLY), list(rules.values()), mode="test").orderBy("t").collect()
    assert test[3].long == pytest.approx((45 - filled.mean()) / filled.std())


def test_missing_values_and_features(spark):
    rows = frame(spark, TRAIN).withColumn("none", pp.F.lit(None).cast("double")).withColumn("text", pp.F.lit("bad"))
    rules = {r.feature: r for r in pp.fit(rows, ["none", "text", "long"], POLICY)}
    assert (rules["none"].center, rules["none"].scale, rules["text"].kind) == (0.0, 1.0, "robust")
    assert pp.fit(rows.where("false"), ["long"], POLICY)[0].scale == 1.0
    with pytest.warns(UserWarning, match="unknown"):
        assert pp.without_features(rows, FEATURES, ["long", "unknown"]) == FEATURES[:3]
    with pytest.raises(ValueError):
        pp.without_features(rows, ["long"], ["long"])
    with pytest.raises(KeyError):
        pp.without_features(rows, ["elsewhere"], [])
    with pytest.raises(ValueError):
        pp.Policy(asinh_mode="mean")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert pp.without_features(rows, FEATURES, []) == FEATURES


@pytest.mark.parametrize("small,accuracy", [(1_000_000, 1000), (1_000_000, 20), (10, 20)])
def test_quantiles_equal_numpy(spark, monkeypatch, small, accuracy):
    """In one window, with brackets that leave most rows out, and by running totals over ranges."""
    monkeypatch.setattr(staging, "SMALL", small)
    monkeypatch.setattr(staging, "ACCURACY", accuracy)
    monkeypatch.setattr(staging, "MARGIN", 3 / accuracy)
    rng = random.Random(4)
    values = {k: [rng.choice([round(rng.gauss(0, 3), 1), rng.random()]) for _ in range(n)] for k, n in (("a", 3000), ("b", 1), ("c", 64), (None, 5))}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    at = (0.0, 0.005, 0.25, 0.5, 0.9, 1.0)
    found, counts = staging.bracketed(df, ["k"], "v", at, {"most": pp.F.max("v")})
    got = {r.k: r for r in found.collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        assert got[k].q == pytest.approx(np.quantile(vs, at).tolist()) and got[k].most == max(vs)
    assert counts.agg(pp.F.sum("n")).first()[0] == sum(map(len, values.values()))
    assert accuracy < 1000 or counts.where("k = 'a'").count() < 400
    assert staging.exact_quantiles(df.where("false"), ["k"], "v", at).count() == 0


def test_infinite_values_have_quantiles(spark):
    df = spark.createDataFrame([("a", v) for v in [float("-inf")] * 5 + [1.0, 2.0] + [float("inf")] * 3], "k string, v double")
    assert staging.exact_quantiles(df, ["k"], "v", (0.0, 0.5, 0.6, 1.0)).first().q == [float("-inf"), float("-inf"), pytest.approx(1.4), float("inf")]


def test_top_cosines_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(sc, "BLOCK", 50)
    x = np.random.default_rng(1).normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -9)
    want = {i: 1 - np.sort(c[i])[-3:].mean() for i in range(0, 300, 20)}
    got = {r.vec_id: r.score for r in sc.knn_novelty(df.where("vec_id % 20 = 0"), df).collect()}
    assert got == pytest.approx(want)
    assert sc.knn_novelty(df.where("vec_id < 2"), df.where("false")).count() == 0


def test_variants_and_sources(spark):
    assert tables.resolved_variant("x_ext", ["a", "b", "c"], ["c", "a", "z"]) == ("x", ["a", "c"], True)
    assert tables.resolved_variant("plain", ["a"], []) == ("plain", ["a"], False)
    with pytest.raises(ValueError):
        tables.resolved_variant("x_red", ["a"], ["b"])
    with pytest.raises(ValueError):
        pp.all_of([])
    files = spark.createDataFrame([("d/train_a.csv",), ("d/test_a.csv",)], "path string")
    assert [r.path for r in tables.train_files(files).collect()] == ["d/train_a.csv"]


def test_staged_tables_can_be_swept_away(spark):
    df = staging.staged(spark.range(5).toDF("x"))
    assert df.count() == 5 and staging.sweep_away(spark) >= 1 and staging.sweep_away(spark) == 0


def test_splits_take_fractions_as_written(spark):
    """90 * 0.7 is less than 63 in doubles; the border is floor(0.7 * n) in decimals, as SQL has it."""
    rows = spark.range(90).select(F.lit("r").alias("run_key"), F.lit(1).cast("long").alias("sequence_id"), F.col("id").alias("t"))
    seqs = spark.range(90).select(F.lit("r").alias("run_key"), F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("t"))
    counts = lambda df: {r.part: r["count"] for r in df.groupBy("part").count().collect()}
    assert counts(pp.time_split(rows, 0.7)) == counts(pp.sequence_split(seqs, 0.7)) == {"train": 63, "val": 27}
    assert counts(pp.overlapping_split(rows, 0.7, 10)) == {"train": 63, "val": 37}


def test_quantiles_of_columns_side_by_side(spark, monkeypatch):
    """Equal to NumPy with brackets and where tasks hand on what they hold; no row is made of a cell."""
    monkeypatch.setattr(staging, "HELD", 500)
    rng = np.random.default_rng(5)
    x = {"a": rng.normal(size=6000), "b": np.round(rng.normal(size=6000), 1), "c": np.where(rng.random(6000) < 0.7, 0.0, rng.normal(size=6000))}
    rows = [tuple(None if i % 7 == 3 else float(v[i]) for v in x.values()) + (None,) for i in range(6000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, none double").repartition(3)
    found, counts = staging.column_quantiles(df, ["a", "b", "c", "none"], (0.0, 0.25, 0.995), lambda c: {"n_total": pp.F.count("*")})
    got, keep = {r.feature: r for r in found.collect()}, np.arange(6000) % 7 != 3
    assert set(got) == {"a", "b", "c"} and got["a"].n_total == 6000
    for c, v in x.items():
        assert got[c].q == pytest.approx(np.quantile(v[keep], (0.0, 0.25, 0.995)).tolist())
        assert counts.where(pp.F.col("feature") == c).agg(pp.F.sum("n")).first()[0] == keep.sum()
    report = pp.report_of(df, ["a", "b", "c", "none"])
    assert {r.feature: r.n_unique for r in report.collect()}["b"] == len(np.unique(x["b"][keep]))
    assert pp.report_of(df.where("a > 1e9"), ["a"]).count() == 0
    assert "explode" not in staging.column_counts(df, ["a"], {"a": [(0.0, 1.0)]})._jdf.queryExecution().optimizedPlan().toString()
