import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideglass.operators import preprocess as pp, regimes as rg, report
from tideglass.streaming import alarms as stream


@pytest.fixture(scope="module")
def plant(spark):
    """Two channels that move together, one constant, one of noise; the level of the first two has two regimes."""
    r = np.random.default_rng(7)
    rows = []
    for s in range(4):
        level = np.repeat(r.integers(0, 2, 6) * 50.0, 20)
        a = level + r.normal(size=120)
        rows += [("r", s, t, float(a[t]), float(2 * a[t] + r.normal() * 0.1), 3.0, float(r.normal()), 0, int(level[t] > 0)) for t in range(120)]
    return spark.createDataFrame(rows, "run_key string, sequence_id long, t long, a double, b double, c double, d double, label long, truth int")


def test_blocks(plant):
    assert rg.channel_blocks(plant, ["a", "b", "c", "d"], 8) == [["a", "b"], ["c"], ["d"]]
    assert rg.channel_blocks(plant, ["c"], 8) == [["c"]]


def test_regimes_follow_the_level(plant):
    model = rg.fit_regimes(plant, ["a", "b", "c", "d"], 2, 2, 1)
    assert model.channels in (["a"], ["b"])
    out = model.assign(plant).groupBy("truth", "regime").count().toPandas()
    top = out.sort_values("count").groupby("truth").tail(1)
    assert top["regime"].nunique() == 2 and top["count"].sum() > 0.9 * 480


def test_slow_drift_against_numpy(plant):
    blocks, widths = [["a", "b"], ["d"]], [5]
    rows = plant.withColumn("regime", F.col("truth"))
    refs = rg.drift_references(rows.where("truth = 0"), blocks, widths)  # regime 1 falls back to all rows
    got = rg.slow_drift(rows, refs).orderBy("sequence_id", "t").toPandas()["score"].to_numpy()
    pdf = plant.where("truth = 0").toPandas().sort_values(["sequence_id", "t"])
    frames = lambda p: pd.concat([_frames(g) for _, g in p.groupby("sequence_id")])
    ref, now = frames(pdf), frames(plant.toPandas().sort_values(["sequence_id", "t"]))
    sd = lambda x: max(x.std(ddof=0), 1e-6)
    shift = {c: (now[c] - ref[c].mean()).abs() / sd(ref[c]) for c in "abd"}
    turn = sum(n * (now[k] - ref[k].mean()).abs() for k, n in (("aa", 1), ("bb", 1), ("ab", 2))) / 4
    want = np.maximum((shift["a"] + shift["b"]) / 2 + turn, shift["d"])
    assert np.allclose(got, want, atol=1e-6)


def _frames(g):
    out = pd.DataFrame({c: g[c].rolling(5, min_periods=1).mean() for c in "abd"})
    var = lambda x, y: ((x * y).rolling(5, min_periods=1).mean() - x.rolling(5, min_periods=1).mean() * y.rolling(5, min_periods=1).mean())
    for x, y in ("aa", "bb", "ab"):
        out[x + y] = var(g[x], g[y]) / np.sqrt(np.maximum(var(g[x], g[x]), 1e-6) * np.maximum(var(g[y], g[y]), 1e-6))
    return out


def test_stages(spark):
    rows = spark.createDataFrame([(m, s) for m in ("train", "val", "test", "train_ext") for s in ("real", "synthetic")], "mode string, source string")
    got = lambda *a: {(r.mode, r.source, r.stage, r.fits_scaler) for r in pp.stages(rows, *a).collect()}
    assert got("real") == {("train", "real", "train", True), ("val", "real", "val", False), ("test", "real", "test", False), ("train_ext", "real", "train_ext", True)}
    assert got("synthetic") == {("train", "synthetic", "train", False), ("val", "synthetic", "val", False), ("test", "real", "test", False), ("train", "real", "scaler", True)}
    assert ("test", "synthetic", "test", False) in got("synthetic", False)
    with pytest.raises(ValueError):
        pp.stages(rows, "both")


def test_result_files(spark):
    wide = spark.createDataFrame([("m", "d", "1.5"), ("n", "d", "x"), ("z", "d", "1")], "model string, dataset string, normalized_alarm_score_pct_mean string")
    names = spark.createDataFrame([("m",), ("n",)], "model string")
    good = report.checked_results(report.one_layout(wide), names, wide.select("dataset"))
    assert {tuple(r) for r in good.collect()} == {("m", "d", 1.5, None, "complete"), ("n", "d", None, None, "missing")}
    assert report.result_faults(good).isEmpty()
    bad = spark.createDataFrame([(1.0, 0.1, "missing"), (None, None, "complete"), (1.0, -1.0, "complete"), (1.0, 0.0, None), (1.0, 0.0, "complete")], "mean double, std double, status string")
    assert sorted(r.fault for r in report.result_faults(bad).collect()) == ["complete without a mean", "missing with a mean", "negative deviation", "unknown status"]
    with pytest.raises(ValueError):
        report.one_layout(names)


@pytest.mark.parametrize("n", [1, 3, 6, 17, 23])
def test_patch_stream_is_the_one_shot_score(spark, tmp_path, n):
    """Whatever the batches: each row's mean over its patches; short sequences are filled up in front."""
    length, stride = 6, 3
    x = np.random.default_rng(n).normal(size=n)
    rows = spark.createDataFrame([(1, t, float(v), t == n - 1) for t, v in enumerate(x)], "sequence_id long, t long, score double, last boolean")
    for lo, hi in ((0, 4), (5, 5), (6, 13), (14, 99)):
        part = rows.where(F.col("t").between(lo, hi)).coalesce(1)
        if not part.isEmpty():
            part.write.mode("append").parquet(f"{tmp_path}/in")
    read = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = stream.patch_scores(read, ["score"], length, stride, lambda p: p[:, :, 0].mean(axis=1))
    got = stream.run_to_table(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint").where("not late").orderBy("t").collect()
    padded = np.concatenate((np.repeat(x[:1], max(0, length - n)), x))
    starts = range(0, len(padded) - length + 1, stride)
    for r in got:
        cover = [padded[s : s + length].mean() for s in starts if n < length or s <= r.t < s + length]
        assert r.score == (pytest.approx(np.mean(cover)) if cover else None)
    assert [r.t for r in got] == list(range(n))


def test_training_rows_are_summed_up_once(spark, plant):
    """k-means and its statistics read a staged table of summaries."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rg.fit_regimes(plant.mapInPandas(count, plant.schema), ["a", "b", "c", "d"], 2, 2, 1)
    assert seen.value == plant.count()


def test_sequences_are_laid_out_without_a_second_shuffle(spark):
    from pyspark.sql import Window

    rows = spark.range(60).select(F.lit("r").alias("run_key"), (F.col("id") % 3).alias("sequence_id"), (-F.col("id")).alias("x"))
    rows = rows.withColumn("t", F.row_number().over(Window.partitionBy("sequence_id").orderBy("x")).cast("long") - 1)
    out = rg.wide.laid_out(rows, ["x"], 2, 0, ("sequence_id", "t"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    for task in out.rdd.glom().collect():
        cuts = [i for i in range(1, len(task)) if task[i].sequence_id != task[i - 1].sequence_id]
        assert len(cuts) == max(0, len({r.sequence_id for r in task}) - 1)
        assert all(b.t == a.t + 1 for a, b in zip(task, task[1:]) if a.sequence_id == b.sequence_id)
