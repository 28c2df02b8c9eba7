"""Matrix work over many channels against NumPy, whole and in pieces, and the time that 244 channels take."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideglass.operators import regimes as rg, wide

NAMES = [f"c{i}" for i in range(7)]


def table(spark, lengths, c, seed=1, gaps=0.0):
    r = np.random.default_rng(seed)
    frames = []
    for s, n in enumerate(lengths):
        x = np.cumsum(r.normal(size=(n, c)), axis=0) + 1000.0 * np.arange(c)
        x[:, c // 2] = 0.1  # a constant channel
        if gaps:
            x[r.random(x.shape) < gaps] = np.nan
        frames.append(pd.DataFrame(x, columns=[f"c{i}" for i in range(c)]).assign(run_key="r", sequence_id=s, t=range(n), label=0, regime=np.arange(n) // 10 % 2))
    pdf = pd.concat(frames, ignore_index=True)
    df = spark.createDataFrame(pdf)
    return pdf, df.select(*("run_key", "sequence_id", "t", "label", "regime"), *(F.when(~F.isnan(f"c{i}"), F.col(f"c{i}")).alias(f"c{i}") for i in range(c))).repartition(6)


@pytest.fixture(params=[1 << 22, 200], ids=["whole", "pieces"])
def cells(request, monkeypatch):
    monkeypatch.setattr(wide, "CELLS", request.param)


def frames_of(x, width):
    return [x[max(0, i - width + 1) : i + 1] for i in range(len(x))]


def test_moments_and_graph(spark, monkeypatch):
    monkeypatch.setattr(wide, "BLOCK", 3)
    pdf, df = table(spark, [90, 40], 7)
    m = wide.whole(wide.moments(df, NAMES), 7)[0]
    x = pdf[NAMES].to_numpy()
    assert m.n == len(x) and np.allclose(m.mean, x.mean(axis=0)) and np.allclose(m.m2 / m.n, np.cov(x.T, bias=True), atol=1e-6)
    cos = (x.T @ x) / np.sqrt(np.outer((x * x).sum(axis=0), (x * x).sum(axis=0)))
    want = {}
    for a in range(7):
        for b in sorted((b for b in range(7) if b != a), key=lambda b: (-cos[a, b], b))[:2]:
            want[f"c{a}", f"c{b}"] = want[f"c{b}", f"c{a}"] = 1 / (1 + np.exp(-cos[a, b]))
    got = {(r.a, r.b): r.weight for r in wide.channel_graph(df, NAMES, 2).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    loops = {(r.a, r.b): r.weight for r in wide.channel_graph(df, NAMES, 2, self_loops=True).collect()}
    assert {k: v for k, v in loops.items() if k[0] != k[1]} == pytest.approx(want) and sum(a == b for a, b in loops) == 7
    assert wide.channel_graph(df.where("false"), NAMES, 2).count() == 0


@pytest.mark.parametrize("gaps", [0.0, 0.05])
def test_summaries_and_correlations_of_frames(cells, gaps):
    r = np.random.default_rng(3)
    x = np.cumsum(r.normal(size=(700, 5)), axis=0) + 1e6
    x[r.random(x.shape) < gaps] = np.nan
    mean, std, _ = wide.summary(x, 9)
    got = np.full((700, 5, 5), np.nan)
    for rows, m, s, corr in wide.rolling_correlations(x, 9, 1e-6):
        got[rows, s] = corr
    with np.errstate(invalid="ignore", divide="ignore"):
        for i, f in enumerate(frames_of(x, 9)):
            for a in range(5):
                v = f[~np.isnan(f[:, a]), a]
                assert len(v) == 0 or (np.isclose(mean[i, a], v.mean()) and np.isclose(std[i, a], v.std(), atol=1e-6))
                for b in range(5):
                    both = f[~np.isnan(f[:, [a, b]]).any(axis=1)]
                    if len(both):
                        sd = [max(np.nanvar(f[:, k]), 1e-6) ** 0.5 for k in (a, b)]
                        cov = ((both[:, a] - both[:, a].mean()) * (both[:, b] - both[:, b].mean())).mean()
                        assert np.isclose(got[i, a, b], cov / (sd[0] * sd[1]), atol=1e-5)


def test_similarity_drift_and_structure_in_pieces(spark, cells):
    pdf, df = table(spark, [1, 30, 260], 7)
    parts = [pd.concat([g[NAMES].rolling(6, min_periods=1).mean(), g[NAMES].rolling(6, min_periods=1).std(ddof=0)], axis=1) for _, g in pdf.groupby("sequence_id")]
    mean = np.corrcoef(pd.concat([p.iloc[:, :7] for p in parts]).drop(columns="c3").to_numpy().T)
    std = np.corrcoef(pd.concat([p.iloc[:, 7:] for p in parts]).drop(columns="c3").to_numpy().T)
    slope = np.corrcoef(np.concatenate([_slopes(g[NAMES].to_numpy(), 6) for _, g in pdf.groupby("sequence_id")])[:, [0, 1, 2, 4, 5, 6]].T)
    got = rg.channel_similarity(df, NAMES, 6)
    off = ~np.eye(6, dtype=bool)
    assert np.allclose(got[np.ix_([0, 1, 2, 4, 5, 6], [0, 1, 2, 4, 5, 6])][off], (np.abs(mean + std + slope) / 3)[off], atol=1e-6)
    assert (got[3, [0, 1, 2, 4, 5, 6]] == 0).all()

    blocks = [["c0", "c1", "c5"], ["c2"], ["c3", "c4"]]
    refs = rg.drift_references(df, blocks, [4, 11], F.col("t") % 3 > 0)
    scores = rg.slow_drift(df, refs).orderBy("sequence_id", "t").toPandas()
    assert len(scores) == len(pdf) and np.allclose(scores["score"], _drift(pdf, blocks, [4, 11], pdf["t"] % 3 > 0), atol=1e-5)

    normal = rg.structure_reference(df.where("sequence_id = 2"), NAMES, 12, 5)
    patches = {(s, i): _corr(x[i : i + 12]) for s, x in ((s, g[NAMES].to_numpy()) for s, g in pdf.groupby("sequence_id")) for i in range(0, len(x) - 11, 5)}
    assert np.allclose(normal, np.mean([c for (s, _), c in patches.items() if s == 2], axis=0))
    got = {(r.sequence_id, r.patch_start): r.score for r in rg.structural_score(df, normal, NAMES, 12, 5).collect()}
    assert got == {k: pytest.approx(float(np.sqrt(((c - normal) ** 2).sum())), abs=1e-6) for k, c in patches.items()}


def _slopes(x, w):
    return np.array([(x[i] - x[max(0, i - w + 1)]) / max(1, min(i, w - 1)) for i in range(len(x))])


def _corr(x):
    cov = np.cov(x.T, bias=True)
    return cov / np.sqrt(np.outer(np.diag(cov) + 1e-6, np.diag(cov) + 1e-6))


def _drift(pdf, blocks, widths, counts):
    out = np.full(len(pdf), -np.inf)
    for w in widths:
        for b in blocks:
            frames = [f for _, g in pdf.groupby("sequence_id") for f in frames_of(g[b].to_numpy(), w)]
            mean = np.array([f.mean(axis=0) for f in frames])
            cov = np.array([np.atleast_2d(np.cov(f.T, bias=True)) for f in frames])
            sd = np.sqrt(np.maximum(np.diagonal(cov, axis1=1, axis2=2), 1e-6))
            corr = cov / (sd[:, :, None] * sd[:, None, :])
            for r in (0, 1):
                ref, now = ((pdf["regime"] == r) & counts).to_numpy(), (pdf["regime"] == r).to_numpy()
                dev = mean[ref].std(axis=0)
                shift = np.abs((mean[now] - mean[ref].mean(axis=0)) / np.where(dev < 1e-6, 1.0, dev)).mean(axis=1)
                turn = np.abs(corr[now] - corr[ref].mean(axis=0)).sum(axis=(1, 2)) / len(b) ** 2 if len(b) > 1 else 0.0
                out[now] = np.maximum(out[now], shift + turn)
    return out


def test_244_channels(spark):
    names = [f"c{i}" for i in range(244)]
    x = np.random.default_rng(2).normal(size=(2000, 244))
    pdf = pd.DataFrame(x, columns=names).assign(run_key="r", sequence_id=np.repeat(range(4), 500), t=np.tile(range(500), 4), label=0, regime=0)
    df = spark.createDataFrame(pdf).repartition(8).cache()
    df.count()
    took = {}
    for name, f in {
        "graph": lambda: wide.channel_graph(df, names, 5).count(), "blocks": lambda: rg.channel_blocks(df, names, 16),
        "structure": lambda: rg.structural_score(df, rg.structure_reference(df, names, 96, 8), names, 96, 8).count(),
        "drift": lambda: rg.slow_drift(df, rg.drift_references(df, [names[:122], names[122:]], [16, 64])).agg(F.max("score")).first(),
    }.items():
        began = time.time()
        f()
        took[name] = time.time() - began
    df.unpersist()
    assert max(took.values()) < 60, took  # under 20 s each on 8 idle cores
    print(took)
