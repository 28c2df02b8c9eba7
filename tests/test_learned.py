"""Fitted detectors against NumPy, and raw files against the file system."""

import os

import numpy as np
import pytest

from tideglass.operators import windows as wd
from tideglass.plans import learned
from tideglass.sources import tables


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    rows = [("r", s, t, float(np.sin(t / 3) + 0.1 * rng.normal()), float(rng.normal() + 5 * (t > 30)), float(np.sin(2 * np.pi * t / 8)), 0) for s in range(4) for t in range(64)]
    return spark.createDataFrame(rows, "run_key string, sequence_id long, t long, a double, b double, score double, label int")


def test_pca_residual(series):
    windows = wd.sliding_windows(series, ["a", "b"], 4, 2)
    rows = {(r.sequence_id, r.t_end): np.array([[x.a, x.b] for x in r.w]).ravel() for r in windows.collect()}
    x = np.array(list(rows.values()))
    c = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / (len(x) - 1))
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), 0.9)) + 1
    left = c - c @ vectors[:, :k] @ vectors[:, :k].T
    want = dict(zip(rows, np.linalg.norm(left, axis=1)))
    got = {(r.sequence_id, r.t_end): r.score for r in learned.pca_residual(windows, 0.9).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_kmeans_distance_is_to_the_nearest_centre(series):
    windows = wd.sliding_windows(series, ["a", "b"], 4, 2)
    rows = {(r.sequence_id, r.t_end): np.array([[x.a, x.b] for x in r.w]).ravel() for r in windows.collect()}
    got = {(r.sequence_id, r.t_end): (r.cluster, r.score) for r in learned.kmeans_distance(windows, 2).collect()}
    assert set(got) == set(rows) and {c for c, _ in got.values()} == {0, 1}
    centres = [np.mean([rows[k] for k, (c, _) in got.items() if c == i], axis=0) for i in (0, 1)]
    for k, (_, score) in got.items():
        assert score == pytest.approx(min(np.linalg.norm(rows[k] - c) for c in centres), abs=0.05)


def test_dominant_periods(series):
    found = learned.dominant_periods(series, 1).first()
    assert found.period == 8 and found.place == 1 and found.amplitude == pytest.approx(0.5, abs=1e-6)


def test_coreset_covers_better_than_chance(spark, monkeypatch):
    monkeypatch.setattr(learned, "CORESET_BLOCK", 200)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(1, 8)) + 0.05 * rng.normal(size=(n, 8)) for n in (700, 30, 30, 30, 30, 30, 30, 30, 30, 30)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(10**6, None)], "vec_id long, embedding array<double>")
    chosen = sorted(r.vec_id for r in learned.coreset(df, 0.1).collect())
    assert 0.05 * len(x) < len(chosen) <= 0.11 * len(x) and len(set(chosen)) == len(chosen)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    away = lambda ids: np.sqrt(np.maximum(0, 2 - 2 * u @ u[ids].T)).min(axis=1).mean()
    assert away(chosen) < away(rng.choice(len(x), len(chosen), replace=False))
    assert learned.coreset(df.where("false"), 0.1).count() == 0


def test_coreset_is_of_the_whole_table(spark, monkeypatch):
    """Cut into cells, the mean distance to the coreset is near that of one clustering of all rows of sf0.1."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    x = {r.vec_id: np.array(r.embedding, float) for r in df.where("embedding is not null").collect()}
    ids = sorted(x)
    u = np.array([x[i] / np.linalg.norm(x[i]) for i in ids])

    def away(chosen) -> float:
        c = u[np.searchsorted(ids, sorted(chosen))]
        return float(np.sqrt(np.maximum(0, 2 - 2 * u @ c.T)).min(axis=1).mean())

    at_once = [r.vec_id for r in learned.coreset(df, 0.1).collect()]
    monkeypatch.setattr(learned, "CORESET_BLOCK", 100)
    monkeypatch.setattr(learned, "CELLS", 5)
    monkeypatch.setattr(learned, "FAN", 4)
    found = learned.coreset(df, 0.1).collect()
    in_cells = [r.vec_id for r in found]
    assert len({r.cell for r in found}) > 5 and len(in_cells) == len(set(in_cells))
    assert len(in_cells) < 1.1 * len(at_once)
    assert away(in_cells) < 1.1 * away(at_once)


def test_provenance_is_what_the_file_system_says(spark, tmp_path):
    for name, size in (("a/x.csv", 10), ("b.csv", 0), ("a/c/d.txt", 7)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    got = {r.path.removeprefix(f"file:{tmp_path}/"): (r.length, int(r.modificationTime.timestamp())) for r in tables.provenance(spark, str(tmp_path)).collect()}
    assert got == {n: (os.stat(tmp_path / n).st_size, int(os.stat(tmp_path / n).st_mtime)) for n in ("a/x.csv", "a/c/d.txt")}


def test_windows_are_built_once(series):
    """Models read staged vectors: no window is left to work out in what comes back."""
    windows = wd.sliding_windows(series, ["a", "b"], 4, 2)
    for out in (learned.pca_residual(windows, 0.9), learned.kmeans_distance(windows, 2)):
        assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
