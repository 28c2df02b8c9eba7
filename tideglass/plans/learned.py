"""Detectors that fit a model with pyspark.ml, and the way in for a user's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import KEYS
from ..functions.staging import staged


def flat(windows: DataFrame) -> DataFrame:
    """Windows as vectors, rows one after the other."""
    fields = windows.schema["w"].dataType.elementType.names
    values = F.flatten(F.transform("w", lambda r: F.array(*(r[f].cast("double") for f in fields))))
    return windows.select(*KEYS, "t_end", array_to_vector(values).alias("v"))


def _distance(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def pca_residual(windows: DataFrame, variance: float) -> DataFrame:
    """Distance of each window to its projection on as few components as have the given share of variance. Vectors are staged, as they are read several times."""
    rows = staged(flat(windows))
    width = rows.first()["v"].size
    fitted = PCA(k=width, inputCol="v", outputCol="p").fit(rows)
    share = np.cumsum(fitted.explainedVariance.toArray())
    k = int(np.searchsorted(share, min(variance, share[-1]))) + 1
    parts = fitted.pc.toArray()[:, :k]
    mean = rows.select(Summarizer.mean(F.col("v")).alias("m")).first()["m"].toArray()
    shift = parts.T @ mean
    p = F.slice(vector_to_array("p"), 1, k)
    centred = F.zip_with(p, F.array(*map(F.lit, shift.tolist())), lambda a, b: a - b)
    x = F.zip_with(vector_to_array("v"), F.array(*map(F.lit, mean.tolist())), lambda a, b: a - b)
    norm2 = lambda a: F.aggregate(a, F.lit(0.0), lambda s, y: s + y * y)
    return fitted.transform(rows).select(*KEYS, "t_end", F.sqrt(F.greatest(norm2(x) - norm2(centred), F.lit(0.0))).alias("score"))


def kmeans_distance(windows: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """Distance of each window to the nearest of k centres. Vectors are staged, as they are read several times."""
    rows = staged(flat(windows))
    model = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster").fit(rows)
    centres = F.array(*(F.array(*map(F.lit, x.tolist())) for x in model.clusterCenters()))
    return model.transform(rows).select(*KEYS, "t_end", "cluster", _distance(vector_to_array("v"), F.get(centres, F.col("cluster"))).alias("score"))


CORESET_BLOCK = 4096  # vectors whose centres are sought together
CELLS = 32  # cells that a cell is cut into
SUMMARY = 256  # weighted points that stand for a block, or for blocks merged
FAN = 64  # summaries merged at once


def _lloyd(x: np.ndarray, weight: np.ndarray, k: int, seed: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted k-means from points drawn by seed, in an order that is the points' own: centres, and the weight of each."""
    order = np.lexsort(x.T[::-1])
    x, weight = x[order], weight[order]
    centres = x[np.sort(np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False))]
    for i in range(rounds + 1):
        near = (-2 * x @ centres.T + (centres * centres).sum(axis=1)).argmin(axis=1)
        held = np.bincount(near, weight, len(centres))
        if i < rounds:
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x * weight[:, None])
            centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1e-300)[:, None], centres)
    return centres[held > 0], held[held > 0]


def _units(column: pa.ChunkedArray) -> np.ndarray:
    v = np.array(column.to_pylist(), float)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _in_blocks(rows: DataFrame) -> DataFrame:
    """rows(cell, ...) with block: a cell's rows dealt by a hash of their id into blocks of about CORESET_BLOCK."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / CORESET_BLOCK).alias("_n"))
    return rows.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("_n")).cast("int")).drop("_n")


def _cut(rows: DataFrame, blocks: int, seed: int, rounds: int) -> DataFrame:
    """Each row of rows(cell, vec_id, embedding) in one of CELLS cells of its cell, by the nearest centre of the cell's own.

    Every block is reduced to weighted points, these are merged and reduced in a tree, and the cell's centres are those of
    what is left: no task holds more than a block or FAN summaries, and a cell with most of the rows is many tasks.
    """

    def pack(group: pa.Table) -> pa.Table:
        v = _units(group.column("embedding"))
        points, held = _lloyd(v, np.ones(len(v)), SUMMARY, seed, 3)
        values = (group.column("vec_id").to_pylist(), v.tobytes(), points.tobytes(), held.tobytes())
        kinds = (pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
        return pa.table([group.column("cell").slice(0, 1), group.column("block").slice(0, 1), *(pa.array([x], k) for x, k in zip(values, kinds))], ["cell", "block", "ids", "data", "points", "held"])

    packed = staged(_in_blocks(rows).groupBy("cell", "block").applyInArrow(pack, "cell long, block int, ids array<long>, data binary, points binary, held binary"))

    def merge(k: int, rounds: int):
        def run(group: pa.Table) -> pa.Table:
            held = [np.frombuffer(x) for x in group.column("held").to_pylist()]
            points = np.concatenate([np.frombuffer(x).reshape(len(h), -1) for x, h in zip(group.column("points").to_pylist(), held)])
            points, held = _lloyd(points, np.concatenate(held), k, seed, rounds)
            return pa.table([group.column("cell").slice(0, 1), group.column("block").slice(0, 1), pa.array([points.tobytes()], pa.binary()), pa.array([held.tobytes()], pa.binary())], ["cell", "block", "points", "held"])

        return run

    parts, kinds = packed.select("cell", "block", "points", "held"), "cell long, block int, points binary, held binary"
    while blocks > FAN:
        parts = parts.withColumn("block", F.floor(F.col("block") / FAN).cast("int")).groupBy("cell", "block").applyInArrow(merge(SUMMARY, 3), kinds)
        blocks = -(-blocks // FAN)
    centres = staged(parts.withColumn("block", F.lit(0)).groupBy("cell").applyInArrow(merge(CELLS, rounds), kinds).select("cell", F.col("points").alias("centres")))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, ids, data, centre in zip(*(batch.column(c) for c in ("cell", "ids", "data", "centres"))):
                v = np.frombuffer(data.as_py()).reshape(len(ids), -1)
                c = np.frombuffer(centre.as_py()).reshape(-1, v.shape[1])
                near = (-2 * v @ c.T + (c * c).sum(axis=1)).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.as_py() * CELLS + near, pa.int64()), ids.values, pa.array(list(v), pa.list_(pa.float64()))], ["cell", "vec_id", "embedding"])

    # a row of packed is a block, so centres are joined once for each block
    return staged(packed.join(centres, "cell").select("cell", "ids", "data", "centres").mapInArrow(assign, "cell long, vec_id long, embedding array<double>"))


def coreset(embeddings: DataFrame, ratio: float, seed: int = 1, rounds: int = 10) -> DataFrame:
    """cell, block, vec_id: of every block of vectors, the real ones nearest to ratio * size centres, after normalisation.

    The table is cut into cells of vectors that lie together (see _cut), as often as it takes for the mean cell to be a block, so work is
    rows times CELLS for each cut, of which there are as many as the logarithm of the rows. Then each cell is clustered by itself (Lloyd's
    rounds from vectors drawn by seed). A cell of more than CORESET_BLOCK vectors, as of many that are alike, is
    dealt into blocks by a hash of their id. Null vectors are left out.
    """
    rows = embeddings.where("embedding is not null").select(F.lit(0).cast("long").alias("cell"), "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = rows.count()
    cells = 1
    while cells * CORESET_BLOCK < n:
        rows = _cut(rows, -(-n // CORESET_BLOCK), seed, rounds)
        cells *= CELLS

    def pick(group: pa.Table) -> pa.Table:
        ids = np.array(group.column("vec_id").to_pylist(), np.int64)
        order = np.argsort(ids, kind="stable")
        v = _units(group.column("embedding"))[order]
        centres, _ = _lloyd(v, np.ones(len(v)), max(1, int(round(ratio * len(v)))), seed, rounds)
        chosen = np.unique((-2 * v @ centres.T + (centres * centres).sum(axis=1)).argmin(axis=0))
        first = [pa.array([group.column(c)[0].as_py()] * len(chosen), k) for c, k in (("cell", pa.int64()), ("block", pa.int32()))]
        return pa.table([*first, pa.array(ids[order][chosen])], ["cell", "block", "vec_id"])

    return _in_blocks(rows).groupBy("cell", "block").applyInArrow(pick, "cell long, block int, vec_id long")


def dominant_periods(series: DataFrame, top: int) -> DataFrame:
    """The periods with the most spectral amplitude, averaged over sequences."""

    def spectrum(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("t")["score"].to_numpy(float)
        amp = np.abs(np.fft.rfft(x - x.mean()))[1:]
        return pd.DataFrame({"period": np.round(len(x) / np.arange(1, len(amp) + 1)).astype(np.int64), "amplitude": amp / max(1, len(x))})

    found = series.select("sequence_id", "t", "score").groupBy("sequence_id").applyInPandas(spectrum, "period long, amplitude double")
    by = found.groupBy("period").agg(F.avg("amplitude").alias("amplitude"))
    return by.withColumn("place", F.row_number().over(Window.orderBy(F.desc("amplitude"), "period"))).where(F.col("place") <= top)  # one row for each period


def score_with(series: DataFrame, model: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Scores of a user's fitted model, given a sequence at a time in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        return pd.DataFrame({"run_key": pdf["run_key"], "sequence_id": pdf["sequence_id"], "t": pdf["t"], "score": model(pdf)})

    return series.groupBy(*KEYS).applyInPandas(run, "run_key string, sequence_id long, t long, score double")
