"""Drift that depends on the operating regime: channel blocks and regimes; references of each and scores against them are in wide.py.

Blocks, regimes and references are as many as channels and settings, whatever the number of rows; they are all
that reaches the driver or is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import trailing
from ..functions.staging import staged
from . import wide
from .scores import top_cosines, unit
from .wide import drift_references, slow_drift, structural_score, structure_reference  # noqa: F401

KINDS = ("mean", "std", "slope")
FLOOR = 1e-6


def summaries(df: DataFrame, features: list[str], width: int) -> DataFrame:
    """df with mean_, std_ and slope_ of each feature over the last width rows."""
    w = trailing(width)
    n = F.count("*").over(w)
    more = {}
    for c in features:
        slope = F.when(n > 1, (F.col(c) - F.first(c).over(w)) / (n - 1)).otherwise(0.0)
        more |= {f"mean_{c}": F.avg(c).over(w), f"std_{c}": F.stddev_pop(c).over(w), f"slope_{c}": slope}
    return df.withColumns(more)


def channel_similarity(df: DataFrame, features: list[str], width: int) -> np.ndarray:
    """|correlation| of the channels' signatures: their normalised window means, deviations and slopes, end to end."""
    found = wide.whole(wide.summary_moments(df, features, width), len(features))
    same = np.full((len(KINDS), len(features), len(features)), np.nan)
    for kind, m in found.items():
        sd = np.sqrt(np.diag(m.m2))
        with np.errstate(invalid="ignore", divide="ignore"):
            same[kind] = m.m2 / np.outer(sd, sd)
    off = np.where(np.eye(len(features), dtype=bool), np.nan, same)  # a constant channel correlates with nothing
    n = (~np.isnan(off)).any(axis=2).sum(axis=0)
    out = np.abs(np.nan_to_num(same).sum(axis=0)) / np.sqrt(np.maximum(1, np.outer(n, n)))
    np.fill_diagonal(out, 1.0)
    return out


def channel_blocks(df: DataFrame, features: list[str], width: int, least: float = 0.6) -> list[list[str]]:
    """Channels joined by chains of similarities of at least least; a channel like no other is a block alone."""
    near = channel_similarity(df, features, width) >= least
    block = np.arange(len(features))
    for _ in features:  # the longest chain has as many links as there are channels
        block = np.array([block[row].min() for row in near])
    return [[features[i] for i in np.flatnonzero(block == b)] for b in np.unique(block)]


@dataclass
class Regimes:
    """Centres of window summaries of the channels that tell regimes apart best."""

    channels: list[str]
    width: int
    mean: list[float]
    scale: list[float]
    centres: list[list[float]]

    def assign(self, df: DataFrame) -> DataFrame:
        """df with regime: the nearest centre of each row's summaries."""
        v = _normed(self.channels, self.mean, self.scale)
        away = lambda c: sum((a - F.lit(x)) * (a - F.lit(x)) for a, x in zip(v, c))
        nearest = F.array_min(F.array(*(F.struct(away(c).alias("away"), F.lit(i).alias("i")) for i, c in enumerate(self.centres))))
        return summaries(df, self.channels, self.width).withColumn("regime", nearest["i"]).select(*df.columns, "regime")


def _normed(channels: list[str], mean: list[float], scale: list[float]) -> list[Column]:
    return [(F.col(f"{k}_{c}") - m) / s for (k, c), m, s in zip(((k, c) for k in KINDS for c in channels), mean, scale)]


def _spread(rows: DataFrame, channels: list[str]) -> tuple[list[float], list[float]]:
    names = [f"{k}_{c}" for k in KINDS for c in channels]
    one = rows.agg(*(F.avg(n) for n in names), *(F.stddev_pop(n) for n in names)).first()
    scale = [s if s is not None and s >= FLOOR else 1.0 for s in one[len(names) :]]
    return [m or 0.0 for m in one[: len(names)]], scale


def separation(clustered: DataFrame, channels: list[str]) -> dict[str, float]:
    """How far the clusters lie apart for each channel: variance between them by variance within, over all summaries."""
    names = [f"{k}_{c}" for k in KINDS for c in channels]
    by = clustered.groupBy("cluster").agg(F.count("*").alias("n"), *(F.avg(x).alias(f"a_{x}") for x in names), *(F.var_pop(x).alias(f"v_{x}") for x in names)).collect()  # one row for each cluster
    n = np.array([r["n"] for r in by], float)
    out = {}
    for c in channels:
        between = within = 0.0
        for k in KINDS:
            a, v = (np.array([r[f"{p}_{k}_{c}"] for r in by], float) for p in "av")
            between += float((n * (a - (n * a).sum() / n.sum()) ** 2).sum())
            within += float((n * v).sum())
        out[c] = between / (within + FLOOR)
    return out


def fit_regimes(train: DataFrame, features: list[str], width: int, count: int, top: int, seed: int = 1) -> Regimes:
    """k-means on the summaries of all channels, then again on those of the top channels by separation."""

    def cluster(channels: list[str]):
        mean, scale = _spread(rows, channels)
        vectors = rows.withColumn("v", array_to_vector(F.array(*_normed(channels, mean, scale))))
        model = KMeans(k=max(2, count), seed=seed, featuresCol="v", predictionCol="cluster").fit(vectors)
        return model, vectors, mean, scale

    names = [f"{k}_{c}" for k in KINDS for c in features]
    rows = staged(summaries(train, features, width).select(*names))  # read a dozen times
    model, vectors, _, _ = cluster(features)
    apart = separation(model.transform(vectors), features)
    best = set(sorted(features, key=lambda c: (-apart[c], c))[: max(1, top)])
    chosen = [c for c in features if c in best]
    model, _, mean, scale = cluster(chosen)
    return Regimes(chosen, width, mean, scale, [c.tolist() for c in model.clusterCenters()])


def step_inconsistency(df: DataFrame, vector: Column, order: list[str], keys: list[str]) -> DataFrame:
    """Mean squared difference of a vector to the one before it in its sequence; 0 for the first."""
    rows = df.withColumn("_v", vector)
    rows = rows.withColumn("_b", F.lag("_v").over(Window.partitionBy(*keys).orderBy(*order)))
    steps = F.zip_with("_v", "_b", lambda a, b: (a - b) * (a - b))
    mean = F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / F.size("_v")
    return rows.withColumn("score", F.when(F.col("_b").isNull(), 0.0).otherwise(mean)).drop("_v", "_b")


def knn_novelty_by_regime(queries: DataFrame, bank: DataFrame, k: int = 3) -> DataFrame:
    """1 - mean of the k largest cosines to the bank of the regime whose centre is nearest, the query's own vector left out.

    bank has regime (few), vec_id and embedding, and may be of any size (see top_cosines). A centre is the mean of a regime's
    normalised vectors, ties go to the smallest regime.
    """
    units = bank.select("regime", unit(F.col("embedding")).alias("b"))
    means = units.select("regime", F.posexplode("b").alias("i", "x")).groupBy("regime", "i").agg(F.avg("x").alias("m"))
    centres = means.groupBy("regime").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    all_centres = F.broadcast(centres.agg(F.collect_list(F.struct("regime", "c")).alias("centres")))  # one row
    q = queries.select("vec_id", "embedding", unit(F.col("embedding")).alias("q")).crossJoin(all_centres)
    away = lambda c: F.aggregate(F.zip_with("q", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    nearest = F.array_min(F.transform("centres", lambda c: F.struct(away(c["c"]).alias("away"), c["regime"].alias("regime"))))
    placed = q.select("vec_id", "embedding", nearest["regime"].alias("regime"))
    found = top_cosines(placed, bank.select("vec_id", "embedding", "regime"), k, ["regime"])
    return found.groupBy("vec_id", "regime").agg((1 - F.avg("cosine")).alias("score"))
