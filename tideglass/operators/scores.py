"""Detectors that are data work: every score is a frame, an aggregate or a small join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import INF, KEYS, along, safe_score, trailing
from ..functions.scans import PIECE, Sequences, Total
from ..functions.staging import exact_quantiles, staged


def channels(df: DataFrame, features: list[str]) -> DataFrame:
    """One series for each feature: sequence rows with feature and x."""
    x = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features)))
    return df.select(*KEYS, "t", "label", x.alias("c")).select(*KEYS, "t", "label", "c.*")


def moving_threshold(df: DataFrame, feature: str, width: int, k: float, two_sided: bool = False, use_mean: bool = True) -> DataFrame:
    """How far a value is above the mean (or median) of the width rows before it, less k deviations; null at the start."""
    w = along().rowsBetween(-width, -1)
    x = F.col(feature)
    mid = F.avg(feature).over(w) if use_mean else F.median(feature).over(w)
    away = F.abs(x - mid) if two_sided else x - mid
    return df.select(*KEYS, "t", "label", (away - k * F.stddev_pop(feature).over(w)).alias("score"))


def train_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """One row: mean and deviation of each feature and of its differences."""
    w = along()
    rows = df.select(*features, *((F.col(c) - F.lag(c).over(w)).alias(f"d_{c}") for c in features))
    both = [*features, *(f"d_{c}" for c in features)]
    return rows.agg(*(F.avg(c).alias(f"m_{c}") for c in both), *(F.greatest(F.stddev_pop(c), F.lit(1e-6)).alias(f"s_{c}") for c in both))


def sparse_score(df: DataFrame, stats: DataFrame, features: list[str], top: int, weight: float) -> DataFrame:
    """Mean of the top channels of z + weight * z of the difference, both against training rows."""
    w = along()
    rows = df.select(*KEYS, "t", "label", *features, *(F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)).alias(f"d_{c}") for c in features)).crossJoin(F.broadcast(stats))  # stats: one row
    z = lambda c: F.abs((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}"))
    parts = F.slice(F.sort_array(F.array(*(z(c) + weight * z(f"d_{c}") for c in features)), asc=False), 1, top)
    return rows.select(*KEYS, "t", "label", (F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / top).alias("score"))


def cusum(df: DataFrame, stats: DataFrame, features: list[str], slack: float, top: int = 1, size: int | None = PIECE) -> DataFrame:
    """Two-sided CUSUM of z with slack; a reflected running sum is the running sum less its least so far (0 at most)."""
    rows = df.crossJoin(F.broadcast(stats))  # stats: one row
    z = lambda c: (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")
    steps = {f"{side}_{c}": F.lit(sign) * z(c) - slack for c in features for side, sign in (("_u", 1.0), ("_l", -1.0))}
    rows = Sequences(rows.select(*KEYS, "t", "label", *(x.alias(n) for n, x in steps.items())), size)
    rows = rows.scan(**{f"s{n}": Total("sum", F.col(n)) for n in steps})
    rows = rows.scan(**{f"m{n}": Total("min", F.col(f"s{n}")) for n in steps}).done()
    one = lambda n: F.col(f"s{n}") - F.least(F.lit(0.0), F.col(f"m{n}"))
    best = F.slice(F.sort_array(F.array(*(F.greatest(one(f"_u_{c}"), one(f"_l_{c}")) for c in features)), asc=False), 1, top)
    return rows.select(*KEYS, "t", "label", (F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / top).alias("score"))


def mean_drift(df: DataFrame, stats: DataFrame, features: list[str], width: int) -> DataFrame:
    w = trailing(width)
    rows = df.crossJoin(F.broadcast(stats))
    parts = [F.abs((F.avg(c).over(w) - F.col(f"m_{c}")) / F.col(f"s_{c}")) for c in features]
    return rows.select(*KEYS, "t", "label", (sum(parts[1:], parts[0]) / len(features)).alias("score"))


def rolling_correlation(df: DataFrame, a: str, b: str, width: int, floor: float = 1e-6) -> DataFrame:
    w = trailing(width)
    spread = F.sqrt(F.greatest(F.var_pop(a).over(w), F.lit(floor)) * F.greatest(F.var_pop(b).over(w), F.lit(floor)))
    return df.select(*KEYS, "t", "label", (F.covar_pop(a, b).over(w) / spread).alias("corr"))


def slow_channels(df: DataFrame, features: list[str]) -> DataFrame:
    """Channels ranked by how slowly they move: correlation with the row before, less relative size of steps."""
    x = {i: F.col(c).cast("double") for i, c in enumerate(features)}
    rows = df.select(*KEYS, "t", *(v.alias(f"x{i}") for i, v in x.items()))
    rows = rows.select("*", *(F.lag(f"x{i}").over(along()).alias(f"b{i}") for i in x))
    slow = lambda i: F.corr(f"x{i}", f"b{i}") - F.stddev_pop(F.col(f"x{i}") - F.col(f"b{i}")) / F.greatest(F.stddev_pop(f"x{i}"), F.lit(1e-6))
    one = rows.agg(F.array(*(F.struct(F.lit(c).alias("feature"), slow(i).alias("slowness")) for i, c in enumerate(features))).alias("s"), F.count("*").alias("n")).where("n > 0")
    found = one.select(F.explode("s").alias("s")).select("s.*")  # rows stay whole, each once
    return found.select("feature", "slowness", F.row_number().over(Window.orderBy(F.desc("slowness"), "feature")).alias("place"))  # one row for each feature


def duration_pool(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Largest over the lengths of the sum of positive scores by the root of their number."""
    pos = F.greatest(F.col("score"), F.lit(0.0))
    parts = [F.sum(pos).over(trailing(n)) / F.sqrt(F.count("*").over(trailing(n))) for n in lengths]
    return df.withColumn("score", F.greatest(*parts) if len(parts) > 1 else parts[0])


def robust_location(df: DataFrame, keys: list[str]) -> DataFrame:
    """Median and 1.4826 MAD; where that is 0 the deviation, else 1. Exact, and counted when this is called."""
    rows = df.select(*keys, safe_score().alias("s")).where(F.abs("s") < F.lit(INF))
    middle = exact_quantiles(rows, keys, "s", [0.5], {"std": F.stddev_pop("s")}).select(*keys, F.col("q")[0].alias("middle"), "std")
    away = rows.join(middle, keys).select(*keys, F.abs(F.col("s") - F.col("middle")).alias("s"))
    mad = exact_quantiles(away, keys, "s", [0.5]).select(*keys, F.col("q")[0].alias("mad"))
    scale = F.when(F.col("mad") > 1e-12, 1.4826 * F.col("mad")).when(F.col("std") > 1e-12, F.col("std")).otherwise(1.0)
    return middle.join(mad, keys).select(*keys, F.col("middle").alias("location"), scale.alias("scale"))


def robust_normalised(df: DataFrame, keys: list[str]) -> DataFrame:
    """Scores less their key's robust location, in units of its robust scale. Scores are staged, as they are read five times."""
    df = staged(df)
    found = robust_location(df, keys)
    return df.join(F.broadcast(found) if keys == ["run_key"] else found, keys).withColumn("score", (F.col("score") - F.col("location")) / F.col("scale")).drop("location", "scale")  # runs are few


def histogram_score(df: DataFrame, features: list[str], bins: int = 10, alpha: float = 0.1) -> DataFrame:
    """Sum over features of -log(density + alpha) in equal bins between the least and greatest value (our formula)."""
    ranges = df.agg(*(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"_r_{c}") for c in features))
    rows = df.crossJoin(F.broadcast(ranges))
    bin_of = lambda c: F.least(F.floor((F.col(c) - F.col(f"_r_{c}.lo")) / F.greatest(F.col(f"_r_{c}.hi") - F.col(f"_r_{c}.lo"), F.lit(1e-12)) * bins), F.lit(bins - 1)).cast("int")
    rows = rows.select(*KEYS, "t", "label", *(bin_of(c).alias(f"b_{c}") for c in features))
    counts = rows.agg(F.count("*").alias("n"), *(F.array(*(F.sum((F.col(f"b_{c}") == b).cast("double")) for b in range(bins))).alias(f"h_{c}") for c in features))
    total = F.lit(0.0)
    for c in features:
        top = F.array_max(f"h_{c}")
        total = total - F.log(F.get(f"h_{c}", F.col(f"b_{c}")) / top + alpha)
    return rows.crossJoin(F.broadcast(counts)).select(*KEYS, "t", "label", total.alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    n = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / n)


BLOCK = 4096  # vectors in one block


def _blocks(vectors: DataFrame, groups: list[str]) -> DataFrame:
    """A staged table of about BLOCK unit vectors a row: groups, ids, and the vectors as bytes. Null vectors have no place."""
    rows = vectors.where("embedding is not null")
    sizes = rows.groupBy(*groups).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n"))
    dealt = rows.join(F.broadcast(sizes), groups).withColumn("_b", F.pmod(F.xxhash64("vec_id"), F.col("_n")).cast("int"))  # a row for each group

    def pack(group: pa.Table) -> pa.Table:
        v = np.array(group.column("embedding").to_pylist(), float)
        v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)
        keys = [group.column(g).slice(0, 1) for g in groups]
        return pa.table([*keys, pa.array([group.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([v.tobytes()], pa.binary())], [*groups, "ids", "data"])

    kinds = ", ".join(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in groups)
    return staged(dealt.select(*groups, "_b", "vec_id", "embedding").groupBy(*groups, "_b").applyInArrow(pack, f"{kinds}, ids array<long>, data binary"))


def top_cosines(queries: DataFrame, bank: DataFrame, k: int, groups: list[str]) -> DataFrame:
    """groups, vec_id and cosine: the k largest cosines of each query to vectors of the bank in the same groups, its own vec_id left out.

    Both sides have vec_id, embedding and the groups (few). Vectors are packed into blocks, each block of queries meets each of the
    bank in a matrix product, and the k best of every block are merged by query, partly before they are shuffled. So no side
    has to fit one task or be sent to all, and no pair becomes a row.
    """
    q, b = _blocks(queries, groups), _blocks(bank, groups)
    b = b.select(*(F.col(g).alias(f"_{g}") for g in groups), F.col("ids").alias("bank_ids"), F.col("data").alias("bank"))
    same = F.lit(True)
    for g in groups:
        same = same & (F.col(g) == F.col(f"_{g}"))
    met = q.hint("shuffle_replicate_nl").join(b, same).select(*groups, "ids", "data", "bank_ids", "bank")  # blocks, not rows

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, others = (np.array(batch.column(c)[i].as_py(), np.int64) for c in ("ids", "bank_ids"))
                x, y = (np.frombuffer(batch.column(c)[i].as_py()).reshape(len(n), -1) for c, n in (("data", ids), ("bank", others)))
                keys = [batch.column(g).slice(i, 1) for g in groups]
                for a in range(0, len(ids), 512):
                    c = x[a : a + 512] @ y.T
                    c[ids[a : a + 512, None] == others[None]] = -INF
                    n = min(k, c.shape[1])
                    top = np.partition(c, c.shape[1] - n, axis=1)[:, -n:]
                    found = np.isfinite(top)
                    who = np.repeat(ids[a : a + 512], n)[found.ravel()]
                    yield pa.RecordBatch.from_arrays([*(pa.concat_arrays([key] * len(who)) if len(who) else key.slice(0, 0) for key in keys), pa.array(who), pa.array(top[found])], [*groups, "vec_id", "cosine"])

    kinds = ", ".join(f"`{g}` {queries.schema[g].dataType.simpleString()}" for g in groups)
    rows = met.mapInArrow(best, f"{kinds}, vec_id long, cosine double")
    w = Window.partitionBy(*groups, "vec_id").orderBy(F.desc("cosine"))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def knn_novelty(queries: DataFrame, bank: DataFrame, k: int = 3) -> DataFrame:
    """1 - mean of the k largest cosines to a bank of patches of any size, the query's own left out (see top_cosines)."""
    one = lambda df: df.select("vec_id", "embedding", F.lit(0).alias("g"))
    return top_cosines(one(queries), one(bank), k, ["g"]).groupBy("vec_id").agg((1 - F.avg("cosine")).alias("score"))


def points_from_patches(points: DataFrame, patches: DataFrame, length: int, how: str = "mean", q: float = 0.9) -> DataFrame:
    """Mean, maximum or q quantile of the scores of the patches that cover a point."""
    if how not in ("mean", "max", "quantile"):
        raise ValueError(f"no such pooling: {how}")
    w = along().rowsBetween(-(length - 1), 0)
    both = points.select(*KEYS, "t", "label").join(patches.select(*KEYS, F.col("patch_start").alias("t"), F.col("score").alias("_s")), [*KEYS, "t"], "left")
    pooled = {"mean": F.avg("_s"), "max": F.max("_s"), "quantile": F.percentile("_s", F.lit(q))}[how]  # of length scores at most
    return both.select(*KEYS, "t", "label", pooled.over(w).alias("score"))


def residual_score(df: DataFrame, features: list[str], season: int = 1, squared: bool = True) -> DataFrame:
    """Mean error of the forecast that repeats the value season rows before."""
    w = along()
    e = [F.col(c) - F.lag(c, season).over(w) for c in features]
    parts = [x * x if squared else F.abs(x) for x in e]
    return df.select(*KEYS, "t", "label", (sum(parts[1:], parts[0]) / len(parts)).alias("score"))


def prediction_residual(df: DataFrame, predicted: dict[str, str], squared: bool = True, width: int = 1, size: int | None = PIECE) -> DataFrame:
    """Error of a user's predictions (feature -> column), squared or absolute: its mean over features, then over the last width rows; null before there are so many. Rows without a prediction count as missing."""
    e = [F.col(c) - F.col(p) for c, p in predicted.items()]
    parts = [x * x if squared else F.abs(x) for x in e]
    rows = Sequences(df.select(*KEYS, "t", "label", (sum(parts[1:], parts[0]) / len(parts)).alias("score")), size)
    frame = lambda w: w.rowsBetween(1 - width, 0)
    return rows.near(width - 1, 0, lambda w: {"score": F.when(F.count("*").over(frame(w)) == width, F.avg("score").over(frame(w)))}).done()


def fuse(df: DataFrame, first: str, second: str, weight: float = 1.0, train: DataFrame | None = None, how: str = "sum") -> DataFrame:
    """Sum (or product) of two scores, each in units of its mean and deviation over the run's training rows (all rows, if none are given); the second weighs `weight` in the sum."""
    if how not in ("sum", "product"):
        raise ValueError(f"no such fusion: {how}")
    stats = (df if train is None else train).groupBy("run_key").agg(*(f(x).alias(f"_{n}_{x}") for x in (first, second) for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.greatest(F.col(f"_s_{c}"), F.lit(1e-12))
    return df.join(F.broadcast(stats), "run_key").withColumn("score", z(first) + weight * z(second) if how == "sum" else z(first) * z(second)).select(*(c for c in df.columns if c != "score"), "score")  # a row for each run


def centroid_distance(df: DataFrame, how: str = "l2") -> DataFrame:
    """Distance of each embedding to the mean of all: l2, or cosine, (1 - cosine) / 2."""
    if how not in ("l2", "cosine"):
        raise ValueError(f"no such distance: {how}")
    means = df.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))  # one value for each dimension
    v, c = F.col("embedding"), F.col("c")
    away = F.zip_with(v, c, lambda x, m: x.cast("double") - m)
    cosine = dot(v, c) / F.greatest(F.sqrt(dot(v, v) * dot(c, c)), F.lit(1e-12))
    distance = F.sqrt(F.aggregate(away, F.lit(0.0), lambda s, d: s + d * d)) if how == "l2" else (1 - cosine) / 2
    return df.crossJoin(F.broadcast(centre)).select("vec_id", distance.alias("distance"))
