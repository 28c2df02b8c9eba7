"""Fit a policy for each feature by aggregates, and apply it as one projection."""

from __future__ import annotations

import warnings
from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import INF, KEYS, along, clip, numeric
from ..functions.staging import column_counts, column_quantiles, local, staged


def long_form(table: DataFrame, features: list[str]) -> DataFrame:
    """feature, value: one row for each cell of numbers()."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in features))).alias("x")
    return table.select(pairs).select("x.feature", "x.value")


@dataclass(frozen=True)
class Policy:
    """How features are judged and scaled."""

    q_ref: float = 0.995  # tails: jump from here
    q_top: float = 0.999  # to here
    max_tail_mass: float = 0.01
    min_jump_ratio: float = 10.0  # in interquartile ranges
    min_jump: float = 0.0
    side: str = "both"  # upper, lower, both
    extreme: str = "ffill"  # none, nan, ffill: what becomes of values beyond the cutoffs
    const_abs: float = 1e-8
    const_rel: float = 1e-6
    const_unique: int = 2
    decimals: int = 12
    zero_inflated: bool = True
    zero_frac: float = 0.5
    zero_eps: float = 0.0
    min_nonzero: int = 8
    min_nonzero_frac: float = 0.01
    indicator: bool = True
    asinh: bool = True
    asinh_tail: float = 6.0
    asinh_q: float = 0.99
    asinh_mode: str = "median_abs"  # median_abs, p50_abs, p90_abs, iqr
    asinh_least: float = 1e-6
    robust: bool = False
    low_q: float = 25.0
    high_q: float = 75.0
    unit_variance: bool = False
    min_scale: float = 1e-3

    def __post_init__(self):
        if self.side not in ("upper", "lower", "both") or self.extreme not in ("none", "nan", "ffill") or self.asinh_mode not in ("median_abs", "p50_abs", "p90_abs", "iqr"):
            raise ValueError(f"no such side, action or mode: {self.side}, {self.extreme}, {self.asinh_mode}")
        if not 0 < self.low_q < self.high_q < 100:
            raise ValueError("0 < low_q < high_q < 100 must hold")


def numbers(df: DataFrame, features: list[str], ordered: bool = False) -> DataFrame:
    """A staged table of the features as finite numbers (else null); ordered: with the order columns there are. Rows are dealt out evenly, as the table is read several times and files may be few or of any size."""
    order = [c for c in (*KEYS, "t") if ordered and c in df.columns]
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return staged(df.select(*order, *(numeric(c).alias(c) for c in features)).repartition(n, F.monotonically_increasing_id()))


def report_of(table: DataFrame, features: list[str], policy: Policy = Policy(), extra: tuple[float, ...] = ()) -> DataFrame:
    """Count, quantiles, spread, zeros and tails of each feature of numbers(), and the kind of treatment that follows; a row for each feature, by way of the driver.

    Whether a feature is almost constant is judged on what isn't zero if it has many zeros, and left open if too little is left then
    (const_support: all, nonzero, insufficient_nonzero). Features without a finite value have no row. extra are further quantiles, in the column extra. The
    table is read five times, its columns side by side; what is shuffled are sketches, the values near a quantile, and distinct values where they are counted (n_unique).
    """
    p = policy
    zero = lambda c: F.abs(f"`{c}`") <= p.zero_eps
    names = ("q_low_top", "q_low", "q25", "median", "q75", "q_high", "q_high_top")
    fractions = (1 - p.q_top, 1 - p.q_ref, 0.25, 0.5, 0.75, p.q_ref, p.q_top, *extra)
    found, counts = column_quantiles(table, features, fractions, lambda c: {"n_total": F.count("*"), "n_finite": F.count(f"`{c}`"), "zeros": F.coalesce(F.sum(F.when(zero(c), 1)), F.lit(0))})
    nonzero = F.col("n_finite") - F.col("zeros")
    enough = (nonzero >= p.min_nonzero) & (nonzero / F.col("n_finite") >= p.min_nonzero_frac)
    inflated = F.lit(p.zero_inflated) & (F.col("zero_frac") >= p.zero_frac)
    first = found.withColumn("zero_frac", F.col("zeros") / F.col("n_finite"))
    first = first.withColumn("const_support", F.when(~inflated, "all").when(enough, "nonzero").otherwise("insufficient_nonzero"))
    first = first.select("*", *(F.col("q")[i].alias(n) for i, n in enumerate(names)), F.slice("q", len(names) + 1, max(1, len(extra))).alias("extra")).drop("q")
    first = local(first)
    # what is beyond a quantile can be told from the counts, as the quantile is in a bracket
    v, out, side = F.col("v"), F.col("out") == 1, lambda c: F.when(c, F.col("n")).otherwise(0)
    tails = counts.join(F.broadcast(first.select("feature", "q_low", "q_high")), "feature").groupBy("feature").agg(
        F.sum(side((v > F.col("q_high")) | out & (v >= F.col("q_high")))).alias("n_high"), F.sum(side(v < F.col("q_low"))).alias("n_low")
    )
    support = {r["feature"]: r["const_support"] for r in first.select("feature", "const_support").collect()}  # features
    judged = {c: F.col(f"`{c}`") if kind == "all" else F.when(~zero(c), F.col(f"`{c}`")) for c, kind in support.items() if kind != "insufficient_nonzero"}
    cq = first.where("const_support = 'all'").select("feature", (F.col("q75") - F.col("q25")).alias("iqr_const"), F.col("median").alias("middle"))
    some = [c for c in judged if support[c] == "nonzero"]
    if some:
        own, _ = column_quantiles(table.select(*(judged[c].alias(c) for c in some)), some, (0.25, 0.5, 0.75))
        cq = local(cq.union(own.select("feature", F.col("q")[2] - F.col("q")[0], F.col("q")[1])))
    middle = {r["feature"]: r["middle"] for r in cq.collect()}
    away, _ = column_quantiles(table.select(*(F.abs(x - F.lit(middle[c])).alias(c) for c, x in judged.items())), list(judged), (0.5,))
    mad = away.select("feature", F.col("q")[0].alias("mad"))
    each = column_counts(table.select(*(x.alias(c) for c, x in judged.items())), list(judged), {c: [(-INF, INF)] for c in judged})
    unique = each.select("feature", F.round("v", p.decimals).alias("value")).distinct().groupBy("feature").agg(F.count("*").alias("n_unique"))
    out = first
    for more in (tails, cq, mad, unique):
        out = out.join(F.broadcast(more), "feature", "left")
    limit = p.const_abs + p.const_rel * F.greatest(F.lit(1.0), F.abs("middle"))
    constant = (F.col("iqr_const") <= limit) | (F.col("mad") <= limit) | (F.col("n_unique") <= p.const_unique)
    out = out.withColumns({"iqr": F.col("q75") - F.col("q25"), "mass_high": F.col("n_high") / F.col("n_finite"), "mass_low": F.col("n_low") / F.col("n_finite"), "const_thr": F.coalesce(limit, F.lit(0.0)), "mad": F.coalesce("mad", F.lit(0.0)), "almost_constant": F.coalesce(constant, F.lit(False))})

    def tail(jump: Column, mass: str) -> Column:
        ratio = F.when(F.col("iqr") > 0, jump / F.col("iqr")).otherwise(F.lit(INF))
        return (F.col(mass) <= p.max_tail_mass) & (ratio >= p.min_jump_ratio) & (jump >= p.min_jump)

    high, low = tail(F.col("q_high_top") - F.col("q_high"), "mass_high"), tail(F.col("q_low") - F.col("q_low_top"), "mass_low")
    high, low = (high if p.side != "lower" else F.lit(False)), (low if p.side != "upper" else F.lit(False))
    out = out.withColumns({"upper_cutoff": F.when(high, F.col("q_high")), "lower_cutoff": F.when(low, F.col("q_low")), "extreme": high | low, "n_extreme": F.when(high, F.col("n_high")).otherwise(0) + F.when(low, F.col("n_low")).otherwise(0)})
    kind = F.when(F.col("almost_constant"), "almost_constant").when(F.lit(p.zero_inflated) & (F.col("zero_frac") >= p.zero_frac), "zero_inflated").when(F.col("extreme"), "extreme").otherwise("robust")
    return local(out.withColumns({"kind": kind, "frac_extreme": F.col("n_extreme") / F.col("n_finite")}).drop("zeros", "n_high", "n_low", "iqr_const", "middle"))


def feature_report(df: DataFrame, features: list[str], policy: Policy = Policy()) -> DataFrame:
    """report_of the features' values, in the order almost constant, extreme, share of extreme values (falling), name."""
    report = report_of(numbers(df, features), features, policy).drop("extra")
    return report.orderBy(F.desc("almost_constant"), F.desc("extreme"), F.desc("frac_extreme"), "feature")  # a row for each feature


@dataclass(frozen=True)
class Rule:
    feature: str
    kind: str
    center: float
    scale: float
    asinh_scale: float | None  # None: no compression
    low: float | None
    high: float | None
    indicator: bool = False
    zero_eps: float = 0.0


def _without_extremes(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]], action: str) -> DataFrame:
    """Values beyond a feature's cutoffs become null (nan) or, with ffill, the last good value of the sequence, or at its start the next one."""
    if action == "none" or not bounds:
        return df
    inside = {}
    for c, (low, high) in bounds.items():
        x = F.col(c)
        beyond = F.lit(False)
        if low is not None:
            beyond = beyond | (x < low)
        if high is not None:
            beyond = beyond | (x > high)
        inside[c] = F.when(~F.coalesce(beyond, F.lit(False)), x)
    df = df.withColumns(inside)
    if action == "nan":
        return df
    back, ahead = along().rowsBetween(Window.unboundedPreceding, 0), along().rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(ahead)) for c in bounds})


def fit(train: DataFrame, features: list[str], policy: Policy = Policy()) -> list[Rule]:
    """One rule for each feature, from training rows. The rows are staged once; what reaches the driver is a row for each feature.

    A feature is compressed by asinh if its upper tail is long; scales and centres of features with many zeros are those of what
    isn't zero. A feature without a finite value is left as it is.
    """
    p = policy
    rows, train = train, numbers(train, features)
    report = {r["feature"]: r for r in report_of(train, features, p, (p.asinh_q,)).collect()}
    bounds = {c: (r["lower_cutoff"], r["upper_cutoff"]) for c, r in report.items() if r["kind"] == "extreme"}
    if bounds and p.extreme != "none":
        train = staged(_without_extremes(numbers(rows, features, True), bounds, p.extreme))

    def cells(of: Iterable[str], nonzero: bool = True) -> dict[str, Column]:
        """The features' values; of those with many zeros what isn't zero, if asked for."""
        x = {c: F.col(f"`{c}`") for c in of}
        return {c: F.when(F.abs(v) > p.zero_eps, v) if nonzero and report[c]["kind"] == "zero_inflated" else v for c, v in x.items()}

    def by_feature(of: dict[str, Column], fractions: tuple[float, ...]) -> dict[str, list[float]]:
        found, _ = column_quantiles(train.select(*(x.alias(c) for c, x in of.items())), list(of), fractions)
        return {r["feature"]: r["q"] for r in found.collect()}

    scales: dict[str, float] = {}
    if p.asinh:
        spread = {c: (r["q25"], r["median"], r["q75"], r["extra"][0]) for c, r in report.items()}
        if bounds and p.extreme != "none":
            spread |= by_feature(cells(bounds, False), (0.25, 0.5, 0.75, p.asinh_q))
        squeezed = [c for c, q in spread.items() if report[c]["kind"] != "almost_constant" and (q[3] - q[1]) / max(q[2] - q[0], 1e-12) >= p.asinh_tail]
        if squeezed:
            of = cells(squeezed)
            if p.asinh_mode == "iqr":
                scales = {c: q[1] - q[0] for c, q in by_feature(of, (0.25, 0.75)).items()}
            else:
                at = 0.9 if p.asinh_mode == "p90_abs" else 0.5
                scales = {c: q[0] for c, q in by_feature({c: F.abs(x) for c, x in of.items()}, (at,)).items()}
            scales = {c: max(s, p.asinh_least) for c, s in scales.items()}
    if p.robust:
        moved = {c: F.asinh(x / scales[c]) if c in scales else x for c, x in cells(report).items()}
        found = {c: (q[1], q[2] - q[0]) for c, q in by_feature(moved, (p.low_q / 100, 0.5, p.high_q / 100)).items()}
        if p.unit_variance:
            wide = NormalDist().inv_cdf(p.high_q / 100) - NormalDist().inv_cdf(p.low_q / 100)
            found = {c: (m, s / wide) for c, (m, s) in found.items()}
    else:
        exprs = []
        for i, c in enumerate(features):
            x = F.asinh(F.col(c) / scales[c]) if c in scales else F.col(c)
            x = F.when(F.abs(c) > p.zero_eps, x) if c in report and report[c]["kind"] == "zero_inflated" else x
            exprs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
        got = train.agg(*exprs).first()
        found = {c: (got[f"m{i}"], got[f"s{i}"]) for i, c in enumerate(features) if got[f"m{i}"] is not None}
    out = []
    for c in features:
        center, scale = found.get(c, (0.0, 1.0))
        kind = report[c]["kind"] if c in report else "robust"
        low, high = bounds.get(c, (None, None))
        out.append(Rule(c, kind, center, max(scale if scale and scale > 0 else 1.0, p.min_scale), scales.get(c), low, high, kind == "zero_inflated" and p.indicator, p.zero_eps))
    return out


def apply(df: DataFrame, rules: list[Rule], mode: str = "train", extreme: str = "ffill", clip_at: float | None = None) -> DataFrame:
    """One projection: x - center of almost constant features, (f(x) - center) / scale of the others, cut off at clip_at on either side.

    Features with many zeros become c__is_nonzero (if their rule says so) and c__mag. extreme is what becomes of values beyond the
    cutoffs (see Policy); test data keep theirs.
    """
    df = df.withColumns({r.feature: numeric(r.feature) for r in rules})
    df = _without_extremes(df, {r.feature: (r.low, r.high) for r in rules if r.kind == "extreme"}, "none" if mode == "test" else extreme)
    out = []
    for r in rules:
        x = F.col(r.feature)
        y = F.asinh(x / r.asinh_scale) if r.asinh_scale else x
        y = x - r.center if r.kind == "almost_constant" else (y - r.center) / r.scale
        y = clip(y, clip_at) if clip_at is not None else y
        if r.indicator:
            out.append(F.coalesce(F.abs(x) > r.zero_eps, F.lit(False)).cast("double").alias(f"{r.feature}__is_nonzero"))
        out.append(y.alias(f"{r.feature}__mag" if r.kind == "zero_inflated" else r.feature))
    rest = [c for c in df.columns if c not in {r.feature for r in rules}]
    return df.select(*rest, *out)


def without_features(df: DataFrame, features: list[str], drop: list[str]) -> list[str]:
    """features without those to drop. Unknown ones among these bring a warning, a missing feature or none left an error."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise KeyError(f"no such features: {missing}")
    unknown = [c for c in drop if c not in features]
    if unknown:
        warnings.warn(f"not among the features, so not dropped: {unknown}", stacklevel=2)
    kept = [c for c in features if c not in set(drop)]
    if not kept:
        raise ValueError("no feature is left")
    return kept


def fill_missing(df: DataFrame, feature: str) -> DataFrame:
    """The last value seen, at the start the first to come."""
    x = numeric(feature)
    back, ahead = along().rowsBetween(Window.unboundedPreceding, 0), along().rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(feature, x).withColumn(feature, F.coalesce(F.last(feature, ignorenulls=True).over(back), F.first(feature, ignorenulls=True).over(ahead)))


def numeric_channels(df: DataFrame, columns: list[str]) -> DataFrame:
    """channel, present, distinct_values, is_numeric (over 80 % present and over 5 values), is_binary (at most 8 values, all 0 or 1)."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).cast("string").try_cast("double").alias("v")) for c in columns))).alias("x")).select("x.*")
    out = cells.groupBy("channel").agg(F.avg(F.col("v").isNotNull().cast("double")).alias("present"), F.countDistinct("v").alias("distinct_values"), F.min(F.col("v").isin(0.0, 1.0).cast("int")).alias("zero_one"))
    return out.select("channel", F.round("present", 6).alias("present"), "distinct_values", ((F.col("present") > 0.8) & (F.col("distinct_values") > 5)).alias("is_numeric"), ((F.col("distinct_values") <= 8) & (F.col("zero_one") == 1)).alias("is_binary"))


def _share(n: Column, fraction: float) -> Column:
    """floor(n * fraction), the fraction taken as it is written: in doubles 610 * 0.7 is less than 427."""
    return F.floor(n * F.lit(Decimal(str(fraction)))).cast("long")


def time_split(df: DataFrame, fraction: float = 0.7) -> DataFrame:
    """part: train for the first rows of each sequence, val for the rest."""
    n = F.count("*").over(Window.partitionBy(*KEYS))
    return df.withColumn("part", F.when(F.col("t") < _share(n, fraction), "train").otherwise("val"))


def overlapping_split(df: DataFrame, fraction: float, overlap: int) -> DataFrame:
    """As time_split, with the last rows of train in val too."""
    n = F.count("*").over(Window.partitionBy(*KEYS))
    border = _share(n, fraction)
    parts = F.array_compact(F.array(F.when(F.col("t") < border, F.lit("train")), F.when(F.col("t") >= border - overlap, F.lit("val"))))
    return df.withColumn("_parts", parts).withColumn("part", F.explode("_parts")).drop("_parts")


def sequence_split(df: DataFrame, fraction: float = 0.7) -> DataFrame:
    """part by whole sequences, in the order of their ids."""
    seqs = df.select(*KEYS).distinct()
    w = Window.partitionBy("run_key")
    placed = seqs.withColumn("_i", F.row_number().over(w.orderBy("sequence_id"))).withColumn("_n", F.count("*").over(w))
    placed = placed.select(*KEYS, F.when(F.col("_i") <= _share(F.col("_n"), fraction), "train").otherwise("val").alias("part"))
    return df.join(placed, KEYS)


def budget_cut(df: DataFrame, rows: int) -> DataFrame:
    """Sequences in the order of their ids until their rows reach a budget; the one that crosses it is in."""
    sizes = df.groupBy(*KEYS).agg(F.count("*").alias("n"))
    w = Window.partitionBy("run_key").orderBy("sequence_id").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("before") < rows)


def chosen_sources(real: DataFrame, synthetic: DataFrame | None, choice: str = "both", extra: DataFrame | None = None) -> DataFrame:
    """Rows of one or both sources with source, and extra data (train_ext, label 0) behind real training data.

    Columns are matched by name; those that one source lacks are null there.
    """
    if choice not in ("real", "synthetic", "both"):
        raise ValueError(f"no such choice of sources: {choice}")
    parts = [(real, "real")] if choice != "synthetic" else []
    parts += [(synthetic, "synthetic")] if choice != "real" and synthetic is not None else []
    if extra is not None and choice != "synthetic":
        parts.append((extra.withColumns({"mode": F.lit("train_ext"), "label": F.lit(0).cast("long")}), "real"))
    return all_of([rows.withColumn("source", F.lit(name)) for rows, name in parts])


def all_of(sources: list[DataFrame]) -> DataFrame:
    """Several sources as one, matched by name; columns that one lacks are null there. One at least."""
    if not sources:
        raise ValueError("no sources")
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def window_cap(windows: DataFrame, most: int, *keys: str) -> DataFrame:
    """The first windows of each sequence by t_end, at most so many."""
    w = Window.partitionBy(*(keys or KEYS)).orderBy("t_end")
    return windows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= most).drop("_i")


def stages(series: DataFrame, source: str = "real", test_on_real: bool = True) -> DataFrame:
    """The rows of one stage from series with mode and source (real or synthetic), with stage and fits_scaler.

    Training and validation rows are of the stage's source, train_ext of real stages only; a synthetic stage is tested on
    real rows unless told otherwise. Scalers are fitted on real training rows always: where these aren't trained on, their
    stage is scaler.
    """
    if source not in ("real", "synthetic"):
        raise ValueError(f"no such source of a stage: {source}")
    real, mode = F.col("source") == "real", F.col("mode")
    own = F.col("source") == source
    tested = real if source == "real" or test_on_real else ~real
    extra = (mode == "train_ext") & real if source == "real" else F.lit(False)
    stage = F.when(mode.isin("train", "val") & own, mode).when((mode == "test") & tested, mode).when(extra, mode).when((mode == "train") & real, "scaler")
    fits = ((mode == "train") & real) | extra
    return series.withColumns({"stage": stage, "fits_scaler": fits}).where("stage is not null")
