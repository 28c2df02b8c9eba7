"""Evaluation with and without post-processing, for many settings in one job, and a search over settings."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import KEYS
from ..functions.scans import PIECE, fits
from ..functions.staging import staged
from .alarms import decision_scores, drop_short, fill_gaps, hysteresis, predict, robust_scale
from .metrics import METRICS, evaluate
from .preprocess import all_of
from .sweep import best_threshold, quantile_thresholds


@dataclass(frozen=True)
class Settings:
    width: int = 1
    span: int = 1
    delta: float = 0.0
    enter: int = 1
    leave: int = 1
    gap: int = 0
    least: int = 1
    enabled: bool = True


RAW = Settings(enabled=False)  # scores as they are, and alarm above the threshold


@dataclass(frozen=True)
class Evaluation:
    """What an evaluation gives: metrics and thresholds of each (setting, run_key), and rows with scores, decisions and alarms."""

    runs: DataFrame
    rows: DataFrame


def evaluation(scores: DataFrame, settings: list[Settings], fraction: float | None = None) -> Evaluation:
    """All of the settings, numbered from 0, over all runs of scores(run_key, sequence_id, t, score, label).

    Scores are smoothed by setting, one exact sweep gives the thresholds of all (or, with fraction, the score that so many rows are
    above), hysteresis starts at it and ends delta robust scales below, then gaps are filled and short alarms dropped. Without
    post-processing alarms are the scores above the threshold. Rows and thresholds are staged when this is called.

    runs: setting, run_key, the metrics, threshold_on, threshold_off, robust_scale (0 without post-processing).
    rows: setting, run_key, sequence_id, t, raw_score, score (the decision), label, pred.
    """
    base = scores.select(*KEYS, "t", "score", "label")
    size = None if fits(base) else PIECE
    name = lambda i: F.concat(F.lit(f"{i}|"), F.col("run_key"))
    smoothed: dict[tuple[int, int], int] = {}
    for i, s in enumerate(settings):
        smoothed.setdefault((s.width, s.span) if s.enabled else (1, 1), i)
    parts = []
    for i, s in enumerate(settings):
        w = decision_scores(base.withColumn("raw_score", F.col("score")), s.width if s.enabled else 1, s.span if s.enabled else 1, size)
        parts.append(w.select(name(i).alias("run_key"), "sequence_id", "t", "raw_score", F.col("decision").alias("score"), "label", "gap", "stretch", F.lit(i).alias("setting")))
    decided = staged(all_of(parts))
    leaders = [smoothed[(s.width, s.span) if s.enabled else (1, 1)] for s in settings]  # settings that smooth alike share a threshold
    swept = decided.where(F.col("setting").isin(*set(leaders))).select(*KEYS, "t", "score", "label")
    on = best_threshold(swept, size) if fraction is None else quantile_thresholds(swept, [fraction])
    found = staged(on.select("run_key", "threshold").join(robust_scale(swept, ["run_key"]), "run_key", "left"))
    whose = F.array(*map(F.lit, leaders))
    run = F.expr("substring(run_key, instr(run_key, '|') + 1)")
    value = lambda f: F.get(F.array(*(F.lit(f(s)) for s in settings)), F.col("setting"))
    keys = decided.select("setting", "run_key").distinct().withColumn("_leader", F.concat(F.get(whose, F.col("setting")).cast("string"), F.lit("|"), run))
    scale = F.when(value(lambda s: s.enabled), F.coalesce("scale", F.lit(1e-12))).otherwise(F.lit(0.0))
    limits = keys.join(found.withColumnRenamed("run_key", "_leader"), "_leader").select("setting", "run_key", F.col("threshold").alias("threshold_on"), scale.alias("robust_scale"))
    limits = staged(limits.withColumn("threshold_off", F.col("threshold_on") - value(lambda s: float(s.delta)) * F.col("robust_scale")))
    rows = decided.join(F.broadcast(limits.drop("setting")), "run_key")  # a row for each setting and run
    alike: dict[tuple, list[int]] = {}
    for i, s in enumerate(settings):
        alike.setdefault((s.enabled, s.enter, s.leave, s.gap, s.least) if s.enabled else (False,), []).append(i)
    done = []
    for (enabled, *how), which in alike.items():
        mine = rows.where(F.col("setting").isin(*which))
        if enabled:
            enter, leave, gap, least = how
            pred = hysteresis(mine, F.col("threshold_on"), F.col("threshold_off"), enter, leave, "score", size)
            pred = drop_short(fill_gaps(pred, gap, size), least, size)
        else:
            pred = predict(mine, F.col("threshold_on"))
        done.append(pred.select("setting", *KEYS, "t", "raw_score", "score", "label", "pred"))
    out = staged(all_of(done))
    runs = evaluate(out, size).join(F.broadcast(limits), "run_key").select("setting", run.alias("run_key"), *METRICS, "threshold_on", "threshold_off", "robust_scale")
    return Evaluation(runs, out.withColumn("run_key", run))


def evaluated(scores: DataFrame, settings: Settings, fraction: float | None = None) -> DataFrame:
    """Metrics and thresholds of each run under one setting (see evaluation)."""
    return evaluation(scores, [settings], fraction).runs.drop("setting")


SPACE = {"width": [1, 3, 5], "span": [1, 5, 15], "delta": [0.0, 0.5, 1.0], "enter": [1, 2, 3], "leave": [1, 2, 3], "gap": [0, 2, 5], "least": [1, 2, 3]}
TIE_BREAKS = ("event_recall", "aaf", "event_detection_delay")


def rank_key(values: dict, target: str) -> tuple[float, ...]:
    """Larger is better: the target, then recall, alarms in an anomaly and delay; a missing value is worst."""
    def signed(name: str) -> float:
        v = values[name]
        return float("-inf") if v is None else -v if METRICS[name].lower_is_better else v

    return tuple(signed(name) for name in (target, *TIE_BREAKS))


@dataclass(frozen=True)
class Search:
    baseline: dict  # metrics without post-processing
    default: dict  # with the settings at the start
    best: Settings
    values: dict  # metrics of the best
    history: list[tuple[Settings, dict]]  # all settings tried, in order
    rounds: int


def coordinate_search(scores: DataFrame, space: dict[str, list] | None = None, target: str = "alarm_score", rounds: int = 3, start: Settings = Settings(), fraction: float | None = None) -> Search:
    """One parameter after another, keeping a value only if it is strictly better by rank_key; until a round brings nothing.

    Each step is one job over all its new candidates; nothing is tried twice. Metrics are means over runs.
    """
    names = {f.name for f in fields(Settings)} - {"enabled"}
    space = SPACE if space is None else space
    if unknown := set(space) - names:
        raise ValueError(f"no such settings: {sorted(unknown)}")
    scores = staged(scores.select(*KEYS, "t", "score", "label"))
    known: dict[Settings, dict] = {}

    def measure(candidates: list[Settings]) -> None:
        fresh = [c for c in dict.fromkeys(candidates) if c not in known]
        if fresh:
            means = evaluation(scores, fresh, fraction).runs.groupBy("setting").agg(*(F.avg(m).alias(m) for m in METRICS))
            found = {r["setting"]: {m: r[m] for m in METRICS} for r in means.collect()}  # a row for each setting
            known.update((c, found.get(i, dict.fromkeys(METRICS))) for i, c in enumerate(fresh))

    best = replace(start, enabled=True)
    measure([RAW, best])
    n = 0
    for n in range(1, rounds + 1):
        before = best
        for name, values in space.items():
            candidates = [replace(best, **{name: v}) for v in dict.fromkeys((getattr(best, name), *values))]
            measure(candidates)
            for c in candidates:
                if rank_key(known[c], target) > rank_key(known[best], target):
                    best = c
        if best == before:
            break
    return Search(known[RAW], known[replace(start, enabled=True)], best, known[best], list(known.items()), n)
