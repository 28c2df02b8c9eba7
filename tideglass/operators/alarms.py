"""From scores to alarms: smoothing, hysteresis, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import INF, KEYS, safe_score
from ..functions.scans import PIECE, Sequences, Total
from ..functions.staging import exact_quantiles


def segments(df: DataFrame, mask: str, size: int | None = PIECE) -> DataFrame:
    """EVENTS: start_t and end_t (exclusive) of every maximal run of rows where mask is 1; numbered from 0 in each sequence."""
    rows = Sequences(df.select(*KEYS, "t", (F.coalesce(F.col(mask), F.lit(0)) == 1).alias("_m")), size)
    rows = rows.near(1, 0, lambda w: {"_new": (F.col("_m") & ~F.coalesce(F.lag("_m").over(w), F.lit(False))).cast("long")})
    events = rows.scan(_run=Total("sum", F.col("_new"))).rows.where("_m").groupBy(*KEYS, "_run").agg(F.min("t").alias("start_t"), (F.max("t") + 1).alias("end_t"))
    return events.select(*KEYS, (F.col("_run") - 1).alias("event_id"), "start_t", "end_t", (F.col("end_t") - F.col("start_t")).alias("length"))


def sequences_of(flat: DataFrame, key: str = "run_key", size: int | None = PIECE) -> DataFrame:
    """Sequences from a flat run of scores(run_key, t): maximal stretches of rows with a score, numbered from 0, with t from 0 in each."""
    rows = flat.withColumn("score", safe_score()).withColumn("_gap", F.abs("score") >= F.lit(INF)).drop("sequence_id")
    rows = Sequences(rows.withColumnRenamed(key, "run_key").withColumn("sequence_id", F.lit(0)), size)
    rows = rows.near(1, 0, lambda w: {"_new": ~F.col("_gap") & F.coalesce(F.lag("_gap").over(w), F.lit(True))})
    rows = rows.scan(_n=Total("sum", F.lit(1)), _id=Total("sum", F.col("_new").cast("long")))
    rows = rows.scan(_start=Total("max", F.when(F.col("_new"), F.col("_n")))).done().where(~F.col("_gap"))
    rows = rows.withColumn("sequence_id", F.col("_id") - 1).withColumn("t", (F.col("_n") - F.col("_start")).cast("long"))
    return rows.withColumnRenamed("run_key", key).select(*(c for c in flat.columns if c != "sequence_id"), "sequence_id")


def _stretches(df: DataFrame, size: int | None) -> Sequences:
    rows = Sequences(df.withColumn("score", safe_score()).withColumn("gap", F.col("score") == F.lit(-INF)), size)
    return rows.scan(stretch=Total("sum", F.col("gap").cast("long")))


def finite_stretches(df: DataFrame, size: int | None = PIECE) -> DataFrame:
    """stretch: rows of it follow each other without a missing score; rows without a score (gap) stand apart."""
    return _stretches(df, size).done()


STRETCH = ("gap", "stretch")


def _rolling_max(rows: Sequences, width: int) -> Sequences:
    return rows.near(width - 1, 0, lambda w: {"rolling_max": F.when(~F.col("gap"), F.max("score").over(w.rowsBetween(1 - width, 0)))}, *STRETCH)


def rolling_max(df: DataFrame, width: int, size: int | None = PIECE) -> DataFrame:
    """Largest of the last width scores of the stretch."""
    return _rolling_max(Sequences(df, size), width).done()


def ewma_rows(span: int) -> int:
    """Rows after which a weight falls below 1e-17."""
    import math

    keep = 1 - 2 / (span + 1)
    return 1 if keep <= 0 else math.ceil(math.log(1e-17) / math.log(keep))


def _ewma(rows: Sequences, span: int) -> Sequences:
    """A step of the mean is an affine map, m -> keep * m + (1 - keep) * x. Rows of a stretch fall into blocks so long that a whole one has

    a factor below 1e-17: what comes into a block is then what the block before it gives by itself, and inside a block a running sum of x over powers of keep
    is all that's needed. So the work is linear in the rows, whatever the span, and a window has ewma_rows(span) rows.
    """
    keep, n = 1 - 2 / (span + 1), ewma_rows(span)
    if keep <= 0:
        return rows.columns(ewma=F.when(~F.col("gap"), F.col("score")))
    rows = rows.scan(_n=Total("sum", F.lit(1)))
    rows = rows.scan(_start=Total("max", F.when(F.col("gap"), F.col("_n"))))
    place = F.col("_n") - F.coalesce("_start", F.lit(0)) - 1  # in the stretch, from 0; a gap has -1
    rows = rows.columns(_block=F.floor(place / n), _j=F.pmod(place, F.lit(n)).cast("double"))
    first = (F.col("_block") == 0) & (F.col("_j") == 0)
    step = F.when(first, 1.0).otherwise(1 - keep) * F.col("score") * F.pow(F.lit(1 / keep), F.col("_j"))
    inside = Window.partitionBy(*KEYS, *STRETCH, "_block").orderBy("_j").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.columns(_own=F.when(~F.col("gap"), F.sum(step).over(inside) * F.pow(F.lit(keep), F.col("_j"))))
    rows = rows.scan(_full=Total("last", F.when(F.col("gap"), F.lit(0.0)).when(F.col("_j") == n - 1, F.col("_own")), own=False))
    carried = F.when(F.col("_block") > 0, F.col("_full") * F.pow(F.lit(keep), F.col("_j") + 1)).otherwise(F.lit(0.0))
    rows = rows.columns(ewma=F.when(~F.col("gap"), F.col("_own") + carried))
    return rows._with(rows.rows.drop("_n", "_start", "_block", "_j", "_own", "_full"))


def ewma(df: DataFrame, span: int, size: int | None = PIECE) -> DataFrame:
    """Exponentially weighted mean of each stretch, seeded by its first score. A score of +inf makes all later means of its stretch +inf or NaN."""
    return _ewma(Sequences(df, size), span).done()


def decision_scores(df: DataFrame, width: int = 1, span: int = 1, size: int | None = PIECE) -> DataFrame:
    """decision: the larger of the rolling maximum and the weighted mean; -inf without a score."""
    out = _ewma(_rolling_max(_stretches(df, size), width), span)
    return out.columns(decision=F.coalesce(F.greatest("rolling_max", "ewma"), F.lit(-INF))).done()


def predict(df: DataFrame, threshold: float | Column, strict: bool = True, score: str = "score") -> DataFrame:
    s, limit = safe_score(score), threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return df.withColumn("pred", (s > limit if strict else s >= limit).cast("int"))


def robust_scale(df: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """1.4826 times the median distance to the median of the scores there are; 1e-12 at least. Exact; counted when this is called."""
    rows = df.select(*keys, safe_score(score).alias("_s")).where(F.abs("_s") < F.lit(INF))
    middle = exact_quantiles(rows, keys, "_s", [0.5]).select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("q")[0].alias("middle"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    away = exact_quantiles(rows.join(middle, same).select(*keys, F.abs(F.col("_s") - F.col("middle")).alias("_s")), keys, "_s", [0.5])
    return away.select(*keys, F.greatest(F.lit(1.4826) * F.col("q")[0], F.lit(1e-12)).alias("scale"))


def hysteresis(df: DataFrame, on: Column | float, off: Column | float, enter: int = 1, leave: int = 1, score: str = "decision", size: int | None = PIECE) -> DataFrame:
    """pred: 1 from the first of enter rows at or above on, up to the last of leave rows below off; rows without a score reset.

    A row is in alarm if the last thing that happened in its stretch before it was an entry, or an entry
    completes at it or within the next enter - 1 rows.
    """
    on, off = (x if isinstance(x, Column) else F.lit(float(x)) for x in (on, off))
    s, most = F.col(score), max(enter, leave)
    full = lambda n, w: F.count("*").over(w.rowsBetween(1 - n, 0)) == n
    entered = lambda w: full(enter, w) & (F.min((s >= on).cast("int")).over(w.rowsBetween(1 - enter, 0)) == 1)
    left = lambda w: full(leave, w) & (F.min((s < off).cast("int")).over(w.rowsBetween(1 - leave, 0)) == 1)
    rows = Sequences(df, size).near(most - 1, 0, lambda w: {"_happened": F.when(entered(w), 1).when(left(w), 0)}, *STRETCH)
    rows = rows.near(0, enter - 1, lambda w: {"_soon": F.max(F.when(F.col("_happened") == 1, 1).otherwise(0)).over(w.rowsBetween(0, enter - 1))}, *STRETCH)
    rows = rows.scan(_state=Total("last", F.when(F.col("gap"), 0).otherwise(F.col("_happened")), own=False))  # a gap ends what was before it
    active = (F.coalesce("_state", F.lit(0)) == 1) | (F.col("_soon") == 1)
    return rows.columns(pred=F.when(F.col("gap"), 0).otherwise(active.cast("int"))).done("_happened", "_soon", "_state")


def _runs(rows: Sequences) -> Sequences:
    """_from and _to: places of the first and last row of a row's run of equal pred; _first and _last: of its stretch, or sequence without such."""
    by = [c for c in STRETCH if c in rows.rows.columns]
    differs = lambda at, w, *cs: ~at(F.struct(F.lit(0), *cs)).over(w).eqNullSafe(F.struct(F.lit(0), *cs))
    rows = rows.scan(_n=Total("sum", F.lit(1)))
    rows = rows.near(1, 1, lambda w: {"_new": differs(F.lag, w, "pred", *by), "_end": differs(F.lead, w, "pred", *by), "_begins": differs(F.lag, w, *by), "_ends": differs(F.lead, w, *by)})
    here = lambda c: F.when(F.col(c), F.col("_n"))
    return rows.scan(_from=Total("max", here("_new")), _to=Total("min", here("_end"), back=True), _first=Total("max", here("_begins")), _last=Total("min", here("_ends"), back=True))


_RUN = ("_n", "_new", "_end", "_begins", "_ends", "_from", "_to", "_first", "_last")


def _fill_gaps(rows: Sequences, most: int) -> Sequences:
    rows = _runs(rows)
    between = (F.col("pred") == 0) & (F.col("_from") > F.col("_first")) & (F.col("_to") < F.col("_last")) & (F.col("_to") - F.col("_from") < most)
    rows = rows.columns(pred=F.when(between, 1).otherwise(F.col("pred")))
    return rows._with(rows.rows.drop(*_RUN))


def _drop_short(rows: Sequences, least: int) -> Sequences:
    rows = _runs(rows)
    rows = rows.columns(pred=F.when((F.col("pred") == 1) & (F.col("_to") - F.col("_from") + 1 < least), 0).otherwise(F.col("pred")))
    return rows._with(rows.rows.drop(*_RUN))


def fill_gaps(df: DataFrame, most: int, size: int | None = PIECE) -> DataFrame:
    """Gaps of at most so many rows between two alarms become alarm."""
    return _fill_gaps(Sequences(df, size), most).done()


def drop_short(df: DataFrame, least: int, size: int | None = PIECE) -> DataFrame:
    """Alarms of fewer rows go."""
    return _drop_short(Sequences(df, size), least).done()


def merge_events(df: DataFrame, gap: int, least: int, size: int | None = PIECE) -> DataFrame:
    return _drop_short(_fill_gaps(Sequences(df, size), gap), least).done()
