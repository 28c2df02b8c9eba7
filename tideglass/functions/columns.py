"""Column helpers: finiteness, label masks, numeric coercion, compression."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec, functions as F

INF = float("inf")
FAULT_WORDS = "anom|fault|failure|attack|abnormal"  # fixed values: words that mark a faulty label


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """Neither null nor NaN nor infinite."""
    c = col(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF))


def finite_or_null(c: str | Column) -> Column:
    return F.when(finite(c), col(c).cast("double"))


def numeric(c: str | Column) -> Column:
    """Text and numbers as double; what isn't a finite number is null."""
    return finite_or_null(col(c).try_cast("double"))


def label_mask(c: str | Column) -> Column:
    """Whether a label of any kind (bool, number, text) stands for an anomaly."""
    text = F.lower(col(c).cast("string"))
    number = F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(text.try_cast("double"))
    return F.when(number.isNotNull() & ~F.isnan(number), number != 0).otherwise(F.coalesce(text.rlike(FAULT_WORDS), F.lit(False)))


def asinh_scaled(c: str | Column, scale: float) -> Column:
    x = col(c) / F.lit(scale)
    return F.asinh(x)


def clip(c: str | Column, limit: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(-limit)), F.lit(limit))


KEYS = ["run_key", "sequence_id"]


def along(*keys: str) -> WindowSpec:
    """Rows of one sequence in time."""
    return Window.partitionBy(*(keys or KEYS)).orderBy("t")


def trailing(width: int, *keys: str) -> WindowSpec:
    return along(*keys).rowsBetween(-(width - 1), 0)


def safe_score(c: str | Column = "score") -> Column:
    """NaN counts as the highest score, null as no score (-inf)."""
    return F.coalesce(F.nanvl(col(c).cast("double"), F.lit(INF)), F.lit(-INF))
