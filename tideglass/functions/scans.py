"""Work along sequences of any length: running totals and frames by pieces of a sequence.

A window over a whole sequence is one task. Here a sequence of more than `size` rows is cut into pieces of so many rows. What a row
needs of the rows just around it (a frame of stated width) comes with a halo: rows near a border are copied to the neighbouring piece. What it needs of
all rows before or after it is a total that adds up piece by piece: each piece works out its own, one row for each piece carries what came before,
and both are combined. Sequences that fit a piece (checked by a count) are plain windows. Results don't depend on the way, but for
the order in which numbers are added.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from .columns import KEYS, along
from .staging import staged

PIECE = 1 << 18


@dataclass(frozen=True)
class Total:
    """A running sum, least, most or last value: of the rows so far, or with back of those still to come; without own, the row itself isn't in it. Nulls don't count."""

    kind: str
    value: Column
    back: bool = False
    own: bool = True

    def over(self, w: WindowSpec) -> Column:
        near = 0 if self.own else 1
        frame = w.rowsBetween(near, Window.unboundedFollowing) if self.back else w.rowsBetween(Window.unboundedPreceding, -near)
        if self.kind == "last":
            return (F.first if self.back else F.last)(self.value, ignorenulls=True).over(frame)
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.kind](self.value).over(frame)

    def of_piece(self, value: str, at: str) -> Column:
        if self.kind == "last":
            return (F.min_by if self.back else F.max_by)(value, F.when(F.col(value).isNotNull(), F.col(at)))
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.kind](value)

    def joined(self, carried: Column, own: Column) -> Column:
        if self.kind == "last":
            return F.coalesce(own, carried)
        if self.kind == "sum":
            return F.coalesce(carried + own, carried, own)
        return (F.least if self.kind == "min" else F.greatest)(carried, own)


def fits(rows: DataFrame, size: int = PIECE) -> bool:
    """Whether no sequence has more than size rows. Counts by key: t isn't read, so that where a window gives it, rows aren't sorted for this."""
    most = rows.groupBy(*KEYS).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return most is None or most <= size


class Sequences:
    """rows(run_key, sequence_id, t, ...), taken along t. size None: sequences are known to fit one task."""

    def __init__(self, rows: DataFrame, size: int | None = PIECE):
        self.size = None if size is None or fits(rows, size) else size
        self.rows = rows if self.size is None else self._placed(rows)

    def _placed(self, rows: DataFrame) -> DataFrame:
        """rows with _at, their place in the sequence: sorted ranges of rows, and what each adds to the places in it."""
        n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        ranged = rows.repartitionByRange(n, *KEYS, "t").sortWithinPartitions(*KEYS, "t").withColumn("_row", F.monotonically_increasing_id())
        ranged = staged(ranged.withColumn("_range", F.shiftright("_row", 33)))
        before = Window.partitionBy(*KEYS).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        starts = ranged.groupBy(*KEYS, "_range").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
        starts = staged(starts.select(*KEYS, "_range", (F.col("_first") - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_zero")))
        return ranged.join(starts, [*KEYS, "_range"]).withColumn("_at", F.col("_row") - F.col("_zero")).drop("_row", "_range", "_zero")

    def _with(self, rows: DataFrame) -> Sequences:
        out = object.__new__(Sequences)
        out.size, out.rows = self.size, rows
        return out

    def columns(self, **more: Column) -> Sequences:
        return self._with(self.rows.withColumns(more))

    def near(self, before: int, after: int, make: Callable[[WindowSpec], dict[str, Column]], *by: str) -> Sequences:
        """More columns, from frames of w of at most so many rows before and after a row, among rows alike in `by`."""
        if self.size is None:
            return self._with(self.rows.withColumns(make(along(*KEYS, *by))))
        at, n = "_at", self.size
        piece = F.explode(F.sequence(F.floor((F.col(at) - after) / n), F.floor((F.col(at) + before) / n)))
        rows = self.rows.withColumn("_piece", piece)
        rows = rows.withColumns(make(Window.partitionBy(*KEYS, "_piece", *by).orderBy(at)))
        return self._with(rows.where(F.col("_piece") == F.floor(F.col(at) / n)).drop("_piece"))

    def scan(self, **totals: Total) -> Sequences:
        """More columns: totals along the sequence. Where sequences have several pieces, rows are staged with each piece's own totals."""
        if self.size is None:
            return self._with(self.rows.withColumns({name: x.over(along()) for name, x in totals.items()}))
        keys, w = [*KEYS, "_piece"], Window.partitionBy(*KEYS, "_piece").orderBy("_at")
        rows = self.rows.withColumn("_piece", F.floor(F.col("_at") / self.size))
        local = staged(rows.withColumns({f"_v_{name}": x.value for name, x in totals.items()}).withColumns({f"_o_{name}": x.over(w) for name, x in totals.items()}))
        pieces = local.groupBy(*keys).agg(*(x.of_piece(f"_v_{name}", "_at").alias(f"_t_{name}") for name, x in totals.items()))
        order = Window.partitionBy(*KEYS).orderBy("_piece")
        carried = pieces.select(*keys, *(Total(x.kind, F.col(f"_t_{name}"), x.back, False).over(order).alias(f"_c_{name}") for name, x in totals.items()))
        both = local.join(carried, keys).withColumns({name: x.joined(F.col(f"_c_{name}"), F.col(f"_o_{name}")) for name, x in totals.items()})
        return self._with(both.drop("_piece", *(f"{p}{name}" for name in totals for p in ("_v_", "_o_", "_c_"))))

    def done(self, *drop: str) -> DataFrame:
        return self.rows.drop("_at", *drop)
