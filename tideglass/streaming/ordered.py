"""Rows of each sequence in order, from a stream that brings them out of order: waiting rows as list state, event-time timers, late rows set aside."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PLACE = "next_t long, newest long, wake long, ended boolean"
WAITING = "t_of array<long>, ms_of array<long>, last_of array<boolean>, x_of array<double>"  # x: the features of all rows, one after the other
NO_TS = 1_000_000_000  # seconds; event time of t = 0 where a stream has no ts


@dataclass(frozen=True)
class Lateness:
    """How streams that need order treat rows that come late (all in event time).

    A row whose predecessors have come is taken at once. One that comes after a gap in t waits until the newest event is `wait` ahead
    of it; then it is taken, and what belongs in the gap is late. Rows that come late are set aside in the output (late) for as long as `aside`; still later ones Spark
    drops, and counts in the query's progress. A sequence of which nothing has come for `idle`, counted against the watermark (newest event less `aside`), is over.
    """

    wait: str = "1 hour"
    aside: str = "1 day"
    idle: str = "1 day"

    def ms(self) -> tuple[int, int, int]:
        wait, aside, idle = (int(pd.Timedelta(x).total_seconds() * 1000) for x in (self.wait, self.aside, self.idle))
        if aside < wait:
            raise ValueError("late rows can only be set aside for longer than rows wait")
        return wait, aside, idle


Advance = Callable[[tuple | None, list[int], list[list[float]], bool], tuple[dict[str, list], tuple | None]]


class InOrder(StatefulProcessor):
    """Hands a sequence's rows on by t, each once, to advance(held, t, x, over): what it gives out (columns by name, t among them), and what it holds until the next rows.

    Most sequences bring a few rows a batch, so what counts is the work for each: a row comes in as one array (t, ms, last, features), what a call gives out goes back as one
    row of arrays, and all that is kept of a sequence is one value, read and written once. A timer that is too early is left to fire, which changes nothing, rather than moved with every batch.
    """

    def __init__(self, advance: Advance, state: str, columns: dict[str, str], lateness: Lateness):
        self.advance, self.state, self.columns = advance, state, list(columns)
        self.wait, self.aside, self.idle = lateness.ms()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.row, self.at = handle, Row("sequence_id", "t", *self.columns, "late"), None
        self.kept = handle.getValueState("kept", f"{PLACE}, {WAITING}, has_held boolean, {self.state}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = []
        for r in rows:
            if self.at is None:
                self.at = r.__fields__.index("v")
            t, ms, last, *x = r[self.at]
            new.append((int(t), int(ms), last > 0, x))
        new.sort(key=lambda r: r[:2])
        return self._go(key, new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._go(key, [], timerValues, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass

    def _go(self, key, new: list[tuple], timers, fired: int | None = None) -> Iterator[Row]:
        now = timers.getCurrentWatermarkInMs()
        next_t, newest, wake, ended, *waiting, has_held = (kept := self.kept.get() or (0, -1, -1, False, [], [], [], [], False))[:9]
        held = tuple(kept[9:]) if has_held else None
        if fired is not None and fired == wake:
            wake = -1
        ts, mss, lasts, xs = waiting
        width = len(xs) // len(ts) if ts else 0
        here, late = {t: (t, ms, last, xs[i * width : (i + 1) * width]) for i, (t, ms, last) in enumerate(zip(ts, mss, lasts))}, []
        for r in new:
            if ended or r[0] < next_t or r[0] in here:
                late.append(r)
            else:
                here[r[0]] = r
        newest = max([newest, *(r[1] for r in new)])
        idle = now >= newest + self.idle
        rows = sorted(here.values(), key=lambda r: r[0])
        past = now + self.aside - self.wait  # events up to here have waited long enough
        n = len(rows) if idle else max((i + 1 for i, r in enumerate(rows) if r[1] <= past), default=0)
        reached = rows[n - 1][0] + 1 if n else next_t
        while n < len(rows) and rows[n][0] == reached:
            n, reached = n + 1, reached + 1
        taken = next((i + 1 for i, r in enumerate(rows[:n]) if r[2]), n)  # none after the last one
        over = idle or any(r[2] for r in rows[:taken])
        late += rows[taken:] if over else []
        out = [[r[0] for r in late], *([None] * len(late) for _ in self.columns), [True] * len(late)]
        if (taken or over) and not ended:
            found, held = self.advance(held, [r[0] for r in rows[:taken]], [r[3] for r in rows[:taken]], over)
            for a, b in zip(out, (found["t"], *([None if v is None or v != v else v for v in found[c]] for c in self.columns), [False] * len(found["t"]))):
                a += b
        out = [self.row(key[0], *out)] if out[0] else []
        if idle:  # nothing is left of the sequence
            if wake > now:
                self.handle.deleteTimer(wake)
            self.kept.clear()
            return iter(out)
        rest = [] if over else rows[taken:]
        due = max(min([newest + self.idle, *(r[1] - self.aside + self.wait for r in rest)]), now + 1)
        if wake <= now or due < wake:
            if wake > now:
                self.handle.deleteTimer(wake)
            self.handle.registerTimer(due)
            wake = due
        waiting = [r[0] for r in rest], [r[1] for r in rest], [r[2] for r in rest], [v for r in rest for v in r[3]]
        self.kept.update((reached if taken else next_t, newest, wake, ended or over, *waiting, held is not None, *(held or [None] * (len(kept) - 9 or self.state.count(",") + 1))))
        return iter(out)


def in_order(stream: DataFrame, features: list[str], advance: Advance, state: str, columns: dict[str, str], lateness: Lateness) -> DataFrame:
    """sequence_id, t, the columns that advance gives, and late, in append mode.

    stream has sequence_id, t (counting from 0), the features, last (marks a sequence's final row), and ts, the event time (without it, t in seconds). A late row, a second
    row with the same t and rows after the last one come out with late and nothing else; so do no others. State is in RocksDB, which is set on the session if it isn't.
    """
    conf = stream.sparkSession.conf
    if conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ts = F.col("ts").cast("timestamp") if "ts" in stream.columns else F.timestamp_seconds(F.col("t") + NO_TS)
    x = (F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features)
    v = F.array(*(c.cast("double") for c in (F.col("t"), F.unix_millis(ts), F.coalesce("last", F.lit(False)).cast("int"))), *x)
    kinds = {"t": "long", **columns, "late": "boolean"}
    shape = "sequence_id long, " + ", ".join(f"{n} array<{k}>" for n, k in kinds.items())
    found = stream.select("sequence_id", ts.alias("ts"), v.alias("v")).withWatermark("ts", lateness.aside).groupBy("sequence_id").transformWithState(InOrder(advance, state, columns, lateness), shape, "Append", "EventTime")
    return found.select("sequence_id", F.explode(F.arrays_zip(*kinds)).alias("r")).select("sequence_id", *(F.col("r")[n].alias(n) for n in kinds))
