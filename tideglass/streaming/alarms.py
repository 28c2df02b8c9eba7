"""Structured Streaming forms: summaries by event time, causal windows and online alarms by sequence."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from math import isfinite

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .ordered import Lateness, in_order

STATE = "last_t long, mean double, active int, raw array<double>, decided array<double>, wait_t array<long>, wait_raw array<double>, wait_decided array<double>, wait_active array<int>"


def windowed_summary(stream: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count, mean and greatest score in windows of event time; rows later than the watermark are dropped."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "kind").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score")).select(F.col("w.start").alias("start"), "kind", "n", "mean_score", "max_score")


def session_summary(stream: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "sequence_id").agg(F.count("*").alias("n"), F.max("score").alias("max_score")).select("sequence_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "max_score")


class _Alarms:
    """What is known of one sequence between batches: the end of its last stretch of scores, and rows that wait for the next ones.

    Row by row: what a batch brings of one sequence is mostly too little for anything else to pay.
    """

    def __init__(self, width: int, span: int, on: float, off: float, enter: int, leave: int, held: tuple | None):
        self.width, self.alpha, self.on, self.off, self.enter, self.leave = width, 2 / (span + 1), on, off, enter, leave
        keep = max(width, enter, leave) - 1
        self.last_t, self.mean, active, raw, decided, *waiting = held or (None, None, 0, [], [], [], [], [], [])
        self.active, self.waiting = bool(active), deque([t, x, d, bool(p)] for t, x, d, p in zip(*waiting))
        self.raw, self.decided = deque(maxlen=keep), deque(maxlen=keep)
        self.high: deque[tuple[int, float]] = deque()  # of the last width scores those that none after them reaches, with their places
        self.n = self.above = self.below = 0  # scores of the stretch, and decisions up to the last that are all at or above on, or below off
        for x in raw:
            self._highest(x)
        for d in decided:
            self._decide(d)
        self.out: list[tuple] = []

    def held(self) -> tuple:
        return self.last_t, self.mean, int(self.active), list(self.raw), list(self.decided), *([r[i] for r in self.waiting] for i in range(3)), [int(r[3]) for r in self.waiting]

    def add(self, t: Sequence[int], score: Sequence[float]) -> None:
        """Rows that follow, in order; ones without a finite score end the stretch."""
        for at, x in zip(map(int, t), map(float, score)):
            if self.last_t is not None and at <= self.last_t:
                raise ValueError("rows of a sequence must come in order of t, each once")
            self.last_t = at
            if isfinite(x):
                self._next(at, x)
            else:
                self.flush()
                self.out.append((at, x, None, 0))

    def _highest(self, x: float) -> float:
        self.raw.append(x)
        while self.high and self.high[-1][1] <= x:
            self.high.pop()
        self.high.append((self.n, x))
        self.n += 1
        if self.high[0][0] < self.n - self.width:
            self.high.popleft()
        return self.high[0][1]

    def _decide(self, d: float) -> None:
        self.decided.append(d)
        self.above = self.above + 1 if d >= self.on else 0
        self.below = self.below + 1 if d < self.off else 0

    def _next(self, at: int, x: float) -> None:
        high = self._highest(x)
        self.mean = x if self.mean is None else (1 - self.alpha) * self.mean + self.alpha * x
        d = max(high, self.mean)
        self._decide(d)
        self.waiting.append([at, x, d, self.active])
        if self.above >= self.enter:  # the rows that wait are those of the entry
            for r in self.waiting:
                r[3] = True
            self.active = True
        elif self.below >= self.leave:
            self.active = False
        while len(self.waiting) >= self.enter:
            self._give()

    def _give(self) -> None:
        t, x, d, alarm = self.waiting.popleft()
        self.out.append((t, x, d, int(alarm)))

    def flush(self) -> None:
        """The stretch is over: nothing that waits can become an entry any more."""
        while self.waiting:
            self._give()
        for x in (self.raw, self.decided, self.high):
            x.clear()
        self.mean, self.active, self.n, self.above, self.below = None, False, 0, 0, 0


def online_alarms(stream: DataFrame, width: int, span: int, on: float, off: float, enter: int = 1, leave: int = 1, lateness: Lateness = Lateness()) -> DataFrame:
    """Append mode: each row with its decision score and alarm, as decision_scores and hysteresis give them over all rows at once.

    An alarm begins at the first of enter decisions at or above on, so a row comes out once the enter - 1 rows after it are known, a
    row without a score has come, or the sequence is over (the column last, or idle). State is that of max(width, enter, leave) rows of
    each sequence, and rows that wait for earlier ones. Late rows come out with late and change no alarm (see Lateness and in_order).
    """

    def advance(held: tuple | None, t: list[int], x: list[list[float]], over: bool) -> tuple[dict[str, list], tuple | None]:
        alarms = _Alarms(width, span, on, off, enter, leave, held)
        alarms.add(t, [v[0] for v in x])
        if over:
            alarms.flush()
        names = ("t", "score", "decision", "pred")
        out = dict(zip(names, map(list, zip(*alarms.out)))) if alarms.out else {n: [] for n in names}
        return out | {"score": [v if isfinite(v) else None for v in out["score"]]}, None if over else alarms.held()

    return in_order(stream, ["score"], advance, STATE, {"score": "double", "decision": "double", "pred": "int"}, lateness)


def scored_windows(windows: DataFrame, score: Callable[[np.ndarray], np.ndarray], keys: list[str], chunk: int = 16_384) -> DataFrame:
    """A score for each window (column w: rows of features), by a function of (windows, rows, features), chunk windows a call or the rest of a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            while n >= chunk:
                rows = pd.concat(held, ignore_index=True)
                yield scored(rows[:chunk])
                held, n = [rows[chunk:]], n - chunk
        if n:
            yield scored(pd.concat(held, ignore_index=True))

    def scored(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[keys].assign(score=score(np.array([[list(r) for r in w] for w in rows["w"]], float)))

    fields = ", ".join(f"`{k}` {windows.schema[k].dataType.simpleString()}" for k in keys)
    values = F.transform("w", lambda r: F.array(*(r[f].cast("double") for f in windows.schema["w"].dataType.elementType.names)))
    return windows.select(*keys, values.alias("w")).mapInPandas(run, f"{fields}, score double")


def causal_scores(stream: DataFrame, features: list[str], width: int, score: Callable[[np.ndarray], np.ndarray], lateness: Lateness = Lateness()) -> DataFrame:
    """Append mode: a score for each row, by a function of (windows, rows, features) over the last width rows.

    Before the start the first row is repeated. State is the last width - 1 rows of each sequence and rows that wait for earlier ones; it
    goes when the sequence is over. Late rows come out with late and no score (see Lateness and in_order).
    """

    def advance(held: tuple | None, t: list[int], x: list[list[float]], over: bool) -> tuple[dict[str, list], tuple | None]:
        if not t:
            return {"t": [], "score": []}, None
        x = np.array(x, float)
        before = np.array(held[0], float).reshape(-1, len(features)) if held else np.repeat(x[:1], width - 1, axis=0)
        x = np.concatenate((before, x))
        windows = np.lib.stride_tricks.sliding_window_view(x, width, axis=0).transpose(0, 2, 1)
        return {"t": t, "score": np.asarray(score(windows), float).tolist()}, None if over else (x[len(x) - width + 1 :].ravel().tolist(),)

    return in_order(stream, features, advance, "tail array<double>", {"score": "double"}, lateness)


def patch_scores(stream: DataFrame, features: list[str], length: int, stride: int, score: Callable[[np.ndarray], np.ndarray], lateness: Lateness = Lateness()) -> DataFrame:
    """Append mode: for each row the mean score of the patches that cover it, once the length - 1 rows after it are known.

    Patches start at every stride-th row and are scored by a function of (patches, rows, features). When a sequence is over (the column
    last, or idle) what is held back comes out; one shorter than a patch is filled up in front with its first row. Rows that no patch covers
    have no score (null). Rows count as neighbours as they are taken: where rows of a gap never came, patches go over it. State is at most
    2 * length + stride rows of each sequence and rows that wait for earlier ones. Late rows come out with late and no score (see Lateness and in_order).
    """

    def advance(held: tuple | None, t: list[int], x: list[list[float]], over: bool) -> tuple[dict[str, list], tuple | None]:
        values, times, start, out = held or ([], [], 0, 0)
        x = np.concatenate([np.array(v, float).reshape(-1, len(features)) for v in (values, x)])
        times = [*times, *t]
        end = start + len(x)
        until = end if over else max(out, end - length + 1)
        if over and end < length:
            scores = np.repeat(score(np.concatenate((np.repeat(x[:1], length - end, axis=0), x))[None]), end)[out:] if end else np.zeros(0)
        else:
            total, n = np.zeros(len(x)), np.zeros(len(x))
            at = np.arange(0, len(x) - length + 1, stride)  # start is a multiple of the stride
            if len(at):
                for i, s in zip(at, score(np.stack([x[i : i + length] for i in at]))):
                    total[i : i + length] += s
                    n[i : i + length] += 1
            scores = np.where(n > 0, total / np.maximum(n, 1), np.nan)[out - start : until - start]
        keep = max(0, until - length + 1) // stride * stride
        rest = max(0, keep - start)
        return {"t": times[out - start : until - start], "score": scores.tolist()}, None if over else (x[rest:].ravel().tolist(), times[rest:], keep, until)

    return in_order(stream, features, advance, "held array<double>, times array<long>, start long, out long", {"score": "double"}, lateness)


class DroppedRows(StreamingQueryListener):
    """Counts what stateful operators have dropped because it was behind the watermark, by query id. An aggregation sees rows after partial sums: late rows of one window and task count once."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.over: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows[str(p.id)] = self.rows.get(str(p.id), 0) + sum(s.numRowsDroppedByWatermark for s in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.over.add(str(event.runId))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, dropped: DroppedRows | None = None) -> DataFrame:
    """All that is there now, in append mode, into Parquet; the file sink and the checkpoint make a rerun exact.

    With dropped, a listener that is added for the run, one knows afterwards how many rows came too late for the state.
    """
    spark = stream.sparkSession
    if dropped is not None:
        spark.streams.addListener(dropped)
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    if dropped is not None:
        for _ in range(600):  # events come in their own thread
            if str(query.runId) in dropped.over:
                break
            time.sleep(0.1)
        spark.streams.removeListener(dropped)
    return spark.read.schema(stream.schema).parquet(path)


def event_stream(spark: SparkSession, path: str, schema, files: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
