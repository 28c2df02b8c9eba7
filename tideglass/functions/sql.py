"""Functions for SQL users: event_segments (a table function) and alarm_score_agg."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession, functions as F


class EventSegments:
    """SELECT * FROM event_segments(TABLE (...) PARTITION BY sequence_id ORDER BY t), of columns sequence_id, t, mask."""

    def __init__(self):
        self.open = None

    def eval(self, row):
        s, t, m = row["sequence_id"], row["t"], row["mask"]
        if self.open and not m:
            yield self.open
            self.open = None
        elif m:
            self.open = (s, self.open[1] if self.open else t, t + 1)

    def terminate(self):
        if self.open:
            yield self.open


def edges(mask) -> list[tuple[int, int]]:
    d = np.diff(np.concatenate(([0], np.asarray(mask).astype(int), [0])))
    return list(zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist()))


def alarm_score_of(t: pd.Series, pred: pd.Series, label: pd.Series) -> float:
    """The alarm score of one sequence; rows in any order."""
    order = t.argsort()
    p, y = (c.iloc[order].to_numpy() != 0 for c in (pred, label))
    if not p.any():
        return 0.0
    anomalies = edges(y)
    credited, false = set(), 0
    for a, b in edges(p):
        hit = next((k for k, (u, v) in enumerate(anomalies) if u < b and a < v), None)
        false += hit is None
        credited |= set() if hit is None else {hit}
    nominal = []
    for k in credited:
        u, v = anomalies[k]
        nominal.append((1 + sum(2.0 ** -(i - u + 1) for i in range(u, v) if p[i])) * 2.0 ** -len(edges(p[u:v])))
    points = int((p & ~y).sum())
    early = sum(u > 0 and p[u - 1] and p[u] for u, _ in anomalies)
    late = sum(v < len(p) and p[v - 1] and p[v] for _, v in anomalies)
    return float(len(credited) - false / 2 - (1 - 1 / points if points else 0) - 0.75 * early - 0.25 * late + (sum(nominal) / len(nominal) if nominal else 0))


def register(spark: SparkSession) -> None:
    spark.udtf.register("event_segments", F.udtf(EventSegments, returnType="sequence_id long, start_t long, end_t long"))
    spark.udf.register("alarm_score_agg", F.pandas_udf(alarm_score_of, "double"))
