"""The threshold with the best alarm score, over all scores at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import INF, KEYS, along, safe_score
from ..functions.scans import PIECE, Sequences, Total, fits
from ..functions.staging import HELD, exact_quantiles, running_totals, staged
from .scores import channels

TERMS = ["nf", "fa", "early", "late", "d", "nom"]
BLOCK = 1 << 17  # rows that a task takes at once, up to the end of a sequence


def _y():
    return (F.coalesce("label", F.lit(0)) != 0).cast("int").alias("y")


@dataclass
class _Run:
    """What a task knows of one run: changes by value, and what the score of all rows in alarm needs."""

    changes: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    size: int = 0
    counts: np.ndarray = field(default_factory=lambda: np.zeros(3))  # normal rows, sequences, anomalies
    first: dict | None = None
    last: dict | None = None

    def add(self, values: np.ndarray, terms: np.ndarray) -> bool:
        """Takes changes; whether so many values are held that they should be handed on."""
        self.changes.append((values, terms))
        self.size += len(values)
        if self.size > HELD:
            values, at = np.unique(np.concatenate([v for v, _ in self.changes]), return_inverse=True)
            terms = np.concatenate([x for _, x in self.changes], axis=1)
            self.changes, self.size = [(values, np.stack([np.bincount(at, x, len(values)) for x in terms]))], len(values)
        return self.size > HELD // 2


def _changes(s: np.ndarray, y: np.ndarray, first: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The finite values (and inf) of whole sequences, one after the other, and the changes of each term as the threshold falls to them; see _deltas.

    Scores are taken by their rank, so that all that is needed are counts by rank and, for the anomalies, one sort by anomaly and rank.
    """
    values, rank = np.unique(s, return_inverse=True)
    count = len(values)
    add = lambda at, weights=None: np.bincount(at, weights, count)
    a, b, joined = y[:-1], y[1:], ~first[1:]
    pair = np.minimum(rank[:-1], rank[1:])
    inside, border, early, late = joined & a & b, joined & ~(a & b), joined & ~a & b, joined & a & ~b
    edges = np.flatnonzero(first | np.append(True, a != b))  # of stretches alike in y
    starts = edges[y[edges]]
    anomaly = np.searchsorted(starts, np.arange(len(y)), side="right") - 1
    # the rows of a gap with the last row before and the first row after it
    gap = np.flatnonzero(~y[edges[:-1]] & ~first[edges[:-1]] & ~first[edges[1:]])
    after = edges[gap + 1]
    bridge = np.minimum(np.minimum(np.minimum.reduceat(rank, edges)[gap], rank[after]), rank[edges[gap] - 1])
    normal = add(rank[~y])
    out = [normal, normal - add(pair[border]) + add(bridge), add(pair[early]), add(pair[late])]
    rows, pairs = np.flatnonzero(y), np.flatnonzero(inside)
    weight = np.ldexp(1.0, -np.minimum(t[rows] - t[starts[anomaly[rows]]] + 1, 1100).astype(np.int32))
    key = np.concatenate((anomaly[rows], anomaly[pairs], anomaly[after])) * count + (count - 1 - np.concatenate((rank[rows], pair[pairs], bridge)))
    if len(key):
        order, n = np.argsort(key), (len(rows), len(pairs), len(after))
        key = key[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        whose, value = key[at] // count, count - 1 - key[at] % count
        fresh = np.append(True, whose[1:] != whose[:-1])
        zero = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]

        def so_far(x):
            total = np.cumsum(own := np.add.reduceat(np.repeat(x, n)[order], at))
            return total - (total - own)[zero]

        al, br = so_far([1, -1, 0]), so_far([0, 0, 1])
        wt = pd.Series(np.add.reduceat(np.concatenate((weight, np.zeros(n[1] + n[2])))[order], at)).groupby(whose).cumsum().to_numpy()
        hit = al >= 1 + br
        for now in (hit.astype(float), np.where(hit, np.ldexp(1 + wt, -al.astype(np.int32)), 0.0)):
            out.append(add(value, now - np.where(fresh, 0.0, np.append(0.0, now[:-1]))))
    else:
        out += [np.zeros(count)] * 2
    some = values > -INF
    return values[some], np.stack(out)[:, some].astype(float)


def _by_task(scores: DataFrame, columns: list[str], named: bool, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """changes(run_key, value, terms) and _everything, of sequences that are known to fit a task; named: each column is a run, by its name.

    A window puts each sequence into one task, in order (without another shuffle where that is how rows come); a task adds up what its sequences change at
    each value, so that only sums by value go on. They are staged.
    """
    run_kind, id_kind = ("string" if named else scores.schema["run_key"].dataType.simpleString()), scores.schema["sequence_id"].dataType.simpleString()
    rows = scores.select(*KEYS, F.col("t").cast("long").alias("t"), _y(), *(safe_score(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(columns)))
    rows = rows.withColumn("was", F.lag("y").over(along()))  # none at the head of a sequence

    def out(key, run: _Run, kind: pa.DataType, id_kind: pa.DataType, end: bool) -> Iterator[pa.RecordBatch]:
        fields = [pa.field("run_key", kind), *(pa.field(c, pa.float64()) for c in ("value", *TERMS, "normal", "seqs", "n"))]
        fields += [pa.field("first", pa.struct([pa.field("sequence_id", id_kind), pa.field("len1", pa.float64())])), pa.field("last", pa.struct([pa.field("sequence_id", id_kind), pa.field("y", pa.int32())]))]
        schema = pa.schema(fields)
        for values, terms in run.changes:
            nulls = [pa.nulls(len(values), f.type) for f in fields[8:]]
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(values), kind), pa.array(values), *map(pa.array, terms), *nulls], schema=schema)
        run.changes, run.size = [], 0
        if end:
            yield pa.RecordBatch.from_pylist([{"run_key": key, "normal": run.counts[0], "seqs": run.counts[1], "n": run.counts[2], "first": run.first, "last": run.last}], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict = {}
        held: list[pa.RecordBatch] = []
        kinds: list[pa.DataType] = []
        n, need = 0, size

        def take(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            y, t = block["y"].to_numpy() != 0, block["t"].to_numpy()
            first = block["was"].is_null().to_numpy(zero_copy_only=False)
            if (~first[1:] & (t[1:] < t[:-1])).any():
                raise ValueError("rows of a sequence are out of order")
            codes = np.zeros(len(y), np.int64) if named else block["run_key"].dictionary_encode("encode").indices.to_numpy()
            cuts = np.flatnonzero(codes[1:] != codes[:-1]) + 1
            met = set()
            for lo, hi in zip([0, *cuts], [*cuts, len(y)]):
                yy, ff, tt = y[lo:hi], first[lo:hi], t[lo:hi]
                starts = np.flatnonzero(yy & (ff | np.append(True, ~yy[:-1])))
                heads = np.flatnonzero(ff)
                for i, c in enumerate(columns):
                    key = c if named else block["run_key"][lo].as_py()
                    met.add(key)
                    one = runs.setdefault(key, _Run())
                    one.counts += (len(yy) - yy.sum(), len(heads), len(starts))
                    one.last = {"sequence_id": block["sequence_id"][hi - 1].as_py(), "y": int(yy[-1])}
                    if one.first is None and len(starts):
                        at = starts[0]
                        end = np.append(heads, len(yy))[np.searchsorted(heads, at, side="right")]
                        normal = np.flatnonzero(~yy[at:end])
                        one.first = {"sequence_id": block["sequence_id"][lo + at].as_py(), "len1": float((tt[at + normal[0]] if len(normal) else tt[end - 1] + 1) - tt[at])}
                    if one.add(*_changes(block[f"s{i}"].to_numpy()[lo:hi], yy, ff, tt)):
                        yield from out(key, one, *kinds, False)
            for key in [k for k in runs if k not in met]:  # runs come one after the other
                yield from out(key, runs.pop(key), *kinds, True)

        for batch in batches:
            if not kinds:
                kinds += [pa.string() if named else batch.schema.field("run_key").type, batch.schema.field("sequence_id").type]
            held.append(batch)
            n += batch.num_rows
            if n >= need:
                block = pa.concat_batches(held)
                cut = int(np.flatnonzero(block["was"].is_null().to_numpy(zero_copy_only=False))[-1])
                if cut:
                    yield from take(block.slice(0, cut))
                held, n = [block.slice(cut)], block.num_rows - cut
                need = max(size, 2 * n)
        if n:
            yield from take(pa.concat_batches(held))
        for key, one in runs.items():
            yield from out(key, one, *kinds, True)

    shape = f"run_key {run_kind}, value double, {', '.join(f'{c} double' for c in (*TERMS, 'normal', 'seqs', 'n'))}, first struct<sequence_id: {id_kind}, len1: double>, last struct<sequence_id: {id_kind}, y: int>"
    found = staged(rows.mapInArrow(run, shape))
    total = found.where("value is null").groupBy("run_key").agg(*(F.sum(c).alias(c) for c in ("normal", "seqs", "n")), F.max("last")["y"].alias("last_y"), F.min("first")["len1"].alias("len1"))
    return found.where("value is not null").select("run_key", "value", *TERMS), _all_in_alarm(total)


def _labelled(scores: DataFrame, size: int | None) -> DataFrame:
    """s, y, k (anomalies so far), start of the last of them, was (the row before's y), and the next row's s and y; staged."""
    rows = Sequences(scores.select(*KEYS, "t", safe_score().alias("s"), _y()), size).near(1, 1, lambda w: {"was": F.lag("y").over(w), "s1": F.lead("s").over(w), "y1": F.lead("y").over(w)})
    starts = (F.col("y") == 1) & (F.coalesce("was", F.lit(0)) == 0)
    rows = rows.scan(k=Total("sum", starts.cast("long")), start=Total("max", F.when(starts, F.col("t"))))
    return staged(rows.columns(pair=F.least("s", "s1")).done())


def _deltas(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes as the threshold falls to a value: of the whole run, and of each anomaly."""
    zero = F.lit(0.0)
    normal, border = F.col("y") == 0, F.col("y1").isNotNull()
    early, late = normal & (F.col("y1") == 1), (F.col("y") == 1) & (F.col("y1") == 0)
    inside = (F.col("y") == 1) & (F.col("y1") == 1)
    item = lambda value, nf=0, fa=0, e=0, l=0: F.struct(*(F.lit(x).cast("double").alias(n) for n, x in (("value", value), ("nf", nf), ("fa", fa), ("early", e), ("late", l))))  # noqa: E731, E741
    items = F.array(
        F.when(normal, item(F.col("s"), nf=1, fa=1)),
        F.when(border & ~inside, F.struct(F.col("pair").alias("value"), zero.alias("nf"), F.lit(-1.0).alias("fa"), early.cast("double").alias("early"), late.cast("double").alias("late"))),
    )
    whole = rows.select("run_key", F.explode(items).alias("d")).where("d is not null").select("run_key", "d.*")
    # the rows of a gap with the last row before and the first row after it
    gaps = rows.withColumn("kk", F.when(F.col("y") == 1, F.col("k")).otherwise(F.col("k") + 1))
    low = gaps.groupBy(*KEYS, "kk").agg(F.min(F.when(normal, F.col("s"))).alias("low"), F.min_by(F.when(F.col("y") == 1, F.col("s")), F.when(F.col("y") == 1, F.col("t"))).alias("first_s"), F.min(F.when(early, F.lit(1))).alias("_"))
    lasts = rows.where("y = 1").groupBy(*KEYS, "k").agg(F.max_by("s", "t").alias("last_s")).select(*KEYS, (F.col("k") + 1).alias("kk"), "last_s")
    bridges = low.join(lasts, [*KEYS, "kk"]).where("low is not null and first_s is not null").select(*KEYS, F.col("kk").alias("k"), F.least("low", "first_s", "last_s").alias("value"))
    whole = whole.union(bridges.select("run_key", "value", zero.alias("nf"), F.lit(1.0).alias("fa"), zero.alias("early"), zero.alias("late")))
    weight = F.pow(F.lit(2.0), -(F.col("t") - F.col("start") + 1).cast("double"))
    own = F.array(
        F.struct(F.col("s").alias("value"), F.lit(1.0).alias("al"), weight.alias("wt"), zero.alias("br")),
        F.when(inside, F.struct(F.col("pair").alias("value"), F.lit(-1.0).alias("al"), zero.alias("wt"), zero.alias("br"))),
    )
    each = rows.where("y = 1").select(*KEYS, "k", F.explode(own).alias("d")).where("d is not null").select(*KEYS, "k", "d.*")
    each = each.union(bridges.select(*KEYS, "k", "value", zero.alias("al"), zero.alias("wt"), F.lit(1.0).alias("br")))
    return whole.where(F.col("value") > F.lit(-INF)), each.where(F.col("value") > F.lit(-INF))


def sweep_curve(scores: DataFrame, size: int | None = PIECE) -> DataFrame:
    """The alarm score of score >= value for every finite value of each run.

    Each term of the alarm score is a step function of the threshold, so one table of changes and running sums
    in falling order gives it everywhere; sequences only meet in the sums by run, which ranges of values share
    out. The table of changes is written to the shared folder when this is called. Sequences of up to size rows are taken whole, many in a task; where there are longer ones,
    all are taken in pieces, and the values of one anomaly in ranges.
    """
    return _curve(_by_task(scores, ["score"], False)[0] if size is None or fits(scores, size) else _by_piece(_labelled(scores, size)))


def _by_piece(rows: DataFrame) -> DataFrame:
    """changes(run_key, value, terms) of sequences of any length."""
    whole, each = _deltas(rows)
    sums = ("al", "wt", "br")
    by_value = each.groupBy(F.struct(*KEYS, "k").alias("a"), "value").agg(*(F.sum(c).alias(c) for c in sums))
    run = running_totals(by_value, "a", "value", list(sums), own=True)

    def value(al, wt, br):
        hit = (al >= 1 + br).cast("double")
        return hit, hit * (1 + wt) * F.pow(F.lit(2.0), -al)

    now, was = value(*(F.col(f"{c}_") for c in sums)), value(*(F.col(f"{c}_") - F.col(c) for c in sums))
    zero = F.lit(0.0)
    found = run.select("a.run_key", "value", zero.alias("nf"), zero.alias("fa"), zero.alias("early"), zero.alias("late"), (now[0] - was[0]).alias("d"), (now[1] - was[1]).alias("nom"))
    return whole.select("*", zero.alias("d"), zero.alias("nom")).union(found)


def _curve(changes: DataFrame) -> DataFrame:
    at = running_totals(changes.groupBy("run_key", "value").agg(*(F.sum(c).alias(c) for c in TERMS)), "run_key", "value", TERMS)
    return at.select("run_key", "value", _score(*(F.col(c) for c in TERMS)).alias("alarm_score"))


def _score(nf, fa, early, late, d, nom):
    points = F.when(nf > 0.5, 1 - 1 / nf).otherwise(0.0)
    nominal = F.when(d > 0.5, nom / d).otherwise(0.0)
    return F.round(d - fa / 2 - points - 0.75 * early - 0.25 * late + nominal, 9)


def _everything(rows: DataFrame) -> DataFrame:
    """The alarm score when all rows are in alarm, sequences standing one after the other with a row before each."""
    marked = rows.select(*KEYS, "t", "y", ((F.col("y") == 1) & (F.coalesce("was", F.lit(0)) == 0)).cast("int").alias("starts"))
    first = F.min(F.when(F.col("starts") == 1, F.struct("sequence_id", "t"))).alias("first")
    total = marked.groupBy("run_key").agg(F.sum((1 - F.col("y")).cast("double")).alias("normal"), F.countDistinct("sequence_id").cast("double").alias("seqs"), F.sum("starts").cast("double").alias("n"), F.max(F.struct("sequence_id", "t", "y"))["y"].alias("last_y"), first)
    at_first = marked.join(F.broadcast(total.select("run_key", "first")), "run_key").where((F.col("sequence_id") == F.col("first.sequence_id")) & (F.col("t") >= F.col("first.t")))
    ended = at_first.groupBy("run_key").agg(F.min(F.when(F.col("y") == 0, F.col("t"))).alias("end"), F.max("t").alias("last_t"), F.min("t").alias("begin"))
    length = (F.coalesce("end", F.col("last_t") + 1) - F.col("begin")).cast("double")
    return _all_in_alarm(total.join(ended, "run_key", "left").withColumn("len1", length))


def _all_in_alarm(total: DataFrame) -> DataFrame:
    none = F.col("n") == 0
    nominal = (2 - F.pow(F.lit(2.0), -F.col("len1"))) / 2
    return total.select("run_key", F.lit(-INF).alias("value"), _score(F.col("normal") + F.col("seqs"), none.cast("double"), F.col("n"), F.col("n") - F.coalesce("last_y", F.lit(0)), (~none).cast("double"), F.when(none, 0.0).otherwise(nominal)).alias("alarm_score"))


def best_threshold(scores: DataFrame, size: int | None = PIECE) -> DataFrame:
    """run_key, threshold, best_score, num_steps of scores(run_key, sequence_id, t, score, label).

    Over all distinct scores and -inf; 0 at +inf unless one is better; of equally good ones the largest.
    """
    if size is None or fits(scores, size):
        changes, everything = _by_task(scores, ["score"], False)
        return _best(_curve(changes).union(everything))
    rows = _labelled(scores, size)
    return _best(_curve(_by_piece(rows)).union(_everything(rows)))


def best_thresholds(df: DataFrame, features: list[str], size: int | None = PIECE) -> DataFrame:
    """best_threshold of each feature of one run's rows, with the feature's name as run_key; rows stay whole, with all features side by side."""
    if size is None or fits(df, size):
        changes, everything = _by_task(df, features, True)
        return _best(_curve(changes).union(everything))
    return best_threshold(channels(df, features).select(F.col("feature").alias("run_key"), "sequence_id", "t", F.col("x").alias("score"), "label"), size)


def _best(curve: DataFrame) -> DataFrame:
    best = curve.groupBy("run_key").agg(F.max(F.struct("alarm_score", "value")).alias("b"), F.count("*").alias("num_steps"))
    better = F.col("b.alarm_score") > 0
    return best.select("run_key", F.when(better, F.col("b.value")).otherwise(F.lit(INF)).alias("threshold"), F.when(better, F.col("b.alarm_score")).otherwise(0.0).alias("best_score"), "num_steps")


def with_sentinels(scores: DataFrame) -> DataFrame:
    """A row without score and label in front of every sequence."""
    heads = scores.select(*KEYS).distinct().select(*KEYS, F.lit(-1).cast("long").alias("t"), F.lit(-INF).alias("score"), F.lit(0).cast("long").alias("label"))
    return scores.select(*KEYS, "t", safe_score().alias("score"), F.col("label").cast("long").alias("label")).union(heads)


def quantile_thresholds(scores: DataFrame, fractions: list[float]) -> DataFrame:
    """run_key, fraction, threshold: the score that the given fraction of rows (and sentinels) is above.

    Between two scores as far as the place falls between their rows. Exact, and counted when this is called.
    """
    found = exact_quantiles(with_sentinels(scores), ["run_key"], "score", [1 - f for f in fractions])
    each = F.arrays_zip(F.array(*(F.lit(float(f)) for f in fractions)).alias("fraction"), F.col("q").alias("threshold"))
    return found.select("run_key", F.explode(each).alias("x")).select("run_key", "x.fraction", "x.threshold")


def fixed_thresholds(scores: DataFrame, fractions: DataFrame) -> DataFrame:
    """run_key, fraction, threshold: as quantile_thresholds, each run with its own fraction of fractions(run_key, fraction); a run without one is an error."""
    known = fractions.select("run_key", F.col("fraction").cast("double").alias("fraction"))
    without = scores.select("run_key").distinct().join(known, "run_key", "left_anti")
    if not without.isEmpty():
        raise ValueError(f"no fraction is known of {[r.run_key for r in without.limit(5).collect()]}")
    values = sorted(r.fraction for r in known.select("fraction").distinct().collect())  # at most one for each run
    return quantile_thresholds(scores, values).join(known, ["run_key", "fraction"]).select("run_key", "fraction", "threshold")
