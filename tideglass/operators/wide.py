"""Tables of hundreds of channels: second moments, correlations and frames as matrix work in tasks, not an expression for each pair of channels.

Rows travel as one array of doubles. Sequences are laid out in groups (whole, or pieces of bounded size with a halo), a task goes
through its groups with NumPy, and what it adds up (matrices of channels by channels) leaves it once, in blocks that are merged in a tree. Missing values are NaN here;
a value that is NaN counts as missing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import KEYS, along
from ..functions.scans import Sequences

BLOCK = 256  # channels by channels in one row of second moments
CELLS = 1 << 22  # values that a task holds of one piece, and of one tile of pairs
FAN = 256  # parts merged at once
MOMENTS = "kind int, bi int, bj int, n double, mi binary, mj binary, m2 binary"


def row_array(features: list[str]) -> Column:
    return F.array(*(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in features))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


# second moments


@dataclass
class Moments:
    """Number, means and sums of products of deviations from them; two of these make that of both."""

    n: float
    mean: np.ndarray
    m2: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        mean = x[0] + (x - x[0]).mean(axis=0)  # exact for a channel that doesn't change
        d = x - mean
        return cls(float(len(x)), mean, d.T @ d)

    def __add__(self, other: Moments) -> Moments:
        n, d = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + d * (other.n / n), self.m2 + other.m2 + np.outer(d, d) * (self.n * other.n / n))


def _blocks_of(found: dict[int, Moments]) -> Iterator[pa.RecordBatch]:
    rows = []
    for kind, m in found.items():
        cuts = range(0, len(m.mean), BLOCK)
        for i in cuts:
            for j in (j for j in cuts if j >= i):
                a, b = slice(i, i + BLOCK), slice(j, j + BLOCK)
                rows.append((kind, i // BLOCK, j // BLOCK, m.n, m.mean[a].tobytes(), m.mean[b].tobytes(), np.ascontiguousarray(m.m2[a, b]).tobytes()))
    if rows:
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["kind", "bi", "bj", "n", "mi", "mj", "m2"])


def _merged(group: pa.Table) -> pa.Table:
    n = mi = mj = m2 = None
    for r in zip(*(group.column(c) for c in ("n", "mi", "mj", "m2"))):
        k, a, b, m = r[0].as_py(), *(np.frombuffer(x.as_py()) for x in r[1:])
        m = m.reshape(len(a), len(b))
        if n is None:
            n, mi, mj, m2 = k, a, b, m
            continue
        da, db, both = a - mi, b - mj, n + k
        m2 = m2 + m + np.outer(da, db) * (n * k / both)
        mi, mj, n = mi + da * (k / both), mj + db * (k / both), both
    out = group.select(["kind", "bi", "bj"]).slice(0, 1)
    for name, v in (("n", pa.array([n])), ("mi", pa.array([mi.tobytes()])), ("mj", pa.array([mj.tobytes()])), ("m2", pa.array([m2.tobytes()]))):
        out = out.append_column(name, v)
    return out


def tree(parts: DataFrame) -> DataFrame:
    """One row for each block of parts(MOMENTS), of which every task has one: FAN tasks' parts meet first, then what they give."""
    keys = ["kind", "bi", "bj"]
    some = parts.withColumn("_p", F.floor(F.spark_partition_id() / FAN)).groupBy(*keys, "_p").applyInArrow(lambda g: _merged(g), MOMENTS)
    return some.groupBy(*keys).applyInArrow(lambda g: _merged(g), MOMENTS)


def moments(df: DataFrame, features: list[str], missing: float | None = None) -> DataFrame:
    """Blocks of the features' second moments: a row for each pair of BLOCK channels. Rows with a missing value are left out, or have `missing` in its place. No shuffle of rows."""
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Moments | None = None
        for batch in batches:
            x = matrix(batch.column("x"), width)
            gone = np.isnan(x)
            x = x[~gone.any(axis=1)] if missing is None else np.where(gone, missing, x)
            if len(x):
                total = Moments.of(x) if total is None else total + Moments.of(x)
        yield from _blocks_of({} if total is None else {0: total})

    return tree(df.select(row_array(features).alias("x")).mapInArrow(run, MOMENTS))


def whole(blocks: DataFrame, width: int) -> dict[int, Moments]:
    """Moments of each kind, on the driver: matrices of channels by channels."""
    out: dict[int, Moments] = {}
    for r in blocks.toLocalIterator():
        m = out.setdefault(r.kind, Moments(r.n, np.zeros(width), np.zeros((width, width))))
        a, b = r.bi * BLOCK, r.bj * BLOCK
        mi, mj = np.frombuffer(r.mi), np.frombuffer(r.mj)
        m.mean[a : a + len(mi)], m.mean[b : b + len(mj)] = mi, mj
        m.m2[a : a + len(mi), b : b + len(mj)] = np.frombuffer(r.m2).reshape(len(mi), len(mj))
        m.m2[b : b + len(mj), a : a + len(mi)] = m.m2[a : a + len(mi), b : b + len(mj)].T
    return out


def products(df: DataFrame, features: list[str]) -> DataFrame:
    """a, b (places in features, a <= b) and v: the sum of the two channels' products over rows that have both."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                mi, mj = np.frombuffer(r["mi"]), np.frombuffer(r["mj"])
                v = np.frombuffer(r["m2"]).reshape(len(mi), len(mj)) + r["n"] * np.outer(mi, mj)
                a, b = np.triu_indices(len(mi)) if r["bi"] == r["bj"] else (x.ravel() for x in np.indices(v.shape))
                yield pa.RecordBatch.from_arrays([pa.array((a + r["bi"] * BLOCK).astype(np.int32)), pa.array((b + r["bj"] * BLOCK).astype(np.int32)), pa.array(v[a, b])], ["a", "b", "v"])

    return moments(df, features, 0.0).mapInArrow(cells, "a int, b int, v double")


def channel_graph(df: DataFrame, features: list[str], k: int, self_loops: bool = False) -> DataFrame:
    """Edges of the symmetrised graph of each channel's k most similar others: a, b, weight = sigmoid(cosine). With self_loops each channel has one to itself, which doesn't count among the k."""
    cells = products(df, features)
    norms = F.broadcast(cells.where("a = b").select(F.col("a").alias("i"), F.sqrt("v").alias("norm")))  # a row for each channel
    weight = 1 / (1 + F.exp(-F.try_divide(F.col("v"), F.col("x.norm") * F.col("y.norm"))))
    own = cells.alias("c").join(norms.alias("x"), F.col("c.a") == F.col("x.i")).join(norms.alias("y"), F.col("c.b") == F.col("y.i")).select("a", "b", weight.alias("weight")).where("weight is not null")
    name = lambda c: F.get(F.array(*map(F.lit, features)), F.col(c))
    named = lambda e: e.select(name("a").alias("a"), name("b").alias("b"), "weight")
    apart = named(own.where("a <> b"))
    w = Window.partitionBy("a").orderBy(F.desc("weight"), "b")
    kept = apart.union(apart.select("b", "a", "weight")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("a", "b", "weight")
    edges = kept.union(kept.select("b", "a", "weight")).groupBy("a", "b").agg(F.max("weight").alias("weight"))
    return edges.union(named(own.where("a = b"))) if self_loops else edges


# frames


@dataclass
class Group:
    """A sequence, or a piece of one with its halo: values by row and channel, which rows are the piece's own, and further columns."""

    x: np.ndarray
    own: np.ndarray
    more: dict[str, pa.Array]

    def values(self, name: str) -> np.ndarray:
        return self.more[name].to_numpy(zero_copy_only=False)


def laid_out(df: DataFrame, features: list[str], before: int, after: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows of each group together and in order: _g, _own, x and the columns of carry. Pieces have about CELLS values."""
    seqs = Sequences(df.select(*dict.fromkeys((*KEYS, "t", *carry)), row_array(features).alias("x")), max(4 * (before + after), CELLS // max(1, len(features)), 1))
    rows = seqs.rows
    if seqs.size is None:  # a window keeps sequences together and in order, and needs no shuffle where t came from one
        return rows.select(F.xxhash64(*KEYS).alias("_g"), (F.row_number().over(along()) > 0).alias("_own"), "x", *carry)
    piece = F.floor(F.col("_at") / seqs.size)
    rows = rows.withColumn("_piece", F.explode(F.sequence(F.floor((F.col("_at") - after) / seqs.size), F.floor((F.col("_at") + before) / seqs.size))))
    rows = rows.withColumns({"_g": F.xxhash64(*KEYS, "_piece"), "_own": F.col("_piece") == piece})
    return rows.repartition("_g").sortWithinPartitions("_g", "_at").select("_g", "_own", "x", *carry)


def groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Group]:
    """The groups of a task of laid_out."""
    held: list[pa.RecordBatch] = []

    def done() -> Group:
        cols = {c: pa.concat_arrays([b.column(c) for b in held]) for c in held[0].schema.names}
        return Group(matrix(cols.pop("x"), width), cols.pop("_own").to_numpy(zero_copy_only=False), cols)

    last = None
    for batch in batches:
        g = batch.column("_g").to_numpy()
        if not len(g):
            continue
        if held and g[0] != last:
            yield done()
            held.clear()
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1), len(g)]
        for i, j in zip(cuts, cuts[1:]):
            if i:
                yield done()
                held.clear()
            held.append(batch.slice(i, j - i))
        last = g[-1]
    if held:
        yield done()


def _sums(x: np.ndarray, width: int, lead: int) -> np.ndarray:
    """Sums over the last width rows, for all rows from lead on."""
    c = np.concatenate((np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)))
    at = np.arange(lead, len(x)) + 1
    return c[at] - c[np.maximum(at - width, 0)]


def trailing(x: np.ndarray, width: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """For stretches of rows: which, the values in sight of them less a value near them (0 where missing), how many rows lead, and that value.

    Sums of a stretch start near it and count from one of its values, so that a level far from 0 or far away costs no digits.
    """
    step = max(width, 1024)
    for i in range(0, len(x), step):
        lo, hi = max(0, i - width + 1), min(len(x), i + step)
        part = x[lo:hi]
        some = ~np.isnan(part)
        near = np.where(some.any(axis=0), part[some.argmax(axis=0), np.arange(part.shape[1])], 0.0)
        yield slice(i, hi), part - near, i - lo, near


def summary(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, deviation and slope over the last width rows (fewer at the start), by channel. Missing values don't count; the slope is between the frame's first and last row."""
    mean, std, slope = (np.empty_like(x) for _ in range(3))
    for rows, d, lead, near in trailing(x, width):
        some = ~np.isnan(d)
        v = np.where(some, d, 0.0)
        with np.errstate(invalid="ignore", divide="ignore"):
            n = _sums(some.astype(float), width, lead)
            m = _sums(v, width, lead) / n
            mean[rows] = near + m
            std[rows] = np.sqrt(np.maximum(_sums(v * v, width, lead) / n - m * m, 0.0))
    at = np.arange(len(x))
    first = np.maximum(at - width + 1, 0)
    slope[:] = (x - x[first]) / np.maximum(at - first, 1)[:, None]
    return mean, std, slope


def summary_moments(df: DataFrame, features: list[str], width: int) -> DataFrame:
    """Blocks of second moments of the channels' trailing means (kind 0), deviations (1) and slopes (2)."""
    c = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, Moments] = {}
        for g in groups(batches, c):
            parts = summary(g.x, width)
            good = g.own & ~np.isnan(np.concatenate(parts, axis=1)).any(axis=1)
            for kind, part in enumerate(parts if good.any() else ()):
                m = Moments.of(part[good])
                total[kind] = total[kind] + m if kind in total else m
        yield from _blocks_of(total)

    return tree(laid_out(df, features, width - 1, 0).mapInArrow(run, MOMENTS))


def rolling_correlations(x: np.ndarray, width: int, floor: float) -> Iterator[tuple[slice, np.ndarray, slice, np.ndarray]]:
    """For stretches of rows and tiles of channels: which rows, their trailing means, which channels, and each row's correlations of these with all channels.

    Sums of products over frames are differences of running sums. Variances are `floor` at least. Missing values count in no pair.
    """
    c = x.shape[1]
    for rows, d, lead, near in trailing(x, width):
        some = ~np.isnan(d)
        v, k = np.where(some, d, 0.0), some.astype(float)
        whole_ = bool(some.all())
        with np.errstate(invalid="ignore", divide="ignore"):
            n = _sums(k, width, lead)
            m = _sums(v, width, lead) / n
            spread = np.sqrt(np.maximum(_sums(v * v, width, lead) / n - m * m, floor))
            tile = max(1, CELLS // (len(d) * c))
            for a in range(0, c, tile):
                s = slice(a, a + tile)
                both = _sums(v[:, s, None] * v[:, None, :], width, lead)
                if whole_:
                    cov = both / n[:, :1, None] - m[:, s, None] * m[:, None, :]
                else:
                    nn = _sums(k[:, s, None] * k[:, None, :], width, lead)
                    cov = both / nn - _sums(v[:, s, None] * k[:, None, :], width, lead) / nn * (_sums(k[:, s, None] * v[:, None, :], width, lead) / nn)
                yield rows, near + m, s, cov / (spread[:, s, None] * spread[:, None, :])


# drift against references


@dataclass
class DriftReferences:
    """By regime (None: all rows), width and block of channels: mean and deviation of trailing means, and mean correlations. Sizes follow channels, settings and regimes, not rows."""

    features: list[str]
    blocks: list[list[str]]
    widths: list[int]
    found: dict[int | None, dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]] = field(default_factory=dict)


def _indices(features: list[str], blocks: list[list[str]]) -> list[np.ndarray]:
    at = {c: i for i, c in enumerate(features)}
    return [np.array([at[c] for c in b]) for b in blocks]


DRIFT = "regime long, width int, block int, n double, mean binary, m2 binary, corr binary, pairs binary"


def _drift_sums(group: pa.Table) -> pa.Table:
    n = mean = m2 = corr = pairs = None
    for r in zip(*(group.column(c) for c in ("n", "mean", "m2", "corr", "pairs"))):
        k, (a, b, q, p) = r[0].as_py(), (np.frombuffer(x.as_py()) for x in r[1:])
        if n is None:
            n, mean, m2, corr, pairs = k, a, b, q, p
            continue
        d, both = a - mean, n + k
        mean, m2, corr, pairs, n = mean + d * (k / both), m2 + b + d * d * (n * k / both), corr + q, pairs + p, both
    out = group.select(["regime", "width", "block"]).slice(0, 1)
    for name, v in (("n", n), ("mean", mean), ("m2", m2), ("corr", corr), ("pairs", pairs)):
        out = out.append_column(name, pa.array([v if name == "n" else v.tobytes()]))
    return out


def drift_references(df: DataFrame, blocks: list[list[str]], widths: list[int], only: Column | None = None, floor: float = 1e-6) -> DriftReferences:
    """References of each regime, and of all rows, from the rows where only holds; frames see the others too. Rows without a regime have regime -1."""
    features = [c for b in blocks for c in b]
    at, c = _indices(features, blocks), len(features)
    counts = (F.lit(True) if only is None else F.coalesce(only, F.lit(False))).alias("_counts")
    rows = df.select(*KEYS, "t", F.coalesce("regime", F.lit(-1)).cast("long").alias("regime"), counts, *(F.col(f"`{x}`") for x in features))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], list] = {}
        for g in groups(batches, c):
            use, regime = g.own & g.values("_counts"), g.values("regime")
            regimes = np.unique(regime[use])
            for width in widths:
                for k, where in enumerate(at):
                    x = g.x[:, where]
                    for r in map(int, regimes):
                        if (r, width, k) not in sums:
                            sums[r, width, k] = [None, np.zeros((len(where), len(where))), np.zeros((len(where), len(where)))]
                    for rows_, means, s, corr in rolling_correlations(x, width, floor):
                        for r in regimes:
                            mine = (use & (regime == r))[rows_]
                            if not mine.any():
                                continue
                            held = sums[int(r), width, k]
                            if s.start == 0:
                                part = means[mine]
                                part = part[~np.isnan(part).any(axis=1)]
                                if len(part):
                                    mean = part[0] + (part - part[0]).mean(axis=0)
                                    one = (float(len(part)), mean, ((part - mean) ** 2).sum(axis=0))
                                    if held[0] is None:
                                        held[0] = one
                                    else:
                                        n, m, v = held[0]
                                        d, both = one[1] - m, n + one[0]
                                        held[0] = (both, m + d * (one[0] / both), v + one[2] + d * d * (n * one[0] / both))
                            good = ~np.isnan(corr[mine])
                            held[1][s] += np.where(good, corr[mine], 0.0).sum(axis=0)
                            held[2][s] += good.sum(axis=0)
        out = [(r, w, k, h[0][0], h[0][1].tobytes(), h[0][2].tobytes(), h[1].tobytes(), h[2].tobytes()) for (r, w, k), h in sums.items() if h[0] is not None]
        if out:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*out), kinds)], ["regime", "width", "block", "n", "mean", "m2", "corr", "pairs"])

    keys = ["regime", "width", "block"]
    parts = laid_out(rows, features, max(widths) - 1, 0, ("regime", "_counts")).mapInArrow(run, DRIFT)
    parts = parts.withColumn("_p", F.floor(F.spark_partition_id() / FAN)).groupBy(*keys, "_p").applyInArrow(lambda g: _drift_sums(g), DRIFT)
    out = DriftReferences(features, blocks, widths)
    every: dict[tuple[int, int], list] = {}
    for r in parts.groupBy(*keys).applyInArrow(lambda g: _drift_sums(g), DRIFT).toLocalIterator():
        size = len(blocks[r.block])
        one = [r.n, *(np.frombuffer(x) for x in (r.mean, r.m2)), *(np.frombuffer(x).reshape(size, size) for x in (r.corr, r.pairs))]
        out.found.setdefault(r.regime, {})[r.width, r.block] = _reference(one, floor)
        if (r.width, r.block) in every:
            n, m, v, q, p = every[r.width, r.block]
            d, both = one[1] - m, n + one[0]
            one = [both, m + d * (one[0] / both), v + one[2] + d * d * (n * one[0] / both), q + one[3], p + one[4]]
        every[r.width, r.block] = one
    out.found[None] = {k: _reference(one, floor) for k, one in every.items()}
    return out


def _reference(sums: list, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, mean, m2, corr, pairs = sums
    std = np.sqrt(m2 / n)
    return mean, np.where(std < floor, 1.0, std), corr / np.maximum(pairs, 1)


def slow_drift(df: DataFrame, references: DriftReferences, mean_weight: float = 1.0, corr_weight: float = 1.0, floor: float = 1e-6) -> DataFrame:
    """KEYS, t, label, regime and score: the largest, over widths and blocks, of mean drift and correlation shift against the references of a row's regime.

    Rows of a regime that the references don't have are held against those of all rows. The references go to the tasks as they are (see DriftReferences for their size).
    """
    ref = references
    features, at = ref.features, _indices(ref.features, ref.blocks)
    out = [*KEYS, "t", "label", "regime"]
    rows = df.select(*KEYS, "t", "label", F.coalesce("regime", F.lit(-1)).alias("regime"), *(F.col(f"`{x}`") for x in features))
    shipped = df.sparkSession.sparkContext.broadcast(ref.found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for g in groups(batches, len(features)):
            score, ids = np.full(len(g.x), np.nan), g.values("regime")
            names = np.where(np.isin(ids, [r for r in known if r is not None]), ids, ALL)
            for width in ref.widths:
                for k, where in enumerate(at):
                    refs = {ALL if r is None else r: v[width, k] for r, v in known.items() if (width, k) in v}
                    for rows_, shift, turn in _against(g.x[:, where], width, names, refs, floor):
                        score[rows_] = np.fmax(score[rows_], mean_weight * shift + corr_weight * turn)
            own = pa.array(g.own)
            yield pa.RecordBatch.from_arrays([*(g.more[c].filter(own) for c in out), pa.array(score[g.own], from_pandas=True)], [*out, "score"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in out) + ", score double"
    return laid_out(rows, features, max(ref.widths) - 1, 0, tuple(out)).mapInArrow(run, schema)


ALL = -(1 << 62)  # in place of a regime: all rows


def _against(x: np.ndarray, width: int, names: np.ndarray, refs: dict, floor: float) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Mean drift and correlation shift of stretches of rows; names has each row's regime, or what isn't among refs."""
    pairs = x.shape[1] > 1
    now: slice | None = None
    shift = turn = None
    for rows, means, s, corr in rolling_correlations(x, width, floor):
        if now != rows:
            if now is not None:
                yield now, shift, turn
            now, shift, turn = rows, np.zeros(len(means)), np.zeros(len(means))
        for r in np.unique(names[rows]):
            mine = names[rows] == r
            m, sd, q = refs.get(int(r), refs[ALL])
            if s.start == 0:
                shift[mine] = np.abs((means[mine] - m) / sd).mean(axis=1)
            if pairs:
                turn[mine] += np.abs(corr[mine] - q[s]).sum(axis=(1, 2)) / x.shape[1] ** 2
    if now is not None:
        yield now, shift, turn


# structure of patches


def _patches(g: Group, length: int, stride: int, eps: float) -> Iterator[tuple[int, np.ndarray]]:
    """First row and correlations of each complete patch that starts at one of the group's own rows whose t the stride divides."""
    starts = np.flatnonzero(g.own & (g.values("t") % stride == 0))
    for i in starts[starts + length <= len(g.x)]:
        d = g.x[i : i + length]
        d = d - d.mean(axis=0)
        cov = d.T @ d / length
        sd = np.sqrt(np.diag(cov) + eps)
        yield i, cov / np.outer(sd, sd)


def structure_reference(df: DataFrame, features: list[str], length: int, stride: int, eps: float = 1e-6) -> np.ndarray:
    """Mean correlations of the channels over all complete patches of the rows: channels by channels, added up in tasks and merged in a tree. Patches with missing values don't count."""
    c = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((c, c)), 0
        for g in groups(batches, c):
            for _, corr in _patches(g, length, stride, eps):
                if not np.isnan(corr).any():
                    total, n = total + corr, n + 1
        # as moments whose means are 0 their merging is the plain sum
        yield from _blocks_of({0: Moments(float(n), np.zeros(c), total)} if n else {})

    found = whole(tree(laid_out(df, features, 0, length - 1, ("t",)).mapInArrow(run, MOMENTS)), c)
    return found[0].m2 / found[0].n if found else np.full((c, c), np.nan)


def structural_score(df: DataFrame, reference: np.ndarray, features: list[str], length: int, stride: int, eps: float = 1e-6) -> DataFrame:
    """KEYS, patch_start and score: Frobenius distance of each complete patch's correlations to the reference's; null where values are missing. No correlation leaves its task."""
    c = len(features)
    shipped = df.sparkSession.sparkContext.broadcast(reference)
    kinds = {k: df.schema[k].dataType.simpleString() for k in KEYS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, c):
            found = [(i, float(np.sqrt(((corr - shipped.value) ** 2).sum()))) for i, corr in _patches(g, length, stride, eps)]
            if found:
                at = pa.array([i for i, _ in found])
                yield pa.RecordBatch.from_arrays([*(g.more[k].take(at) for k in (*KEYS, "t")), pa.array([s for _, s in found], from_pandas=True)], [*KEYS, "patch_start", "score"])

    schema = ", ".join(f"`{k}` {t}" for k, t in kinds.items()) + ", patch_start long, score double"
    return laid_out(df.withColumn("t", F.col("t").cast("long")), features, 0, length - 1, ("t", *KEYS)).mapInArrow(run, schema)
