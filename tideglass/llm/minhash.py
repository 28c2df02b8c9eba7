"""Near duplicates: banded MinHash candidates, odd sketches to rule pairs out, full sets to confirm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import tables as t
from .line_dedup import LOWER
from .textblocks import SPACES, RollingHash, blocks, mix, pack, runs_inside, unpack

SHINGLE, SIMILARITY = 5, 75
BANDS, ROWS = 40, 5  # a pair at 0.75 shares no band with probability 2e-5
SKETCH_BITS = 512
PLAUSIBLE = 0.55  # sketches show a pair at 0.75 as less with probability below 1e-6
BLOCK = 1024  # distinct sets of a cluster compared in one task
BAND_BLOCK = 4096  # members of a band whose sketches are compared in one task


def _shingles(block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct shingles of each document, sorted, and where each document's begin."""
    data = LOWER[block.data]
    start, end = runs_inside(~SPACES[data], block.off)
    words = RollingHash(data).spans(start, end)
    first = np.searchsorted(start, block.off)
    rolling = RollingHash(words)
    owner = np.repeat(np.arange(len(block)), np.diff(first))
    full = rolling.windows(width)
    inside = owner[: len(full)] == owner[width - 1 :] if len(full) else np.zeros(0, bool)
    few = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < width))
    h = np.concatenate((full[inside], rolling.spans(first[few], first[few + 1])))
    owner = np.concatenate((owner[: len(full)][inside], few))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))) if len(h) else np.zeros(0, bool)
    h, owner = h[fresh], owner[fresh]
    return h, np.searchsorted(owner, np.arange(len(block) + 1))


_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_XOR, _ODD = (_SEEDS >> np.uint64(32)).astype(np.uint32), _SEEDS.astype(np.uint32) | np.uint32(1)


def _signatures(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Least of each hash function over each non-empty set: documents x functions."""
    filled = np.flatnonzero(np.diff(cut))
    out = np.full((len(cut) - 1, len(_SEEDS)), 0xFFFFFFFF, np.uint32)
    short = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    if len(filled):
        for j in range(len(_SEEDS)):
            x = (short ^ _XOR[j]) * _ODD[j]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            out[filled, j] = np.minimum.reduceat(x, cut[filled])
    return out


def _sketches(sig: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, as 64-bit words."""
    n, k = sig.shape
    at = mix(sig.astype(np.uint64) * np.uint64(k) + np.arange(k, dtype=np.uint64) + np.uint64(1)) % np.uint64(SKETCH_BITS)
    bits = np.bincount((np.arange(n)[:, None] * SKETCH_BITS + at.astype(np.int64)).ravel(), minlength=n * SKETCH_BITS).reshape(n, SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8), axis=1).view(np.uint64)


def most_odd_bits(similarity: float, samples: int = BANDS * ROWS) -> int:
    """XOR population count up to which two sketches look at least so similar."""
    return int(SKETCH_BITS / 2 * (1 - np.exp(-4 * samples * (1 - similarity) / SKETCH_BITS)) + 0.5)


SIGNED = "doc long, tag int, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary"


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _ in blocks(batches):
            h, cut = _shingles(block, width)
            sums = [np.concatenate(([0], np.cumsum(mix(h ^ np.uint64(seed)), dtype=np.uint64))).astype(np.uint64) for seed in (0x1234567, 0x89ABCDEF)]
            a, b = (mix(s[cut[1:]] - s[cut[:-1]]).view(np.int64) for s in sums)
            sig = _signatures(h, cut)
            bands = RollingHash(sig.astype(np.uint64).ravel()).windows(ROWS)[::ROWS] if len(block) else np.zeros(0, np.uint64)
            bands = mix(bands ^ np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), len(block)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.doc), pa.array(block.tag.astype(np.int32)), pa.array(np.diff(cut)), pa.array(a), pa.array(b), pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1, dtype=np.int32) * BANDS), pa.array(bands)), pa.array([x.tobytes() for x in _sketches(sig)], pa.binary())],
                [x.split()[0] for x in SIGNED.split(", ")],
            )

    return run


def _sketch_links(limit: int):
    def run(group: pa.Table) -> pa.Table:
        """A forest over the documents of one band whose sketches are near: each document's link to one found before it."""
        node = group.column("node").to_numpy()
        order = np.argsort(node)
        node = node[order]
        sketch = np.frombuffer(b"".join(group.column("sketch").take(pa.array(order)).to_pylist()), np.uint64).reshape(len(node), -1)
        left = np.arange(len(node))
        u, v = [], []
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                near = np.bitwise_count(sketch[left] ^ sketch[x]).sum(axis=1) <= limit
                found = left[near]
                u += [node[x]] * len(found)
                v += node[found].tolist()
                queue += found.tolist()
                left = left[~near]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in blocks(batches):
            h, cut = _shingles(block, width)
            packed = pa.array([pack(h[i:j]) for i, j in zip(cut, cut[1:])], pa.binary())
            names = ["component", "part", "parts", "node", "sketch"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), packed], [*names, "shingles"])

    return run


def _confirmed(limit: int, percent: int, seeking: bool):
    def run(group: pa.Table) -> pa.Table:
        """Links among the sets of one part of a cluster, confirmed on the full sets: enough of them to join all that belong together.

        When seeking, only members are compared with sets that came from the cluster's other parts.
        """
        group = group.take(pa.array(np.unique(group.column("node").to_numpy(), return_index=True)[1]))
        node, comp = group.column("node").to_numpy(), group.column("label").to_numpy().copy()
        member = group.column("role").to_numpy() == 0
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
        sets = [unpack(p, np.uint64)[0] for p in group.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets])
        u, v = [], []
        for x in range(len(node)):
            near = comp != comp[x]
            near[: x + 1] = False
            if seeking:
                near &= member != member[x]
            near &= 100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x])
            at = np.flatnonzero(near)
            for y in at[np.bitwise_count(sketch[at] ^ sketch[x]).sum(axis=1) <= limit]:
                if comp[x] != comp[y]:
                    a, b = (sets[x], sets[y]) if size[x] <= size[y] else (sets[y], sets[x])
                    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                    if 100 * common >= percent * (len(a) + len(b) - common):
                        u.append(node[x])
                        v.append(node[y])
                        comp[comp == comp[y]] = comp[x]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _links_between(limit: int):
    def run(group: pa.Table) -> pa.Table:
        """Links between two parts of a band: of every two near sketches of different labels, at least one is outside the band's main label."""
        node, label = group.column("node").to_numpy(), group.column("label").to_numpy().copy()
        seeks, low = group.column("seeks").to_numpy(zero_copy_only=False), group.column("part").to_numpy() == group.column("low").to_numpy()
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
        u, v = [], []
        for mine, others in ((low & seeks, ~low), (~low & seeks, low & ~seeks)):
            others = np.flatnonzero(others)
            for x in np.flatnonzero(mine):
                at = others[label[others] != label[x]]
                at = at[np.bitwise_count(sketch[at] ^ sketch[x]).sum(axis=1) <= limit]
                if len(at):
                    found, first = np.unique(label[at], return_index=True)
                    u += [node[x]] * len(first)
                    v += node[at[first]].tolist()
                    label[np.isin(label, found)] = label[x]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


LINKS = "u long, v long"
SETS = "component long, part int, parts int, node long, sketch binary, shingles binary"


def _band_links(reps: DataFrame, limit: int) -> DataFrame:
    """Links that join all sets (node, bands, sketch) that share a band and have near sketches.

    Bands of more than BAND_BLOCK sets are dealt into parts that share the least set. What is joined by that carries
    one label; every set outside the most frequent label of its band then meets the sets of each other part, two parts a task.
    """
    banded = reps.select(F.explode("bands").alias("band"), "node")
    shared = banded.groupBy("band").agg(F.count("*").alias("c"), F.min("node").alias("hub")).where("c > 1")
    shared = t.staged(shared.select("band", "hub", F.ceil(F.col("c") / BAND_BLOCK).cast("int").alias("parts")), "bands")
    part = F.pmod(F.xxhash64("node", "band"), F.col("parts")).cast("int")
    parts = F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part))
    in_bands = banded.join(shared, "band").select("band", F.explode(parts).alias("part"), "node")
    dealt = in_bands.join(reps.select("node", "sketch"), "node").repartition(t.buckets(reps.sparkSession), "band", "part")  # a number, as this stage is dear by rows, not by bytes
    links = dealt.groupBy("band", "part").applyInArrow(_sketch_links(limit), LINKS).distinct()
    large = shared.where("parts > 1")
    if large.isEmpty():
        return links
    links = t.staged(links, "links")
    labels = t.components(links).withColumnRenamed("component", "label")
    now = banded.join(large, "band").select("band", "node", "parts", part.alias("part")).join(labels, "node", "left")
    now = t.staged(now.withColumn("label", F.coalesce("label", "node")), "large")
    main = now.groupBy("band", "label").agg(F.count("*").alias("c")).groupBy("band").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    now = now.join(main, "band").withColumn("seeks", F.col("label") != F.col("main")).drop("main")
    seeking = now.where("seeks").groupBy("band").agg(F.collect_set("part").alias("seeking"))  # part numbers
    other = F.filter(F.when(F.col("seeks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.col("seeking")), lambda p: p != F.col("part"))
    sent = now.join(seeking, "band").withColumn("other", F.explode(other))
    sent = sent.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).join(reps.select("node", "sketch"), "node")
    more = sent.select("band", "low", "high", "part", "node", "label", "seeks", "sketch").groupBy("band", "low", "high").applyInArrow(_links_between(limit), LINKS)
    return links.union(more.distinct())


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose sets of width-word shingles are linked.

    Words are runs other than space and \\t to \\r, with A-Z lower-cased. With fewer words than width the whole
    sequence is the one shingle; null and blank texts have none and are linked with nothing. Two sets are linked
    when 100 * intersection >= percent * union (75 or more: bands are laid out for that). Of rows that share an
    id but not a text, one text takes part in links for the id. Other columns are ignored. Returns doc_id,
    n_shingles, component_id (the least id that can be reached) and kept (doc_id = component_id).

    Equal sets count once from the start, whatever their number. Bands of MinHash samples propose, odd sketches
    of the samples rule out, and clusters of what is left are confirmed on full sets: about BLOCK sets a task.
    In larger bands, sets outside the largest component so far are held against those of all other parts as well.
    In larger clusters, sets outside the largest component so far are sought in all other parts as well.
    """
    rows = t.keyed(docs, id_col, text_col)
    signed = t.staged(rows.mapInArrow(_signed(width), SIGNED), "signed")
    one = F.min(F.struct("doc", "tag", "bands", "sketch")).alias("one")
    reps = signed.where("n_shingles > 0").groupBy("set_a", "set_b").agg(one)
    reps = t.staged(reps.select("set_a", "set_b", F.col("one.doc").alias("node"), "one.tag", "one.bands", "one.sketch"), "sets")
    limit = most_odd_bits(PLAUSIBLE)
    links = _band_links(reps, limit)
    clusters = t.staged(t.components(links), "clusters")
    clusters = clusters.union(clusters.select(F.col("component").alias("node"), "component").distinct())
    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    placed = clusters.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    wanted = placed.join(reps.select("node", "tag", "sketch"), "node").withColumn("doc", F.col("node"))
    sets = rows.join(wanted, ["doc", "tag"]).mapInArrow(_sets(width), SETS)
    sets = t.staged(sets, "shingles")
    members = sets.withColumn("role", F.lit(0))
    found = t.staged(members.withColumn("label", F.col("node")).repartition(t.buckets(docs.sparkSession), "component", "part").groupBy("component", "part").applyInArrow(_confirmed(limit, percent, False), LINKS), "found")
    large = members.where("parts > 1")
    if not large.isEmpty():
        found = _across_parts(large, found, limit, percent)
    labels = t.components(found).withColumnRenamed("component", "label")
    named = t.staged(reps.select("set_a", "set_b", "node").join(labels, "node", "left").select("set_a", "set_b", F.coalesce("label", "node").alias("label")), "labels")
    out = signed.join(named, ["set_a", "set_b"], "left").withColumn("component", F.coalesce("label", "doc"))
    return out.select(t.id_back().alias("doc_id"), "n_shingles", t.id_back("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


def _across_parts(large: DataFrame, found: DataFrame, limit: int, percent: int) -> DataFrame:
    """Links between parts of clusters that are too large for one task, added to those found inside parts.

    First the least member of each component seeks in the other parts, which joins most. Then every set outside
    the largest component of its cluster does: of any two sets not joined yet, one at least is among these.
    """
    for everyone in (False, True):
        labels = t.staged(t.components(found).withColumnRenamed("component", "label"), "labels")
        now = t.staged(large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
        if everyone:
            sizes = now.groupBy("component", "label").agg(F.count("*").alias("c"))
            main = sizes.groupBy("component").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
            seekers = now.join(main, "component").where("label <> main").drop("main")
        else:
            least = now.groupBy("component", "part", "label").agg(F.min("node").alias("node"))
            seekers = now.join(least, ["component", "part", "label", "node"], "left_semi").select(now.columns)
        other = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("part"))
        sent = seekers.withColumn("role", F.lit(1)).withColumn("part", F.explode(other))
        more = now.unionByName(sent).groupBy("component", "part").applyInArrow(_confirmed(limit, percent, True), LINKS)
        found = t.staged(found.union(more), "found")
    return found
