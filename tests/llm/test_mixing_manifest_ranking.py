"""Operators 11 to 13 against plain versions, and on odd rows."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.llm import merkle, mixing, queries as q, ranking, tables

LONG = " ".join(f"Word{i % 977}" for i in range(20_000))
ODD = [(1, None, "a"), (2, "", "a"), (3, "  \n\t ", None), (4, LONG, "b"), (5, LONG, "b"), (5, LONG, "b"), (None, "alone here " * 60, None), (None, None, None), (6, "é" * 900, "ñ"), (8, "one two", "a"), (9, "ONE  two", "B")]
CLASH = ("g", "key", "pos", "n", "digest", "run", "left", "right", "path", "term", "query", "doc", "_range", "_at", "size", "copies", "target", "root")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(*r, r[2], len(r[1] or "")) for r in ODD], "doc_id long, text string, source string, lang string, n_chars long").repartition(3)
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, "one of two words"), (2, None), (3, "..."), (None, "ALONE, here"), (4, "word5 word976 one"), (4, "two"), (5, "nowhere")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("query", F.lit("x")).withColumn("h", F.lit(1))


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# 11


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Deal by weight; whoever is above the limit stops there and the rest is dealt again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return out


def mixed(df, **more):
    return mixing.mix_sources(df, **more).collect()


def check_mix(rows, docs, weights=(5, 2, 1)):
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = plain_targets(sizes, weights)
    assert len(rows) == len(docs)
    for s, total in sizes.items():
        own = [r for r in rows if r.source == s]
        assert all(r.source_size == total and r.target == pytest.approx(want[s]) and 0 <= r.copies <= 2 and r.taken == r.copies * r.size for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own) + 1e-3
        assert abs(sum(r.copies for r in own) - len(own) * (want[s] / total if total else 0)) <= 1


def test_mixing(spark, small_dir, odd):
    check_mix(mixed(odd), ODD)
    docs = q.read(spark, small_dir, "documents").select("doc_id", "text", "source")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    check_mix(mixed(docs), rows)
    assert sorted(mixed(docs.repartition(7))) == sorted(mixed(docs)) != sorted(mixed(docs, seed=5))
    assert mixed(odd.where("false")) == [] and [r.taken for r in mixed(odd.where("doc_id = 1"))] == [0]


def test_one_source_with_most_of_the_rows_and_many_small_ones(spark):
    rows = [(i, "w " * (i % 37), "hot") for i in range(4000)] + [(10_000 + i, "w " * (1 + i % 9), f"s{i}") for i in range(500)]
    check_mix(mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")), rows)
    assert len(plain_targets({"a": 10, "b": 0, "c": 5})) == 3


# 12


def plain_tree(digests):
    """Levels from the leaves up."""
    out = [list(digests)]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def steps(tree, i):
    out = []
    for level in tree[:-1]:
        a = i - i % 8
        out.append((level[a:i], level[i + 1 : a + 8]))
        i //= 8
    return out


def plain_manifest(rows):
    """(id, leaf, subroot, root, proof, folded root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    record = lambda r: "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, sha(record(r)), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = plain_tree([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for i, (known, doc, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = steps(trees[g], i) + steps(top, at)
            now = sha(record((*r[:4], r[4] and r[4].translate(lower)))) if known and zlib.crc32(str(doc).encode()) % 3 == 0 else leaf
            for a, b in path:
                now = sha(*a, now, *b)
            root = top[-1][0]
            out.append((r[0], leaf, trees[g][-1][0], root, sha(*(x for a, b in path for x in a + b)), now, now == root))
    return out


def test_manifest(spark, small_dir, odd, tmp_path):
    for name, df in (("odd", odd), ("docs", q.read(spark, small_dir, "documents")), ("one", odd.where("doc_id = 4")), ("none", odd.where("false"))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
        got = [tuple(r) for r in q.op12_merkle_manifest(spark, f"{tmp_path}/{name}").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
        assert sorted(got, key=str) == sorted(plain_manifest(rows), key=str)


def test_trees_of_all_shapes(spark):
    sizes = [1, 2, 7, 8, 9, 63, 64, 65, 513]
    df = spark.range(sum(sizes)).select(F.col("id").alias("doc_id"), F.element_at(F.array(*(F.lit(f"l{g}") for g, n in enumerate(sizes) for _ in range(n))), (F.col("id") + 1).cast("int")).alias("lang"))
    df = df.withColumns({"source": F.lit("s"), "n_chars": F.lit(None).cast("long"), "text": F.concat(F.lit("Text "), F.col("doc_id"))})
    out = merkle.manifest(df, {"bad": F.lit("0" * 64)}).withColumns({"a": merkle.folded("leaf"), "b": merkle.folded("bad"), "p": merkle.proof()}).collect()
    want = {r[0]: r for r in plain_manifest([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()])}
    assert len(out) == len(want) and all((r.leaf, r.subroot, r.root, r.p) == want[r.id][1:5] and r.a == r.root != r.b for r in out)


# 13


def plain_ranks(docs, items, k=10):
    found = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    texts = [(d, found(t)) for d, t in docs]
    texts = [(d, w) for d, w in texts if w]
    n_all, l_all = len(texts), sum(len(w) for _, w in texts)
    df = {}
    for _, w in texts:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(found(t))
    out = []
    for i, terms in queries.items():
        scored = []
        for d, w in texts:
            m = 10 + 90 * len(w) * n_all // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[x] + 1))) * (10**9 * w.count(x) // (1000 * w.count(x) + 8 * m)) for x in terms if x in w)
            scored.append((-s, d is not None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(x for x in scored if x[0] < 0)[:k])]
    return out


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("segment,part", [(ranking.SEGMENT, ranking.PART_TERMS), (5, 3)])
def test_ranking_of_odd_rows(odd, bench, monkeypatch, segment, part):
    monkeypatch.setattr(ranking, "SEGMENT", segment)
    monkeypatch.setattr(ranking, "PART_TERMS", part)
    items = [(r.item_id, r.text) for r in bench.collect()]
    assert found(ranking.ranked_search(odd, bench)) == sorted(plain_ranks([r[:2] for r in ODD], items), key=str)
    assert found(ranking.ranked_search(odd, bench, k=2)) == sorted(plain_ranks([r[:2] for r in ODD], items, 2), key=str)
    assert found(ranking.ranked_search(odd.where("false"), bench)) == found(ranking.ranked_search(odd, bench.where("false"))) == found(ranking.ranked_search(odd, bench.where("item_id = 2"))) == []


def test_ties_go_to_the_lesser_id_over_all_tasks(spark, bench):
    rows = [(i, "one two filler") for i in range(200, 0, -1)] + [(500 + i, "filler only here") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    assert found(ranking.ranked_search(docs, bench)) == sorted(plain_ranks(rows, [(r.item_id, r.text) for r in bench.collect()]), key=str)


def test_limited_accumulators_keep_the_best(spark):
    rng = np.random.default_rng(4)
    for _ in range(300):
        n, k = 400, int(rng.integers(1, 12))
        lists, total = [], np.zeros(n, np.int64)
        for share, most in sorted((rng.uniform(0.01, 0.9), int(rng.integers(1, 60))) for _ in range(6)):
            docs = np.flatnonzero(rng.random(n) < share)
            s = rng.integers(1, most + 1, len(docs))
            if len(docs):
                lists.append((docs, s, int(s.max())))
                total[docs] += s
        least = int(rng.integers(0, 80))
        docs, s = ranking.best_of(lists, n, k, least)
        assert len(set(docs)) == len(docs) and (total[docs] == s).all()
        kth = max(least, ranking._kth(total[total > 0], k))
        assert set(np.flatnonzero((total >= kth) & (total > 0))) <= set(docs)


def test_places_in_groups_and_sums_over_ranges(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 5 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"), (F.col("id") * 7919 % 3001).alias("v"))
    for r in tables.numbered(rows, "g", F.desc("v")).groupBy("g").agg(F.max("n").alias("n"), F.count("*").alias("rows"), F.countDistinct("pos").alias("places"), F.min("pos").alias("a"), F.max("pos").alias("b")).collect():
        assert r.n == r.rows == r.places == r.b + 1 and r.a == 0
    got = tables.summed(rows, ["v"], F.asc("v")).collect()
    so_far = 0
    for r in sorted(got, key=lambda r: r.v):
        assert r.v_before == so_far
        so_far += r.v
