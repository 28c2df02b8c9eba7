import pytest

from tideglass.llm import queries as q

from . import brute


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def rows_of(df):
    out = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in out}) == len(out)
    return {r[0]: r[1:] for r in out}


def test_substring_dedup_equals_brute_force(spark, sf_dir, docs):
    got = rows_of(q.op2_substring_dedup(spark, sf_dir).select("doc_id", "n_words", "n_removed", "kept_sha256"))
    assert got == brute.substring_dedup(docs)


def test_suffix_array_dedup_equals_brute_force(spark, sf_dir, docs):
    got = rows_of(q.op1_suffix_array_dedup(spark, sf_dir))
    assert got == brute.suffix_dedup(docs)


def test_hot_anchors_give_the_same(spark, docs, monkeypatch):
    from tideglass.llm import suffix_dedup as s

    monkeypatch.setattr(s, "HOT_ANCHOR", 1)
    df = spark.createDataFrame(docs[:300], "doc_id long, text string")
    out = {r[0]: (sum(r.ends) - sum(r.starts), len(r.starts)) for r in s.suffix_array_dedup(df).collect()}
    assert out == {d: x[1:3] for d, x in brute.suffix_dedup(docs[:300]).items()}


def test_line_dedup_equals_brute_force(spark, sf_dir, docs):
    assert rows_of(q.op3_line_dedup(spark, sf_dir)) == brute.line_dedup(docs)


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_line_streams_in_any_batches(size):
    import numpy as np
    import pyarrow as pa

    from tideglass.llm.line_dedup import _stream
    from tideglass.llm.textblocks import unpack

    rng = np.random.default_rng(size)
    rows = sorted({(int(h), -int(d), int(x)) for h, d, x in zip(rng.integers(0, 12, 90), rng.integers(0, 6, 90), rng.integers(0, 4, 90))})
    h, doc, line = (np.array(c) for c in zip(*rows))
    table = pa.table({"h": h, "doc": -doc, "tag": np.zeros(len(h), np.int32), "line": line, "keeper": pa.nulls(len(h), pa.int64())})
    got = set()
    for b in _stream(3, 2)(iter(table.to_batches(max_chunksize=size))):
        for p in b.column("payload").to_pylist():
            got |= {(int(d), int(x)) for d, _, x in zip(*unpack(p, np.int64, np.int64, np.int64))}
    want = set()
    for k in set(h.tolist()):
        mine = [(-d, x) for y, d, x in rows if y == k]
        if len({d for d, _ in mine}) >= 3:
            want |= {(d, x) for d, x in mine if d != max(mine)[0]}
    assert got == want


def test_near_duplicates_equal_brute_force(spark, sf_dir, docs):
    assert rows_of(q.op5_minhash_near_dedup(spark, sf_dir)) == brute.near_dups(docs)


def test_near_duplicates_in_parts(spark, monkeypatch):
    import random

    from tideglass.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "BAND_BLOCK", 16)
    rng = random.Random(5)
    base, rows = [f"w{i}" for i in range(200)], []
    for d in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 8, 10])):
            words[rng.randrange(200)] = f"x{rng.random()}"
        rows.append((d, " ".join(words)))
    got = rows_of(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute.near_dups(rows)


def test_pairs_in_different_parts_of_a_hot_band_meet(spark, monkeypatch):
    """Pairs unlike the least set of their band and unlike each other: nothing but their own two sketches joins them."""
    import numpy as np

    from tideglass.llm import minhash

    monkeypatch.setattr(minhash, "BAND_BLOCK", 8)
    rng = np.random.default_rng(3)
    sketches = [rng.integers(0, 256, minhash.SKETCH_BITS // 8, np.uint8).tobytes() for _ in range(60)]
    rows = [(0, [7, 9], rng.integers(0, 256, minhash.SKETCH_BITS // 8, np.uint8).tobytes())]
    rows += [(1 + 2 * k + i, [7, 100 + 2 * k + i], sketches[k]) for k in range(60) for i in (0, 1)]
    rows += [(1000 + i, [7], sketches[0]) for i in range(30)]
    reps = spark.createDataFrame(rows, "node long, bands array<long>, sketch binary")
    links = minhash._band_links(reps, minhash.most_odd_bits(minhash.PLAUSIBLE))
    got = {r.node: r.component for r in minhash.t.components(links).collect()}
    want = {2 + 2 * k: 1 + 2 * k for k in range(60)} | {1000 + i: 1 for i in range(30)}  # without the least of each
    assert got == want


def test_suffix_array_dedup_equals_a_count_of_all_windows(spark):
    """At sf0.1, against the counts of another hash (a polynomial modulo a prime) of every 400-byte window."""
    import numpy as np

    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()]
    p, width = (1 << 31) - 1, 400

    def windows(b, base):
        x = np.frombuffer(b, np.uint8).astype(np.int64) + 1
        power, size = base, 1
        h = x
        for bit in bin(width)[3:]:  # hash of 2n bytes from two of n, of 2n + 1 with one byte more
            h = (h[: len(h) - size] * power + h[size:]) % p
            size, power = 2 * size, power * power % p
            if bit == "1":
                h = (h[: len(h) - 1] * base + x[size : size + len(h) - 1]) % p
                size, power = size + 1, power * base % p
        return h

    keys = [windows(b, 911382323) << 32 | windows(b, 972663749) if len(b) >= width else np.zeros(0, np.int64) for _, b in docs]
    every = np.concatenate(keys)
    values, counts = np.unique(every, return_counts=True)
    twice = values[counts > 1]
    want = {}
    for (d, b), k in zip(docs, keys):
        hit = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, k), len(twice) - 1)] == k)
        gone = np.zeros(len(b) + 1, np.int64)
        np.add.at(gone, hit, 1)
        np.add.at(gone, hit + width, -1)
        mask = np.cumsum(gone)[: len(b)] > 0
        want[d] = (len(b), int(mask.sum()), int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum()), brute.sha(np.frombuffer(b, np.uint8)[~mask].tobytes()))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in q.op1_suffix_array_dedup(spark, "/root/testdata/sf0.1").collect()}
    assert got == want and sum(w[1] > 0 for w in want.values()) > 1000


def test_planted_passages_go_by_their_bytes(spark):
    """Passages of 51 words in two documents each: from 400 bytes on they go from both, shorter ones and clean documents stay."""
    import random

    from tideglass.llm.suffix_dedup import suffix_array_dedup

    rng = random.Random(11)
    text = lambda: " ".join("".join(rng.choices("npqrstvwxz", k=rng.randint(3, 8))) for _ in range(120))

    def passage(size):
        each, more = divmod(size - 50, 51)
        return " ".join("".join(rng.choices("bcdfghklm", k=each + (i < more))) for i in range(51))

    rows, want = [], {}
    for size in (322, 340, 380, 398, 399, 400, 401, 420, 500):
        p = passage(size)
        for gap in (" ", "\n"):  # so that the two documents differ on both sides of the passage
            before, after = text() + gap, gap + text()
            want[len(rows)] = (size, before + after) if size >= 400 else (0, before + p + after)
            rows.append((len(rows), before + p + after))
    for _ in range(20):
        clean = text()
        want[len(rows)] = (0, clean)
        rows.append((len(rows), clean))
    out = suffix_array_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (sum(r.ends) - sum(r.starts), bytes(r.kept).decode()) for r in out} == want
    assert {d: w[0] for d, w in want.items()} == {d: x[1] for d, x in brute.suffix_dedup(rows).items()}
