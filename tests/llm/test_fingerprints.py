import hashlib
import re
import struct

import pytest
import xxhash

from tideglass.llm import queries as q


def _x(value, seed=42):
    raw = value.encode() if isinstance(value, str) else struct.pack("<q", value)
    h = xxhash.xxh64_intdigest(raw, seed=seed & (2**64 - 1))
    return h - 2**64 if h >> 63 else h


def _chain(values):
    h = 42
    for v in values:
        h = _x(v, h)
    return h


def anchors(text, k=5, s=2):
    """(hash, place) of the distinct syncmers at their first places."""
    if not text:
        return {}
    w = [_x(x) for x in re.split("[ \t-\r]+", text)]
    found = []
    if len(w) < k:
        found = [(_chain(w), 0)]
    inner = [_chain(w[i : i + s]) for i in range(len(w) - s + 1)]
    for i in range(len(w) - k + 1):
        h = inner[i : i + k - s + 1]
        if min(h) in (h[0], h[-1]):
            found.append((_chain(w[i : i + k]), i))
    out = {}
    for h, i in found:
        out.setdefault((h & (2**64 - 1)) >> 24, i)
    return out


def like(a, b):
    if not a and not b:
        return 1.0
    pairs = sorted((a[h], b[h]) for h in a if h in b)
    runs = []
    for i, j in pairs:
        if runs and runs[-1][-1][0] - runs[-1][-1][1] == i - j:
            runs[-1].append((i, j))
        else:
            runs.append([(i, j)])
    best = []
    for r in runs:
        best.append((r[-1][1], len(r) + max((n for last, n in best if last < r[0][1]), default=0)))
    return 2 * max((n for _, n in best), default=0) / (len(a) + len(b))


def _hex(found):
    return "".join(f"{h:010x}{i:06x}" for i, h in sorted((i, h) for h, i in found.items()))


def _want(rows):
    rows = sorted(rows, reverse=True)
    out = {}
    for i, (d, text) in enumerate(rows):
        text, nxt = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        a, e = anchors(text), anchors(edited)
        out[d] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), _hex(a), _hex(e), like(a, e), like(a, anchors(nxt)))
    return out


def test_fingerprints_equal_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = q.op9_syncmer_fingerprints(spark, sf_dir).collect()
    got = {r[0]: tuple(r)[1:] for r in rows}
    assert got == _want(docs)
    assert sum(r.near_edited for r in rows) / len(rows) > 0.3 > 0.1 > sum(r.near_next for r in rows) / len(rows)


def test_few_and_odd_documents(spark, tmp_path):
    for i, rows in enumerate(([(7, "only one text of some words here")], [(1, None), (5, ""), (10**15, " é 日本 x  y z "), (-(10**17), "a b c d e f g h" * 9)], [])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{i}/documents.parquet")
        assert {r[0]: tuple(r)[1:] for r in q.op9_syncmer_fingerprints(spark, f"{tmp_path}/{i}").collect()} == _want(rows)


def _alike(spark, a, b):
    from tideglass.llm import syncmers

    df = spark.createDataFrame([(a, b)], "a string, b string")
    got = df.select(syncmers.likeness(syncmers.anchors(df.a), syncmers.anchors(df.b))).first()[0]
    assert got == like(anchors(a), anchors(b))
    return got


def test_places_decide_and_no_anchor_is_left_out(spark):
    parts = [" ".join(f"w{p}x{i}" for i in range(2000)) for p in range(4)]
    whole = " ".join(parts)
    assert _alike(spark, whole, whole) == 1.0
    assert _alike(spark, whole, "new words in front of it " + whole) > 0.99
    assert 0.2 < _alike(spark, whole, " ".join(reversed(parts))) < 0.3  # one part of four stays in order
    assert 0.7 < _alike(spark, whole, " ".join([parts[1], parts[0], *parts[2:]])) < 0.8
    other = " ".join(f"v{i}" for i in range(8000))
    assert 0.005 < _alike(spark, whole, other + " " + " ".join(parts[2].split()[100:180])) < 0.015  # 80 shared words of 8000


def test_one_outlying_id_spoils_no_range(spark):
    from tideglass.llm import syncmers

    rows = spark.range(20_000).union(spark.createDataFrame([(10**15,)], "id long"))
    rows = rows.selectExpr("id as doc", "0 as tag", "concat('text of ', id) as text")
    bounds = [r[0] for r in syncmers.with_next(rows).select("doc").collect()]
    assert len(bounds) == 20_001
    n = syncmers.RANGES_EACH * 8
    cut = rows.selectExpr(f"percentile_approx(doc, array({', '.join(str(i / n) for i in range(1, n))}), {10 * n + 10_000}) as b").first().b
    df = rows.select(syncmers._range_of(rows.doc, syncmers.F.array(*map(syncmers.F.lit, sorted(set(cut))))).alias("r"))
    assert df.groupBy("r").count().agg({"count": "max"}).first()[0] < 3 * 20_000 / n
    got = {r.doc: r.next_text for r in syncmers.with_next(rows).collect()}
    assert got[10**15] == "text of 19999" and got[5] == "text of 4" and got[0] == f"text of {10**15}"


def test_licences(spark, sf_dir):
    from tideglass.llm.licences import licence_scan

    found = {r.doc_id: r for r in q.op6_licence_scan(spark, sf_dir).collect()}
    assert len(found) == 1000
    names = {"MIT License": "MIT", "Apache License": "Apache-2.0", "GNU General Public License, version 3": "GPL-3.0", "CC BY-NC 4.0": "CC-BY-NC-4.0"}
    n = 0
    for d, text in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        own = {v for k, v in names.items() if f" {k}" in (text or "") and re.search(r"^(Released|Licensed|This work is licensed) under", text, re.M)}
        assert set(found[d]["headers"]) == own, (d, own, found[d])
        n += bool(own)
    assert n > 15
    rows = [
        (1, "r/LICENSE", "Released under the MIT License."), (2, "r/a/b/x.txt", "some words without any notice"), (3, "r/a/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (4, "r/y.txt", "other words here"), (5, "q/z.txt", None), (6, "r/a/w.txt", "plain words\nLicensed under the Apache License, Version 2.0.\nmore words and more"), (7, None, ""), (8, "ra/x.txt", "none of it"),
    ]
    got = {r.doc_id: (r.licence, r.source) for r in licence_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "header"), 2: ("GPL-3.0", "inherited"), 3: ("GPL-3.0", "header"), 4: ("MIT", "inherited"), 5: (None, None), 6: ("Apache-2.0", "header"), 7: (None, None), 8: (None, None)}


def test_whole_licences_and_wrapped_notices(spark):
    from tideglass.llm import licences

    texts = dict(licences.TEXTS)
    rows = [(i, f"{name}/LICENSE", f"Copyright (c) 2020 Somebody Else\n\n{text}") for i, (name, text) in enumerate(texts.items())]
    rows += [(100 + i, f"{name}/src/a.c", "int main") for i, name in enumerate(texts)]
    notice = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."
    rows += [(200, "w/a.py", f"# a file of ours\n#\n{notice}\n\nimport os"), (201, "w/b.py", "This work is licensed under the GNU General\nPublic License, version 3.\n\nother words")]
    rows += [(1000 + i, "p/x.txt", f"plain prose number {i} of the people and the sea, which is under no notice") for i in range(300)]
    got = {r.doc_id: r for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for i, name in enumerate(texts):
        assert got[i].licence_file and (got[100 + i].licence, got[100 + i].source) == (name, "inherited"), (name, got[i], got[100 + i])
    assert got[200].headers == got[201].headers == ["GPL-3.0"]
    assert all(got[1000 + i].licence is None for i in range(300))


@pytest.mark.parametrize("text", ["Это обычный рассказ о море и людях у берега", "هذه قصة عن البحر والناس على الشاطئ البعيد", "这是一个关于大海和海边人们的故事", "これは海と人々の物語です"])
def test_a_notice_in_a_text_beyond_ascii_makes_no_licence_file(spark, text):
    from tideglass.llm import licences

    lines = "\n".join(f"{text} {text[i % 7:]}" for i in range(60))
    rows = [(1, "r/story.txt", f"{lines}\nLicensed under CC BY 4.0.\n{lines}"), (2, "r/other.txt", lines)]
    got = {r.doc_id: r for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert (got[1].licence, got[1].source, got[1].licence_file) == ("CC-BY-4.0", "header", False)
    assert got[2].licence is None
