import hashlib
import random

import pytest

from tideglass.llm import queries as q, warc


def test_warc_round_trip(spark, sf_dir):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    groups = {}
    for p, b in pages.items():
        groups.setdefault(b, []).append(p)
    want = {}
    for p, b in pages.items():
        first = max(groups[b])
        again = len(b) >= 1000 and p != first
        want[p] = (len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", first if again else None)
    assert {r[0]: tuple(r)[1:] for r in q.op4_warc_zstd(spark, sf_dir).collect()} == want


def test_nulls_copies_and_payloads(spark):
    from tideglass.llm import tables

    long = "é" * 600
    rows = [(1, None, long), (2, "u", long), (3, "u\r\nx", None), (None, "n", long), (4, "v", "short"), (5, "v", "short"), (-7, "w", "")]
    folder = tables.shared_dir(spark) + "/warc-test"
    tables.make_folder(spark, folder)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", q.F.lit("x"))
    got = {r.page_id: r for r in warc.read_warc(warc.write_warc(df, folder), folder).collect()}
    assert len(got) == len(rows)
    assert got[2].record_type == "response" and bytes(got[2].payload).decode() == long
    assert {(p, got[p].refers_to) for p in got if got[p].record_type == "revisit"} == {(1, 2), (None, 2)}
    assert bytes(got[3].payload) == b"" and got[3].uri == "u x" and got[-7].payload_bytes == 0


def test_broken_archives_are_told():
    record = warc.write_record("response", warc.record_uri(3), "u", hashlib.sha1(b"abc").hexdigest(), 3, b"abc", None)
    assert warc.read_record(record)[1] == 3
    for bad in (record[:-1], record.replace(b"WARC/1.1", b"WORC/1.1"), record.replace(b"abc\r", b"abd\r"), record.replace(b"WARC-Date", b"WARC-Dote")):
        with pytest.raises(ValueError):
            warc.read_record(bad)
    import zstandard

    archive = warc.archive_head(warc.dictionary_from([b"%d some text to learn from %d" % (i, i * i) for i in range(3000)], 4096)) + zstandard.ZstdCompressor().compress(record)
    assert [r[1] for r in warc.read_archive(archive)] == [3]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.read_archive(archive[:-3]))


def test_an_empty_table_and_repeated_rows(spark):
    from tideglass.llm import tables

    kinds = "page_id long, url string, html string, doc string, digest string"
    for i, rows in enumerate(([], [(1, "u", "x" * 1200, "c", "c")] * 3, [(None, None, None, None, None)])):
        folder = f"{tables.shared_dir(spark)}/warc-empty-{i}"
        tables.make_folder(spark, folder)
        got = warc.read_warc(warc.write_warc(spark.createDataFrame(rows, kinds), folder), folder).collect()
        assert len(got) == len(rows)
        if rows and rows[0][0]:
            assert {(r.page_id, r.payload_bytes) for r in got} == {(1, 1200)} and "response" in {r.record_type for r in got}


def test_reading_grows_with_the_archive_and_not_with_its_square():
    from time import perf_counter

    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3)
    rng = random.Random(2)

    def archive(n: int) -> bytes:
        out = []
        for i in range(n):
            body = rng.randbytes(rng.choice((0, 300, 6000)))
            out.append(squeeze.compress(warc.write_record("response", warc.record_uri(i), "u", hashlib.sha1(body).hexdigest(), len(body), body, None)))
        return b"".join(out)

    def seconds(raw: bytes, n: int) -> float:
        start = perf_counter()
        assert sum(1 for _ in warc.read_archive(raw)) == n
        return perf_counter() - start

    few, many = archive(1000), archive(16000)
    assert seconds(many, 16000) < 16 * 4 * max(seconds(few, 1000), 0.02)
    with pytest.raises(ValueError):
        list(warc.read_archive(few[:-1]))
