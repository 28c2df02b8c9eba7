"""Files by their headers, conversions that go on, and upserts."""

import pytest
from pyspark.sql import functions as F

from tideglass.sources import tables as t

LABELS = [f"Label ({a}/{b} fault)" for a in ("common", "advanced") for b in ("hard", "soft", "controller", "all")]


def put(path, name, text):
    at = path / name
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(text)


def rows(df, *columns):
    key = lambda r: tuple((v is None, v) for v in r)
    return sorted((tuple(r) for r in df.select(F.element_at(F.split("sequence_id", "/"), -1).alias("f"), "t", *(f"`{c}`" for c in columns)).collect()), key=key)


def test_columns_are_found_by_name(spark, tmp_path):
    put(tmp_path, "x.csv", "Time,a,b,Anomaly\n1,10,20,0\n0,11,21,1\n")
    put(tmp_path, "s/y.csv", '﻿Time,"b",a,Anomaly\n0,5,6,x\n1,"7",,1\n')
    put(tmp_path, "z.csv", "b,other\n3,1\n1,2\n2,bad\n")
    got = rows(t.read_csv_sequences(spark, str(tmp_path), ["a", "b"]), "a", "b", "label")
    assert got == [("x.csv", 0, 11, 21, 1), ("x.csv", 1, 10, 20, 0), ("y.csv", 0, 6, 5, 0), ("y.csv", 1, None, 7, 1), ("z.csv", 0, None, 3, 0), ("z.csv", 1, None, 1, 0), ("z.csv", 2, None, 2, 0)]
    with pytest.raises(ValueError, match="3 layouts"):
        t.read_csv_sequences(spark, str(tmp_path), ["a", "b"], agree=True)
    with pytest.raises(ValueError, match="no file has"):
        t.read_csv_sequences(spark, str(tmp_path), ["a", "c"])
    with pytest.raises(ValueError):
        t.one_header(spark, str(tmp_path))
    one = t.read_csv_sequences(spark, f"{tmp_path}/x.csv", ["b"], agree=True)
    assert rows(one, "b", "label") == [("x.csv", 0, 21, 1), ("x.csv", 1, 20, 0)]


def test_eight_label_columns(spark, tmp_path):
    for i, name in enumerate(("x.csv", "y.csv")):
        names = ["Time", *LABELS, "a"] if i else ["a", *reversed(LABELS), "Time"]
        value = {"Time": 0, "a": i, **{c: k % 2 for k, c in enumerate(LABELS)}}
        put(tmp_path, name, ",".join(names) + "\n" + ",".join(str(value[c]) for c in names) + "\n")
    got = t.read_csv_sequences(spark, str(tmp_path), ["a"], LABELS)
    assert got.columns == ["sequence_id", "a", *LABELS, "t"]
    assert rows(got, "a", *LABELS) == [(f, 0, i, *(k % 2 for k in range(8))) for i, f in enumerate(("x.csv", "y.csv"))]


def test_extension_files(spark, tmp_path):
    put(tmp_path, "a/1_styled_features.csv", "p,q\n1,2\n3,4\n")
    put(tmp_path, "__MACOSX/2_styled_features.csv", "junk\n")
    got = t.extension_rows(spark, str(tmp_path), ["z", "q", "p"])
    assert rows(got, "q", "p", "label", "mode") == [("1_styled_features.csv", 0, 2, 1, 0, "train_ext"), ("1_styled_features.csv", 1, 4, 3, 0, "train_ext")]
    put(tmp_path, "b/3_styled_features.csv", "q,p\n8,9\n")
    assert ("3_styled_features.csv", 0, 8, 9) in rows(t.extension_rows(spark, str(tmp_path), ["q", "p"], ["p", "q"]), "q", "p")
    with pytest.raises(ValueError, match="layouts"):
        t.extension_rows(spark, str(tmp_path), ["q", "p"])


def test_conversion_goes_on(spark, tmp_path):
    source, bundle = f"{tmp_path}/raw", f"{tmp_path}/bundle"
    put(tmp_path, "raw/x.csv", "Time,a,Anomaly\n0,1,0\n")
    assert t.convert_new(spark, source, bundle, ["a"]) == 1 and t.convert_new(spark, source, bundle, ["a"]) == 0
    put(tmp_path, "raw/y.csv", "Anomaly,a,Time\n1,2,0\n1,3,1\n")
    spark.range(1).select(F.lit("z").alias("sequence_id"), F.lit(9.0).alias("a"), F.lit(0).cast("long").alias("label"), F.lit(0).cast("long").alias("t"), F.lit("broken").alias("batch")).write.mode("append").partitionBy("batch").parquet(f"{bundle}/rows")
    assert t.convert_new(spark, source, bundle, ["a"]) == 1
    assert rows(t.converted(spark, bundle), "a", "label") == [("x.csv", 0, 1, 0), ("y.csv", 0, 2, 1), ("y.csv", 1, 3, 1)]
    assert t.ledger(spark, bundle).count() == 2


def test_upserts_leave_one_row_a_key(spark, tmp_path):
    kind, path = "k long, at long, v string", f"{tmp_path}/results"
    t.upsert(spark.createDataFrame([(i, 5, "old") for i in range(300)], kind), path, ["k"], "at", parts=16)
    out = t.upsert(spark.createDataFrame([(1, 6, "new"), (2, 4, "older"), (3, 5, "same"), (400, 1, "own"), (400, 0, "x")], kind), path, ["k"], "at", parts=16)
    got = {r.k: r.v for r in out.collect()}
    assert out.count() == len(got) == 301 and (got[1], got[2], got[3], got[400], got[7]) == ("new", "old", "same", "own", "old")
