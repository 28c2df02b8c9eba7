"""All registered queries of the time-series engine, with SQL for comparison.

A query's name begins with its place in the operator inventory. Floating results are rounded to six places on
both sides, and -inf shows as null.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .functions import columns as c
from .functions.sql import register
from .functions.staging import shared_folder, staged
from .operators import alarms, metrics, preprocess as pp, regimes as rg, report, scores as sc, search, sweep, wide, windows as wd
from .plans import learned
from .sources import tables as t
from .streaming import alarms as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FEATURES = list(t.FEATURES)
KEYS = c.KEYS

EV = """ev AS (SELECT 'events' AS run_key, user_id AS sequence_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
  value AS score, CAST(event_type = 'error' AS BIGINT) AS label, event_type AS kind, ts FROM events)"""
LI = """li AS (SELECT 'lineitem' AS run_key, l_suppkey AS sequence_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber,
  l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag) - 1 AS t, l_quantity AS quantity, l_extendedprice AS extendedprice,
  l_discount AS discount, l_tax AS tax, CAST(l_returnflag = 'R' AS BIGINT) AS label FROM lineitem)"""
RES = """res AS (SELECT event_type AS model, 'd' || CAST(user_id % 4 AS VARCHAR) AS dataset, user_id % 5 AS seed, m.metric, avg(CASE m.metric WHEN 'alarm_score' THEN value ELSE value / 7 END) AS value
  FROM events, (VALUES ('alarm_score'), ('aaf')) m(metric) GROUP BY 1, 2, 3, 4)"""
W = "PARTITION BY run_key, sequence_id ORDER BY t"
NEWLY = f"CAST(pred <> coalesce(lag(pred) OVER ({W}), 0) AS INT)"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def sql6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def ev(spark, d):
    return t.events_series(spark, d)


def li(spark, d):
    return t.lineitem_series(spark, d)


def results(spark, d):
    """RESULTS from the events table: kinds stand for models, users for data sets and seeds."""
    e = t.read(spark, d, "events").select(F.col("event_type").alias("model"), F.concat(F.lit("d"), (F.col("user_id") % 4).cast("string")).alias("dataset"), (F.col("user_id") % 5).alias("seed"), "value")
    e = e.withColumn("metric", F.explode(F.array(F.lit("alarm_score"), F.lit("aaf"))))
    return e.groupBy("model", "dataset", "seed", "metric").agg(F.avg(F.when(F.col("metric") == "alarm_score", F.col("value")).otherwise(F.col("value") / 7)).alias("value"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The exact sweep over the events, and all metrics at the threshold found."""
    rows = ev(spark, d)
    best = sweep.best_threshold(rows)
    pred = alarms.predict(rows.join(F.broadcast(best), "run_key"), F.col("threshold"), strict=False)
    return best.join(metrics.evaluate(pred), "run_key")


# A: sources and sinks


@query("a1_csv_sequences", f"WITH {EV} SELECT CAST(sequence_id % 8 AS BIGINT) AS part, count(*) AS n, round(sum(score), 4) AS total, sum(label) AS labels FROM ev GROUP BY 1")
def _(spark, d):
    """The events as CSV files, read back with a given schema."""
    folder = shared_folder(spark)
    rows = ev(spark, d).select(F.col("t").alias("Time"), "score", F.col("sequence_id").alias("user"), F.col("label").alias("Anomaly"))
    rows.repartition(8, F.col("user") % 8).write.csv(folder, header=True)
    return t.read_csv_sequences(spark, folder, ["score", "user"]).groupBy((F.col("user").cast("long") % 8).alias("part")).agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"), F.sum("label").alias("labels"))


PARTS = "CASE sequence_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END"


@query("a1_layouts", f"WITH {EV} SELECT {PARTS} AS part, t, CAST(CASE WHEN sequence_id % 3 < 2 THEN score END AS DOUBLE) AS score, CAST(sequence_id AS DOUBLE) AS user, CAST(CASE WHEN sequence_id % 3 = 0 THEN label ELSE 0 END AS BIGINT) AS \"Label (common/all)\", CAST(CASE WHEN sequence_id % 3 = 1 THEN label ELSE 0 END AS BIGINT) AS \"Label (advanced/soft fault)\" FROM ev")
def _(spark, d):
    """Files of three layouts: columns in another order, and one that is missing; two label columns, each in some of the files."""
    folder, one, two = shared_folder(spark), "Label (common/all)", "Label (advanced/soft fault)"
    rows = ev(spark, d).select("sequence_id", F.col("t").alias("Time"), "score", F.col("sequence_id").alias("user"), "label")
    kinds = (("Time", "score", "user", one), (two, "user", "Time", "score"), ("user", "Time"))
    for i, (name, columns) in enumerate(zip("abc", kinds)):
        some = rows.where(F.col("sequence_id") % 3 == i).withColumns({one: F.col("label"), two: F.col("label")}).repartition(3, "sequence_id")
        some.select(*(F.col(f"`{c}`") for c in columns)).write.csv(f"{folder}/{name}", header=True)
    found = t.read_csv_sequences(spark, folder, ["score", "user"], [one, two])
    part = F.element_at(F.split("sequence_id", "/"), -2)
    return found.select(part.alias("part"), F.row_number().over(Window.partitionBy("user").orderBy("t")).cast("long").alias("t"), "score", "user", f"`{one}`", f"`{two}`").withColumn("t", F.col("t") - 1)


@query("a2_convert_new", f"WITH {EV} SELECT CAST(sequence_id % 4 AS BIGINT) AS part, count(*) AS n, round(sum(score), 3) AS total, CAST(sum(label) AS BIGINT) AS labels, 5 AS files FROM ev GROUP BY 1")
def _(spark, d):
    """Files come in two turns; the second conversion takes only the new ones, a third none."""
    folder = shared_folder(spark)
    rows = ev(spark, d).select(F.col("t").alias("Time"), "score", F.col("sequence_id").alias("user"), F.col("label").alias("Anomaly"))
    rows.where("user % 4 = 0").coalesce(2).repartition(2).write.csv(f"{folder}/raw/0", header=True)
    counts = [t.convert_new(spark, f"{folder}/raw", f"{folder}/bundle", ["score", "user"])]
    rows.where("user % 4 > 0").repartition(3).write.csv(f"{folder}/raw/1", header=True)
    counts += [t.convert_new(spark, f"{folder}/raw", f"{folder}/bundle", ["score", "user"]) for _ in range(2)]
    out = t.converted(spark, f"{folder}/bundle").groupBy((F.col("user").cast("long") % 4).alias("part"))
    return out.agg(F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("total"), F.sum("label").alias("labels")).withColumn("files", F.lit(counts[0] + counts[1] + 100 * counts[2]))


@query("a2_convert_once", f"WITH {LI} SELECT count(*) AS n, round(sum(quantity), 2) AS total FROM li")
def _(spark, d):
    """A second conversion, of other data, leaves what is there."""
    folder = shared_folder(spark)
    rows = li(spark, d).withColumn("mode", F.lit("train"))
    t.write_bundle(rows, folder)
    t.write_bundle(rows.withColumn("quantity", F.col("quantity") * 2).where("t > 3"), folder)
    return spark.read.parquet(folder).agg(F.count("*").alias("n"), F.round(F.sum("quantity"), 2).alias("total"))


@query("a3_train_files", f"WITH {EV} SELECT count(*) AS n, round(sum(score), 3) AS total, 'Time,score' AS header FROM ev WHERE sequence_id % 3 = 1")
def _(spark, d):
    """Of files of several kinds those of normal training data are taken, and features are what isn't meta data."""
    folder = shared_folder(spark)
    rows = ev(spark, d).select(F.col("t").alias("Time"), "score", F.col("label").alias("Anomaly"), "sequence_id")
    for i, name in enumerate(("train_a", "train_normal_a", "test_a")):
        rows.where(F.col("sequence_id") % 3 == i).drop("sequence_id").write.option("header", True).csv(f"{folder}/{name}")
    kinds = t.provenance(spark, folder, "*.csv").select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct()  # a folder stands for a file here
    chosen = [r.path for r in t.train_files(kinds).collect()]  # as many as kinds of files
    found = spark.read.option("header", True).csv(chosen)
    return found.agg(F.count("*").alias("n"), F.round(F.sum(F.col("score").cast("double")), 3).alias("total")).withColumn("header", F.lit(",".join(["Time", *t.feature_names(found)])))


def extension_folder(spark, d) -> str:
    folder = shared_folder(spark)
    rows = ev(spark, d).select(F.col("t").alias("Time"), "score", F.lit(1.5).alias("other"), "sequence_id")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for i, name in enumerate(("a/x_styled_features.csv", "__MACOSX/x_styled_features.csv", "a/notes.csv", "b/c/y_styled_features.csv")):
        rows.where(F.col("sequence_id") % 4 == i).drop("sequence_id").coalesce(1).write.option("header", True).csv(f"{folder}/parts{i}")
        at = fs.Path(f"{folder}/parts{i}")
        store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        part = next(f.getPath() for f in store.listStatus(at) if f.getPath().getName().endswith(".csv"))
        store.mkdirs(fs.Path(f"{folder}/raw/{name}").getParent())
        store.rename(part, fs.Path(f"{folder}/raw/{name}"))
    return f"{folder}/raw"


@query("a4_extension_files", "SELECT * FROM (VALUES ('x_styled_features.csv', 'a'), ('y_styled_features.csv', 'c')) v(name, parent) WHERE (SELECT count(*) FROM events) > 0")
def _(spark, d):
    parts = F.split("path", "/")
    return t.extension_files(spark, extension_folder(spark, d)).select(F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("parent"))


@query("a7_extension_rows", f"WITH {EV} SELECT CASE sequence_id % 4 WHEN 0 THEN 'x' ELSE 'y' END AS file, count(*) AS n, round(sum(score), 3) AS total, CAST(0 AS BIGINT) AS labels, 'train_ext' AS mode FROM ev WHERE sequence_id % 4 IN (0, 3) GROUP BY 1")
def _(spark, d):
    rows = t.extension_rows(spark, extension_folder(spark, d), ["pressure", "score"], ["score", "other"])
    return rows.groupBy(F.substring(F.element_at(F.split("sequence_id", "/"), -1), 1, 1).alias("file"), "mode").agg(F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("total"), F.sum("label").alias("labels"))


@query("a5_header_variants", "SELECT CASE user_id % 2 WHEN 0 THEN 'Time,score' ELSE 'Time,score,user' END AS header, count(*) AS rows FROM events GROUP BY 1")
def _(spark, d):
    """Files of two layouts, and how many rows stand under each header."""
    folder = shared_folder(spark)
    rows = ev(spark, d).select(F.col("t").alias("Time"), "score", F.col("sequence_id").alias("user"))
    rows.where("user % 2 = 0").drop("user").repartition(3).write.csv(f"{folder}/a", header=True)
    rows.where("user % 2 = 1").repartition(2).write.csv(f"{folder}/b", header=True)
    return t.header_variants(spark, folder).select("header", "rows")


@query("a6_series", f"WITH {LI} SELECT sequence_id, t, quantity, extendedprice, discount, tax, label FROM li")
def _(spark, d):
    return li(spark, d).drop("run_key")


MODES = "CASE WHEN sequence_id % 3 = 0 THEN 'test' ELSE 'train' END AS mode"


@query("a8_bundle", f"WITH {LI}, b AS (SELECT *, {MODES} FROM li) SELECT mode, count(*) AS rows, count(DISTINCT sequence_id) AS series, round(sum(extendedprice), 2) AS total FROM b GROUP BY mode")
def _(spark, d):
    folder = shared_folder(spark)
    t.write_bundle(li(spark, d).withColumn("mode", F.expr(MODES.removesuffix(" AS mode"))), folder)
    return spark.read.parquet(folder).groupBy("mode").agg(F.count("*").alias("rows"), F.countDistinct("sequence_id").alias("series"), F.round(F.sum("extendedprice"), 2).alias("total"))


@query("a10_manifest", f"WITH {LI}, s AS (SELECT {MODES}, sequence_id, count(*) AS n FROM li GROUP BY 1, 2) SELECT mode, count(*) AS item_count, CAST(sum(n) AS BIGINT) AS rows, '[' || string_agg(CAST(n AS VARCHAR), ',' ORDER BY sequence_id) || ']' AS lengths FROM s GROUP BY mode")
def _(spark, d):
    return t.manifest(li(spark, d).withColumn("mode", F.expr(MODES.removesuffix(" AS mode"))))


@query("a11_bundle_check", f"WITH {LI}, b AS (SELECT *, {MODES} FROM li WHERE NOT (sequence_id % 7 = 0 AND t = 3)), k AS (SELECT {MODES}, sequence_id, count(*) AS n FROM li GROUP BY 1, 2), r AS (SELECT mode, sequence_id, count(*) AS rows, max(t) AS last_t FROM b GROUP BY 1, 2) SELECT mode, sequence_id, rows, last_t, n FROM r FULL JOIN k USING (mode, sequence_id) WHERE n IS NULL OR rows IS NULL OR n <> rows OR last_t + 1 <> rows")
def _(spark, d):
    rows = li(spark, d).withColumn("mode", F.expr(MODES.removesuffix(" AS mode")))
    broken = rows.where(~((F.col("sequence_id") % 7 == 0) & (F.col("t") == 3)))
    return t.faulty_sequences(broken, rows.groupBy("mode", "sequence_id").agg(F.count("*").alias("n")))


@query("a13_provenance")
def _(spark, d):
    return t.provenance(spark, f"{d}/events.parquet").select("path", "length")


@query("a14_digest", f"WITH {EV}, r AS (SELECT run_key, sequence_id, t, t // 16 AS piece, md5(concat_ws('|', CAST(t AS VARCHAR), kind, CAST(label AS VARCHAR))) AS h FROM ev), p AS (SELECT run_key, sequence_id, piece, md5(string_agg(h, '' ORDER BY t)) AS h FROM r GROUP BY ALL), s AS (SELECT run_key, sequence_id, md5(string_agg(h, '' ORDER BY piece)) AS h FROM p GROUP BY ALL), f AS (SELECT run_key, substr(md5(CAST(sequence_id AS VARCHAR)), 1, 5) AS five, md5(string_agg(h, '' ORDER BY sequence_id)) AS h FROM s GROUP BY ALL), w AS (SELECT run_key, substr(five, 1, 2) AS two, md5(string_agg(h, '' ORDER BY five)) AS h FROM f GROUP BY ALL) SELECT run_key, md5(string_agg(h, '' ORDER BY two)) AS digest FROM w GROUP BY 1")
def _(spark, d):
    return t.digest(ev(spark, d), ["t", "kind", "label"], 16)


@query("a16_profile", f"WITH {LI}, m AS (SELECT *, CAST(label <> 0 AND coalesce(lag(label) OVER ({W}), 0) = 0 AS BIGINT) AS starts FROM li) SELECT run_key, count(DISTINCT sequence_id) AS series, count(*) AS steps, CAST(sum(starts) AS BIGINT) AS anomalies, round(avg(CAST(label <> 0 AS DOUBLE)) * 100, 6) AS anomaly_pct FROM m GROUP BY 1")
def _(spark, d):
    return t.profile(li(spark, d))


@query("a17_latest_results", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def _(spark, d):
    return t.latest(t.read(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("a17_upserts", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def _(spark, d):
    """Three upserts, the newest events first."""
    folder, rows = shared_folder(spark), t.read(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    for k in (2, 0, 1):
        out = t.upsert(rows.where(F.col("event_id") % 3 == k), folder, ["user_id", "event_type"], "ts", "event_id")
    return out.select("user_id", "event_type", "event_id", "value")


# B: projections and predicates


@query("b3_numeric_coercion", "SELECT event_type, count(*) AS n, count(try_cast(CASE WHEN event_id % 5 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE)) AS numbers FROM events GROUP BY 1")
def _(spark, d):
    e = t.read(spark, d, "events").withColumn("x", F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.col("value").cast("string")))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count(c.numeric("x")).alias("numbers"))


HOLES = "CASE WHEN t % 11 = 5 THEN NULL ELSE quantity END"


@query("b5_drop_faulty_windows", f"WITH {LI}, w AS (SELECT sequence_id, t, sum(CASE WHEN ({HOLES}) IS NULL THEN 1 ELSE 0 END) OVER f AS bad, count(*) OVER f AS n FROM li WINDOW f AS ({W} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) SELECT sequence_id, t FROM w WHERE n = 8 AND bad = 0")
def _(spark, d):
    return wd.drop_faulty_windows(li(spark, d).withColumn("quantity", F.expr(HOLES)), ["quantity"], 8).select("sequence_id", "t")


@query("b5_window_report", f"WITH {LI}, w AS (SELECT run_key, sum(CASE WHEN ({HOLES}) IS NULL THEN 1 ELSE 0 END) OVER f AS bad, count(*) OVER f AS n FROM li WINDOW f AS ({W} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) SELECT run_key, count(*) FILTER (bad = 0) AS kept, count(*) FILTER (bad > 0) AS dropped FROM w WHERE n = 8 GROUP BY 1")
def _(spark, d):
    return wd.window_report(li(spark, d).withColumn("quantity", F.expr(HOLES)), ["quantity"], 8)


@query("b6_label_mask", "SELECT event_type, CAST(sum(CASE WHEN event_type = 'error' THEN 1 WHEN event_type = 'view' THEN 0 WHEN event_type = 'click' THEN CAST(event_id % 2 AS INT) ELSE 0 END) AS BIGINT) AS n FROM events GROUP BY 1")
def _(spark, d):
    text = F.when(F.col("event_type") == "error", "Sensor FAULT").when(F.col("event_type") == "click", (F.col("event_id") % 2).cast("string")).when(F.col("event_type") == "view", "False").otherwise("normal")
    return t.read(spark, d, "events").select("event_type", c.label_mask(text).cast("long").alias("m")).groupBy("event_type").agg(F.sum("m").alias("n"))


@query("b7_numeric_channels", "SELECT channel, round(avg(CAST(v IS NOT NULL AS DOUBLE)), 6) AS present, count(DISTINCT v) AS distinct_values, avg(CAST(v IS NOT NULL AS DOUBLE)) > 0.8 AND count(DISTINCT v) > 5 AS is_numeric, count(DISTINCT v) <= 8 AND min(CASE WHEN v IN (0, 1) THEN 1 WHEN v IS NULL THEN NULL ELSE 0 END) = 1 AS is_binary FROM (SELECT 'l_quantity' AS channel, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_linenumber', l_linenumber FROM lineitem UNION ALL SELECT 'is_r', CAST(l_returnflag = 'R' AS INT) FROM lineitem) GROUP BY 1")
def _(spark, d):
    rows = t.read(spark, d, "lineitem").withColumn("is_r", (F.col("l_returnflag") == "R").cast("int"))
    return pp.numeric_channels(rows, ["l_quantity", "l_linenumber", "is_r"])


@query("b9_canonical_names", "SELECT CASE WHEN event_type IN ('view', 'click') THEN 'Browse' WHEN event_type = 'purchase' THEN 'Buy' ELSE upper(event_type) || ' - ' END AS kind, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    aliases = spark.createDataFrame([("view", "Browse"), ("click", "Browse"), ("purchase", "Buy")], "alias string, name string")
    e = t.read(spark, d, "events").select(F.concat(F.upper("event_type"), F.lit(" - ")).alias("kind"))
    return report.canonical(e, "kind", aliases).groupBy("kind").agg(F.count("*").alias("n"))


@query("b1_shared_features", f"WITH {LI} SELECT 'x_ext' AS name, 'x' AS base, 'quantity,tax' AS features, true AS extended, count(*) AS n, round(sum(quantity + tax), 3) AS total FROM li UNION ALL SELECT 'x_red', 'x', 'quantity,tax', false, count(*), round(sum(quantity + tax), 3) FROM li UNION ALL SELECT 'x', 'x', 'quantity,extendedprice,discount,tax', false, count(*), round(sum(quantity + extendedprice + discount + tax), 3) FROM li")
def _(spark, d):
    """Data sets with and without an extension, over the features that they share."""
    rows, out = li(spark, d), []
    for name in ("x_ext", "x_red", "x"):
        base, features, extended = t.resolved_variant(name, FEATURES, ["tax", "pressure", "quantity"])
        total = rows.select(*features).agg(F.count("*").alias("n"), F.round(F.sum(sum((F.col(f) for f in features), F.lit(0.0))), 3).alias("total"))
        out.append(total.select(F.lit(name).alias("name"), F.lit(base).alias("base"), F.lit(",".join(features)).alias("features"), F.lit(extended).alias("extended"), "n", "total"))
    return pp.all_of(out)


@query("b2_without_features", f"WITH {LI} SELECT sequence_id, t, round(quantity + discount, 6) AS total FROM li")
def _(spark, d):
    rows = li(spark, d)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        kept = pp.without_features(rows, FEATURES, ["tax", "extendedprice", "unknown"])
    return rows.select("sequence_id", "t", F.round(sum((F.col(f) for f in kept), F.lit(0.0)), 6).alias("total"))


@query("b10_variants", "SELECT DISTINCT event_type || v.suffix AS dataset, event_type AS base, v.name AS variant FROM events, (VALUES ('_ext', 'ext'), ('_red', 'red'), ('', 'base')) v(suffix, name)")
def _(spark, d):
    suffixes = F.explode(F.array(*map(F.lit, ("_ext", "_red", ""))))
    e = t.read(spark, d, "events").select("event_type").distinct().withColumn("s", suffixes).select(F.concat("event_type", "s").alias("dataset"))
    return e.select("dataset", t.base_of(F.col("dataset")).alias("base"), t.variant_of(F.col("dataset")).alias("variant"))


@query("b11_compress_and_clip", "SELECT event_id, round(asinh(value / 50.0), 6) AS squeezed, greatest(least(value, 100.0), -100.0) AS clipped, round(exp2, 6) AS exp2 FROM (SELECT *, pow(2.0, -(event_id % 9)) AS exp2 FROM events)")
def _(spark, d):
    e = t.read(spark, d, "events")
    return e.select("event_id", F.round(c.asinh_scaled("value", 50.0), 6).alias("squeezed"), c.clip("value", 100.0).alias("clipped"), F.round(F.pow(F.lit(2.0), -(F.col("event_id") % 9)), 6).alias("exp2"))


@query("b13_reduce_scores", f"WITH {LI} SELECT sequence_id, round(max(greatest(quantity, discount * 400, tax * 500)), 6) AS score FROM li GROUP BY 1")
def _(spark, d):
    return li(spark, d).groupBy("sequence_id").agg(F.round(F.max(F.greatest("quantity", F.col("discount") * 400, F.col("tax") * 500)), 6).alias("score"))


# C: splits and joins


@query("c1_time_split", f"WITH {LI} SELECT sequence_id, CASE WHEN t < floor(n * 0.7) THEN 'train' ELSE 'val' END AS part, count(*) AS n_rows, max(t) AS last FROM (SELECT *, count(*) OVER (PARTITION BY run_key, sequence_id) AS n FROM li) GROUP BY 1, 2")
def _(spark, d):
    return pp.time_split(li(spark, d)).groupBy("sequence_id", "part").agg(F.count("*").alias("n_rows"), F.max("t").alias("last"))


@query("c2_sequence_split", f"WITH {LI}, s AS (SELECT sequence_id, row_number() OVER (ORDER BY sequence_id) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT sequence_id FROM li)) SELECT CASE WHEN i <= floor(n * 0.7) THEN 'train' ELSE 'val' END AS part, count(*) AS n_rows, count(DISTINCT sequence_id) AS series FROM li JOIN s USING (sequence_id) GROUP BY 1")
def _(spark, d):
    return pp.sequence_split(li(spark, d)).groupBy("part").agg(F.count("*").alias("n_rows"), F.countDistinct("sequence_id").alias("series"))


@query("c3_overlapping_split", f"WITH {LI}, n AS (SELECT *, floor(count(*) OVER (PARTITION BY run_key, sequence_id) * 0.8) AS b FROM li) SELECT sequence_id, 'train' AS part, count(*) AS n_rows FROM n WHERE t < b GROUP BY 1 UNION ALL SELECT sequence_id, 'val', count(*) FROM n WHERE t >= b - 10 GROUP BY 1")
def _(spark, d):
    return pp.overlapping_split(li(spark, d), 0.8, 10).groupBy("sequence_id", "part").agg(F.count("*").alias("n_rows"))


@query("c4_budget_cut", f"WITH {EV}, s AS (SELECT sequence_id, count(*) AS n FROM ev GROUP BY 1), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY sequence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) SELECT sequence_id, n, CAST(before AS BIGINT) AS before FROM b WHERE before < 3000")
def _(spark, d):
    return pp.budget_cut(ev(spark, d), 3000).drop("run_key")


@query("c5_chosen_sources", f"WITH {EV}, u AS (SELECT 'real' AS source, CASE WHEN sequence_id % 2 = 0 THEN 'train' ELSE 'test' END AS mode, score, label FROM ev UNION ALL SELECT 'synthetic', 'train', score * 2, label FROM ev WHERE label = 0 UNION ALL SELECT 'real', 'train_ext', score + 1, 0 FROM ev WHERE sequence_id % 5 = 0) SELECT source, mode, count(*) AS n, round(sum(score), 4) AS total, CAST(sum(label) AS BIGINT) AS labels FROM u GROUP BY 1, 2")
def _(spark, d):
    e = ev(spark, d).withColumn("mode", F.expr("CASE WHEN sequence_id % 2 = 0 THEN 'train' ELSE 'test' END"))
    synthetic = e.where("label = 0").withColumns({"score": F.col("score") * 2, "mode": F.lit("train")})
    extra = ev(spark, d).where("sequence_id % 5 = 0").withColumn("score", F.col("score") + 1)
    return pp.chosen_sources(e, synthetic, "both", extra).groupBy("source", "mode").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"), F.sum("label").alias("labels"))


@query("c7_all_sources", f"WITH {EV}, {LI} SELECT run_key, count(*) AS n, count(score) AS scores, count(quantity) AS quantities FROM (SELECT run_key, score, NULL AS quantity FROM ev UNION ALL SELECT run_key, NULL, quantity FROM li) GROUP BY 1")
def _(spark, d):
    return pp.all_of([ev(spark, d), li(spark, d)]).groupBy("run_key").agg(F.count("*").alias("n"), F.count("score").alias("scores"), F.count("quantity").alias("quantities"))


@query("c8_window_cap", f"WITH {EV} SELECT sequence_id, count(*) AS n FROM ev WHERE t >= 7 AND t - 7 < 20 GROUP BY 1")
def _(spark, d):
    return pp.window_cap(wd.sliding_windows(ev(spark, d), ["score"], 8), 20).groupBy("sequence_id").agg(F.count("*").alias("n"))


@query("c10_complete_grid", f"WITH {RES}, r AS (SELECT model, dataset, avg(value) AS mean FROM res WHERE metric = 'alarm_score' AND NOT (model = 'view' AND dataset = 'd1') GROUP BY 1, 2) SELECT m.model, x.dataset, round(mean, 6) AS mean, CASE WHEN mean IS NULL THEN 'missing' ELSE 'ok' END AS status FROM (SELECT DISTINCT model FROM r) m CROSS JOIN (SELECT DISTINCT dataset FROM r) x LEFT JOIN r USING (model, dataset)")
def _(spark, d):
    r = results(spark, d).where("metric = 'alarm_score' and not (model = 'view' and dataset = 'd1')").groupBy("model", "dataset").agg(F.avg("value").alias("mean"))
    return report.complete_grid(r).select("model", "dataset", *r6("mean"), "status")


@query("c11_align_scores", f"WITH {EV}, {LI} SELECT ev.label AS a, li.label AS b, count(*) AS n FROM ev JOIN li ON ev.sequence_id = li.sequence_id AND ev.t = li.t GROUP BY 1, 2")
def _(spark, d):
    a = ev(spark, d).select("sequence_id", "t", F.col("label").alias("a"))
    return a.join(li(spark, d).select("sequence_id", "t", F.col("label").alias("b")), ["sequence_id", "t"]).groupBy("a", "b").agg(F.count("*").alias("n"))


SOURCES = """src AS (SELECT *, CASE WHEN sequence_id % 3 = 0 THEN 'synthetic' ELSE 'real' END AS source, ['train', 'val', 'test', 'train_ext', 'train'][sequence_id % 5 + 1] AS mode FROM ev)"""


def sourced(spark, d):
    """The events with a source and a mode by user."""
    mode = F.get(F.array(*map(F.lit, ("train", "val", "test", "train_ext", "train"))), (F.col("sequence_id") % 5).cast("int"))
    return ev(spark, d).withColumns({"source": F.when(F.col("sequence_id") % 3 == 0, "synthetic").otherwise("real"), "mode": mode})


@query(
    "c6_stage_rows",
    f"""WITH {EV}, {SOURCES}, g AS (SELECT 'real' AS of_stage, mode AS stage, * FROM src WHERE source = 'real'
UNION ALL SELECT 'synthetic', CASE WHEN mode = 'train' AND source = 'real' THEN 'scaler' ELSE mode END, * FROM src WHERE (mode IN ('train', 'val', 'test') AND source = 'synthetic') OR (mode = 'train' AND source = 'real'))
SELECT of_stage, stage, count(*) AS n, sum(CASE WHEN mode IN ('train', 'train_ext') AND source = 'real' THEN 1 ELSE 0 END) AS n_fit, round(sum(score), 3) AS total FROM g GROUP BY 1, 2""",
)
def _(spark, d):
    rows = sourced(spark, d)
    both = pp.stages(rows, "real").withColumn("of_stage", F.lit("real")).union(pp.stages(rows, "synthetic", test_on_real=False).withColumn("of_stage", F.lit("synthetic")))
    return both.groupBy("of_stage", "stage").agg(F.count("*").alias("n"), F.sum(F.col("fits_scaler").cast("long")).alias("n_fit"), F.round(F.sum("score"), 3).alias("total"))


@query("c9_model_pairs", f"WITH {RES} SELECT model, dataset FROM (SELECT DISTINCT model FROM res WHERE model < 'e') m, (SELECT DISTINCT dataset FROM res WHERE dataset < 'd2') x UNION SELECT model, dataset FROM res WHERE model = 'view'")
def _(spark, d):
    r = results(spark, d)
    return report.model_pairs(r.where("model < 'e'").select("model").distinct(), r.where("dataset < 'd2'").select("dataset").distinct(), r.where("model = 'view'"))


@query("c13_alarms_with_diagnostics", f"WITH {RES}, a AS (SELECT model, dataset, avg(value) AS mean FROM res WHERE metric = 'alarm_score' AND model <> 'view' GROUP BY 1, 2), b AS (SELECT model, dataset, metric, avg(value) AS metric_mean FROM res WHERE metric = 'aaf' AND dataset <> 'd1' GROUP BY 1, 2, 3) SELECT model, dataset, metric, {sql6('mean', 'metric_mean')} FROM a JOIN b USING (model, dataset)")
def _(spark, d):
    r = report.over_seeds(results(spark, d))
    status = lambda gap: F.when(gap, "missing").otherwise("complete")
    a = r.where("metric = 'alarm_score'").withColumn("status", status(F.col("model") == "view"))
    b = r.where("metric = 'aaf'").withColumn("status", status(F.col("dataset") == "d1"))
    return report.with_diagnostics(a, b).select("model", "dataset", "metric", *r6("mean", "metric_mean"))


# D: preprocessing

CELLS = "cells AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS value FROM li" for f in FEATURES) + ")"


@query("d1_feature_report", f"WITH {LI}, {CELLS}, a AS (SELECT feature, count(*) AS n_total, count(value) AS n_finite, median(value) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, count(DISTINCT round(value, 12)) AS n_unique, avg(CAST(value = 0 AS DOUBLE)) AS zero_frac, quantile_cont(value, 0.995) AS q_high FROM cells GROUP BY 1), b AS (SELECT feature, median(abs(value - a.median)) AS mad, avg(CAST(value > q_high AS DOUBLE)) AS mass_high FROM cells JOIN a USING (feature) GROUP BY 1) SELECT feature, n_total, n_finite, n_unique, {sql6('median', 'iqr', 'mad', 'zero_frac', 'q_high', 'mass_high')} FROM a JOIN b USING (feature)")
def _(spark, d):
    return pp.feature_report(li(spark, d), FEATURES).select("feature", "n_total", "n_finite", "n_unique", *r6("median", "iqr", "mad", "zero_frac", "q_high", "mass_high"))


# features of every kind, made from the line items
KINDS = {
    "discount": "discount", "fixed": "CAST(3 AS DOUBLE)", "heavy": "exp(quantity / 4)", "pulse": "CASE WHEN t % 4 = 0 THEN CAST(5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END", "quantity": "quantity",
    "rare": "CASE WHEN t % 200 = 7 THEN quantity ELSE CAST(0 AS DOUBLE) END", "sparse": "CASE WHEN t % 4 = 0 THEN quantity ELSE CAST(0 AS DOUBLE) END", "spiky": "CASE WHEN t % 300 = 7 THEN quantity + 100000 * (1 + t % 2) ELSE quantity END",
}
MANY = list(KINDS)
REPORT = f"""{LI}, many AS (SELECT run_key, sequence_id, t, {', '.join(f'{x} AS {n}' for n, x in KINDS.items())} FROM li), cells AS ({' UNION ALL '.join(f"SELECT '{n}' AS feature, {n} AS value FROM many" for n in MANY)}),
s AS (SELECT feature, count(value) AS n_finite, avg(CAST(value = 0 AS DOUBLE)) AS zero_frac, count(*) FILTER (value <> 0) AS nonzero, quantile_cont(value, 0.25) AS q25, median(value) AS q50, quantile_cont(value, 0.75) AS q75,
 quantile_cont(value, 0.001) AS q001, quantile_cont(value, 0.005) AS q005, quantile_cont(value, 0.99) AS q99, quantile_cont(value, 0.995) AS q995, quantile_cont(value, 0.999) AS q999 FROM cells GROUP BY 1),
u AS (SELECT *, CASE WHEN zero_frac < 0.5 THEN 'all' WHEN nonzero >= 8 AND nonzero / n_finite >= 0.01 THEN 'nonzero' ELSE 'insufficient_nonzero' END AS const_support FROM s),
j AS (SELECT feature, value FROM cells JOIN u USING (feature) WHERE const_support = 'all' OR (const_support = 'nonzero' AND value <> 0)),
c AS (SELECT feature, median(value) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr_c, count(DISTINCT round(value, 12)) AS n_unique FROM j GROUP BY 1),
a AS (SELECT feature, median(abs(value - m)) AS mad FROM j JOIN c USING (feature) GROUP BY 1),
h AS (SELECT feature, count(*) FILTER (value > q995) AS n_high, count(*) FILTER (value < q005) AS n_low FROM cells JOIN u USING (feature) GROUP BY 1),
r AS (SELECT u.*, n_unique, coalesce(mad, 0) AS mad, n_high, n_low, n_high / n_finite AS mass_high, n_low / n_finite AS mass_low, coalesce(least(iqr_c, mad) <= 1e-8 + 1e-6 * greatest(1, abs(m)) OR n_unique <= 2, false) AS almost_constant,
 n_high / n_finite <= 0.01 AND q999 - q995 >= 0 AND (q75 = q25 OR (q999 - q995) / (q75 - q25) >= 10) AS high, n_low / n_finite <= 0.01 AND q005 - q001 >= 0 AND (q75 = q25 OR (q005 - q001) / (q75 - q25) >= 10) AS low
 FROM u LEFT JOIN c USING (feature) LEFT JOIN a USING (feature) JOIN h USING (feature)),
k AS (SELECT *, CASE WHEN almost_constant THEN 'almost_constant' WHEN zero_frac >= 0.5 THEN 'zero_inflated' WHEN high OR low THEN 'extreme' ELSE 'robust' END AS kind FROM r)"""


def many(spark, d):
    return li(spark, d).select(*KEYS, "t", *(F.expr(x).alias(n) for n, x in KINDS.items()))


@query("d2_constness", f"WITH {REPORT} SELECT feature, const_support, n_unique, round(mad, 6) AS mad, round(zero_frac, 6) AS zero_frac, almost_constant FROM r")
def _(spark, d):
    """D2 and D3: whether a feature is almost constant, of many zeros by what isn't zero."""
    return pp.feature_report(many(spark, d), MANY).select("feature", "const_support", "n_unique", *r6("mad", "zero_frac"), "almost_constant")


@query("d4_extreme_tails", f"WITH {REPORT} SELECT feature, round(mass_high, 6) AS mass_high, round(mass_low, 6) AS mass_low, CASE WHEN high THEN round(q995, 6) END AS upper_cutoff, CASE WHEN low THEN round(q005, 6) END AS lower_cutoff, high OR low AS extreme, CASE WHEN high THEN n_high ELSE 0 END + CASE WHEN low THEN n_low ELSE 0 END AS n_extreme FROM r")
def _(spark, d):
    return pp.feature_report(many(spark, d), MANY).select("feature", *r6("mass_high", "mass_low", "upper_cutoff", "lower_cutoff"), "extreme", "n_extreme")


@query("d5_feature_kinds", f"WITH {REPORT} SELECT feature, kind FROM k")
def _(spark, d):
    return pp.feature_report(many(spark, d), MANY).select("feature", "kind")


SQUEEZED = "z AS (SELECT feature, kind, CASE WHEN kind <> 'almost_constant' AND (q99 - q50) / greatest(q75 - q25, 1e-12) >= 6 THEN greatest((SELECT median(abs(value)) FROM cells WHERE cells.feature = k.feature AND (kind <> 'zero_inflated' OR value <> 0)), 1e-6) END AS asinh_scale FROM k)"


def ruled(spark, rules):
    rows = [(r.feature, r.kind, r.asinh_scale, r.center, r.scale) for r in rules]  # one for each feature
    return spark.createDataFrame(rows, "feature string, kind string, asinh_scale double, center double, scale double").select("feature", "kind", *(F.round(x, 5).alias(x) for x in ("asinh_scale", "center", "scale")))


@query("d6_compression", f"WITH {REPORT}, {SQUEEZED}, y AS (SELECT feature, kind, asinh_scale, CASE WHEN asinh_scale IS NULL THEN value ELSE asinh(value / asinh_scale) END AS y FROM cells JOIN z USING (feature) WHERE kind <> 'zero_inflated' OR value <> 0) SELECT feature, kind, round(any_value(asinh_scale), 5) AS asinh_scale, round(avg(y), 5) AS center, round(CASE WHEN stddev_pop(y) > 1e-9 THEN greatest(stddev_pop(y), 1e-3) ELSE 1 END, 5) AS scale FROM y GROUP BY 1, 2")
def _(spark, d):
    """Which features are compressed and by what, and the mean and deviation of what comes out."""
    return ruled(spark, pp.fit(many(spark, d), MANY, pp.Policy(extreme="none")))


@query("d7_robust_scales", f"WITH {REPORT}, q AS (SELECT feature, any_value(kind) AS kind, median(value) AS center, (quantile_cont(value, 0.9) - quantile_cont(value, 0.1)) / 2.5631031310892007 AS s FROM cells JOIN k USING (feature) WHERE kind <> 'zero_inflated' OR value <> 0 GROUP BY 1) SELECT feature, kind, CAST(NULL AS DOUBLE) AS asinh_scale, round(center, 5) AS center, round(CASE WHEN s > 0 THEN greatest(s, 1e-3) ELSE 1 END, 5) AS scale FROM q")
def _(spark, d):
    """Median and a free range of quantiles in units of the normal distribution's."""
    return ruled(spark, pp.fit(many(spark, d), MANY, pp.Policy(extreme="none", asinh=False, robust=True, low_q=10, high_q=90, unit_variance=True)))


@query("d8_scaled_features", f"WITH {LI}, p AS (SELECT *, count(*) OVER (PARTITION BY run_key, sequence_id) AS n FROM li), m AS (SELECT avg(quantity) AS mq, stddev_pop(quantity) AS sq, avg(extendedprice) AS me, stddev_pop(extendedprice) AS se FROM p WHERE t < floor(n * 0.7)) SELECT sequence_id, t, round((quantity - mq) / sq, 6) AS quantity, round((extendedprice - me) / se, 6) AS extendedprice FROM li, m")
def _(spark, d):
    rows = pp.time_split(li(spark, d))
    rules = pp.fit(rows.where("part = 'train'"), ["quantity", "extendedprice"])
    return pp.apply(rows, rules, mode="test").select("sequence_id", "t", *r6("quantity", "extendedprice"))


@query("d9_fill_missing", f"WITH {LI}, h AS (SELECT *, {HOLES} AS q FROM li), f AS (SELECT sequence_id, t, coalesce(last_value(q IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(q IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS quantity FROM h) SELECT sequence_id, t, quantity FROM f")
def _(spark, d):
    return pp.fill_missing(li(spark, d).withColumn("quantity", F.expr(HOLES)), "quantity").select("sequence_id", "t", "quantity")


INSIDE = "CASE WHEN spiky > cut THEN NULL ELSE spiky END"
FILLED = f"coalesce(last_value(inside IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(inside IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


@query("d9_extreme_actions", f"WITH {REPORT}, g AS (SELECT (SELECT q995 FROM k WHERE feature = 'spiky' AND high) AS cut, avg(spiky) AS m, stddev_pop(spiky) AS s FROM many), i AS (SELECT *, {INSIDE} AS inside FROM many, g) SELECT sequence_id, t, round((spiky - m) / s, 5) AS none, round((inside - m) / s, 5) AS nan, round(({FILLED} - m) / s, 5) AS ffill FROM i")
def _(spark, d):
    """What becomes of extreme values: none, nan or ffill."""
    rows = many(spark, d).select(*KEYS, "t", "spiky")
    rules = pp.fit(rows, ["spiky"], pp.Policy(extreme="none"))
    three = rows.select(*KEYS, "t", *(F.col("spiky").alias(a) for a in ("none", "nan", "ffill")))
    for action in ("none", "nan", "ffill"):
        three = pp.apply(three, [replace(r, feature=action) for r in rules], extreme=action)
    return three.select("sequence_id", "t", *(F.round(a, 5).alias(a) for a in ("none", "nan", "ffill")))


@query("d10_zero_inflated", f"WITH {REPORT}, g AS (SELECT avg(sparse) AS m, stddev_pop(sparse) AS s FROM many WHERE sparse <> 0) SELECT sequence_id, t, CAST(sparse <> 0 AS DOUBLE) AS sparse__is_nonzero, round((sparse - m) / s, 5) AS sparse__mag FROM many, g")
def _(spark, d):
    rows = many(spark, d).select(*KEYS, "t", "sparse")
    return pp.apply(rows, pp.fit(rows, ["sparse"], pp.Policy(asinh=False))).select("sequence_id", "t", "sparse__is_nonzero", F.round("sparse__mag", 5).alias("sparse__mag"))


@query("d12_fit_and_apply", f"WITH {REPORT}, p AS (SELECT *, t < floor(count(*) OVER (PARTITION BY run_key, sequence_id) * 0.7) AS is_train FROM many), g AS (SELECT CASE WHEN quantile_cont(spiky, 0.999) - quantile_cont(spiky, 0.995) >= 10 * (quantile_cont(spiky, 0.75) - quantile_cont(spiky, 0.25)) THEN quantile_cont(spiky, 0.995) ELSE 1e18 END AS cut FROM p WHERE is_train), i AS (SELECT *, {INSIDE} AS inside FROM p, g WHERE is_train), f AS (SELECT sequence_id, t, {FILLED} AS x FROM i), n AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM f) SELECT 'train' AS part, sequence_id, t, round((x - m) / s, 5) AS spiky FROM f, n UNION ALL SELECT 'val', sequence_id, t, round((spiky - m) / s, 5) FROM p, n WHERE NOT is_train")
def _(spark, d):
    """Fitted on training rows; these lose their extreme values, validation rows keep theirs."""
    rows = pp.time_split(many(spark, d).select(*KEYS, "t", "spiky"))
    rules = pp.fit(rows.where("part = 'train'"), ["spiky"], pp.Policy(asinh=False))
    out = pp.apply(rows.where("part = 'train'"), rules, "train").unionByName(pp.apply(rows.where("part = 'val'"), rules, "test"))
    return out.select("part", "sequence_id", "t", F.round("spiky", 5).alias("spiky"))


# E: windows

F8 = f"({W} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"


@query("e1_sliding_windows", f"WITH {EV} SELECT sequence_id, t AS t_end, round(m, 6) AS m FROM (SELECT sequence_id, t, avg(score) OVER {F8} AS m FROM ev) WHERE t >= 7 AND (t - 7) % 2 = 0")
def _(spark, d):
    out = wd.sliding_windows(ev(spark, d), ["score"], 8, 2)
    return out.select("sequence_id", "t_end", F.round(F.aggregate("w", F.lit(0.0), lambda s, x: s + x["score"]) / 8, 6).alias("m"))


@query("e2_causal_windows", f"WITH {EV} SELECT sequence_id, t, round((greatest(7 - t, 0) * first_value(score) OVER ({W}) + sum(score) OVER {F8}) / 8, 6) AS m FROM ev")
def _(spark, d):
    return wd.causal_windows(ev(spark, d), "score", 8).select("sequence_id", "t", F.round(F.aggregate("w", F.lit(0.0), lambda s, x: s + x) / 8, 6).alias("m"))


@query("e3_patches", f"WITH {EV}, n AS (SELECT *, count(*) OVER (PARTITION BY run_key, sequence_id) AS n, sum(score) OVER ({W} ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS s, first_value(score) OVER ({W}) AS f FROM ev) SELECT sequence_id, t AS patch_start, round(s + greatest(10 - n, 0) * f, 6) AS total FROM n WHERE t % 5 = 0 AND (t + 10 <= n OR (n < 10 AND t = 0))")
def _(spark, d):
    return wd.patches(ev(spark, d), "score", 10, 5).select("sequence_id", "patch_start", F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("e4_last_elements", f"WITH {LI} SELECT sequence_id, t AS t_end, quantity, tax FROM li WHERE t >= 7 AND (t - 7) % 2 = 0")
def _(spark, d):
    return wd.last_elements(wd.sliding_windows(li(spark, d), ["quantity", "tax"], 8, 2)).drop("run_key")


@query("e5_difference", f"WITH {LI} SELECT sequence_id, t, {sql6('quantity', 'tax')}, label FROM (SELECT sequence_id, t, quantity - lag(quantity) OVER ({W}) AS quantity, tax - lag(tax) OVER ({W}) AS tax, label FROM li) WHERE t > 0")
def _(spark, d):
    return wd.difference(li(spark, d), ["quantity", "tax"]).select("sequence_id", "t", *r6("quantity", "tax"), "label")


@query("e6_standardised", f"WITH {LI} SELECT sequence_id, t, round((quantity - m) / greatest(s, 1e-6), 6) AS z FROM (SELECT *, avg(quantity) OVER {F8} AS m, stddev_samp(quantity) OVER {F8} AS s FROM li) WHERE t >= 7")
def _(spark, d):
    return wd.standardised(li(spark, d), "quantity", 8).select("sequence_id", "t", *r6("z"))


@query("e7_prediction_target", f"WITH {EV} SELECT * FROM (SELECT sequence_id, t, score, lead(score, 3) OVER ({W}) AS target FROM ev) WHERE target IS NOT NULL")
def _(spark, d):
    return wd.prediction_target(ev(spark, d), "score", 3).drop("run_key")


@query("e8_reversible_norm", f"WITH {LI} SELECT sequence_id, t, round((quantity - avg(quantity) OVER {F8}) / sqrt(var_pop(quantity) OVER {F8} + 1e-5), 5) AS normed FROM li WHERE t >= 0")
def _(spark, d):
    return wd.reversible_norm(li(spark, d), "quantity", 8).select("sequence_id", "t", F.round("normed", 5).alias("normed"))


@query("e9_normalised_and_back", f"WITH {LI} SELECT sequence_id, t, round((quantity - avg(quantity) OVER ()) / stddev_pop(quantity) OVER (), 5) AS z, round(quantity, 5) AS back FROM li")
def _(spark, d):
    rows, stats = wd.normalised(li(spark, d), ["quantity"])
    return wd.denormalised(rows.withColumn("z", F.col("quantity")), stats, ["quantity"]).select("sequence_id", "t", F.round("z", 5).alias("z"), F.round("quantity", 5).alias("back"))


@query("e10_trend_and_season", f"WITH {LI}, n AS (SELECT *, count(*) OVER (PARTITION BY run_key, sequence_id) AS n, first_value(quantity) OVER ({W}) AS f, last_value(quantity) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, sum(quantity) OVER ({W} ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS s FROM li) SELECT sequence_id, t, round((s + greatest(12 - t, 0) * f + greatest(t + 12 - (n - 1), 0) * l) / 25, 6) AS trend FROM n")
def _(spark, d):
    return wd.trend_and_season(li(spark, d), "quantity", 25).select("sequence_id", "t", *r6("trend"))


@query("e11_window_summary", f"WITH {LI} SELECT sequence_id, t, round(avg(quantity) OVER f, 6) AS mean, round(stddev_pop(quantity) OVER f, 5) AS std, round(CASE WHEN count(*) OVER f > 1 THEN (quantity - first_value(quantity) OVER f) / (count(*) OVER f - 1) ELSE 0 END, 6) AS slope FROM li WINDOW f AS {F8}")
def _(spark, d):
    return wd.window_summary(li(spark, d), "quantity", 8).select("sequence_id", "t", *r6("mean"), F.round("std", 5).alias("std"), *r6("slope"))


@query("e12_padding", f"WITH {EV}, n AS (SELECT *, count(*) OVER (PARTITION BY run_key, sequence_id) AS n FROM ev) SELECT sequence_id, count(*) AS n_rows, sum(CASE WHEN t < 4 OR t >= n - 2 THEN 0 ELSE 1 END) AS with_score FROM n GROUP BY 1")
def _(spark, d):
    out = wd.pad_scores(ev(spark, d), 4, 2)
    return out.groupBy("sequence_id").agg(F.count("*").alias("n_rows"), F.sum(c.finite("score").cast("long")).alias("with_score"))


@query("e13_sentinels", f"WITH {EV} SELECT sequence_id, count(*) + 1 AS n, -1 AS first_t FROM ev GROUP BY 1")
def _(spark, d):
    return sweep.with_sentinels(ev(spark, d)).groupBy("sequence_id").agg(F.count("*").alias("n"), F.min("t").cast("int").alias("first_t"))


# F: scores

P8 = f"({W} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)"
STATS = "st AS (SELECT avg(quantity) AS mq, stddev_pop(quantity) AS sq, avg(extendedprice) AS me, stddev_pop(extendedprice) AS se, avg(dq) AS mdq, stddev_pop(dq) AS sdq, avg(de) AS mde, stddev_pop(de) AS sde FROM (SELECT *, quantity - lag(quantity) OVER (" + W + ") AS dq, extendedprice - lag(extendedprice) OVER (" + W + ") AS de FROM li))"
TWO = ["quantity", "extendedprice"]


@query("f1_moving_threshold", f"WITH {EV} SELECT sequence_id, t, round(score - avg(score) OVER {P8} - 2 * stddev_pop(score) OVER {P8}, 4) AS score FROM ev")
def _(spark, d):
    return sc.moving_threshold(ev(spark, d), "score", 8, 2.0).select("sequence_id", "t", F.round("score", 4).alias("score"))


@query("f4_histogram", f"WITH {LI}, b AS (SELECT sequence_id, t, CAST(least(floor((quantity - (SELECT min(quantity) FROM li)) / (SELECT max(quantity) - min(quantity) FROM li) * 10), 9) AS INT) AS b FROM li), h AS (SELECT b, CAST(count(*) AS DOUBLE) AS n FROM b GROUP BY 1) SELECT sequence_id, t, round(-ln(n / (SELECT max(n) FROM h) + 0.1), 6) AS score FROM b JOIN h USING (b)")
def _(spark, d):
    return sc.histogram_score(li(spark, d), ["quantity"]).select("sequence_id", "t", *r6("score"))


@query("f7_sparse_score", f"WITH {LI}, {STATS}, z AS (SELECT sequence_id, t, abs((quantity - mq) / sq) + 0.5 * abs((coalesce(quantity - lag(quantity) OVER ({W}), 0) - mdq) / sdq) AS a, abs((extendedprice - me) / se) + 0.5 * abs((coalesce(extendedprice - lag(extendedprice) OVER ({W}), 0) - mde) / sde) AS b FROM li, st) SELECT sequence_id, t, round(greatest(a, b), 6) AS score FROM z")
def _(spark, d):
    rows = li(spark, d)
    return sc.sparse_score(rows, sc.train_stats(rows, TWO), TWO, 1, 0.5).select("sequence_id", "t", *r6("score"))


CHANNELS = "ch AS (SELECT run_key, sequence_id, t, label, unnest(['quantity', 'extendedprice', 'discount', 'tax']) AS feature, unnest([quantity, extendedprice, discount, tax]) AS x FROM li)"


@query("f8_slow_channels", f"WITH {LI}, {CHANNELS}, b AS (SELECT *, lag(x) OVER (PARTITION BY sequence_id, feature ORDER BY t) AS x0 FROM ch), s AS (SELECT feature, corr(x, x0) - stddev_pop(x - x0) / greatest(stddev_pop(x), 1e-6) AS slowness FROM b GROUP BY 1) SELECT feature, round(slowness, 6) AS slowness, row_number() OVER (ORDER BY slowness DESC, feature) AS place FROM s")
def _(spark, d):
    return sc.slow_channels(li(spark, d), FEATURES).select("feature", *r6("slowness"), "place")


@query("f9_cusum", f"WITH {LI}, {STATS}, c AS (SELECT sequence_id, t, run_key, sum((quantity - mq) / sq - 0.5) OVER u AS up, sum(-(quantity - mq) / sq - 0.5) OVER u AS lo FROM li, st WINDOW u AS ({W} ROWS UNBOUNDED PRECEDING)) SELECT sequence_id, t, round(greatest(up - least(0, min(up) OVER u), lo - least(0, min(lo) OVER u)), 5) AS score FROM c WINDOW u AS ({W} ROWS UNBOUNDED PRECEDING)")
def _(spark, d):
    rows = li(spark, d)
    return sc.cusum(rows, sc.train_stats(rows, ["quantity"]), ["quantity"], 0.5).select("sequence_id", "t", F.round("score", 5).alias("score"))


@query("f9_cusum_normalised", f"WITH {LI}, {STATS}, c AS (SELECT sequence_id, t, run_key, sum((quantity - mq) / sq - 0.5) OVER u AS up, sum(-(quantity - mq) / sq - 0.5) OVER u AS lo FROM li, st WINDOW u AS ({W} ROWS UNBOUNDED PRECEDING)), x AS (SELECT sequence_id, t, greatest(up - least(0, min(up) OVER u), lo - least(0, min(lo) OVER u)) AS score FROM c WINDOW u AS ({W} ROWS UNBOUNDED PRECEDING)), m AS (SELECT median(score) AS m FROM x), a AS (SELECT 1.4826 * median(abs(score - m)) AS s FROM x, m) SELECT sequence_id, t, round((score - m) / s, 4) + 0.0 AS score FROM x, m, a")
def _(spark, d):
    """CUSUM in units of its own robust location and scale."""
    rows = li(spark, d)
    return sc.robust_normalised(sc.cusum(rows, sc.train_stats(rows, ["quantity"]), ["quantity"], 0.5), ["run_key"]).select("sequence_id", "t", (F.round("score", 4) + F.lit(0.0)).alias("score"))  # no -0


@query("f10_mean_drift", f"WITH {LI}, {STATS} SELECT sequence_id, t, round((abs((avg(quantity) OVER {F8} - mq) / sq) + abs((avg(extendedprice) OVER {F8} - me) / se)) / 2, 6) AS score FROM li, st")
def _(spark, d):
    rows = li(spark, d)
    return sc.mean_drift(rows, sc.train_stats(rows, TWO), TWO, 8).select("sequence_id", "t", *r6("score"))


@query("f11_rolling_correlation", f"WITH {LI} SELECT sequence_id, t, round(covar_pop(quantity, extendedprice) OVER {F8} / sqrt(greatest(var_pop(quantity) OVER {F8}, 1e-6) * greatest(var_pop(extendedprice) OVER {F8}, 1e-6)), 4) + 0.0 AS corr FROM li WHERE t >= 0")
def _(spark, d):
    return sc.rolling_correlation(li(spark, d), *TWO, 8).select("sequence_id", "t", (F.round("corr", 4) + F.lit(0.0)).alias("corr"))  # no -0


@query("f16_duration_pool", f"WITH {EV}, p AS (SELECT *, greatest(score, 0) AS s FROM ev) SELECT sequence_id, t, round(greatest(sum(s) OVER a / sqrt(count(*) OVER a), sum(s) OVER b / sqrt(count(*) OVER b)), 5) AS score FROM p WINDOW a AS ({W} ROWS 3 PRECEDING), b AS ({W} ROWS 15 PRECEDING)")
def _(spark, d):
    return sc.duration_pool(ev(spark, d), [4, 16]).select("sequence_id", "t", F.round("score", 5).alias("score"))


@query("f17_robust_location", f"WITH {EV}, m AS (SELECT kind, median(score) AS location FROM ev GROUP BY 1) SELECT kind, round(any_value(location), 6) AS location, round(1.4826 * median(abs(score - location)), 6) AS scale FROM ev JOIN m USING (kind) GROUP BY 1")
def _(spark, d):
    return sc.robust_location(ev(spark, d), ["kind"]).select("kind", *r6("location", "scale"))


VEC = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"


@query("f20_knn_novelty", f"WITH e AS ({VEC}), s AS (SELECT q.vec_id, list_cosine_similarity(q.v, b.v) AS c, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, b.v) DESC) AS n FROM e q JOIN e b ON q.vec_id % 20 = 0 AND b.vec_id <> q.vec_id) SELECT vec_id, round(1 - avg(c), 5) AS score FROM s WHERE n <= 3 GROUP BY 1")
def _(spark, d):
    """Queries are all vectors whose id is divisible by 20, the bank all vectors."""
    e = t.read(spark, d, "embeddings")
    return sc.knn_novelty(e.where("vec_id % 20 = 0"), e).select("vec_id", F.round("score", 5).alias("score"))


@query("f22_points_from_patches", f"WITH {EV}, p AS (SELECT *, CASE WHEN t % 3 = 0 THEN score END AS s FROM ev) SELECT sequence_id, t, round(avg(s) OVER ({W} ROWS 5 PRECEDING), 6) AS score FROM p")
def _(spark, d):
    e = ev(spark, d)
    return sc.points_from_patches(e, e.where("t % 3 = 0").withColumnRenamed("t", "patch_start"), 6).select("sequence_id", "t", *r6("score"))


@query("f22_patch_quantiles", f"WITH {EV}, p AS (SELECT *, CASE WHEN t % 3 = 0 THEN score END AS s FROM ev) SELECT sequence_id, t, round(quantile_cont(s, 0.9) OVER ({W} ROWS 8 PRECEDING), 6) AS score FROM p")
def _(spark, d):
    e = ev(spark, d)
    return sc.points_from_patches(e, e.where("t % 3 = 0").withColumnRenamed("t", "patch_start"), 9, "quantile").select("sequence_id", "t", *r6("score"))


@query("f23_residual", f"WITH {LI} SELECT sequence_id, t, round((pow(quantity - lag(quantity, 7) OVER ({W}), 2) + pow(tax - lag(tax, 7) OVER ({W}), 2)) / 2, 6) AS score FROM li")
def _(spark, d):
    return sc.residual_score(li(spark, d), ["quantity", "tax"], 7).select("sequence_id", "t", *r6("score"))


@query("f23_predictions", f"WITH {LI}, e AS (SELECT *, (pow(quantity - extendedprice / 1500, 2) + pow(tax - discount, 2)) / 2 AS e FROM li) SELECT sequence_id, t, CASE WHEN t >= 4 THEN round(avg(e) OVER ({W} ROWS 4 PRECEDING), 4) END AS score FROM e")
def _(spark, d):
    """Another channel's value as a user's prediction, the error over windows of five rows."""
    rows = li(spark, d).withColumns({"q_hat": F.col("extendedprice") / 1500, "t_hat": F.col("discount")})
    return sc.prediction_residual(rows, {"quantity": "q_hat", "tax": "t_hat"}, width=5).select("sequence_id", "t", F.round("score", 4).alias("score"))


@query("f24_aligned", f"WITH {EV}, n AS (SELECT *, count(*) OVER (PARTITION BY run_key, sequence_id) AS n FROM ev) SELECT sequence_id, t, CASE WHEN t < 9 OR t >= n - 1 THEN NULL ELSE score END AS score FROM n")
def _(spark, d):
    return wd.aligned(ev(spark, d), 8, 2).select("sequence_id", "t", c.finite_or_null("score").alias("score"))


@query("f25_fused", f"WITH {LI}, n AS (SELECT avg(quantity) AS mq, stddev_pop(quantity) AS sq, avg(tax) AS mt, stddev_pop(tax) AS st FROM li WHERE label = 0) SELECT sequence_id, t, round((quantity - mq) / sq + 0.5 * (tax - mt) / st, 5) AS score FROM li, n")
def _(spark, d):
    rows = li(spark, d)
    return sc.fuse(rows, "quantity", "tax", 0.5, rows.where("label = 0")).select("sequence_id", "t", F.round("score", 5).alias("score"))


@query("f25_product", f"WITH {LI}, n AS (SELECT avg(quantity) AS mq, stddev_pop(quantity) AS sq, avg(tax) AS mt, stddev_pop(tax) AS st FROM li WHERE label = 0) SELECT sequence_id, t, round((quantity - mq) / sq * (tax - mt) / st, 5) AS score FROM li, n")
def _(spark, d):
    rows = li(spark, d)
    return sc.fuse(rows, "quantity", "tax", train=rows.where("label = 0"), how="product").select("sequence_id", "t", F.round("score", 5).alias("score"))


@query("f26_half_cosine", f"WITH e AS ({VEC}), c AS (SELECT i, avg(v[i]) AS m FROM e, range(1, 65) r(i) GROUP BY 1), x AS (SELECT vec_id, (1 - sum(v[i] * m) / sqrt(sum(v[i] * v[i]) * sum(m * m))) / 2 AS distance FROM e, c GROUP BY 1) SELECT vec_id, round(distance, 5) AS distance FROM x")
def _(spark, d):
    return sc.centroid_distance(t.read(spark, d, "embeddings"), "cosine").select("vec_id", F.round("distance", 5).alias("distance"))


@query("f26_centroid_distance", f"WITH e AS ({VEC}), c AS (SELECT i, avg(v[i]) AS m FROM e, range(1, 65) r(i) GROUP BY 1), x AS (SELECT vec_id, sqrt(sum(pow(v[i] - m, 2))) AS distance FROM e, c GROUP BY 1) SELECT vec_id, round(distance, 5) AS distance FROM x")
def _(spark, d):
    return sc.centroid_distance(t.read(spark, d, "embeddings")).select("vec_id", F.round("distance", 5).alias("distance"))


@query("f28_channel_graph", f"WITH {LI}, {CHANNELS}, p AS (SELECT a.feature AS a, b.feature AS b, sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) AS c FROM ch a JOIN ch b ON a.sequence_id = b.sequence_id AND a.t = b.t AND a.feature <> b.feature GROUP BY 1, 2), n AS (SELECT a, b, 1 / (1 + exp(-c)) AS w, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS n FROM p), k AS (SELECT a, b, w FROM n WHERE n <= 2 UNION ALL SELECT b, a, w FROM n WHERE n <= 2) SELECT a, b, round(max(w), 6) AS weight FROM k GROUP BY 1, 2")
def _(spark, d):
    return wide.channel_graph(li(spark, d), FEATURES, 2).select("a", "b", *r6("weight"))


@query("f28_self_loops", f"""WITH {LI}, {CHANNELS}, p AS (SELECT a.feature AS a, b.feature AS b, sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) AS c FROM ch a JOIN ch b ON a.sequence_id = b.sequence_id AND a.t = b.t GROUP BY 1, 2),
n AS (SELECT a, b, 1 / (1 + exp(-c)) AS w, row_number() OVER (PARTITION BY a, a = b ORDER BY c DESC, b) AS n FROM p) SELECT a, b, round(max(w), 6) AS weight FROM (SELECT a, b, w FROM n WHERE n <= 1 UNION ALL SELECT b, a, w FROM n WHERE n <= 1) GROUP BY 1, 2""")
def _(spark, d):
    return wide.channel_graph(li(spark, d), FEATURES, 1, self_loops=True).select("a", "b", *r6("weight"))


@query("f3_pca_residual")
def _(spark, d):
    return learned.pca_residual(wd.sliding_windows(li(spark, d), FEATURES, 4, 4), 0.95)


@query("f5_kmeans_distance")
def _(spark, d):
    return learned.kmeans_distance(wd.sliding_windows(li(spark, d), FEATURES, 4, 4), 4)


@query("f19_coreset")
def _(spark, d):
    return learned.coreset(t.read(spark, d, "embeddings"), 0.1)


@query("f29_dominant_periods")
def _(spark, d):
    return learned.dominant_periods(ev(spark, d), 3)


@query("f31_model_scores", f"WITH {EV} SELECT sequence_id, t, round(score / avg(score) OVER (PARTITION BY sequence_id), 4) AS score FROM ev")
def _(spark, d):
    return learned.score_with(ev(spark, d), lambda pdf: pdf["score"] / pdf["score"].mean()).select("sequence_id", "t", F.round("score", 4).alias("score"))


DRIFT_BLOCKS, DRIFT_WIDTHS = [["quantity", "extendedprice"], ["discount", "tax"]], [4, 16]
DRIFT_PAIRS = [p for a, b in DRIFT_BLOCKS for p in ((a, a), (b, b), (a, b))]


def drift_sql() -> str:
    """x: trailing means and correlations of all rows with their regime; r: references of each regime."""
    var = lambda f, w: f"greatest(var_pop({f}) OVER w{w}, 1e-6)"
    means = [f"avg({f}) OVER w{w} AS x_{w}_{f}" for w in DRIFT_WIDTHS for f in FEATURES]
    corrs = [f"covar_pop({a}, {b}) OVER w{w} / sqrt({var(a, w)} * {var(b, w)}) AS k_{w}_{a}_{b}" for w in DRIFT_WIDTHS for a, b in DRIFT_PAIRS]
    windows = ", ".join(f"w{w} AS ({W} ROWS {w - 1} PRECEDING)" for w in DRIFT_WIDTHS)
    refs = [f"avg(x_{w}_{f}) AS m_{w}_{f}, CASE WHEN stddev_pop(x_{w}_{f}) < 1e-6 THEN 1 ELSE stddev_pop(x_{w}_{f}) END AS s_{w}_{f}" for w in DRIFT_WIDTHS for f in FEATURES]
    refs += [f"avg(k_{w}_{a}_{b}) AS q_{w}_{a}_{b}" for w in DRIFT_WIDTHS for a, b in DRIFT_PAIRS]
    return f"{LI}, x AS (SELECT *, CAST(quantity > 25 AS INT) AS regime, {', '.join(means + corrs)} FROM li WINDOW {windows}), r AS (SELECT regime, {', '.join(refs)} FROM x WHERE label = 0 GROUP BY GROUPING SETS ((regime), ()))"


DRIFT_COLUMNS = [f"{k}_{w}_{f}" for w in DRIFT_WIDTHS for f in FEATURES for k in "ms"] + [f"q_{w}_{a}_{b}" for w in DRIFT_WIDTHS for a, b in DRIFT_PAIRS]


def drift_rows(spark, d):
    return li(spark, d).withColumn("regime", (F.col("quantity") > 25).cast("int"))


def drift_refs(rows):
    """References from the rows' own frames; only rows without an anomaly count."""
    return rg.drift_references(rows, DRIFT_BLOCKS, DRIFT_WIDTHS, F.col("label") == 0)


@query("f12_drift_references", f"WITH {drift_sql()} SELECT coalesce(regime, -9) AS regime, {', '.join(f'round({n}, 4) AS {n}' for n in DRIFT_COLUMNS)} FROM r")
def _(spark, d):
    found, rows = drift_refs(drift_rows(spark, d)), []
    for regime, by in found.found.items():  # a row for each regime
        value = {}
        for (w, k), (mean, std, corr) in by.items():
            names = DRIFT_BLOCKS[k]
            value |= {f"m_{w}_{f}": mean[i] for i, f in enumerate(names)} | {f"s_{w}_{f}": std[i] for i, f in enumerate(names)}
            value |= {f"q_{w}_{a}_{b}": corr[names.index(a), names.index(b)] for a, b in DRIFT_PAIRS if a in names}
        rows.append((-9 if regime is None else regime, *(float(value[n]) for n in DRIFT_COLUMNS)))
    out = spark.createDataFrame(rows, "regime int, " + ", ".join(f"{n} double" for n in DRIFT_COLUMNS))
    return out.select("regime", *(F.round(n, 4).alias(n) for n in DRIFT_COLUMNS))


def drift_score_sql() -> str:
    parts = []
    for w in DRIFT_WIDTHS:
        for a, b in DRIFT_BLOCKS:
            shift = " + ".join(f"abs((x_{w}_{f} - m_{w}_{f}) / s_{w}_{f})" for f in (a, b))
            turn = " + ".join(f"{n} * abs(k_{w}_{p}_{q} - q_{w}_{p}_{q})" for p, q, n in ((a, a, 1), (b, b, 1), (a, b, 2)))
            parts.append(f"({shift}) / 2 + ({turn}) / 4")
    return f"greatest({', '.join(parts)})"


@query("f13_slow_drift", f"WITH {drift_sql()} SELECT sequence_id, t, round({drift_score_sql()}, 4) AS score FROM x JOIN r USING (regime)")
def _(spark, d):
    rows = drift_rows(spark, d)
    return rg.slow_drift(rows, drift_refs(rows)).select("sequence_id", "t", F.round("score", 4).alias("score"))


def blocks_sql() -> str:
    frame = f"({W} ROWS 15 PRECEDING)"
    sums = ", ".join(f"avg({f}) OVER w AS mean_{f}, stddev_pop({f}) OVER w AS std_{f}, CASE WHEN count(*) OVER w > 1 THEN ({f} - first_value({f}) OVER w) / (count(*) OVER w - 1) ELSE 0 END AS slope_{f}" for f in FEATURES)
    alike = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs({' + '.join(f'corr({k}_{a}, {k}_{b})' for k in rg.KINDS)}) / 3 AS alike FROM s" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :])
    return f"""WITH RECURSIVE {LI}, s AS (SELECT {sums} FROM li WINDOW w AS {frame}), p AS ({alike}), e AS (SELECT a, b FROM p WHERE alike >= 0.6 UNION ALL SELECT b, a FROM p WHERE alike >= 0.6),
n AS (SELECT unnest({FEATURES}) AS feature), c(feature, other) AS (SELECT feature, feature FROM n UNION SELECT c.feature, e.b FROM c JOIN e ON c.other = e.a),
i AS (SELECT feature, list_position({FEATURES}, feature) AS at FROM n) SELECT c.feature, arg_min(c.other, i.at) AS block FROM c JOIN i ON c.other = i.feature GROUP BY 1"""


@query("f14_channel_blocks", blocks_sql())
def _(spark, d):
    found = rg.channel_blocks(li(spark, d), FEATURES, 16)
    return spark.createDataFrame([(f, b[0]) for b in found for f in b], "feature string, block string")  # one row for each channel


@query("f15_regimes")
def _(spark, d):
    rows = li(spark, d)
    return rg.fit_regimes(rows.where("label = 0"), FEATURES, 8, 3, 2).assign(rows).select("sequence_id", "t", "regime")


STRUCTURE = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i:]]


def structure_sql() -> str:
    cells = ", ".join(f"covar_pop({a}, {b}) OVER w / sqrt((var_pop({a}) OVER w + 1e-6) * (var_pop({b}) OVER w + 1e-6)) AS k_{a}_{b}" for a, b in STRUCTURE)
    means = ", ".join(f"avg(k_{a}_{b}) AS m_{a}_{b}" for a, b in STRUCTURE)
    total = " + ".join(f"{1 if a == b else 2} * pow(k_{a}_{b} - m_{a}_{b}, 2)" for a, b in STRUCTURE)
    return f"WITH {LI}, k AS (SELECT sequence_id, t, count(*) OVER w AS n, {cells} FROM li WINDOW w AS ({W} ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)), p AS (SELECT * FROM k WHERE n = 16 AND t % 4 = 0), r AS (SELECT {means} FROM p WHERE sequence_id % 2 = 0) SELECT sequence_id, t AS patch_start, round(sqrt({total}), 4) AS score FROM p, r"


@query("f18_structural_score", structure_sql())
def _(spark, d):
    rows = li(spark, d)
    normal = rg.structure_reference(rows.where("sequence_id % 2 = 0"), FEATURES, 16, 4)
    return rg.structural_score(rows, normal, FEATURES, 16, 4).select("sequence_id", "patch_start", F.round("score", 4).alias("score"))


@query(
    "f21_regime_banks",
    f"""WITH e AS (SELECT vec_id, label, list_transform(v, lambda x: x / n) AS u FROM (SELECT e.vec_id, m.label, v, sqrt(list_dot_product(v, v)) AS n FROM ({VEC}) e JOIN embeddings m USING (vec_id))),
b AS (SELECT vec_id, label % 3 AS regime, u FROM e), m AS (SELECT regime, i, avg(u[i]) AS m FROM b, range(1, 65) r(i) GROUP BY 1, 2), c AS (SELECT regime, list(m ORDER BY i) AS c FROM m GROUP BY 1),
q AS (SELECT vec_id, any_value(u) AS u, arg_min(regime, list_distance(u, c)) AS regime FROM e, c WHERE vec_id % 20 = 0 GROUP BY 1),
s AS (SELECT q.vec_id, q.regime, list_dot_product(q.u, b.u) AS c, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.u, b.u) DESC) AS n FROM q JOIN b ON q.regime = b.regime AND q.vec_id <> b.vec_id)
SELECT vec_id, regime, round(1 - avg(c), 5) AS score FROM s WHERE n <= 3 GROUP BY 1, 2""",
)
def _(spark, d):
    e = t.read(spark, d, "embeddings").withColumn("regime", F.col("label") % 3)
    return rg.knn_novelty_by_regime(e.where("vec_id % 20 = 0"), e).select("vec_id", "regime", F.round("score", 5).alias("score"))


UNITS = {"quantity": 50.0, "extendedprice": 100_000.0, "discount": 0.1, "tax": 0.1}  # of each feature, so that none outweighs the others


@query("f27_step_inconsistency", f"WITH {LI} SELECT sequence_id, t, round(coalesce(({' + '.join(f'pow(({f} - lag({f}) OVER w) / {u}, 2)' for f, u in UNITS.items())}) / 4, 0), 6) AS score FROM li WINDOW w AS ({W})")
def _(spark, d):
    return rg.step_inconsistency(li(spark, d), F.array(*(F.col(f) / u for f, u in UNITS.items())), ["t"], KEYS).select("sequence_id", "t", *r6("score"))


# G: thresholds and alarms

SWEEP = f"""WITH {EV}, a AS (SELECT *, lead(score) OVER w AS s1, lead(label) OVER w AS y1, lag(label) OVER w AS y0 FROM ev WINDOW w AS ({W})),
k AS (SELECT *, sum(CASE WHEN label = 1 AND coalesce(y0, 0) = 0 THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS k, least(score, s1) AS pair FROM a),
o AS (SELECT *, t - min(CASE WHEN label = 1 THEN t END) OVER (PARTITION BY run_key, sequence_id, k) AS off FROM k),
lo AS (SELECT run_key, sequence_id, CASE WHEN label = 1 THEN k ELSE k + 1 END AS kk, min(CASE WHEN label = 0 THEN score END) AS low, min_by(CASE WHEN label = 1 THEN score END, CASE WHEN label = 1 THEN t END) AS f FROM o GROUP BY 1, 2, 3),
la AS (SELECT run_key, sequence_id, k + 1 AS kk, max_by(score, t) AS l FROM o WHERE label = 1 GROUP BY 1, 2, 3),
br AS (SELECT run_key, sequence_id, kk AS k, least(low, f, l) AS v FROM lo JOIN la USING (run_key, sequence_id, kk) WHERE low IS NOT NULL AND f IS NOT NULL),
wh AS (SELECT run_key, score AS v, 1.0 AS nf, 1.0 AS fa, 0.0 AS e, 0.0 AS l, 0.0 AS d, 0.0 AS n FROM o WHERE label = 0
 UNION ALL SELECT run_key, pair, 0, -1, CASE WHEN label = 0 AND y1 = 1 THEN 1 ELSE 0 END, CASE WHEN label = 1 AND y1 = 0 THEN 1 ELSE 0 END, 0, 0 FROM o WHERE y1 IS NOT NULL AND NOT (label = 1 AND y1 = 1)
 UNION ALL SELECT run_key, v, 0, 1, 0, 0, 0, 0 FROM br),
ea AS (SELECT run_key, sequence_id, k, score AS v, 1.0 AS al, pow(2.0, -(off + 1)) AS wt, 0.0 AS b FROM o WHERE label = 1
 UNION ALL SELECT run_key, sequence_id, k, pair, -1, 0, 0 FROM o WHERE label = 1 AND y1 = 1 UNION ALL SELECT run_key, sequence_id, k, v, 0, 0, 1 FROM br),
g AS (SELECT run_key, sequence_id, k, v, sum(al) AS al, sum(wt) AS wt, sum(b) AS b FROM ea GROUP BY 1, 2, 3, 4),
ru AS (SELECT run_key, sequence_id, k, v, sum(al) OVER f AS al, sum(wt) OVER f AS wt, sum(b) OVER f AS b FROM g WINDOW f AS (PARTITION BY run_key, sequence_id, k ORDER BY v DESC ROWS UNBOUNDED PRECEDING)),
no AS (SELECT *, CASE WHEN al >= 1 + b THEN 1.0 ELSE 0.0 END AS d, CASE WHEN al >= 1 + b THEN (1 + wt) * pow(2.0, -al) ELSE 0.0 END AS n FROM ru),
al AS (SELECT run_key, v, nf, fa, e, l, d, n FROM wh UNION ALL SELECT run_key, v, 0, 0, 0, 0, d - coalesce(lag(d) OVER f, 0), n - coalesce(lag(n) OVER f, 0) FROM no WINDOW f AS (PARTITION BY run_key, sequence_id, k ORDER BY v DESC)),
su AS (SELECT run_key, v, sum(nf) AS nf, sum(fa) AS fa, sum(e) AS e, sum(l) AS l, sum(d) AS d, sum(n) AS n FROM al GROUP BY 1, 2),
ca AS (SELECT run_key, v, sum(nf) OVER f AS nf, sum(fa) OVER f AS fa, sum(e) OVER f AS e, sum(l) OVER f AS l, sum(d) OVER f AS d, sum(n) OVER f AS n FROM su WINDOW f AS (PARTITION BY run_key ORDER BY v DESC ROWS UNBOUNDED PRECEDING)),
cu AS (SELECT run_key, v, round(d - fa / 2 - CASE WHEN nf > 0.5 THEN 1 - 1 / nf ELSE 0 END - 0.75 * e - 0.25 * l + CASE WHEN d > 0.5 THEN n / d ELSE 0 END, 9) AS s FROM ca)"""


@query("g1_threshold_sweep", f"{SWEEP} SELECT run_key, CASE WHEN max(s) > 0 THEN max_by(v, struct_pack(s := s, v := v)) ELSE CAST('inf' AS DOUBLE) END AS threshold, round(greatest(max(s), 0), 6) AS best_score, count(*) + 1 AS num_steps FROM cu GROUP BY 1")
def _(spark, d):
    return sweep.best_threshold(ev(spark, d)).select("run_key", "threshold", *r6("best_score"), "num_steps")


CHANNEL_RUNS = f"{LI}, {CHANNELS}, ev AS (SELECT feature AS run_key, sequence_id, t, x AS score, label FROM ch)"


@query("f2_best_channel", f"{SWEEP.replace(EV, CHANNEL_RUNS)}, be AS (SELECT run_key, CASE WHEN max(s) > 0 THEN max_by(v, struct_pack(s := s, v := v)) ELSE CAST('inf' AS DOUBLE) END AS threshold, greatest(max(s), 0) AS best FROM cu GROUP BY 1) SELECT run_key, threshold, round(best, 6) AS best_score, row_number() OVER (ORDER BY best DESC, run_key) AS place FROM be")
def _(spark, d):
    """Every channel as a run of its own: one sweep for all of them, then the best."""
    best = sweep.best_thresholds(li(spark, d), FEATURES)
    return best.select("run_key", "threshold", *r6("best_score"), F.row_number().over(Window.orderBy(F.desc("best_score"), "run_key")).alias("place"))  # one row for each channel


@query("g2_quantile_threshold", f"WITH {EV}, u AS (SELECT run_key, score FROM ev UNION ALL SELECT DISTINCT_KEYS.run_key, CAST('-inf' AS DOUBLE) FROM (SELECT DISTINCT run_key, sequence_id FROM ev) DISTINCT_KEYS) SELECT run_key, 0.05 AS fraction, round(quantile_cont(score, 0.95), 6) AS threshold FROM u GROUP BY 1")
def _(spark, d):
    return sweep.quantile_thresholds(ev(spark, d), [0.05]).select("run_key", "fraction", *r6("threshold"))


FRACTIONS = {"view": 0.02, "click": 0.05, "signup": 0.05, "purchase": 0.2, "error": 0.5}


@query("g2_fractions", f"WITH {EV}, r AS (SELECT kind AS run_key, sequence_id, score FROM ev), u AS (SELECT run_key, score FROM r UNION ALL SELECT run_key, CAST('-inf' AS DOUBLE) FROM (SELECT DISTINCT run_key, sequence_id FROM r)), f(run_key, fraction) AS (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in FRACTIONS.items())}) SELECT run_key, any_value(fraction) AS fraction, round(CASE run_key {' '.join(f"WHEN '{k}' THEN quantile_cont(score, {1 - v})" for k, v in FRACTIONS.items())} END, 6) AS threshold FROM u JOIN f USING (run_key) GROUP BY 1")
def _(spark, d):
    """Each kind of event as a run with a fraction of its own."""
    rows = ev(spark, d).withColumn("run_key", F.col("kind"))
    known = spark.createDataFrame(list(FRACTIONS.items()), "run_key string, fraction double")
    return sweep.fixed_thresholds(rows, known).select("run_key", "fraction", *r6("threshold"))


@query("g3_ratio_thresholds", f"WITH {EV}, u AS (SELECT run_key, score FROM ev UNION ALL SELECT run_key, CAST('-inf' AS DOUBLE) FROM ev WHERE t = 0), f AS (SELECT unnest([0.01, 0.02, 0.05, 0.1])::DOUBLE AS fraction), r AS (SELECT run_key, score, row_number() OVER (PARTITION BY run_key ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY run_key) AS n FROM u), x AS (SELECT *, (1 - fraction) * (n - 1) AS place FROM r, f) SELECT run_key, fraction, round(min(score) + (max(place) - floor(max(place))) * (max(score) - min(score)), 6) AS threshold FROM x WHERE i IN (floor(place), ceil(place)) GROUP BY 1, 2")
def _(spark, d):
    return sweep.quantile_thresholds(ev(spark, d), [0.01, 0.02, 0.05, 0.1]).select("run_key", "fraction", *r6("threshold"))


PRED = "p AS (SELECT *, CAST(score > 150 AS INT) AS pred FROM ev)"


@query("g4_predict", f"WITH {EV}, {PRED} SELECT kind, CAST(sum(pred) AS BIGINT) AS alarms FROM p GROUP BY 1")
def _(spark, d):
    return alarms.predict(ev(spark, d), 150.0).groupBy("kind").agg(F.sum("pred").alias("alarms"))


GAPPED = "CASE WHEN t % 13 = 12 THEN NULL ELSE score END"
ST = f"st AS (SELECT *, sum(CASE WHEN s IS NULL THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS stretch FROM (SELECT * EXCLUDE (score), {GAPPED} AS s FROM ev))"


def gapped(spark, d):
    return ev(spark, d).withColumn("score", F.expr(GAPPED))


@query("g5_rolling_max", f"WITH {EV}, {ST} SELECT sequence_id, t, max(s) OVER (PARTITION BY sequence_id, stretch, s IS NULL ORDER BY t ROWS 3 PRECEDING) AS rolling_max FROM st")
def _(spark, d):
    return alarms.rolling_max(alarms.finite_stretches(gapped(spark, d)), 4).select("sequence_id", "t", "rolling_max")


@query("g6_ewma", f"WITH {EV}, {ST}, l AS (SELECT sequence_id, t, s, list(s) OVER (PARTITION BY sequence_id, stretch, s IS NULL ORDER BY t ROWS UNBOUNDED PRECEDING) AS x FROM st) SELECT sequence_id, t, CASE WHEN s IS NULL THEN NULL ELSE round(list_reduce(x, lambda a, b: 0.5 * b + 0.5 * a), 5) END AS ewma FROM l")
def _(spark, d):
    return alarms.ewma(alarms.finite_stretches(gapped(spark, d)), 3).select("sequence_id", "t", F.round("ewma", 5).alias("ewma"))


DECIDED = f"{ST}, de AS (SELECT run_key, sequence_id, t, s, label, stretch, CASE WHEN s IS NOT NULL THEN greatest(max(s) OVER (PARTITION BY sequence_id, stretch, s IS NULL ORDER BY t ROWS 3 PRECEDING), list_reduce(list(s) OVER (PARTITION BY sequence_id, stretch, s IS NULL ORDER BY t ROWS UNBOUNDED PRECEDING), lambda a, b: 0.5 * b + 0.5 * a)) END AS decision FROM st)"


@query("g7_decision_scores", f"WITH {EV}, {DECIDED} SELECT sequence_id, t, round(decision, 5) AS decision FROM de")
def _(spark, d):
    return alarms.decision_scores(gapped(spark, d), 4, 3).select("sequence_id", "t", F.round(c.finite_or_null("decision"), 5).alias("decision"))


@query("g14_sequences_of", f"WITH {EV}, g AS (SELECT sequence_id AS run, t, {GAPPED} AS s FROM ev), n AS (SELECT *, s IS NOT NULL AND lag(s) OVER (PARTITION BY run ORDER BY t) IS NULL AS nw FROM g), q AS (SELECT *, sum(CAST(nw AS INT)) OVER (PARTITION BY run ORDER BY t ROWS UNBOUNDED PRECEDING) - 1 AS seq FROM n) SELECT run AS run_key, seq AS sequence_id, row_number() OVER (PARTITION BY run, seq ORDER BY t) - 1 AS t, s AS score FROM q WHERE s IS NOT NULL")
def _(spark, d):
    """A flat run with holes as sequences."""
    flat = gapped(spark, d).select(F.col("sequence_id").alias("run_key"), "t", "score")
    return alarms.sequences_of(flat).select("run_key", "sequence_id", "t", "score")


@query("g8_robust_scale", f"WITH {EV}, m AS (SELECT median(score) AS m FROM ev) SELECT run_key, round(greatest(1.4826 * median(abs(score - m)), 1e-12), 6) AS scale FROM ev, m GROUP BY 1")
def _(spark, d):
    return alarms.robust_scale(ev(spark, d), ["run_key"]).select("run_key", *r6("scale"))


@query("g9_hysteresis", f"""WITH {EV}, h AS (SELECT *, CASE WHEN t >= 1 AND least(score, lag(score) OVER w) >= 300 THEN 1 WHEN t >= 1 AND greatest(score, lag(score) OVER w) < 150 THEN 0 END AS e FROM ev WINDOW w AS ({W}))
SELECT sequence_id, t, CAST(coalesce(last_value(e IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 OR coalesce(max(CASE WHEN e = 1 THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), 0) = 1 AS INT) AS pred FROM h""")
def _(spark, d):
    return alarms.hysteresis(alarms.decision_scores(ev(spark, d)), 300.0, 150.0, 2, 2).select("sequence_id", "t", "pred")


RUNS = f"n AS (SELECT *, {NEWLY} AS nw FROM p), i AS (SELECT *, sum(nw) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM n)"


@query("g13_segments", f"WITH {EV}, {PRED}, {RUNS}, e AS (SELECT sequence_id, run, min(t) AS start_t, max(t) + 1 AS end_t FROM i WHERE pred = 1 GROUP BY 1, 2) SELECT sequence_id, row_number() OVER (PARTITION BY sequence_id ORDER BY start_t) - 1 AS event_id, start_t, end_t, end_t - start_t AS length FROM e")
def _(spark, d):
    return alarms.segments(alarms.predict(ev(spark, d), 150.0), "pred").drop("run_key")


@query("g12_merged_events", f"WITH {EV}, {PRED}, {RUNS}, z AS (SELECT *, count(*) OVER (PARTITION BY sequence_id, run) AS len, max(run) OVER (PARTITION BY sequence_id) AS top FROM i), q AS (SELECT run_key, sequence_id, t, CASE WHEN pred = 0 AND run > 0 AND run < top AND len <= 2 THEN 1 ELSE pred END AS pred FROM z), n2 AS (SELECT *, {NEWLY} AS nw FROM q), i2 AS (SELECT *, sum(nw) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM n2) SELECT sequence_id, t, CASE WHEN pred = 1 AND count(*) OVER (PARTITION BY sequence_id, run) < 3 THEN 0 ELSE pred END AS pred FROM i2")
def _(spark, d):
    return alarms.merge_events(alarms.predict(ev(spark, d), 150.0), 2, 3).select("sequence_id", "t", "pred")


# H: metrics

METRIC = f"""WITH {EV}, {PRED}, b AS (SELECT *, coalesce(lag(pred) OVER w, 0) AS p0, coalesce(lag(label) OVER w, 0) AS y0 FROM p WINDOW w AS ({W})),
k AS (SELECT *, sum(CASE WHEN label = 1 AND y0 = 0 THEN 1 ELSE 0 END) OVER u AS k, sum(CASE WHEN pred = 1 AND p0 = 0 THEN 1 ELSE 0 END) OVER u AS r FROM b WINDOW u AS ({W} ROWS UNBOUNDED PRECEDING)),
ru AS (SELECT sequence_id, r, min(CASE WHEN label = 1 THEN k END) AS k FROM k WHERE pred = 1 GROUP BY 1, 2),
e0 AS (SELECT sequence_id, k, min(t) AS st FROM k WHERE label = 1 GROUP BY 1, 2),
e AS (SELECT k.sequence_id, k.k, sum(CASE WHEN pred = 1 AND (p0 = 0 OR y0 = 0) THEN 1 ELSE 0 END) AS alarms, sum(pred * pow(2.0, -(t - st + 1))) AS w, max(pred) AS hit, count(*) AS len, min(CASE WHEN pred = 1 THEN t END) - min(t) AS delay FROM k JOIN e0 ON k.sequence_id = e0.sequence_id AND k.k = e0.k WHERE label = 1 GROUP BY 1, 2),
cr AS (SELECT DISTINCT sequence_id, k FROM ru WHERE k IS NOT NULL),
f AS (SELECT sum(pred * (1 - label)) AS fp, sum(pred * p0 * label * (1 - y0)) AS early, sum(pred * p0 * y0 * (1 - label)) AS late FROM k)"""


SCORED = "round((SELECT count(*) FROM cr) - (SELECT count(*) FROM ru WHERE k IS NULL) / 2.0 - CASE WHEN fp > 0 THEN 1 - 1.0 / fp ELSE 0 END + coalesce((SELECT avg((1 + w) * pow(2.0, -alarms)) FROM e JOIN cr USING (sequence_id, k)), 0) - 0.75 * early - 0.25 * late, 6)"
SHARES = "(SELECT round(avg(CASE WHEN hit = 1 THEN alarms END), 6) FROM e) AS aaf, (SELECT round(avg(CAST(hit AS DOUBLE)), 6) FROM e) AS event_recall, (SELECT round(avg(delay / CAST(len AS DOUBLE)), 6) FROM e) AS event_detection_delay"


@query("h1_alarm_score", f"{METRIC} SELECT 'events' AS run_key, {SCORED} AS alarm_score FROM f")
def _(spark, d):
    return metrics.evaluate(alarms.predict(ev(spark, d), 150.0)).select("run_key", *r6("alarm_score"))


@query("h7_metrics", f"{METRIC} SELECT 'events' AS run_key, {SHARES}")
def _(spark, d):
    return metrics.evaluate(alarms.predict(ev(spark, d), 150.0)).select("run_key", *r6("aaf", "event_recall", "event_detection_delay"))


def metric_sql(before: str, pred: str) -> str:
    """SQL up to all metrics, for the CTEs before and the CTE p of predictions."""
    return METRIC.replace(f"WITH {EV}, {PRED},", f"WITH {before}, {pred},")


@query("h6_reference_values", f"{metric_sql(EV, 'p AS (SELECT *, label AS pred FROM ev)')} SELECT 'events' AS run_key, {SCORED} AS alarm_score, {SHARES} FROM f")
def _(spark, d):
    return metrics.reference_values(ev(spark, d)).select("run_key", *r6("alarm_score", "aaf", "event_recall", "event_detection_delay"))


def threshold_sql(rows: str) -> str:
    """The threshold of the sweep over rows, a CTE named ev."""
    return f"{SWEEP.replace(EV, rows)} SELECT CASE WHEN max(s) > 0 THEN max_by(v, struct_pack(s := s, v := v)) ELSE CAST('inf' AS DOUBLE) END AS threshold FROM cu"


ALL_METRICS = ("alarm_score", "aaf", "event_recall", "event_detection_delay")


@query("g15_raw_evaluation", f"{metric_sql(f'{EV}, th AS ({threshold_sql(EV)})', 'p AS (SELECT ev.*, CAST(score > threshold AS INT) AS pred FROM ev, th)')} SELECT {SCORED} AS alarm_score, {SHARES}, (SELECT round(threshold, 6) FROM th) AS threshold_on, (SELECT round(threshold, 6) FROM th) AS threshold_off, 0.0 AS robust_scale FROM f")
def _(spark, d):
    """Without post-processing: alarms above the best threshold."""
    return search.evaluated(ev(spark, d), search.RAW).select(*r6(*ALL_METRICS, "threshold_on", "threshold_off", "robust_scale"))


SMOOTH = "ev AS (SELECT run_key, sequence_id, t, label, greatest(max(score) OVER (PARTITION BY sequence_id ORDER BY t ROWS 1 PRECEDING), list_reduce(list(score) OVER (PARTITION BY sequence_id ORDER BY t ROWS UNBOUNDED PRECEDING), lambda a, b: 0.4 * b + 0.6 * a)) AS score FROM raw)"
SMOOTHED = EV.replace("ev AS", "raw AS", 1) + ", " + SMOOTH
HELD = f"""sc AS (SELECT greatest(1.4826 * median(abs(score - m)), 1e-12) AS scale FROM ev, (SELECT median(score) AS m FROM ev)),
hy AS (SELECT ev.*, threshold AS a, threshold - 0.5 * scale AS b FROM ev, th, sc),
hz AS (SELECT *, CASE WHEN t >= 1 AND least(score, lag(score) OVER w) >= a THEN 1 WHEN t >= 1 AND greatest(score, lag(score) OVER w) < b THEN 0 END AS e FROM hy WINDOW w AS ({W})),
p0 AS (SELECT *, CAST(coalesce(last_value(e IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 OR coalesce(max(CASE WHEN e = 1 THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), 0) = 1 AS INT) AS pred FROM hz),
p1 AS (SELECT *, {NEWLY} AS nw FROM p0), p2 AS (SELECT *, sum(nw) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM p1), p3 AS (SELECT *, count(*) OVER (PARTITION BY sequence_id, run) AS len, max(run) OVER (PARTITION BY sequence_id) AS top FROM p2),
p4 AS (SELECT * EXCLUDE (pred, nw, run, len, top), CASE WHEN pred = 0 AND run > 0 AND run < top AND len <= 1 THEN 1 ELSE pred END AS pred FROM p3), p5 AS (SELECT *, {NEWLY} AS nw FROM p4), p6 AS (SELECT *, sum(nw) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM p5)"""
KEPT = "p AS (SELECT run_key, sequence_id, t, label, CASE WHEN pred = 1 AND count(*) OVER (PARTITION BY sequence_id, run) < 2 THEN 0 ELSE pred END AS pred FROM p6)"
STEPS = search.Settings(2, 4, 0.5, 2, 2, 1, 2)  # a weight of 0.4, so that no mean of scores with two places lies halfway between rounded ones


@query("g15_evaluation", f"{metric_sql(f'{SMOOTHED}, th AS ({threshold_sql(SMOOTHED)}), {HELD}', KEPT)} SELECT {SCORED} AS alarm_score, {SHARES}, (SELECT round(threshold, 5) FROM th) AS threshold_on, (SELECT round(any_value(b), 5) FROM hy) AS threshold_off, (SELECT round(scale, 5) FROM sc) AS robust_scale FROM f")
def _(spark, d):
    """With post-processing: smoothing, the best threshold, hysteresis, merged events."""
    return search.evaluated(ev(spark, d), STEPS).select(*r6(*ALL_METRICS), *(F.round(x, 5).alias(x) for x in ("threshold_on", "threshold_off", "robust_scale")))


@query("g15_evaluated_rows", f"WITH {SMOOTHED}, th AS ({threshold_sql(SMOOTHED)}), {HELD}, {KEPT} SELECT sequence_id, t, round(raw.score, 5) AS raw_score, round(ev.score, 5) AS score, p.label, p.pred FROM p JOIN ev USING (sequence_id, t) JOIN raw USING (sequence_id, t)")
def _(spark, d):
    """What the evaluation gives besides: scores, decisions and alarms of every row."""
    rows = search.evaluation(ev(spark, d), [STEPS]).rows
    return rows.select("sequence_id", "t", *(F.round(x, 5).alias(x) for x in ("raw_score", "score")), "label", "pred")


@query("g17_coordinate_search")
def _(spark, d):
    """All settings that the search over two parameters tries, with their metrics; checked against a plain search in tests."""
    found = search.coordinate_search(ev(spark, d), {"width": [1, 3], "enter": [1, 2]}, rounds=2)
    rows = [(i, str(s), *(m[k] for k in ALL_METRICS), s == found.best) for i, (s, m) in enumerate(found.history)]  # one for each setting
    return spark.createDataFrame(rows, f"step long, settings string, {', '.join(f'{k} double' for k in ALL_METRICS)}, is_best boolean")


# I: reports


@query("i1_over_seeds", f"WITH {RES} SELECT model, dataset, metric, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(CASE WHEN metric = 'aaf' THEN min(value) ELSE max(value) END, 6) AS best, count(*) AS seeds FROM res GROUP BY 1, 2, 3")
def _(spark, d):
    return report.over_seeds(results(spark, d)).select("model", "dataset", "metric", *r6("mean", "std", "best"), "seeds")


@query("i2_ranked_trials", f"WITH {RES}, t AS (SELECT model AS trial, dataset, avg(CASE WHEN metric = 'alarm_score' THEN value END) AS alarm_score, avg(CASE WHEN metric = 'aaf' AND model <> 'view' THEN value END) AS aaf, count(DISTINCT seed) AS seeds FROM res GROUP BY 1, 2) SELECT trial, dataset, round(alarm_score, 6) AS alarm_score, row_number() OVER (PARTITION BY dataset ORDER BY alarm_score DESC, aaf ASC NULLS LAST, trial) AS place FROM t WHERE seeds >= 2")
def _(spark, d):
    m = lambda name, more=F.lit(True): F.avg(F.when((F.col("metric") == name) & more, F.col("value")))
    trials = results(spark, d).groupBy(F.col("model").alias("trial"), "dataset").agg(m("alarm_score").alias("alarm_score"), F.avg(F.when((F.col("metric") == "aaf") & (F.col("model") != "view"), F.col("value"))).alias("aaf"), F.countDistinct("seed").alias("seeds"), F.lit(0).alias("time"))
    return report.ranked_trials(trials, 2).select("trial", "dataset", *r6("alarm_score"), "place")


@query("i3_best_seed", f"WITH {RES} SELECT model, dataset, seed, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY model, dataset ORDER BY value DESC, seed) AS n FROM res WHERE metric = 'alarm_score') WHERE n = 1")
def _(spark, d):
    return report.best_seed(results(spark, d), "alarm_score").select("model", "dataset", "seed", *r6("value"))


@query("i4_leaderboard", f"WITH {RES} SELECT model, " + ", ".join(f"round(avg(CASE WHEN dataset = 'd{i}' AND metric = '{m}' THEN value END), 6) AS d{i}_{m}" for i in range(4) for m in ("alarm_score", "aaf")) + " FROM res GROUP BY 1")
def _(spark, d):
    names = [f"d{i}_{m}" for i in range(4) for m in ("alarm_score", "aaf")]
    return report.leaderboard(report.over_seeds(results(spark, d)), names).select("model", *r6(*names))


@query("i5_extrema", f"WITH {RES}, s AS (SELECT model, dataset, metric, avg(value) AS mean FROM res GROUP BY 1, 2, 3) SELECT model, dataset, metric, mean = CASE WHEN metric = 'aaf' THEN min(mean) OVER w ELSE max(mean) OVER w END AS is_best FROM s WINDOW w AS (PARTITION BY dataset, metric)")
def _(spark, d):
    return report.mark_extrema(report.over_seeds(results(spark, d))).select("model", "dataset", "metric", "is_best")


@query("i6_migrated_labels", f"WITH {RES} SELECT model, 'theory_best_alarm' AS metric, count(*) AS n FROM (SELECT DISTINCT model, dataset FROM res) GROUP BY 1 UNION ALL SELECT model, 'aaf', count(*) FROM res WHERE metric = 'aaf' GROUP BY 1")
def _(spark, d):
    r = results(spark, d).withColumn("metric", F.when(F.col("metric") == "alarm_score", "upper_bound_alarm").otherwise(F.col("metric")))
    return report.migrated_labels(r).groupBy("model", "metric").agg(F.count("*").alias("n"))


@query("i9_top_models", f"WITH {RES}, s AS (SELECT model, dataset, avg(value) AS mean FROM res WHERE metric = 'alarm_score' GROUP BY 1, 2) SELECT dataset, model, place FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY mean DESC, model) AS place FROM s) WHERE place <= 2")
def _(spark, d):
    return report.top_models(report.over_seeds(results(spark, d)).where("metric = 'alarm_score'"), 2).select("dataset", "model", "place")


@query("i13_around_first_event", f"WITH {EV}, f AS (SELECT sequence_id, min(t) AS a FROM ev WHERE label = 1 GROUP BY 1), z AS (SELECT e.sequence_id, min(e.t) AS b FROM ev e JOIN f ON e.sequence_id = f.sequence_id AND e.t > a AND label = 0 GROUP BY 1), n AS (SELECT sequence_id, max(t) + 1 AS n FROM ev GROUP BY 1) SELECT e.sequence_id, count(*) AS n FROM ev e JOIN f USING (sequence_id) LEFT JOIN z USING (sequence_id) JOIN n USING (sequence_id) WHERE t >= a - 5 AND t < coalesce(b, n) + 5 GROUP BY 1")
def _(spark, d):
    e = ev(spark, d)
    return report.around_first_event(e, alarms.segments(e, "label"), 5).groupBy("sequence_id").agg(F.count("*").alias("n"))


@query("i14_channel_effects", f"WITH {LI}, {CELLS.replace('AS value FROM li', 'AS value, label FROM li')}, q AS (SELECT feature, abs(median(value) FILTER (label = 1) - median(value) FILTER (label = 0)) / (quantile_cont(value, 0.75) FILTER (label = 0) - quantile_cont(value, 0.25) FILTER (label = 0)) AS effect FROM cells GROUP BY 1) SELECT feature, round(effect, 6) AS effect, row_number() OVER (ORDER BY effect DESC, feature) AS place FROM q QUALIFY place <= 3")
def _(spark, d):
    return report.channel_effects(li(spark, d), FEATURES, 3).select("feature", *r6("effect"), "place")


def stated(spark, d):
    """Result files as text, in the layout with percentages; one model has no number and one is unknown."""
    r = results(spark, d).where("metric = 'alarm_score'").groupBy("model", "dataset").agg(F.round(F.avg("value"), 3).alias("v"))
    mean = F.when(F.col("model") == "view", "n/a").otherwise(F.col("v").cast("string"))
    return r.select("model", "dataset", mean.alias("normalized_alarm_score_pct_mean"), F.lit("0.5").alias("normalized_alarm_score_pct_std"))


@query(
    "i7_checked_results",
    f"WITH {RES} SELECT model, dataset, CASE WHEN model <> 'view' THEN round(avg(value), 3) END AS mean, CASE WHEN model <> 'view' THEN 0.5 END AS std, CASE WHEN model <> 'view' THEN 'complete' ELSE 'missing' END AS status FROM res WHERE metric = 'alarm_score' AND model <> 'click' GROUP BY 1, 2",
)
def _(spark, d):
    r = results(spark, d)
    return report.checked_results(report.one_layout(stated(spark, d)), r.where("model <> 'click'").select("model"), r.select("dataset"))


@query("i8_one_layout", f"WITH {RES} SELECT model, count(*) AS n, count(*) FILTER (model = 'view') AS not_numbers FROM (SELECT DISTINCT model, dataset FROM res) GROUP BY 1")
def _(spark, d):
    rows = report.one_layout(stated(spark, d))
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.count(F.when(F.col("mean").try_cast("double").isNull(), 1)).alias("not_numbers"))


@query("i10_pair_summaries", f"WITH {RES} SELECT model, dataset, round(avg(value) FILTER (metric = 'aaf'), 6) AS aaf, round(avg(value) FILTER (metric = 'alarm_score'), 6) AS alarm_score, count(*) FILTER (metric = 'aaf') AS seeds, round(arg_min(value, seed) FILTER (metric = 'aaf'), 5) AS first_seed FROM res GROUP BY 1, 2")
def _(spark, d):
    s = report.pair_summaries(results(spark, d)).withColumn("v", F.from_json("seeds", "map<string, array<double>>"))
    return s.select("model", "dataset", *(F.round(F.col("means")[m], 6).alias(m) for m in ("aaf", "alarm_score")), F.size(F.col("v")["aaf"]).cast("long").alias("seeds"), F.round(F.col("v")["aaf"][0], 5).alias("first_seed"))


@query("i15_search_grid", f"WITH {EV} SELECT a AS width, b AS span, (SELECT count(*) FROM ev WHERE t >= a * b) AS n FROM range(1, 6, 2) x(a), range(2, 9, 3) y(b)")
def _(spark, d):
    grid = report.search_grid(spark, width=(1, 5, 2), span=(2, 8, 3))
    at = ev(spark, d).groupBy("t").agg(F.count("*").alias("m"))
    return grid.join(at, F.col("t") >= F.col("width") * F.col("span"), "left").groupBy("width", "span").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"))


# J: streams, K: SQL


@query("j7_windowed_summary", "SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type AS kind, count(*) AS n, round(avg(value), 5) AS mean_score, max(value) AS max_score FROM events GROUP BY 1, 2")
def _(spark, d):
    return stream.windowed_summary(ev(spark, d), "1 day").withColumn("mean_score", F.round("mean_score", 5))


def by_time(spark, d):
    """The events as a stream that comes in three parts, one after the other in event time."""
    folder, rows = shared_folder(spark), ev(spark, d).select("sequence_id", "kind", F.col("ts").cast("timestamp").alias("ts"), "score")
    bounds = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(*(F.timestamp_seconds(F.unix_seconds("a") + (F.unix_seconds("b") - F.unix_seconds("a")) * k / 3).alias(f"b{k}") for k in (1, 2))).first()
    part = F.when(F.col("ts") < F.lit(bounds["b1"]), 0).when(F.col("ts") < F.lit(bounds["b2"]), 1).otherwise(2)
    for k in range(3):
        rows.where(part == k).repartition(4).write.mode("append").parquet(f"{folder}/in")
    return stream.event_stream(spark, f"{folder}/in", rows.schema), folder


def summarised(spark, d, summary):
    """What has come out once all events are in: whatever ends before the newest event, less the hour that rows may be late."""
    rows, folder = by_time(spark, d)
    out = stream.run_to_table(summary(rows), f"{folder}/out", f"{folder}/checkpoint")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end") if c in out.columns})


SEEN = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query("j7_tumbling", f"SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type AS kind, count(*) AS n, round(sum(value), 2) AS sum_score, max(value) AS max_score FROM events GROUP BY 1, 2 HAVING start + INTERVAL 1 DAY <= {SEEN}")
def _(spark, d):
    return summarised(spark, d, lambda rows: stream.windowed_summary(rows, "1 day")).withColumn("sum_score", F.round(F.col("mean_score") * F.col("n"), 2)).drop("mean_score")


@query("j7_sliding", f"SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR * k AS start, event_type AS kind, count(*) AS n, round(sum(value), 2) AS sum_score, max(value) AS max_score FROM events, range(4) r(k) GROUP BY 1, 2 HAVING start + INTERVAL 1 DAY <= {SEEN}")
def _(spark, d):
    return summarised(spark, d, lambda rows: stream.windowed_summary(rows, "1 day", "6 hours")).withColumn("sum_score", F.round(F.col("mean_score") * F.col("n"), 2)).drop("mean_score")


@query(
    "j7_sessions",
    f"""WITH a AS (SELECT user_id, ts, value, coalesce(ts - lag(ts) OVER w > INTERVAL 1 DAY, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM a)
SELECT user_id AS sequence_id, min(ts) AS start, max(ts) + INTERVAL 1 DAY AS end, count(*) AS n, max(value) AS max_score FROM b GROUP BY user_id, session HAVING max(ts) + INTERVAL 1 DAY <= {SEEN}""",
)
def _(spark, d):
    return summarised(spark, d, lambda rows: stream.session_summary(rows, "1 day"))


@query(
    "j6_online_alarms",
    f"""WITH {EV}, {DECIDED}, h AS (SELECT *, CASE WHEN decision IS NOT NULL AND lag(decision) OVER w IS NOT NULL THEN CASE WHEN least(decision, lag(decision) OVER w) >= 300 THEN 1 WHEN greatest(decision, lag(decision) OVER w) < 150 THEN 0 END END AS e FROM de WINDOW w AS (PARTITION BY sequence_id, stretch, s IS NULL ORDER BY t))
SELECT sequence_id, t, round(decision, 5) AS decision, CAST(s IS NOT NULL AND (coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY sequence_id, stretch, s IS NULL ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 OR coalesce(max(CASE WHEN e = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY sequence_id, stretch, s IS NULL ORDER BY t ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), 0) = 1) AS INT) AS pred FROM h""",
)
def _(spark, d):
    """As a stream in three parts that are out of order, with holes in the scores."""
    rows, folder = arriving(spark, d, gapped(spark, d))
    out = stream.online_alarms(rows, 4, 3, 300.0, 150.0, 2, 2)
    return stream.run_to_table(out, f"{folder}/out", f"{folder}/checkpoint").where("not late").select("sequence_id", "t", F.round("decision", 5).alias("decision"), "pred")


@query("j1_scored_windows", f"WITH {LI} SELECT sequence_id, t AS t_end, round(avg(quantity) OVER {F8} - avg(tax) OVER {F8}, 5) AS score FROM li QUALIFY count(*) OVER {F8} = 8")
def _(spark, d):
    windows = wd.sliding_windows(li(spark, d), ["quantity", "tax"], 8)
    return stream.scored_windows(windows, lambda w: (w[:, :, 0] - w[:, :, 1]).mean(axis=1), ["sequence_id", "t_end"], 1000).select("sequence_id", "t_end", F.round("score", 5).alias("score"))


def arriving(spark, d, series=None):
    """The events as a stream that comes in three parts, each with rows from all over the sequences; last marks the end of a sequence."""
    folder = shared_folder(spark)
    n = F.count("*").over(Window.partitionBy(*KEYS))
    rows = staged((ev(spark, d) if series is None else series).select("sequence_id", "t", "score", (F.col("t") == n - 1).alias("last")))  # put in order once, not for each part
    for part in range(3):
        rows.where(F.pmod(F.xxhash64("sequence_id", "t"), F.lit(3)) == part).write.mode("append").parquet(f"{folder}/in")
    files = len(spark.read.schema(rows.schema).parquet(f"{folder}/in").inputFiles())
    return stream.event_stream(spark, f"{folder}/in", rows.schema, max(1, -(-files // 3))), folder  # a batch is a part, whatever its files


@query("j2_causal_scores", f"WITH {EV} SELECT sequence_id, t, round(score - (sum(score) OVER f + (5 - count(*) OVER f) * first_value(score) OVER ({W})) / 5, 5) + 0.0 AS score FROM ev WINDOW f AS ({W} ROWS 4 PRECEDING)")
def _(spark, d):
    rows, folder = arriving(spark, d)
    out = stream.causal_scores(rows, ["score"], 5, lambda w: w[:, -1, 0] - w[:, :, 0].mean(axis=1))
    return stream.run_to_table(out, f"{folder}/out", f"{folder}/checkpoint").where("not late").select("sequence_id", "t", (F.round("score", 5) + F.lit(0.0)).alias("score"))  # no -0


@query(
    "j3_patch_scores",
    f"""WITH {EV}, p AS (SELECT *, CASE WHEN t % 2 = 0 AND count(*) OVER f = 6 THEN avg(score) OVER f END AS s, count(*) OVER (PARTITION BY run_key, sequence_id) AS n FROM ev WINDOW f AS ({W} ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING))
SELECT sequence_id, t, round(CASE WHEN n < 6 THEN (sum(score) OVER a + (6 - n) * first_value(score) OVER ({W})) / 6 ELSE avg(s) OVER ({W} ROWS 5 PRECEDING) END, 4) AS score FROM p WINDOW a AS (PARTITION BY run_key, sequence_id)""",
)
def _(spark, d):
    rows, folder = arriving(spark, d)
    out = stream.patch_scores(rows, ["score"], 6, 2, lambda p: p[:, :, 0].mean(axis=1))
    return stream.run_to_table(out, f"{folder}/out", f"{folder}/checkpoint").where("not late").select("sequence_id", "t", F.round("score", 4).alias("score"))


BY_SEQUENCE = """q AS (SELECT sequence_id, sum(pred * (1 - label)) AS fp, sum(pred * p0 * label * (1 - y0)) AS early, sum(pred * p0 * y0 * (1 - label)) AS late FROM k GROUP BY 1),
c AS (SELECT sequence_id, count(*) AS n, avg((1 + w) * pow(2.0, -alarms)) AS nominal FROM e JOIN cr USING (sequence_id, k) GROUP BY 1), z AS (SELECT sequence_id, count(*) AS n FROM ru WHERE k IS NULL GROUP BY 1)"""


@query("k2_alarm_score_agg", f"{METRIC}, {BY_SEQUENCE} SELECT sequence_id, round(coalesce(c.n, 0) - coalesce(z.n, 0) / 2.0 - CASE WHEN fp > 0 THEN 1 - 1.0 / fp ELSE 0 END + coalesce(nominal, 0) - 0.75 * early - 0.25 * late, 6) AS alarm_score FROM q LEFT JOIN c USING (sequence_id) LEFT JOIN z USING (sequence_id)")
def _(spark, d):
    register(spark)
    alarms.predict(ev(spark, d), 150.0).createOrReplaceTempView("tideglass_predictions")
    return spark.sql("SELECT sequence_id, round(alarm_score_agg(t, pred, label), 6) AS alarm_score FROM tideglass_predictions GROUP BY sequence_id")


@query("k4_event_segments", f"WITH {EV}, {PRED}, {RUNS} SELECT sequence_id, min(t) AS start_t, max(t) + 1 AS end_t FROM i WHERE pred = 1 GROUP BY sequence_id, run")
def _(spark, d):
    register(spark)
    alarms.predict(ev(spark, d), 150.0).select("sequence_id", "t", F.col("pred").alias("mask")).createOrReplaceTempView("tideglass_masks")
    return spark.sql("SELECT * FROM event_segments(TABLE(tideglass_masks) PARTITION BY sequence_id ORDER BY t)")
