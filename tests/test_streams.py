"""Streams out of order: late rows, gaps, restarts, idle sequences, and counts of what the watermark drops."""

import random

import pytest
from pyspark.sql import Row, functions as F

from tideglass import catalog
from tideglass.operators import alarms
from tideglass.streaming import alarms as stream
from tideglass.streaming.ordered import InOrder, Lateness

KIND = "sequence_id long, t long, score double, last boolean, ts timestamp"
SOON = Lateness("10 seconds", "100 seconds", "1000 seconds")


class Feed:
    """A folder of files, one for each batch, and a run of a query over what is there."""

    def __init__(self, spark, path, make):
        self.spark, self.path, self.make, self.n = spark, path, make, 0

    def add(self, rows):
        df = self.spark.createDataFrame([(s, t, x, last, at) for s, t, x, last, at in rows], "sequence_id long, t long, score double, last boolean, at long")
        df.select("sequence_id", "t", "score", "last", F.timestamp_seconds(F.col("at") + 1_700_000_000).alias("ts")).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        return self

    def run(self):
        read = self.spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")
        out = stream.run_to_table(self.make(read), f"{self.path}/out", f"{self.path}/checkpoint")
        return sorted(tuple(r) for r in out.select("sequence_id", "t", "late", "score").collect())


def causal(lateness):
    return lambda rows: stream.causal_scores(rows, ["score"], 2, lambda w: w.mean(axis=(1, 2)), lateness)


def row(s, t, last=False):
    return (s, t, float(t), last, t)


def test_rows_wait_for_a_gap_and_late_ones_are_set_aside(spark, tmp_path):
    feed = Feed(spark, tmp_path, causal(SOON))
    feed.add([row(1, 1), row(1, 3), row(2, 0)]).add([row(1, 0)])  # 3 waits for 2
    assert [r[:3] for r in feed.run()] == [(1, 0, False), (1, 1, False), (2, 0, False)]
    feed.add([row(2, 30)])  # time goes on: 3 has waited long enough
    assert [r[:3] for r in feed.run()] == [(1, 0, False), (1, 1, False), (1, 3, False), (2, 0, False)]
    feed.add([row(1, 2), row(1, 4), row(1, 4)])  # 2 is too late now, and 4 is there twice
    got = feed.run()  # from the checkpoint, with a late row in the batch
    assert [r[:3] for r in got] == [(1, 0, False), (1, 1, False), (1, 2, True), (1, 3, False), (1, 4, False), (1, 4, True), (2, 0, False)]
    assert [r[3] for r in got] == [0.0, 0.5, None, 2.0, 3.5, None, 0.0]
    feed.add([row(1, 5, True)]).add([row(1, 6)]).add([row(3, 200)])
    got = feed.run()
    assert (1, 5, False, 4.5) in got and (1, 6, True, None) in got  # after the last row
    assert (2, 30, False, 15.0) in got and (3, 200, False, 200.0) not in got


def test_an_idle_sequence_ends_and_starts_anew(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda rows: stream.patch_scores(rows, ["score"], 3, 1, lambda p: p[:, :, 0].mean(axis=1), SOON))
    feed.add([row(1, 0), row(1, 1)])
    assert feed.run() == []
    feed.add([row(2, 5000)]).add([row(2, 5001)])
    got = feed.run()
    assert [(r[:3], r[3]) for r in got if r[0] == 1] == [((1, 0, False), pytest.approx(1 / 3)), ((1, 1, False), pytest.approx(1 / 3))]


def test_online_alarms_of_shuffled_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = [(s, t, rng.choice([0.1, 0.4, 0.9, 1.5, None]), t == n - 1, t) for s, n in enumerate((1, 7, 40, 55)) for t in range(n)]
    mixed = rows[:]
    rng.shuffle(mixed)
    feed = Feed(spark, tmp_path, lambda r: stream.online_alarms(r, 3, 3, 1.0, 0.5, 2, 2, Lateness("100 seconds", "200 seconds")))
    for i in range(0, len(mixed), 26):
        feed.add(mixed[i : i + 26])
    feed.run()
    df = spark.createDataFrame([("r", s, t, x) for s, t, x, _, _ in rows], "run_key string, sequence_id long, t long, score double")
    want = alarms.hysteresis(alarms.decision_scores(df, 3, 3), 1.0, 0.5, 2, 2)
    got = spark.read.parquet(f"{tmp_path}/out").where("not late")
    assert sorted((r.sequence_id, r.t, r.pred) for r in got.collect()) == sorted((r.sequence_id, r.t, r.pred) for r in want.collect())


def test_rows_that_the_watermark_drops_are_counted(spark, tmp_path):
    dropped = stream.DroppedRows()
    kind = "kind string, ts timestamp, score double"
    for hours in ([0, 1, 2], [80, 81], [82], [3, 83, 30, 4], [200]):
        rows = spark.createDataFrame([("a", h * 3600, float(h)) for h in hours], "kind string, at long, score double")
        rows.select("kind", F.timestamp_seconds(F.col("at") + 1_699_920_000).alias("ts"), "score").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = stream.run_to_table(stream.windowed_summary(read, "1 day"), f"{tmp_path}/out", f"{tmp_path}/checkpoint", dropped)
    assert sorted((r.n, r.max_score) for r in out.collect()) == [(3, 2.0), (4, 83.0)]
    assert list(dropped.rows.values()) == [2]  # 3 and 4 are one partial sum, 30 another


def test_waiting_longer_than_rows_are_set_aside_is_an_error():
    with pytest.raises(ValueError):
        Lateness("2 hours", "1 hour").ms()


class Counted:
    """A handle that counts what a processor asks of its state."""

    def __init__(self):
        self.calls, self.value = [], None

    def getValueState(self, name, schema):
        return self

    def getListState(self, name, schema):
        return self

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    put = update

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def registerTimer(self, at):
        self.calls.append("register")

    def deleteTimer(self, at):
        self.calls.append("delete")

    def getCurrentWatermarkInMs(self):
        return 0


def test_a_batch_takes_one_read_and_one_write_of_a_sequence():
    """Each is a round trip; with most sequences bringing a few rows a batch, they and tables for each sequence were what online alarms took their time for."""
    handle, seen = Counted(), []

    def advance(held, t, x, over):
        seen.append((held, t, x))
        return {"t": t, "score": [v[0] for v in x]}, (held[0] + len(t) if held else len(t),)

    p = InOrder(advance, "n long", {"score": "double"}, Lateness())
    p.init(handle)
    rows = lambda *ts: iter([Row(sequence_id=1, ts=None, v=[float(t), 1e12 + t, 0.0, t / 2]) for t in ts])
    out = [r for ts in ((2, 0), (1, 5), (3, 3)) for r in p.handleInputRows((1,), rows(*ts), handle)]
    assert [(r.t, r.score, r.late) for r in out] == [([0], [0.0], [False]), ([1, 2], [0.5, 1.0], [False, False]), ([3, 3], [None, 1.5], [True, False])]
    assert seen == [(None, [0], [[0.0]]), ((1,), [1, 2], [[0.5], [1.0]]), ((3,), [3], [[1.5]])]
    assert handle.calls == ["get", "register", "update", "get", "update", "get", "update"]


def test_a_stream_in_three_parts_is_three_batches(spark, small_dir):
    rows, folder = catalog.arriving(spark, small_dir)
    query = rows.writeStream.format("noop").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [p.batchId for p in query.recentProgress if p.numInputRows] == [0, 1, 2]
    assert sum(p.numInputRows for p in query.recentProgress) == spark.read.parquet(f"{small_dir}/events.parquet").count()
