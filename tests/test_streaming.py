import datetime

from pyspark.sql import functions as F

from chronoloom.operators import state
from chronoloom.operators.fold import ordered_fold
from chronoloom.streaming import windows as W
from chronoloom.streaming.stateful import stream_fold
from tests.conftest import rows


def test_closed_windows_equal_batch(spark, data, tmp_path):
    batch = spark.read.parquet(f"{data}/events.parquet")
    src = str(tmp_path / "in")
    batch.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(src)
    # A last row far ahead closes every window of the real rows.
    ahead = batch.limit(1).withColumn("ts", F.lit(datetime.datetime(2030, 1, 1)).cast("timestamp_ntz"))
    ahead.coalesce(1).write.mode("append").parquet(src)
    total = dict(n=F.count(F.lit(1)), total=F.round(F.sum("value"), 4))
    make = {
        "moments": lambda s: W.moments(s, ["event_type"], "ts", "1 hour", **total),
        "sliding": lambda s: W.sliding(s, ["event_type"], "ts", "2 hours", "1 hour", **total),
        "sessions": lambda s: W.sessions(s, ["user_id"], "ts", "30 minutes", **total),
    }
    for name, f in make.items():
        stream = W.event_time(W.table_stream(spark, src, batch.schema), "ts", "45 days")
        q = W.run_to_table(f(stream), str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-ck"))
        q.awaitTermination(120)
        assert W.progress_table(q)
        # The closing row's own window stays open.
        got = spark.read.parquet(str(tmp_path / f"{name}-out"))
        want = f(batch.withColumn("ts", F.col("ts").cast("timestamp")))
        assert rows(got) == rows(want.select(*got.columns))


def test_stream_fold_equals_batch_fold(spark, tmp_path):
    data = [("a", t, float(x), float(y)) for t, x, y in ((0, 0, 0), (100, 50, 0), (500, 50, 0), (900, 90, 0), (1400, 90, 1))] + [("b", 0, 1.0, 1.0), ("b", 1000, 9.0, 9.0)]
    df = spark.createDataFrame(data, "k string, t_ms bigint, x double, y double")
    src = str(tmp_path / "in")
    for lo, hi in ((0, 400), (400, 1000), (1000, 9000)):
        df.filter(f"t_ms >= {lo} and t_ms < {hi}").coalesce(1).write.mode("append").parquet(src)
    for name, fold in (("throttle", state.throttle_fold()), ("tracks", state.track_fold())):
        rows_in = df if name == "throttle" else df.withColumn("conf", F.lit(0.5))
        stream = W.table_stream(spark, src, df.schema, files_per_trigger=1)
        stream = stream if name == "throttle" else stream.withColumn("conf", F.lit(0.5))
        q = W.run_to_table(stream_fold(stream, ["k"], ["t_ms"], fold), str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-ck"))
        q.awaitTermination(120)
        assert rows(spark.read.parquet(str(tmp_path / f"{name}-out"))) == rows(ordered_fold(rows_in, ["k"], ["t_ms"], fold))


def test_band_pairs_and_dedup(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    at = lambda s: t0 + datetime.timedelta(seconds=s)
    df = spark.createDataFrame([("k", "l", at(0), 1), ("k", "r", at(3), 2), ("k", "r", at(9), 3), ("k", "l", at(0), 1), ("k", "l", at(10), 4)], "k string, side string, ts timestamp, id bigint")
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)
    s = W.distinct_records(W.event_time(W.table_stream(spark, src, df.schema), "ts", "1 minute"), ["id"])
    q = W.run_to_table(s, str(tmp_path / "d"), str(tmp_path / "dck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "d")).count() == 4
    side = lambda x: W.event_time(W.table_stream(spark, src, df.schema), "ts", "1 minute").filter(F.col("side") == x)
    seen = []
    q = W.run_each(W.band_pairs(side("l"), side("r"), ["k"], "ts", "ts", "4 seconds"), lambda b, i: seen.extend((r["l_id"], r["r_id"]) for r in b.collect()), str(tmp_path / "pck"))
    q.awaitTermination(60)
    assert set(seen) == {(1, 2), (4, 3)}
