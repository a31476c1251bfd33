import datetime as dt
import time

from pyspark.sql import functions as F

from marlstone.operators import metrics
from marlstone.operators.incremental import VersionedTable
from marlstone.streaming import jobs


def at(s):
    return dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)


def series(spark, *data):
    return spark.createDataFrame([("s", at(t), float(v)) for t, v in data], "k string, ts timestamp, value double")


def test_counters_reset(spark):
    df = metrics.increments(series(spark, (0, 5), (10, 8), (20, 2), (30, 4)), ["k"])
    assert [r.increase for r in df.orderBy("ts").collect()] == [0.0, 3.0, 2.0, 2.0]


def test_rolling_window_is_half_open(spark):
    df = metrics.rolling_rate(series(spark, (0, 1), (299, 1), (300, 1), (301, 1)), ["k"], 300)
    assert [r.in_window for r in df.orderBy("ts").collect()] == [1, 2, 2, 3]


def test_histogram_quantiles(spark):
    df = series(spark, *[(i, v) for i, v in enumerate([0.5, 1.5, 1.5, 3.0])])
    h = metrics.histogram(df, ["k"], [1.0, 2.0])
    assert [(r.le, r["count"]) for r in h.orderBy("le").collect()] == [(1.0, 1), (2.0, 3), (float("inf"), 4)]
    assert metrics.histogram_quantile(h, ["k"], 0.5).first().value == 1.5
    assert metrics.histogram_quantile(h, ["k"], 0.99).first().value == 2.0
    none = metrics.histogram(df.withColumn("value", F.lit(None).cast("double")), ["k"], [1.0])
    assert metrics.histogram_quantile(none, ["k"], 0.5).first().value is None


def test_alerts_need_the_whole_time(spark):
    df = metrics.held_for(series(spark, (0, 9), (60, 9), (120, 1), (180, 9), (240, 9)), ["k"], F.col("value") > 5, 60)
    assert [r.firing for r in df.orderBy("ts").collect()] == [False, True, False, False, True]


def test_stalled(spark):
    traffic = spark.createDataFrame([(1, 0), (2, 0), (3, 5)], "ts int, increase int")
    up = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "ts int, up int")
    assert [r.ts for r in metrics.stalled(traffic, up).collect()] == [1]


def test_gauges(spark):
    assert metrics.gauges(series(spark, (0, 1), (5, 7)), ["k"]).first().value == 7.0


def write(spark, path, name, *rows):
    spark.createDataFrame(list(rows), "event_id long, user_id string, ts timestamp").coalesce(1).write.parquet(f"{path}/{name}")


def stream(spark, path):
    return spark.readStream.schema("event_id long, user_id string, ts timestamp").parquet(f"{path}/*")


def test_stream_into_a_table_once(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t", "event_id long, user_id string, ts timestamp")
    for n in range(2):
        write(spark, tmp_path / "in", f"f{n}", (n, "u", at(n)))
        jobs.ingest_stream(stream(spark, tmp_path / "in"), table, "feed", f"{tmp_path}/ck").awaitTermination()
    assert sorted(r.event_id for r in table.read().collect()) == [0, 1]
    # a batch that was committed before is passed over
    jobs.ingest_stream(stream(spark, tmp_path / "in"), table, "feed", f"{tmp_path}/ck2").awaitTermination()
    assert table.read().count() == 2


def test_windows_and_late_rows(spark, tmp_path):
    write(spark, tmp_path / "in", "a", (1, "u", at(0)), (2, "u", at(10)), (3, "u", at(7200)))
    out = jobs.windowed_counts(stream(spark, tmp_path / "in"), ["user_id"])
    out.writeStream.format("memory").queryName("win").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert [r.total for r in spark.table("win").collect()] == [2]


def test_redelivered_events(spark, tmp_path):
    write(spark, tmp_path / "in", "a", (1, "u", at(0)), (1, "u", at(0)), (2, "u", at(1)))
    out = jobs.distinct_events(stream(spark, tmp_path / "in"), "event_id", ts="ts")
    out.writeStream.format("memory").queryName("dis").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.event_id for r in spark.table("dis").collect()) == [1, 2]


def test_stability_over_polls(spark, tmp_path):
    kind = "user_id string, path string, content_hash string"
    for n, h in enumerate(["1", "2", "2", "2"]):
        spark.createDataFrame([("u", "p", h)], kind).coalesce(1).write.parquet(f"{tmp_path}/in/f{n}")
        seen = spark.readStream.schema(kind).parquet(f"{tmp_path}/in/*")
        jobs.stable_files(seen).writeStream.format("json").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.read.schema(kind).json(f"{tmp_path}/out").collect()] == [("u", "p", "2")]


def test_poll_ticks(spark, tmp_path):
    seen = []
    q = jobs.poll(spark, seen.append, "100 milliseconds", f"{tmp_path}/ck")
    try:
        for _ in range(100):
            if len(seen) > 1:
                break
            time.sleep(0.1)
    finally:
        q.stop()
    assert len(seen) > 1 and q.exception() is None


def test_exposition_and_selectors(spark):
    df = spark.createDataFrame([('a"b', 3), (None, 1)], "user_id string, total long")
    assert [r.line for r in metrics.exposition(df, "searches_total", "counter", ["user_id"], "total").collect()] == ["# TYPE searches_total counter", 'searches_total{user_id="a\\"b"} 3', 'searches_total{user_id=""} 1']
    assert metrics.matching(df, "user_id", "a.*").count() == 1
    assert metrics.any_of(df, F.col("total") > 2).first()[0] is True and metrics.any_of(df.limit(0), F.col("total") > 2).first()[0] is False
    assert df.select(metrics.clamp_max(F.col("total"), 2.0)).first()[0] == 2.0
    assert series(spark, (0, 1)).select(metrics.uptime("ts", F.lit(at(90)))).first()[0] == 90.0
