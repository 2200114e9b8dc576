"""Streaming operators run to completion over small files."""

import time

from tilewright.streaming import samples


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return df.sparkSession.table(name).collect()


def test_tail(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" one \n\ntwo\n   \n")
    assert sorted(r.value for r in run(samples.tail_lines(spark, str(tmp_path)), "tail")) == ["one", "two"]


def test_idle(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("a", 0, float(t), int(t < 5), 0) for t in range(60)] + [("b", 0, float(t), 1, 0) for t in range(20)] + [("c", 0, 900_001.0, 1, 1)]
    spark.createDataFrame(rows, "codec string, rep int, t double, pending int, processing int").coalesce(1).write.json(str(tmp_path / "in"))
    frames = spark.readStream.schema("codec string, rep int, t double, pending int, processing int").json(str(tmp_path / "in"))
    assert sorted(tuple(r) for r in run(samples.detect_loaded(frames), "idle")) == [("a", 0, 34.0, "loaded"), ("c", 0, 900_001.0, "timeout")]


def test_idle_times_out_without_frames(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "codec string, rep int, t double, pending int, processing int"
    spark.createDataFrame([("a", 0, 10.0, 1, 0)], schema).coalesce(1).write.json(str(tmp_path / "in"))
    frames = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    q = samples.detect_loaded(frames, timeout_ms=1500.0, live=True).writeStream.format("memory").queryName("stops").outputMode("append").trigger(processingTime="1 second").start()
    found = []
    for _ in range(60):
        time.sleep(1)
        found = [tuple(r) for r in spark.table("stops").collect()]
        if found or not q.isActive:
            break
    assert q.exception() is None
    q.stop()
    assert found == [("a", 0, 1500.0, "timeout")]


def test_timers(spark, tmp_path):
    spark.sql(
        "SELECT query, t, TIMESTAMP '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,query) AS at FROM VALUES (1, 10.4D), (2, 20.6D) AS v(query, t)"
    ).write.parquet(str(tmp_path / "s"))
    spark.sql(
        "SELECT query, ns, query = 2 AS disjoint, TIMESTAMP '2024-01-01 00:01:00' AS at FROM VALUES (1, 1500000L), (2, 3L) AS v(query, ns)"
    ).write.parquet(str(tmp_path / "e"))
    read = lambda n: spark.readStream.schema(spark.read.parquet(str(tmp_path / n)).schema).parquet(str(tmp_path / n))
    assert [tuple(r) for r in run(samples.timer_results(read("s"), read("e")), "timers")] == [(1, 10.0, 1.5)]
