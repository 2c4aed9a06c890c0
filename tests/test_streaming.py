"""Streams that read everything available give what batch queries give."""

import pytest
from pyspark.sql import functions as F

import scenario
from flowloom.config import DetectorConfig
from flowloom.operators import detectors, folds, series
from flowloom.sources import pcap, projection
from flowloom.streaming import sinks, stateful

SCAN, FLOOD = DetectorConfig(scan_ports=5), DetectorConfig(flood_rate=1.5)
#: A packet long after all others, which closes every second before it.
LATE = 3_600_000_000


@pytest.fixture(scope="module")
def packets(spark, sf):
    return projection.packets(spark, sf, holes=True).cache()


def streamed(spark, df, tmp_path, build, name):
    """``df`` in four files by time, read as a stream one file a trigger; a last file moves the clock on."""
    path = f"{tmp_path}/{name}"
    span = df.agg(F.min("ts_usec").alias("a"), F.max("ts_usec").alias("b")).first()
    part = F.floor((F.col("ts_usec") - span.a) * 4 / (span.b - span.a + 1))
    for k in range(4):
        df.where(part == k).coalesce(1).write.mode("append").parquet(path)
    df.limit(1).withColumn("ts_usec", F.lit(span.b + LATE)).coalesce(1).write.mode("append").parquet(path)
    df.limit(1).withColumn("ts_usec", F.lit(span.b + 2 * LATE)).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = build(source).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name), span.b


def test_port_scans(spark, packets, tmp_path):
    tries = packets.where("flags = 2").select("ts_usec", "src", "dst", "dport")
    got, _ = streamed(spark, tries, tmp_path, lambda s: stateful.port_scans(s, SCAN), "scans")
    want = detectors.port_scans(tries, SCAN)
    columns = ["src", "dst", "tick", "n_ports", "first_ts", "last_ts"]
    rows = sorted(map(tuple, want.select(columns).collect()))
    assert rows and sorted(map(tuple, got.select(columns).collect())) == rows


def test_syn_floods(spark, packets, tmp_path):
    rows = packets.where("flags = 2 or (flags = 24 and event_id % 10 = 0)").select("ts_usec", "dst", F.col("svc_port").alias("dport"), (F.col("flags") == 24).alias("completed"))
    got, _ = streamed(spark, rows, tmp_path, lambda s: stateful.syn_floods(s, FLOOD), "floods")
    want = detectors.syn_floods(rows.where("not completed"), rows.where("completed"), FLOOD)
    columns = ["dst", "dport", "tick", "attempts", "completed", "busy"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_cooldown_and_seconds(spark, packets, tmp_path):
    events = packets.where("flags = 2").select("src", "dst", "ts_usec")
    got, last = streamed(spark, events, tmp_path, lambda s: stateful.cooldown(s, ["src", "dst"], 10), "cool")
    want = folds.cooldown(events, ["src", "dst"], "ts_usec", 10_000_000)
    assert sorted(map(tuple, got.where(F.col("ts_usec") <= last).select("src", "dst", "ts_usec").collect())) == sorted(map(tuple, want.select("src", "dst", "ts_usec").collect()))
    sized = packets.select("ts_usec", "wire_len", F.col("reply").alias("outbound"))
    got, last = streamed(spark, sized, tmp_path, stateful.per_second, "seconds")
    assert sorted(map(tuple, got.where(F.col("sec") <= last // 1_000_000).collect())) == sorted(map(tuple, series.per_second(sized).collect()))


def test_alert_log_and_replay_of_captures(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    rows = scenario.build()[:300]
    for k in range(3):
        pcap.write_packets(str(folder / f"{k}.pcap"), rows[k * 100 : (k + 1) * 100])
    raw = sinks.replay(spark, str(folder))
    alerts = raw.select("ts_usec", F.lit("port_scan").alias("kind"), F.lit("high").alias("severity"), F.lit("t").alias("title"), F.lit("m").alias("message"), F.lit("").alias("src"), F.lit("").alias("dst"))
    q = alerts.writeStream.foreachBatch(sinks.alert_log(str(tmp_path / "log"))).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start()
    try:
        for _ in range(60):
            q.awaitTermination(1)
            if q.lastProgress and (tmp_path / "log" / "batch=2" / "_SUCCESS").exists():
                break
    finally:
        q.stop()
    assert spark.read.text(str(tmp_path / "log")).count() == 300


def test_a_paced_replay_waits_for_its_files(spark, tmp_path):
    import time

    folder, out = tmp_path / "captures", str(tmp_path / "seen")
    folder.mkdir()
    for k, at in enumerate((0, 6, 12)):
        pcap.write_packets(str(folder / f"{k}.pcap"), [((1000 + at) * 1_000_000 + n, 60, b"x") for n in range(5)])
    began = time.monotonic()
    q = sinks.replay(spark, str(folder), per_trigger=3, speed=3).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).start()
    counts = []
    while time.monotonic() - began < 40 and (not counts or counts[-1] < 15):
        counts.append(sum(p.numInputRows for p in q.recentProgress))
        time.sleep(0.1)
    took = time.monotonic() - began
    q.stop()
    assert counts[-1] == 15 and took >= 4 and 5 in counts  # the last file is due 12 / 3 seconds after the first
    assert sinks.losses(q.recentProgress) == {"packets": 15, "kernel_drops": 0, "ring_drops": 0, "late": 0}
