"""Streams give what the batch forms give, however the input is cut into files."""

import pytest
from pyspark.sql import functions as F

from sweepframe.operators import detect, frames, packets
from sweepframe.operators.laps import lap_times
from sweepframe.plans.catalog import pool_packets
from sweepframe.plans.fixtures import Views
from sweepframe.streaming import processors as sp

DIR = "/root/testdata/sf0.001"


def streamed(spark, rows, order, operator, tmp_path, cuts, name, mode="append"):
    """rows in `order`, written as `cuts` files and run through operator one file at a time."""
    data = rows.orderBy(order).collect()
    path, n = tmp_path / name, -(-len(data) // cuts)
    for k in range(cuts):
        part = spark.createDataFrame(data[k * n : (k + 1) * n], rows.schema)
        part.coalesce(1).write.mode("append").parquet(str(path))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    q = operator(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


@pytest.fixture(scope="module")
def v(spark):
    return Views(spark, DIR)


def same(a, b):
    key = lambda r: [(x is None, str(x)) for x in r]
    return sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


@pytest.mark.parametrize("cuts", [1, 3])
def test_throttle(spark, v, tmp_path, cuts):
    rows = v("frames").withColumn("ms", F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col("ts"))).select("device_id", "channel", "frame_no", "ms")
    keys = ["device_id", "channel"]
    got = streamed(spark, rows, "ms", lambda s: sp.throttle_stream(s, keys, "ms", 3_600_000, ["ms", "frame_no"]), tmp_path, cuts, f"throttled{cuts}")
    assert same(got, detect.throttle(rows, keys, "ms", 3_600_000, ["ms", "frame_no"]))


def test_counter_epoch(spark, v, tmp_path):
    rows = v("frame_index_stream").select("device_id", "seq", "image_index")
    got = streamed(spark, rows, "seq", sp.counter_epoch_stream, tmp_path, 3, "epochs")
    assert same(got, packets.counter_epoch(rows))


def test_laps(spark, v, tmp_path):
    us = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col("ts"))
    a = v("angle_feedback").select("device_id", us.alias("us"), F.lit(1).alias("kind"), F.col("seq").alias("n"), "angle_deg", F.lit("").alias("cmd"))
    m = v("motion_commands").select("device_id", us.alias("us"), F.lit(0).alias("kind"), F.col("event_id").alias("n"), F.lit(0.0).alias("angle_deg"), "cmd")
    got = streamed(spark, a.unionByName(m), "us", sp.lap_stream, tmp_path, 3, "laps")
    want = lap_times(v("angle_feedback"), v("motion_commands")).select("device_id", "epoch", us.alias("us"), "lap_seconds")
    assert want.count() > 0 and same(got, want)


@pytest.mark.parametrize("options", [{}, {"sweep": 64}])
def test_reassembly(spark, v, tmp_path, options):
    rows = pool_packets(v)
    got = streamed(spark, rows, "arrival_seq", lambda s: sp.reassembly_stream(s, **options), tmp_path, 3, f"pool{len(options)}")
    want = sp.reassembly_batch(rows, **options)
    assert want.filter("reason is null").count() > 0 and same(got, want)


def test_detections(spark, v, tmp_path):
    rows = v("frames").withColumn("ms", F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col("ts"))).select("device_id", "channel", "ms", "frame_no", "angle_deg")
    rows = rows.withColumn("device_id", F.col("device_id").cast("long"))
    got = streamed(spark, rows, "ms", lambda s: sp.detection_stream(s, [45, 135, 240, 315], 60_000, 120_000), tmp_path, 3, "detections")
    assert same(got, detect.detection_batch(rows.withColumn("ts", F.col("ms")), v("targets"), 60_000, 120_000))


def test_coverage_and_clear(spark, tmp_path):
    rows = [(1, "RGB", i, i % 4, 4, False) for i in range(6)] + [(1, "RGB", 6, 0, 4, True), (1, "RGB", 7, 2, 4, False)]
    events = spark.createDataFrame(rows, "device_id bigint, channel string, seq bigint, tile_index bigint, segments int, clear boolean")
    got = streamed(spark, events, "seq", sp.coverage_stream, tmp_path, 2, "cover", "update").collect()
    assert {(r.tiles, r.full) for r in got} == {(4, True), (1, False)}


def test_mosaic_and_stats(spark, v, tmp_path):
    rows = v("frames").select("device_id", "channel", "tile_index", "frame_no", "ts")
    got = streamed(spark, rows, "ts", sp.mosaic_stream, tmp_path, 2, "mosaic", "complete")
    assert same(got, frames.mosaic_latest(rows))
    events = v("path_msgs").select("device_id", "rx_ts", "arrival_seq", F.lit("RGB").alias("type"), F.lit("/data/x").alias("path"), F.lit("ok").alias("outcome"))
    stats = streamed(spark, events, "rx_ts", sp.rx_stats_stream, tmp_path, 2, "stats")
    assert 0 < stats.agg(F.sum("packets")).first()[0] <= events.count()


def test_resync(spark, tmp_path):
    def frame(c):
        body = bytes([1, 0, 0x59, c >> 8, c & 255])
        return b"\xff" + body + bytes([sum(body) & 255])

    data = b"\x07".join(frame(c) for c in range(0, 36000, 700))
    rows = [(1, k, data[5 * k : 5 * k + 5]) for k in range(-(-len(data) // 5))]
    chunks = spark.createDataFrame(rows, "device_id bigint, chunk_seq bigint, data binary")
    got = streamed(spark, chunks, "chunk_seq", sp.resync_stream, tmp_path, 3, "resync")
    want = packets.turntable_resync(chunks.withColumn("rx_ts", F.lit(0))).select("device_id", "chunk_seq", "nth", "cmd2", "angle_deg")
    assert want.count() == len(range(0, 36000, 700)) and same(got, want)


def test_a_silent_channel_evicts_its_frames(spark, tmp_path):
    """Frame 1 of channel A is never whole and nothing more comes on A; B's packets move the clock."""
    rows = [(1, "A", 1, 5000, 1, 100, "x"), (1, "A", 2, 5010, 2, 1, "y")] + [(1, "B", 3 + i, 5000 + 400 * i, i, 1, "z") for i in range(1, 12)]
    df = spark.createDataFrame(rows, "device_id bigint, channel string, arrival_seq bigint, rx_ms bigint, image_index bigint, total_size bigint, payload string")
    got = streamed(spark, df, "arrival_seq", lambda s: sp.reassembly_stream(s, late="0 seconds"), tmp_path, 4, "silent").collect()
    assert [(r.channel, r.image_index, r.reason) for r in got if r.reason] == [("A", 1, "stalled")]
    assert sum(r.reason is None for r in got) == 12
    kept = streamed(spark, df, "arrival_seq", lambda s: sp.reassembly_stream(s, late="1 hour"), tmp_path, 4, "patient").collect()
    assert all(r.reason is None for r in kept) and len(kept) == 12


def test_snapshot_pairs(spark, v, tmp_path):
    rows = v("frames").select((F.col("device_id") * 1000 + F.floor(F.col("frame_no") / 8)).alias("request_id"), "channel", "ts", "frame_no")
    got = streamed(spark, rows, "ts", lambda s: sp.snapshot_pair_stream(s, keep_ms=400 * 86_400_000), tmp_path, 3, "pairs")
    assert frames.snapshot_pair(rows).count() > 0 and same(got, frames.snapshot_pair(rows))


def test_a_request_is_forgotten_behind_the_watermark(spark, tmp_path):
    at = "timestamp_seconds"
    rows = spark.createDataFrame([(1, "RGB", 0, 10), (2, "RGB", 1, 11), (2, "BW", 2, 12), (3, "RGB", 500, 13), (1, "BW", 501, 14), (3, "BW", 502, 15), (3, "BW", 503, 16)], "request_id bigint, channel string, s bigint, frame_no bigint")
    rows = rows.select("request_id", "channel", F.expr(f"{at}(s)").alias("ts"), "frame_no")
    got = streamed(spark, rows, "ts", lambda s: sp.snapshot_pair_stream(s, "0 seconds", 60_000), tmp_path, 7, "forgotten").collect()
    assert sorted(tuple(r) for r in got) == [(2, 11, 12), (3, 13, 15)]  # request 1's first half was dropped


def test_a_batch_or_snapshot_that_is_written_twice_counts_once(spark, v, tmp_path):
    from sweepframe.sinks import mosaic_sink, mosaic_table, tile_snapshot_sink

    mosaic = frames.mosaic_latest(v("frames")).drop("ts")
    for _ in range(2):
        for ts in ("2026-03-15 10:00:00", "2026-03-15 11:00:00"):
            tile_snapshot_sink(mosaic, str(tmp_path / "shots"), ts)
    assert spark.read.parquet(str(tmp_path / "shots")).count() == 2 * mosaic.count()
    v("frames").write.parquet(str(tmp_path / "landed"))
    stream = lambda: sp.mosaic_stream(spark.readStream.schema(v("frames").schema).parquet(str(tmp_path / "landed")))
    for checkpoint in ("c1", "c2"):  # from the start again: batch 0 replaces batch 0
        mosaic_sink(stream(), str(tmp_path / "mosaic"), str(tmp_path / checkpoint)).awaitTermination()
    got = mosaic_table(spark.read.parquet(str(tmp_path / "mosaic"))).select("device_id", "channel", "tile_index", "frame_no")
    assert same(got, mosaic.select("device_id", "channel", "tile_index", "frame_no"))
