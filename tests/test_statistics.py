"""Receive statistics with evictions, their totals over slices and in a stream, coverage by bits."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sweepframe.operators import frames
from sweepframe.operators import messages as msg
from sweepframe.plans.fixtures import Views
from sweepframe.streaming import processors as sp

from .test_streaming import DIR, same, streamed

T0 = dt.datetime(1970, 1, 1, 10, 0, 0)
at = lambda s: T0 + dt.timedelta(seconds=s)
SCHEMA = "device_id bigint, rx_ts timestamp_ntz, arrival_seq bigint, type string, path string, outcome string, sender string, length bigint, wake boolean"


def test_evictions_drop_but_are_no_packets(spark):
    rows = [(1, at(0), 1, "RGB", "/a", "ok", "x:1", 10, True), (1, at(1), 2, None, None, None, "y:2", 20, None), (1, at(2), 2, None, None, "convert_failed", "z:3", 30, True), (None, at(1), 9, None, None, "drop", None, None, True)]
    gone = spark.createDataFrame([(1, at(2)), (1, at(2)), (2, at(1))], "device_id bigint, rx_ts timestamp_ntz")
    got = {r.device_id: r for r in msg.rx_stats(msg.with_evictions(spark.createDataFrame(rows, SCHEMA), gone)).collect()}
    one, two, none = got[1], got[2], got[None]
    assert (one.packets, one.ok, one.drop, one.fail, one.wakes) == (3, 1, 2, 1, 2)
    assert (one.last_type, one.last_path, one.last_sender, one.last_length) == ("RGB", "/a", "z:3", 30)  # ties of a number go by time
    assert (two.packets, two.drop, two.last_sender) == (0, 1, None) and (none.packets, none.drop, none.wakes) == (1, 1, 1)
    empty = msg.rx_stats(msg.with_evictions(spark.createDataFrame([], SCHEMA), gone.limit(0)))
    assert empty.count() == 0
    assert "last_sender" not in msg.rx_stats(spark.createDataFrame(rows, SCHEMA).drop("sender")).columns


def windows(seed):
    return [(d, 3 * k, (k * seed + 5) % 11, (k * 7 + seed) % 3) for d in (1, None) for k in range(40) if (k * seed) % 4]


@pytest.mark.parametrize("slices", ["1", "4", "17"])
def test_totals_are_the_same_for_every_number_of_slices(spark, slices):
    data, before = windows(3), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    try:
        got = {(r.device_id, r.win_start): (r.total_packets, r.delta_packets, r.total_wakes) for r in msg.running_totals(spark.createDataFrame(data, "device_id bigint, win_start bigint, packets bigint, wakes bigint")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {}
    for d in (1, None):
        total = wakes = last = 0
        for _, w, n, k in sorted((r for r in data if r[0] == d), key=lambda r: r[1]):
            total, wakes = total + n, wakes + k
            want[d, w], last = (total, n - last, wakes), n
    assert got == want


@pytest.mark.parametrize("cuts", [1, 4])
def test_totals_of_a_stream(spark, tmp_path, cuts):
    v = Views(spark, DIR)
    rows = v("path_msgs").select("device_id", "rx_ts", "arrival_seq", F.lit("RGB").alias("type"), F.lit("/x").alias("path"), F.lit("ok").alias("outcome"), "sender", (F.col("arrival_seq") % 3 == 0).alias("wake"))
    rows = rows.withColumn("rx_ts", F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col("rx_ts"))))
    got = streamed(spark, rows, "rx_ts", lambda s: sp.running_totals_stream(sp.rx_stats_stream(s, 86_400)), tmp_path, cuts, f"totals{cuts}")
    ntz = rows.withColumn("rx_ts", F.col("rx_ts").cast("timestamp_ntz"))
    end = got.agg(F.max("win_start")).first()[0]
    want = msg.running_totals(msg.rx_stats(ntz, 86_400)).filter(F.col("win_start") <= end)
    columns = ["device_id", "win_start", "packets", "wakes", "last_sender", "total_packets", "delta_packets", "total_wakes"]
    assert want.count() > 20 and same(got.select(columns), want.select(columns))


def test_coverage_counts_tiles_of_the_grid_only(spark):
    rows = [(1, c, t) for c in ("RGB", "BW") for t in range(130)] + [(1, "RGB", 130), (1, "RGB", -1), (1, "BW", None), (2, "RGB", 63), (2, "RGB", 63), (2, "IR", 5), (3, "BW", None), (None, "BW", 64)]
    df = spark.createDataFrame(rows, "device_id bigint, channel string, tile_index bigint")
    got = {r.device_id: (r.rgb_tiles, r.bw_tiles, r.ready) for r in frames.coverage_ready(df, 130).collect()}
    assert got == {1: (130, 130, True), 2: (1, 0, False), 3: (0, 0, False), None: (0, 1, False)}
    assert {r.ready for r in frames.coverage_ready(df, 0).collect()} == {False} and frames.coverage_ready(df.limit(0)).count() == 0
