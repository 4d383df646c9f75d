"""Folds over slices of a key against plain folds, for any number of slices."""

import random

import pytest
from pyspark.sql import functions as F

from sweepframe.operators import detect, packets

SLICES = [1, 2, 3, 7, 40]


def plain_throttle(rows, gap):
    """(key, ms, n, passes) rows that are kept."""
    out, clock = [], {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        k, ms, _, go = r
        if ms is None:
            out.append(r)
        elif go or clock.get(k) is None or ms - clock[k] >= gap:
            clock[k] = ms
            out.append(r)
    return sorted(out, key=str)


def throttle_rows(seed, n=600):
    rng, t, rows = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([0, 0, 1, 2, 3, 9, 30]) if seed % 2 else rng.choice([1, 1, 1, 1, 200])
        rows.append((rng.choice([None, 1, 1, 1, 1 << 60]), None if rng.random() < 0.02 else t, i, rng.choice([None, False, True]) if rng.random() < 0.05 else False))
    return rows


@pytest.mark.parametrize("slices", SLICES)
@pytest.mark.parametrize("gap", [0, 1, 10, 55, 100_000])
def test_throttle(spark, slices, gap):
    for seed in (1, 2):
        rows = throttle_rows(seed)
        df = spark.createDataFrame(rows, "k bigint, ms bigint, n int, go boolean").repartition(3)
        got = detect.throttle(df, ["k"], "ms", gap, ["ms", "n"], passes="go", slices=slices).collect()
        assert sorted((tuple(r) for r in got), key=str) == plain_throttle(rows, gap)


def test_throttle_of_null_keys_and_times(spark):
    df = spark.createDataFrame([(None, i * 10) for i in range(6)], "device_id bigint, ms bigint")
    assert detect.throttle(df, ["device_id"], "ms", 30).count() == 2
    df = spark.createDataFrame([(1, None)] + [(1, i * 10) for i in range(6)], "device_id bigint, ms bigint")
    assert sorted(r.ms if r.ms is not None else -1 for r in detect.throttle(df, ["device_id"], "ms", 30).collect()) == [-1, 0, 30]
    none = spark.createDataFrame([(1, None)] * 3, "device_id bigint, ms bigint")
    assert detect.throttle(none, ["device_id"], "ms", 30).count() == 3
    assert detect.throttle(none.filter("false"), ["device_id"], "ms", 30).collect() == []
    both = spark.createDataFrame([(None, "a", 5.0), (None, "a", 5.4), (None, "b", 5.4), (2, None, 6.0)], "d int, upto string, clock double")
    assert detect.throttle(both, ["d", "upto"], "clock", 1).count() == 3


def plain_epochs(rows, gap):
    out, state = [], {}
    for k, seq, i in sorted(rows, key=lambda r: r[1]):
        epoch, top = state.get(k, (0, 0))
        if i is not None and i >= 0:
            if top != 0 and i + gap < top:
                epoch, top = epoch + 1, i
            else:
                top = max(top, i)
        state[k] = epoch, top
        out.append((k, seq, i, epoch, top))
    return sorted(out, key=str)


@pytest.mark.parametrize("slices", SLICES)
@pytest.mark.parametrize("shape", ["saw", "noise", "falling", "odd"])
def test_counter_epoch(spark, slices, shape):
    rng, rows = random.Random(7), []
    for k in (None, 3, (1 << 53) + 1):
        for seq in range(400):
            i = {"saw": seq * 7 % 300, "noise": rng.randrange(500), "falling": 5000 - 9 * seq + rng.randrange(5), "odd": rng.choice([None, -4, 0, 0, 60, 200, 1000])}[shape]
            rows.append((k, seq, i))
    got = packets.counter_epoch(spark.createDataFrame(rows, "device_id bigint, seq bigint, image_index bigint").repartition(3), gap=100, slices=slices).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_epochs(rows, 100)


def test_counter_epoch_of_nothing_and_other_columns(spark):
    df = spark.createDataFrame([(1, 1, 5, "x", 9)], "device_id int, seq int, image_index int, top string, epoch int")
    assert [tuple(r) for r in packets.counter_epoch(df).select("device_id", "top", "epoch", "max_seen").collect()] == [(1, "x", 0, 5)]
    assert packets.counter_epoch(df.filter("false")).collect() == []


def frame(angle, cmd=0x59, good=True):
    body = [1, 0, cmd, int(angle * 100) >> 8, int(angle * 100) & 255]
    return bytes([0xFF, *body, (sum(body) + (not good)) & 255])


def serial(seed, n, long=False):
    rng, stream = random.Random(seed), b""
    for _ in range(n):
        stream += rng.choice([b"", b"", b"\x00\x12", b"\xff", b"\xff\xff\x01", b"\xff\x01\x00\x59"]) + frame(rng.randrange(0, 360), rng.choice([0x59, 0x59, 0x51]), rng.random() < 0.8)
    if seed % 3 == 0:
        stream = bytes(rng.choice([0xFF, 0xFF, 0xFE, 0x59, 1]) for _ in range(len(stream)))  # never in step for sure
    chunks, at = [], 0
    while at < len(stream):
        size = rng.choice([0, 1, 1, 2, 3, 5, 8, 13]) if not long else rng.choice([1, 5, 4088, 4090, 4093, 4097, 6000])
        chunks.append(stream[at : at + size] if size or rng.random() < 0.5 else None)
        at += size
    return chunks


@pytest.mark.parametrize("slices", SLICES)
@pytest.mark.parametrize("compat", [False, True])
def test_resync(spark, slices, compat):
    rows, want = [], []
    for device, seed in ((None, 1), (4, 2), (5, 3), ((1 << 60) + 1, 4)):
        rest = b""
        for seq, data in enumerate(serial(seed, 3000 if compat else 60, long=compat)):
            rows.append((device, seq * 10, seq, data))
            found, rest = packets.resync(rest + (data or b""), compat)
            want += [(device, seq * 10, seq, k, cmd, angle) for k, (cmd, angle) in enumerate(found)]
    df = spark.createDataFrame(rows, "device_id bigint, rx_ts bigint, chunk_seq bigint, data binary").repartition(3)
    got = packets.turntable_resync(df, compat, slices).select("device_id", "ts", "chunk_seq", "nth", "cmd2", "angle_deg").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str) and want


def test_resync_of_nothing(spark):
    df = spark.createDataFrame([(1, 0, 1, None), (None, 0, 2, b"")], "device_id bigint, rx_ts bigint, chunk_seq bigint, data binary")
    assert packets.turntable_resync(df).collect() == [] and packets.turntable_resync(df.filter("false")).collect() == []


def test_no_fold_runs_on_a_whole_key(spark):
    """One device on many tasks: every task of the last stage has a part of its rows."""
    df = spark.range(4000).select(F.lit(1).alias("device_id"), F.col("id").alias("seq"), (F.col("id") % 900).alias("image_index"), F.col("id").alias("ms"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for out in (packets.counter_epoch(df, slices=8), detect.throttle(df, ["device_id"], "ms", 1, slices=8)):
            sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == 4000 and max(sizes) <= 3000 and len(sizes) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_reassembly_of_null_devices_and_numbers(spark):
    from sweepframe.streaming import processors as sp

    rows = [(d, "RGB", seq, seq, 5, size, b"abc") for d in (None, 1, (1 << 60) + 1) for seq, size in enumerate([6, 6])] + [(1, "RGB", 9, 9, 5, None, b"x"), (1, "RGB", 10, None, 5, 5, b"x"), (1, None, 11, 11, 5, 3, None)]
    df = spark.createDataFrame(rows, "device_id bigint, channel string, arrival_seq bigint, rx_ms bigint, image_index bigint, total_size bigint, payload binary")
    got = sp.reassembly_batch(df).filter("reason is null").collect()
    assert sorted(((r.device_id, bytes(r.payload)) for r in got), key=str) == sorted([(None, b"abcabc"), (1, b"abcabc"), ((1 << 60) + 1, b"abcabc")], key=str)
