"""Clear events and rasters against plain versions, in batch and in streams."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepframe.operators import detect, frames, pixels
from sweepframe.operators import messages as msg
from sweepframe.operators.clearing import clear_epoch, since_clear, with_clears
from sweepframe.plans.catalog import _clears, _clears_ms, _timed
from sweepframe.plans.fixtures import Views
from sweepframe.sinks import mosaic_table
from sweepframe.streaming import processors as sp

from .test_streaming import DIR, same, streamed

T0 = dt.datetime(2026, 3, 15, 10, 0, 0)
at = lambda s: None if s is None else T0 + dt.timedelta(seconds=s)


@pytest.fixture(scope="module")
def clears(spark):
    return spark.createDataFrame([(1, at(10)), (1, at(20)), (1, None), (None, at(15))], "device_id bigint, ts timestamp_ntz")


def test_epochs_of_ties_nulls_and_clashing_columns(spark, clears):
    rows = [(1, 1, at(9), "a"), (2, 1, at(10), "b"), (3, 1, at(25), "c"), (4, 1, None, "d"), (5, None, at(14), "e"), (6, None, at(15), "f"), (7, 2, at(99), "g")]
    df = spark.createDataFrame(rows, "n bigint, device_id bigint, ts timestamp_ntz, epoch string")
    assert {r.n: r.epoch for r in clear_epoch(df, clears).collect()} == {1: 0, 2: 1, 3: 2, 4: 0, 5: 0, 6: 1, 7: 0}
    kept = since_clear(df, clears)
    assert kept.columns == df.columns and sorted(r.n for r in kept.collect()) == [3, 6, 7]
    none = clears.limit(0)
    assert {r.epoch for r in clear_epoch(df, none).collect()} == {0} and since_clear(df, none).count() == 7
    assert clear_epoch(df.limit(0), clears).count() == 0 and since_clear(df.limit(0), clears).count() == 0


def test_a_target_is_found_again_after_a_clear(spark, clears):
    rows = [(1, "RGB", i, at(s), 45.0) for i, s in enumerate([1, 2, 11, 12, 30])]
    df = spark.createDataFrame(rows, "device_id bigint, channel string, frame_no bigint, ts timestamp_ntz, angle_deg double")
    targets = spark.createDataFrame([(45,)], "angle int")
    got = detect.detect_once_per_lap(df, targets, clears=clears).collect()
    assert sorted((r.lap_id, r.epoch, r.frame_no) for r in got) == [(0, 0, 0), (0, 1, 2), (0, 2, 4)]
    assert [r.frame_no for r in detect.detect_once_per_lap(df, targets).collect()] == [0]


def test_the_zero_is_read_anew_and_samples_stay_known(spark, clears):
    shot = spark.createDataFrame([(1, at(1)), (1, at(5)), (1, at(11)), (1, at(40)), (None, at(15)), (3, at(7))], "device_id bigint, ts timestamp_ntz")
    said = spark.createDataFrame([(1, 1, at(2), 10.0), (1, 2, at(11), 20.0), (1, 3, at(30), None), (None, 4, at(1), 7.0)], "device_id bigint, seq bigint, ts timestamp_ntz, angle_deg double")
    got = {(r.device_id, r.epoch): (r.first_ts, r.zero_deg) for r in detect.zero_angle(shot, said, clears=clears).collect()}
    assert got == {(1, 0): (at(1), 0.0), (1, 1): (at(11), 20.0), (1, 2): (at(40), 0.0), (None, 1): (at(15), 7.0), (3, 0): (at(7), 0.0)}


def test_log_and_mosaic_start_afresh(spark, clears):
    log = spark.createDataFrame([(1, 1, at(5)), (2, 1, at(20)), (3, 1, at(21)), (4, 2, at(1))], "event_id bigint, device_id bigint, ts timestamp_ntz")
    assert sorted((r.event_id, r.rn) for r in msg.log_tail(log, 5, clears).collect()) == [(2, 2), (3, 1), (4, 1)]
    shown = spark.createDataFrame([(1, "RGB", 0, 1, at(5)), (1, "BW", 0, 2, at(25)), (2, "RGB", 0, 1, at(5))], "device_id bigint, channel string, tile_index bigint, frame_no bigint, ts timestamp_ntz")
    got = frames.mosaic_latest(shown, clears=clears).collect()
    assert sorted((r.device_id, r.channel, r.tile_index, r.frame_no) for r in got) == [(1, "BW", 16, 2), (2, "RGB", 0, 1)]


@pytest.mark.parametrize("cuts", [1, 4])
def test_streams_with_clears_give_the_batch_rows(spark, tmp_path, cuts):
    v = Views(spark, DIR)
    rows = _timed(v).select(F.col("device_id").cast("long").alias("device_id"), "channel", "ms", "frame_no", "angle_deg")
    got = streamed(spark, with_clears(rows, _clears_ms(v), "ms"), "ms", lambda s: sp.detection_stream(s, [45, 135, 240, 315], 60_000, 120_000), tmp_path, cuts, f"found{cuts}")
    want = detect.detection_batch(rows.withColumn("ts", F.col("ms")), v("targets"), 60_000, 120_000, clears=_clears_ms(v))
    columns = ["device_id", "channel", "lap_id", "target", "frame_no", "epoch"]
    assert want.filter("epoch > 0").count() > 0 and same(got.select(columns), want.select(columns))


def test_tiles_from_before_a_clear_leave_the_mosaic(spark, tmp_path):
    v = Views(spark, DIR)
    rows = with_clears(v("frames").select("device_id", "channel", "ts", "frame_no", "tile_index"), _clears(v))
    table = streamed(spark, rows, "ts", sp.mosaic_stream, tmp_path, 3, "cleared", "complete").withColumn("batch", F.lit(0))
    want = frames.mosaic_latest(v("frames"), clears=_clears(v)).select("device_id", "channel", "tile_index", "frame_no")
    assert want.count() < frames.mosaic_latest(v("frames")).count()
    assert same(mosaic_table(table).select("device_id", "channel", "tile_index", "frame_no"), want)


# -- rasters ----------------------------------------------------------------------------------

SCHEMA = "session string, image_no bigint, height int, width int, data binary"


def made(seed, n, depth, sessions=("a", "b")):
    """Images of random sizes: heights differ, some are wider than two frames."""
    rng = random.Random(seed)
    out = []
    for s in sessions:
        for i in range(n):
            h, w = rng.choice([3, 3, 5]), rng.choice([1, 2, 7, 30])
            out.append((s, i * 3 + 1, h, w, bytearray(rng.randbytes(h * w * depth))))
    return out


def sliced(images, width, depth):
    """Plain: lay a session's images side by side as columns and cut."""
    out = {}
    for s in {r[0] for r in images}:
        columns = []
        for _, _, h, w, data in sorted((r for r in images if r[0] == s), key=lambda r: r[1]):
            a = np.frombuffer(bytes(data), np.uint8).reshape(h, w, depth)
            columns += [a[:, x] for x in range(w)]
        for k in range(len(columns) // width):
            own = columns[k * width : (k + 1) * width]
            frame = np.zeros((max(map(len, own)), width, depth), np.uint8)
            for x, c in enumerate(own):
                frame[: len(c), x] = c
            out[s, k] = (len(frame), width, frame.tobytes())
    return out


def as_dict(df):
    rows = df.collect()
    out = {(r.session, r.frame_no): (r.height, r.width, bytes(r.data)) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("depth", [1, 3])
def test_frames_have_the_bytes_of_a_plain_slicer(spark, depth):
    images = made(depth, 25, depth)
    df = spark.createDataFrame(images, SCHEMA).repartition(5)
    want = sliced(images, 11, depth)
    assert len(want) > 10 and as_dict(pixels.rechunk_pixels(df, 11, depth)) == want


def test_broken_images_and_empty_tables(spark):
    good = [("a", 1, 1, 2, bytearray(b"ab")), ("a", 9, 1, 2, bytearray(b"cd"))]
    bad = [("a", 2, 1, 2, bytearray(b"abc")), ("a", 3, None, 2, bytearray(b"ab")), ("a", 4, 0, 0, bytearray(b"")), ("a", 5, 1, 2, None), (None, 6, 1, 3, bytearray(b"xyz")), ("a", None, 1, 3, bytearray(b"xyz"))]
    got = pixels.rechunk_pixels(spark.createDataFrame(good + bad[:5], SCHEMA), 3)
    assert as_dict(got) == {("a", 0): (1, 3, b"abc")}
    assert pixels.rechunk_pixels(spark.createDataFrame([], SCHEMA), 3).count() == 0
    assert pixels.rechunk_pixels(spark.createDataFrame(bad, SCHEMA), 3).count() == 0


@pytest.mark.parametrize("cuts", [1, 5])
def test_the_rest_is_carried_over_in_the_stream(spark, tmp_path, cuts):
    images = made(7, 12, 2)
    df = spark.createDataFrame(images, SCHEMA)
    got = streamed(spark, df, "image_no", lambda s: sp.rechunk_stream(s, 11, 2), tmp_path, cuts, f"cut{cuts}")
    assert as_dict(got) == sliced(images, 11, 2)


@pytest.mark.parametrize("ring,slice_w", [(30, 8), (32, 8), (5, 8)])
def test_regions_equal_a_plain_crop(spark, ring, slice_w):
    rng, depth = random.Random(ring), 2
    tiles = -(-ring // slice_w)
    shot = [(d, "RGB", at(i), i, rng.randrange(tiles), 3, slice_w, bytearray(rng.randbytes(3 * slice_w * depth))) for d in (1, 2) for i in range(40)]
    asked = [(n, rng.choice([1, 2]), rng.choice(["RGB", "RGB", "BW"]), at(rng.randrange(-2, 45)), rng.randrange(-50, 90), rng.choice([0, 1, 9, ring, 2 * ring + 3])) for n in range(60)]
    df = spark.createDataFrame(shot, "device_id bigint, channel string, ts timestamp_ntz, frame_no bigint, tile_index bigint, height int, width int, data binary")
    requests = spark.createDataFrame(asked, "request_id bigint, device_id bigint, channel string, ts timestamp_ntz, start bigint, width bigint")
    want = {}
    for n, d, c, ts, start, width in asked:
        if width == 0:
            continue
        mosaic, any_tile = np.zeros((3, tiles * slice_w, depth), np.uint8), np.zeros(tiles, bool)
        for fd, fc, fts, _, tile, h, w, data in shot:
            if fd == d and fc == c and fts <= ts:
                mosaic[:, tile * slice_w : (tile + 1) * slice_w], any_tile[tile] = np.frombuffer(bytes(data), np.uint8).reshape(h, w, depth), True
        at_x = (start + np.arange(width)) % ring
        seen = any_tile[at_x // slice_w].any()
        want[n] = (3, width, mosaic[:, at_x].tobytes()) if seen else (None, width, None)
    got = {r.request_id: (r.height, r.width, r.data and bytes(r.data)) for r in pixels.region_pixels(df, requests, ring, slice_w, depth).collect()}
    assert got == want and any(x[2] for x in want.values()) and any(x[2] is None for x in want.values())
