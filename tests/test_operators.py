"""Exact bytes, edge cases and properties."""

import datetime as dt
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sweepframe.functions import angles, messages
from sweepframe.operators import detect, frames, laps, packets, rasters, rechunk
from sweepframe.operators import messages as msg
from sweepframe.sinks import capture_log_sink, tile_snapshot_sink
from sweepframe.sources.captures import capture_log_scan, image_file_scan, packet_scan

T0 = dt.datetime(2026, 3, 15, 10, 0, 0)


def datagram(code=0xFFFF, kind=1, ts=1, index=7, total=5, block=0, body=b"hello"):
    return struct.pack("<HHIIIHH", code, kind, ts, index, total, block, len(body)) + body


def test_header_decode_and_classify(spark):
    rows = [(1, datagram(index=3_000_000_000, total=4_294_967_295)), (2, datagram(code=0xFFFE)), (3, b"\xff\xff\x01"), (4, "RGB; /data/x".encode()), (5, b"hello"), (6, None), (7, b";x")]
    raw = spark.createDataFrame(rows, "arrival_seq bigint, datagram binary")
    got = packets.packet_header_decode(raw).collect()
    assert [(r.arrival_seq, r.image_index, r.total_size, r.block_size, bytes(r.payload)) for r in got] == [(1, 3_000_000_000, 4_294_967_295, 5, b"hello")]
    kinds = {r.arrival_seq: r.kind for r in packets.packet_classify(raw).collect()}
    assert kinds == {1: "binary", 2: "reject", 3: "reject", 4: "text", 5: "reject", 6: "reject", 7: "reject"}


def frame(angle, cmd2=0x59, spoil=0):
    c = round(angle * 100)
    body = bytes([1, 0, cmd2, c >> 8, c & 255])
    return b"\xff" + body + bytes([(sum(body) + spoil) & 255])


def test_resync_across_chunks():
    stream = b"\x01\x02" + frame(12.34) + frame(1, spoil=1) + b"\xff\xff" + frame(359.99) + frame(5, cmd2=0x51) + frame(200) + b"\xff\x01"
    whole, rest = packets.resync(stream)
    rng = random.Random(4)
    for _ in range(50):
        at, found, buffer = 0, [], b""
        while at < len(stream):
            n = rng.randint(1, 9)
            more, buffer = packets.resync(buffer + stream[at : at + n])
            found += more
            at += n
        assert found == whole and buffer == rest
    assert [round(a, 2) for _, a in whole] == [12.34, 359.99, 200.0]
    assert packets.resync(b"\x00" * 4096 + frame(9), compat=True)[0] == [(0x59, 9.0)]


def test_commands(spark):
    got = packets.turntable_command_encode(spark.createDataFrame([("setOrthoLength", 0x1234), ("enableFeedback", 0), ("turnLeft", 255), ("nothing", 1)], "cmd string, speed int")).collect()
    assert {r.cmd: r.frame_hex for r in got} == {"setOrthoLength": "FF0102E9123432", "enableFeedback": "FF010009000610", "turnLeft": "FF010004FF0004", "nothing": None}


def test_messages(spark):
    r = spark.range(1).select(
        messages.sender_ip(F.lit(" [fe80::1]:80 ")).alias("v6"), messages.sender_ip(F.lit("")).alias("none"), messages.sender_ip(F.lit("host")).alias("host"),
        messages.device_path_map(F.lit("FILE:///data/a/b.jpg"), F.lit(None)).alias("share"), messages.device_path_map(F.lit("D:/x"), F.lit("1.2.3.4")).alias("other"),
        messages.path_type(F.lit("gray;file:///data/a.jpg")).alias("t"), messages.path_type(F.lit("RGB;")).alias("empty"), messages.path_type(F.lit("a;b;c"), strict=True).alias("strict"),
        messages.reply_command(F.lit("TG_X;OK;")).alias("cmd"), messages.html_escape(F.lit("<a&\"b>")).alias("html"),
    ).first()
    assert (r.v6, r.none, r.host) == ("fe80::1", None, "host")
    assert (r.share, r.other, r.t, r.empty, r.strict) == ("\\\\192.168.4.1\\data\\a\\b.jpg", "D:/x", "GRAY", None, None)
    assert (r.cmd, r.html) == ("TG_X;", "&lt;a&amp;&quot;b&gt;")


def test_angle_properties(spark):
    rows = spark.createDataFrame([(x / 7.0, y * 11.3) for x in range(-3000, 3000, 401) for y in range(-40, 40, 13)], "a double, b double")
    n = angles.normalize_angle(F.col("a"))
    d, e = angles.circular_distance(n, angles.normalize_angle(F.col("b"))), angles.circular_distance(angles.normalize_angle(F.col("b")), n)
    bad = rows.filter((n < 0) | (n >= 360) | (angles.normalize_angle(n) != n) | (d != e) | (d > 180) | (d < 0))
    assert bad.count() == 0


def samples(spark, values, device=1):
    return spark.createDataFrame([(device, T0 + dt.timedelta(seconds=i), i, float(a)) for i, a in enumerate(values)], "device_id int, ts timestamp_ntz, seq bigint, angle_deg double")


def test_lap_edges(spark):
    motions = spark.createDataFrame([(1, T0 - dt.timedelta(seconds=1), 1, "turnLeft", 85)], "device_id int, ts timestamp_ntz, event_id bigint, cmd string, speed int")
    got = laps.lap_times(samples(spark, [310, 10, 350, 30, 340, 20]), motions).collect()
    # 310 -> 10 is a change of exactly 300, no crossing; the first crossing arms the timer
    assert sorted(r.lap_seconds for r in got) == [1.0, 1.0, 1.0]
    assert laps.lap_times(samples(spark, []), motions).count() == 0
    assert laps.lap_times(samples(spark, [1]), motions).count() == 0


def test_detection_edges(spark):
    f = samples(spark, [43.0, 43.01, 359.0, 47.0]).withColumn("channel", F.lit("RGB")).withColumn("frame_no", F.col("seq"))
    t = spark.createDataFrame([(45,), (0,)], "angle int")
    want = {(1, 45), (2, 0)}
    for bucketed in (False, True):
        got = {(r.frame_no, r.target) for r in detect.target_detect(f, t, bucketed=bucketed).collect()}
        assert got == want
    for tolerance in (0.5, 7.0, 100.0, 130.0, 179.0):
        many = spark.createDataFrame([(a,) for a in range(0, 360, 17)], "angle int")
        pairs = [sorted((r.frame_no, r.target, r.distance) for r in detect.target_detect(f, many, tolerance, b).collect()) for b in (False, True)]
        assert pairs[0] == pairs[1]


def test_file_stable_edges(spark):
    rows = [(1, 1, 25, 0), (1, 2, 50, 0), (1, 3, 75, 9), (1, 4, 100, None), (1, 5, 125, 9), (2, 1, 25, 5), (2, 2, 2025, 5), (3, 1, 1, None)]
    got = {r.file_id: (r.stable_ms, r["size"]) for r in msg.file_stable(spark.createDataFrame(rows, "file_id int, seq int, poll_ms int, size int")).collect()}
    assert got == {1: (125, 9), 2: (None, None), 3: (None, None)}


def test_counter_epoch_edge(spark):
    rows = [(1, i, x) for i, x in enumerate([2000, 1000, 999, 1500, 498])]
    got = packets.counter_epoch(spark.createDataFrame(rows, "device_id int, seq int, image_index int")).orderBy("seq").collect()
    assert [(r.epoch, r.max_seen) for r in got] == [(0, 2000), (0, 2000), (1, 999), (1, 1500), (2, 498)]


def test_pool_evictions():
    pool = packets.BufferPool()
    assert pool.add(10, 4, "ab", 0) == ([], [])
    assert pool.add(40, 4, "ab", 1)[1] == []  # 10 is exactly 30 behind
    assert pool.add(41, 4, "abcd", 2) == ([(41, 0, 0, 1, 4, ["abcd"])], [(10, "behind")])
    assert pool.add(5, 4, "abcd", 3)[1] == [(5, "late")]
    done, gone = pool.add(42, 9, "x", 2000)
    assert gone == [(40, "stalled")] and not done
    assert [i for i, why in pool.add(1, 9, "x", 2001)[1]] == [1]
    assert ("reset" in {why for _, why in packets_reset()})


def packets_reset():
    pool = packets.BufferPool()
    pool.add(5000, 4, "ab", 0)
    return pool.add(10, 4, "ab", 0)[1]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=40), st.integers(1, 7))
def test_throttled_items_are_apart_and_maximal(spark, gaps, gap):
    at, rows = 0, []
    for g in gaps:
        at += g
        rows.append((1, at))
    kept = [r.ms for r in detect.throttle(spark.createDataFrame(rows, "k int, ms bigint"), ["k"], "ms", gap).orderBy("ms").collect()]
    last, want = None, []
    for _, t in rows:
        if last is None or t - last >= gap:
            want.append(t)
            last = t
    assert kept == want


def test_rechunk_properties(spark):
    rng = random.Random(3)
    rows = [("a", i, 10, rng.randint(1, 5000)) for i in range(60)] + [("b", 1, 10, 100)]
    images = spark.createDataFrame(rows, "session string, image_no bigint, height int, width int")
    got = rechunk.column_rechunk(images).collect()
    total = sum(r[3] for r in rows[:60])
    per = {}
    for r in got:
        assert r.session == "a"
        per.setdefault(r.frame_no, []).append((r.dst_from, r.src_to - r.src_from))
    assert len(per) == total // 2048
    for parts in per.values():
        at = 0
        for dst, n in sorted(parts):
            assert dst == at
            at += n
        assert at == 2048


def test_reassembly_permutations(spark):
    text = "".join(chr(97 + i % 26) for i in range(24_998)) + "é"  # 25,000 bytes
    blocks = packets.payload_blocks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "image_index int, payload string")).collect()
    assert [b.block_size for b in sorted(blocks, key=lambda b: b.block_index)] == [8000, 8000, 8000, 1000]
    rng = random.Random(5)
    for _ in range(3):
        order = [*blocks, blocks[1]]
        rng.shuffle(order)
        rows = spark.createDataFrame([(1, 1, k, b.block_index, b.block_size, 25_000, b.block) for k, b in enumerate(order)], "image_type int, image_index int, arrival_seq int, block_index int, block_size int, total_size int, payload binary")
        (out,) = packets.frame_reassembly_ordered(rows, ["image_type"]).collect()
        assert out.complete and bytes(out.payload) == text.encode() and out.bytes == 25_000
    zero = spark.createDataFrame([(1, 1, 1, 0, 0, 0, "")], "image_type int, image_index int, arrival_seq int, block_index int, block_size int, total_size int, payload string")
    assert not packets.frame_reassembly(zero, ["image_type"]).first().complete


PACKET = "device_id int, image_index int, arrival_seq int, block_index int, block_size int, total_size int, payload binary"


def test_binary_frames_from_datagrams(spark):
    """Bytes that are no text, a first total of zero, a block size that lies, two devices, repeated and truncated packets."""
    rng = random.Random(6)
    pictures = {(d, i): b"\xff\xd8" + rng.randbytes(rng.randint(1, 3000)) + b"\xff\xd9" for d in (1, 2) for i in (7, 8)}
    rows = []
    for (d, i), data in pictures.items():
        cut = [data[k : k + 700] for k in range(0, len(data), 700)]
        for k, part in enumerate(cut):
            total = 0 if k == 0 and len(cut) > 1 else len(data)
            rows.append((str(d), len(rows), struct.pack("<HHIIIHH", 0xFFFF, 1, k, i, total, k, 9) + part))
    rows += [("1", len(rows), datagram(index=9, total=50, body=b"\x80\x81")), ("1", len(rows) + 1, b"\xff\xff\x01"), ("2", len(rows) + 2, b"RGB; /data/x\r\n"), ("2", len(rows) + 3, None)]
    again = [(d, len(rows) + k, x) for k, (d, _, x) in enumerate(rows[:1])]
    raw = spark.createDataFrame(rows + again, "device_id string, arrival_seq bigint, datagram binary")
    decoded = packets.packet_header_decode(packets.packet_classify(raw).filter("kind = 'binary'").drop("kind"))
    got = {(int(r.device_id), r.image_index, r.generation): (r.complete, bytes(r.payload), r.packets, r.bytes) for r in packets.frame_reassembly(decoded, ["device_id"]).collect()}
    for (d, i), data in pictures.items():
        assert got[d, i, 0] == (True, data, -(-len(data) // 700), len(data))
    assert got[1, 9, 0] == (False, b"\x80\x81", 1, 2) and len(got) == 6  # the repeated packet opens a generation
    ordered = {(int(r.device_id), r.image_index): (r.complete, bytes(r.payload)) for r in packets.frame_reassembly_ordered(decoded, ["device_id"]).collect()}
    assert all(ordered[k] == (True, data) for k, data in pictures.items()) and ordered[1, 9] == (False, b"\x80\x81")
    pool = decoded.withColumn("channel", F.lit("BW")).withColumn("rx_ms", F.col("arrival_seq"))
    from sweepframe.streaming.processors import reassembly_batch

    done = {(int(r.device_id), r.image_index): bytes(r.payload) for r in reassembly_batch(pool).collect() if r.reason is None}
    assert done == pictures
    none = spark.createDataFrame([], PACKET)
    assert packets.frame_reassembly(none, ["device_id"]).count() == 0 and packets.frame_reassembly_ordered(none, ["device_id"]).count() == 0
    odd = spark.createDataFrame([(None, 1, 1, 0, 0, None, None), (None, 1, 2, 1, 0, 2, b"ab"), (1, 1, 1, 0, 0, 0, None)], PACKET)
    got = {r.device_id: (r.complete, r.packets, bytes(r.payload)) for r in packets.frame_reassembly(odd, ["device_id"]).collect()}
    assert got == {None: (True, 2, b"ab"), 1: (False, 1, b"")}


def test_pool_state_is_bounded():
    pool = packets.BufferPool(sweep=64)
    for i in range(5000):
        done, _ = pool.add(i, 3, b"abc", i)
        assert done and done[0][:2] == (i, 0)
    assert len(pool.generation) <= 30 + 64 and not pool.open
    assert pool.add(5000, 0, b"ab", 1) == ([], []) and pool.add(5000, 4, b"cd", 2)[0][0][4] == 4  # a total of zero waits for the next


def plain_pool(rows, window, stall, hard, sweep, most, gap):
    """The buffer rules word by word: rows of (index, total, size, now); complete frames and evictions in order."""
    frames, top, seen, out = {}, 0, 0, []
    for index, total, size, now in rows:
        seen += 1
        if top and index + gap < top:
            out += [("gone", i) for i in frames]
            frames, top = {}, index
        top = max(top, index)
        f = frames.setdefault(index, {"total": 0, "got": 0, "made": now, "last": now, "swept": 0})
        if f["total"] == 0:
            f.update(total=total, made=now, swept=0)
        f["got"] += size
        f["last"] = now
        if seen % sweep == 0 or len(frames) > most:
            left = {}
            for i, g in frames.items():
                idle = g["got"] == g["swept"] and (now - g["last"] > stall or now - g["made"] > hard)
                if i < top - window or idle:
                    out.append(("gone", i))
                    continue
                g["swept"] = g["got"]
                left[i] = g
            frames = left
        if index in frames and 0 < f["total"] <= f["got"]:
            out.append(("done", index, f["got"]))
            del frames[index]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.sampled_from([0, 2, 5]), st.integers(0, 3), st.integers(0, 900)), max_size=120), st.sampled_from([1, 4, 64]), st.sampled_from([3, 128]))
def test_pool_against_plain_rules(rows, sweep, most):
    now, timed = 0, []
    for index, total, size, gap in rows:
        now += gap
        timed.append((index if index < 50 else index * 50, total, size, now))
    pool, got = packets.BufferPool(window=5, sweep=sweep, max_open=most), []
    for index, total, size, at in timed:
        done, gone = pool.add(index, total, b"x" * size, at)
        got += [("gone", i) for i, _ in gone] + [("done", d[0], d[4]) for d in done]
    assert got == plain_pool(timed, 5, 1500, 5000, sweep, most, 1000)


def test_running_values_are_those_of_plain_windows(spark):
    from pyspark.sql import Window

    from sweepframe.operators.sliced import running

    rng = random.Random(7)
    rows = [(rng.choice([1, 1, 1, None, 2]), T0 + dt.timedelta(seconds=rng.randint(0, 300)), i, rng.choice([None, rng.randint(0, 50)])) for i in range(400)]
    data = spark.createDataFrame(rows, "k int, ts timestamp_ntz, n bigint, x int")
    w = Window.partitionBy("k").orderBy("ts", "n")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = data.withColumns({"a": F.sum("x").over(upto), "b": F.max("x").over(before), "c": F.last("x", ignorenulls=True).over(before), "d": F.lag("x").over(w)})
    for slices in (1, 2, 7, 50):
        got = running(data, ["k"], ["ts", "n"], {"a": ("sum", F.col("x"), False), "b": ("max", F.col("x"), True), "c": ("last", F.col("x"), True), "d": ("last", F.struct("x"), True)}, slices)
        assert sorted(map(str, got.withColumn("d", F.col("d.x")).collect())) == sorted(map(str, want.collect()))
    assert running(data.limit(0), ["k"], ["ts", "n"], {"a": ("sum", F.col("x"), False)}).count() == 0


def test_only_turns_and_stop_touch_the_lap_timer(spark):
    names = ["turnLeft", "enableFeedback", "stop", "enableOrtho", "disableOrtho", "setOrthoLength", "disableFeedback"]
    motions = spark.createDataFrame([(1, T0 - dt.timedelta(seconds=9 - i), i, c, 85) for i, c in enumerate(names)], "device_id int, ts timestamp_ntz, event_id bigint, cmd string, speed int")
    assert laps.lap_times(samples(spark, [350, 10, 350, 10, 350]), motions).count() == 0  # stopped, and nothing since turns again
    assert laps.lap_times(samples(spark, [350, 10, 350, 10, 350]), motions.filter("cmd <> 'stop'")).count() == 3
    profile = spark.createDataFrame([(85, 4.0)], "speed int, nominal_lap_s double")
    got = laps.nominal_lap_join(laps.lap_times(samples(spark, [350, 10, 350]), motions.filter("cmd <> 'stop'")), motions, profile).collect()
    assert [(r.speed, r.diff_s) for r in got] == [(85, -3.0)]


def test_white_space_and_missing_semicolons(spark):
    rows = [(1, 1, T0, "192.168.4.1:5\r\n", "RGB\t;\t/data/x.jpg\r\n"), (2, 1, T0, None, "\x0bbw\r\n; file:///data/y \f"), (3, 1, T0, "", " ;x"), (4, 1, T0, "a:1", None)]
    got = {r.arrival_seq: (r.type, r.channel, r.path, r.sender_ip) for r in msg.channel_route(msg.path_message_parse(spark.createDataFrame(rows, "arrival_seq bigint, device_id int, rx_ts timestamp_ntz, sender string, payload string"))).collect()}
    assert got == {1: ("RGB", "RGB", "/data/x.jpg", "192.168.4.1"), 2: ("BW", "BW", "file:///data/y", None)}
    commands = spark.createDataFrame([(1, 1, T0, "TG_X"), (2, 1, T0, "TG_Y;"), (3, 1, T0, "TG_Z;"), (4, 1, T0, None)], "cmd_id int, device_id int, ts timestamp_ntz, cmd string")
    replies = spark.createDataFrame([(1, T0 + dt.timedelta(seconds=1), "TG_X;OK;"), (1, T0 + dt.timedelta(seconds=2), "TG_Y;OK;")], "device_id int, ts timestamp_ntz, reply string")
    assert {r.cmd_id: r.latency_s for r in msg.command_reply_match(commands, replies).collect()} == {1: 1.0, 2: 2.0, 3: None, 4: None}
    left = msg.unanswered_commands(commands, replies)
    assert {r.cmd_id for r in left.collect()} == {3, 4} and left.columns == commands.columns


def png(path, rows):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = len(rows), len(rows[0])
    raw = b"".join(b"\0" + b"".join(bytes(p) for p in r) for r in rows)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    png(tmp_path / "b.png", [[(255, 0, 0), (0, 255, 0)], [(0, 0, 255), (9, 9, 9)]])
    (tmp_path / "a.png").write_bytes(b"no image")
    found = image_file_scan(spark, str(tmp_path))
    assert [(r.ok, r.height, r.width) for r in found.collect()] == [(False, -1, -1), (True, 2, 2)]
    grey = {(r.x, r.y): r.gray for r in rasters.image_pixels(found).collect()}
    assert grey == {(0, 0): 76, (1, 0): 150, (0, 1): 29, (1, 1): 9}
    turned = rechunk.rotate_pixels(rasters.image_pixels(found), 2)
    assert {(r.x, r.y): r.gray for r in turned.collect()} == {(1, 0): 76, (1, 1): 150, (0, 0): 29, (0, 1): 9}


def test_log_round_trip(spark, tmp_path):
    sent = spark.createDataFrame([(T0, "192.168.4.1:5", "RGB; /data/x.jpg"), (T0, "10.0.0.1:6", "noise")], "rx_ts timestamp_ntz, sender string, payload string")
    capture_log_sink(sent, str(tmp_path / "log"))
    (tmp_path / "log" / "more.txt").write_text("broken\n[not a time] x: kept\n[2026-03-15 10:00:01] y: \n\n", encoding="utf-8")
    got = {r.payload: (r.log_ts, r.sender_ip, r.sender_port) for r in capture_log_scan(spark, str(tmp_path / "log")).collect()}
    assert got == {"RGB; /data/x.jpg": (T0, "192.168.4.1", 5), "noise": (T0, "10.0.0.1", 6), "kept": (None, None, None)}


def test_landing_and_snapshots(spark, tmp_path):
    rows = [("d", "s", 8002, T0, 1, datagram())]
    spark.createDataFrame(rows, "device_id string, sender string, port int, rx_ts timestamp, arrival_seq bigint, datagram binary").write.parquet(str(tmp_path / "in"))
    assert packet_scan(spark, str(tmp_path / "in")).count() == 1
    assert packet_scan(spark, str(tmp_path / "in"), stream=True).isStreaming
    mosaic = spark.createDataFrame([(1, "RGB", 3, 9), (1, "BW", 4, 8)], "device_id int, channel string, tile_index int, frame_no bigint")
    tile_snapshot_sink(mosaic, str(tmp_path / "out"), "2026-03-15 10:00:00")
    assert (tmp_path / "out" / "snapshot_ts=2026_03_15_10_00_00" / "channel=RGB").is_dir()


def test_numbers_over_many_ranges_and_in_sessions(spark):
    rows = spark.range(0, 3000).select((F.col("id") * 7 % 1000).alias("k"), F.when(F.col("id") % 3 > 0, 1).alias("s"), F.when(F.col("id") % 5 > 0, F.col("id") % 40).alias("at"), "id")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "260")  # more than a hundred bounds are looked up in two steps
    try:
        got = sorted((r.n, r.k) for r in msg.numbered(rows, "k").coalesce(4).collect())
        assert [n for n, _ in got] == list(range(1, 3001)) and [k for _, k in got] == sorted(k for _, k in got)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for order in ("k", "at"):  # null sessions are a session, null places come first
        got = msg.numbered(rows, order, "s").collect()
        for s in (None, 1):
            own = sorted((r.n, -1 if r[order] is None else r[order]) for r in got if r.s == s)
            assert [n for n, _ in own] == list(range(1, len(own) + 1)) and [x for _, x in own] == sorted(x for _, x in own)


def test_numbering_over_ranges(spark):
    rows = spark.range(0, 1000, 7).select((F.col("id") * 37 % 1009).alias("k")).distinct()
    got = [r.n for r in msg.numbered(rows, "k").orderBy("k").collect()]
    assert got == list(range(1, len(got) + 1))
    assert msg.numbered(rows.limit(0), "k").count() == 0
    names = spark.createDataFrame([(f"image {i % 40:03d}.jpg" if i % 9 else None, i) for i in range(300)], "name string, x int")
    one, two = (sorted((r.n, r.name, r.x) for r in msg.numbered(names.repartition(k), "name").collect()) for k in (1, 5))
    assert one == two and [n for n, *_ in one] == list(range(1, 301))  # ties have an order, too
    assert [r[1] or "" for r in one] == sorted(r[1] or "" for r in one)


def test_roi_and_slices(spark):
    f = spark.createDataFrame([(1, "RGB", 0, T0, 5), (1, "RGB", 0, T0 + dt.timedelta(seconds=9), 37)], "device_id int, channel string, tile_index bigint, ts timestamp_ntz, frame_no bigint")
    r = spark.createDataFrame([(1, 1, "RGB", 0, 3.0, T0 + dt.timedelta(seconds=s)) for s in (-1, 0, 10)], "request_id int, device_id int, channel string, tag int, angle double, ts timestamp_ntz")
    assert sorted((x.frame_no or -1) for x in frames.roi_lookup(f, r).collect()) == [-1, 5, 37]
    one = spark.createDataFrame([(1, -100, 2048)], "request_id int, start bigint, width bigint")
    got = sorted((x.dst_from, x.tile_index, x.src_from, x.src_to) for x in frames.circular_range_slice(one).collect())
    assert got == [(0, 31, 1948, 2048), (100, 0, 0, 1948)]


@pytest.mark.parametrize("conflict", [True, False])
def test_clear_epochs(spark, conflict):
    f = spark.createDataFrame([(1, "RGB", 0, T0 + dt.timedelta(seconds=s)) for s in (0, 2, 4)], "device_id int, channel string, tile_index bigint, ts timestamp_ntz")
    c = spark.createDataFrame([(1, T0 + dt.timedelta(seconds=2 if conflict else 3))], "device_id int, ts timestamp_ntz")
    assert [r.epoch for r in frames.clear_epoch(f, c).orderBy("ts").collect()] == ([0, 1, 1] if conflict else [0, 0, 1])


@pytest.mark.parametrize("ring,width", [(64, 16), (65, 16), (70, 20), (7, 9), (1, 1)])
def test_circular_range_slice_of_any_ring(spark, ring, width):
    """Every output pixel comes from the ring's pixel it stands for, whatever the tile width."""
    asked = [(i, s, w) for i, (s, w) in enumerate((s, w) for s in (-3, 0, 1, ring - 1, ring, 5 * ring + 2, None) for w in (0, 1, 5, ring, 2 * ring + 3, None))]
    got = frames.circular_range_slice(spark.createDataFrame(asked, "request_id int, start bigint, width bigint"), ring, width).collect()
    out = {}
    for r in got:
        assert 0 <= r.src_from < r.src_to <= min(width, ring - r.tile_index * width)
        for k in range(r.src_to - r.src_from):
            at = (r.request_id, r.dst_from + k)
            assert at not in out
            out[at] = r.tile_index * width + r.src_from + k
    assert out == {(i, k): (s + k) % ring for i, s, w in asked if s is not None for k in range(w or 0)}
