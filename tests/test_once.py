"""Inputs are made once, state is looked up by time, and payloads stay out of the tasks that need only numbers."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sweepframe.operators import detect, folds
from sweepframe.plans import streams
from sweepframe.streaming import processors as sp


def counted(rows):
    """rows, and an accumulator of how many of them were made."""
    seen = rows.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return rows.mapInArrow(run, rows.schema), seen


def frames(spark, n=400):
    return spark.range(n).select(F.lit(1).cast("long").alias("device_id"), F.lit("RGB").alias("channel"), F.col("id").alias("frame_no"), (F.col("id") * 50).alias("ms"), (F.col("id") * 9 % 360).cast("double").alias("angle_deg"))


def test_a_stream_makes_its_input_once(spark):
    rows, seen = counted(frames(spark).select("device_id", "channel", "frame_no", "ms"))
    out = streams.run_stream(rows, "ms", lambda s: sp.throttle_stream(s, ["device_id", "channel"], "ms", 120, ["ms", "frame_no"]))
    assert out.count() == 134 and seen.value == 400


def test_a_fold_and_detections_make_their_frames_once(spark):
    rows, seen = counted(frames(spark))
    assert folds.throttle(rows, ["device_id", "channel"], "ms", 120, ["ms", "frame_no"]).count() == 134 and seen.value == 400
    rows, seen = counted(frames(spark))
    targets = spark.createDataFrame([(90,)], "angle int")
    assert detect.detection_batch(rows, targets, 33, 120, clears=spark.createDataFrame([(1, 5000)], "device_id bigint, ms bigint")).count() > 0 and seen.value == 400


def test_replies_are_joined_by_slots_of_time(spark):
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    commands = spark.createDataFrame([(1, 7, "TG_A;", at(4.5)), (2, 7, "TG_A;", at(20)), (3, 7, "TG_A;", at(30))], "cmd_id bigint, device_id bigint, cmd string, ts timestamp")
    replies = spark.createDataFrame([(7, at(9.5), "TG_A;OK;"), (7, at(6), "TG_A;OK;"), (7, at(20), "TG_A;OK;"), (7, at(35.1), "TG_A;OK;")], "device_id bigint, ts timestamp, reply string")
    got = sp.command_reply_stream(commands, replies)
    assert sorted((r.cmd_id, r.latency_s) for r in got.collect()) == [(1, 1.5), (2, 0.0), (3, None)]
    join = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(join) == 1 and "__slot" in join[0]


class _State:
    def exists(self):
        return False

    def update(self, value):
        self.value = value


def test_rechunked_frames_come_many_at_a_time():
    p = sp.RechunkProcessor(10, 1)
    p.state = _State()
    rng = np.random.default_rng(3)
    data = [rng.integers(0, 256, (4, 25), np.uint8) for _ in range(400)]
    pdf = pd.DataFrame({"image_no": range(400), "height": 4, "width": 25, "data": [d.tobytes() for d in data]})
    out = list(p.handleInputRows(("s",), iter([pdf]), None))
    assert len(out) == 1 and p.state.value == (1000, 0, b"")
    whole = np.hstack(data)
    assert out[0]["frame_no"].tolist() == list(range(1000)) and all(f == whole[:, 10 * i : 10 * i + 10].tobytes() for i, f in enumerate(out[0]["data"]))


def test_a_channel_is_folded_without_payloads(spark, monkeypatch):
    held, real = [], sp.written
    monkeypatch.setattr(sp, "written", lambda df, name: held.append(df) or real(df, name))
    rows = spark.createDataFrame([(None, "A", 1, 3, 10, 1, "ab"), (None, "A", 1, 3, 10, 1, "ab"), (None, "A", None, 3, 10, 2, None), (None, "A", None, 2, 10, 2, "xy"), (2, "A", 1, 1, 10, 1, "é")],
        "device_id bigint, channel string, arrival_seq bigint, total_size bigint, rx_ms bigint, image_index bigint, payload string")
    got = {(r.device_id, r.image_index): (r.packets, r.bytes, r.payload, r.reason) for r in sp.reassembly_batch(rows).collect()}
    assert got[(None, 1)] == (2, 4, "abab", None) and got[(2, 1)] == (1, 2, "é", None)
    fold = held[0]._jdf.queryExecution().analyzed().toString()
    repartition = [line for line in fold.splitlines() if "Project" in line and "__size" in line][-1]
    assert "payload#" not in repartition.split("octet_length")[0]


def test_a_form_of_words_is_squeezed_once(monkeypatch):
    from sweepframe.llm import quality

    calls, real = [0], quality._TWICE

    class Counted:
        def sub(self, *args):
            calls[0] += 1
            return real.sub(*args)

    monkeypatch.setattr(quality, "_TWICE", Counted())
    words = [b"%s%03d" % (w, i) for i in range(1000) for w in (b"qzxv", b"QZXV")]
    assert {quality.shape(w) for w in words} == {b"\x02a9", b"\x02A9"} and calls[0] <= 2
    assert quality.shape(b"ERUNG!!") == b"\x02A!" and len(quality.shape(b"ab!" * 40)) == 17
