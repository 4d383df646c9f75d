"""Streaming twins of the sequential operators, on transformWithStateInPandas.

Each keeps a few numbers (or the bounded pool of open frames) per key. A key's rows of one micro-batch
are put in order before they are folded, so a stream that arrives in order gives what the batch form
gives, however it is cut into micro-batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import angles
from ..operators.messages import rx_aggregates
from ..operators.packets import BufferPool, resync
from ..operators.pixels import whole_rasters
from ..operators.rechunk import WIDTH
from ..shared import written


class _OneState(StatefulProcessor):
    """A processor with one value of state."""

    state_schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.state_schema)

    def value(self) -> tuple | None:
        return self.state.get() if self.state.exists() else None

    def close(self) -> None:
        pass


class ThrottleProcessor(_OneState):
    """Keeps a row if it is gap_ms after the last kept one, or if its `passes` column is true."""

    state_schema = "last bigint"

    def __init__(self, time_ms: str, gap_ms: int, order: list[str], passes: str | None):
        self.time_ms, self.gap, self.order, self.passes = time_ms, gap_ms, list(dict.fromkeys([time_ms, *order])), passes

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable", na_position="first")
        had = self.value()
        last, keep = (had[0] if had else None), []
        for now, go in zip(pdf[self.time_ms].tolist(), pdf[self.passes].tolist() if self.passes else [False] * len(pdf)):
            if pd.isna(now):  # kept, and the clock stays
                keep.append(True)
                continue
            ok = (not pd.isna(go) and bool(go)) or last is None or now - last >= self.gap
            last = int(now) if ok else last
            keep.append(ok)
        self.state.update((last,))
        yield pdf[keep]


def throttle_stream(rows: DataFrame, keys: list[str], time_ms: str, gap_ms: int, order: list[str] | None = None, passes: str | None = None) -> DataFrame:
    """The streaming twin of detect.throttle, null keys and times included: rows at least gap_ms after the last kept one of their key."""
    return rows.groupBy(*keys).transformWithStateInPandas(ThrottleProcessor(time_ms, gap_ms, order or [time_ms], passes), rows.schema, "Append", "None")


class CounterProcessor(_OneState):
    """Epochs of a frame counter."""

    state_schema = "epoch bigint, top bigint"

    def __init__(self, gap: int, order: str, index: str):
        self.gap, self.order, self.index = gap, order, index

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable", na_position="first")
        epoch, top = self.value() or (0, 0)
        epochs, tops = [], []
        for i in pdf[self.index].tolist():
            if pd.isna(i) or i < 0:
                pass
            elif top != 0 and i + self.gap < top:
                epoch, top = epoch + 1, i
            else:
                top = max(top, i)
            epochs.append(epoch)
            tops.append(top)
        self.state.update((int(epoch), int(top)))
        yield pdf.assign(epoch=epochs, max_seen=tops)


def counter_epoch_stream(stream: DataFrame, key: str = "device_id", order: str = "seq", index: str = "image_index", gap: int = 1000) -> DataFrame:
    """The streaming twin of packets.counter_epoch: stream with epoch and max_seen."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema) + ", epoch bigint, max_seen bigint"
    return stream.groupBy(key).transformWithStateInPandas(CounterProcessor(gap, order, index), schema, "Append", "None")


class LapProcessor(_OneState):
    """Lap times: state is the last angle, the last crossing, whether the timer runs, and the epoch."""

    state_schema = "prev double, crossed bigint, running boolean, epoch bigint"

    def __init__(self, jump: float):
        self.jump = jump

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["us", "kind", "n"], kind="stable")
        prev, crossed, running, epoch = self.value() or (None, None, False, 0)
        out = []
        for r in pdf.itertuples():
            if r.kind == 0:
                if r.cmd == "stop":
                    running = False
                elif r.cmd in ("turnLeft", "turnRight"):  # other commands leave the timer alone
                    running, crossed, epoch = True, None, epoch + 1
                continue
            if running and prev is not None and abs(r.angle_deg - prev) > self.jump:
                if crossed is not None:
                    out.append((r.device_id, epoch, r.us, (r.us - crossed) / 1e6))
                crossed = int(r.us)
            prev = float(r.angle_deg)
        self.state.update((prev, crossed, bool(running), int(epoch)))
        yield pd.DataFrame(out, columns=["device_id", "epoch", "us", "lap_seconds"])


def lap_stream(events: DataFrame, jump: float = 300.0) -> DataFrame:
    """Laps of events(device_id, us, kind, n, angle_deg, cmd): kind 0 is a turntable command, 1 an angle sample."""
    return events.groupBy("device_id").transformWithStateInPandas(LapProcessor(jump), "device_id bigint, epoch bigint, us bigint, lap_seconds double", "Append", "None")


class ResyncProcessor(_OneState):
    """Turntable frames from a byte stream; state is the incomplete frame."""

    state_schema = "rest binary"

    def __init__(self, compat: bool):
        self.compat = compat

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("chunk_seq", kind="stable", na_position="first")
        had = self.value()
        rest, out = (bytes(had[0]) if had else b""), []
        for r in pdf.itertuples():
            found, rest = resync(rest + bytes(r.data or b""), self.compat)
            out += [(r.device_id, r.chunk_seq, k, cmd, angle) for k, (cmd, angle) in enumerate(found)]
        self.state.update((rest,))
        yield pd.DataFrame(out, columns=["device_id", "chunk_seq", "nth", "cmd2", "angle_deg"])


def resync_stream(chunks: DataFrame, compat: bool = False) -> DataFrame:
    """The streaming twin of packets.turntable_resync: angle frames of chunks(device_id, chunk_seq, data)."""
    return chunks.groupBy("device_id").transformWithStateInPandas(ResyncProcessor(compat), "device_id bigint, chunk_seq bigint, nth int, cmd2 int, angle_deg double", "Append", "None")


KEYS = ("device_id", "channel")
_FRAME = ["image_index", "generation", "epoch", "packets", "bytes", "payload", "reason"]


def _frame_schema(packets: DataFrame, keys: tuple[str, ...]) -> str:
    kinds = ", ".join(f"`{k}` {packets.schema[k].dataType.simpleString()}" for k in keys)
    return f"{kinds}, image_index bigint, generation bigint, epoch bigint, packets int, bytes bigint, payload {packets.schema['payload'].dataType.simpleString()}, reason string"


def _pool_rows(pool: BufferPool, key: tuple, r: Any, text: bool) -> list[tuple]:
    done, evicted = pool.add(int(r.image_index), int(r.total_size), r.payload, int(r.rx_ms))
    whole = lambda parts: ("" if text else b"").join(p for p in parts if p is not None)
    return [(*key, i, g, e, n, size, whole(parts), None) for i, g, e, n, size, parts in done] + [(*key, i, None, pool.epoch, None, None, None, why) for i, why in evicted]


class ReassemblyProcessor(StatefulProcessor):
    """Open frames of a device's channel in a map state, with counter epochs, the sequence watermark, stalls and sweeps.

    timers: a frame that is idle or old when the watermark passes its limit goes even if its channel has fallen silent."""

    def __init__(self, keys: tuple[str, ...], payload: str, options: dict[str, int], timers: bool = False):
        self.keys, self.payload, self.options, self.timers = keys, payload, options, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", "top bigint, epoch bigint, seen bigint")
        self.open = handle.getMapState("open", "image_index bigint", f"total bigint, bytes bigint, created bigint, updated bigint, swept bigint, generation bigint, parts array<{self.payload}>")
        self.generations = handle.getMapState("generations", "image_index bigint", "generation bigint")

    def _pool(self) -> BufferPool:
        pool, text = BufferPool(**self.options), self.payload == "string"
        if self.counters.exists():
            pool.top, pool.epoch, pool.seen = self.counters.get()
        for (i,), v in self.open.iterator():
            parts = list(v[6]) if text else [None if p is None else bytes(p) for p in v[6]]
            pool.open[i] = [v[0], v[1], parts, v[2], v[3], v[4], v[5]]
        for (i,), v in self.generations.iterator():
            pool.generation[i] = v[0]
        return pool

    def _set_timer(self, pool: BufferPool) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if (due := pool.due()) is not None:
            self.handle.registerTimer(due)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:
        pool, text = self._pool(), self.payload == "string"
        before, known = set(pool.open), dict(pool.generation)
        out = []
        for r in pd.concat(list(rows)).sort_values("arrival_seq", kind="stable").itertuples():
            out += _pool_rows(pool, key, r, text)
        self.counters.update((pool.top, pool.epoch, pool.seen))
        for i in before - set(pool.open):
            self.open.removeKey((i,))
        for i in pool.touched & set(pool.open):  # only what changed is written
            total, size, parts, created, updated, swept, generation = pool.open[i]
            self.open.updateValue((i,), (total, size, created, updated, swept, generation, parts))
        for i in set(known) - set(pool.generation):
            self.generations.removeKey((i,))
        for i, g in pool.generation.items():
            if known.get(i) != g:
                self.generations.updateValue((i,), (g,))
        if self.timers:
            self._set_timer(pool)
        yield pd.DataFrame(out, columns=[*self.keys, *_FRAME])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        pool = self._pool()
        gone = pool.expire(int(expiredTimerInfo.getExpiryTimeInMs()))
        for i, _ in gone:
            self.open.removeKey((i,))
        if (due := pool.due()) is not None:
            self.handle.registerTimer(due)
        yield pd.DataFrame([(*key, i, None, pool.epoch, None, None, None, why) for i, why in gone], columns=[*self.keys, *_FRAME])

    def close(self) -> None:
        pass


def whole_packets(packets: DataFrame) -> DataFrame:
    """Packets that have an image index, a total size and a time; the others belong to no frame and are rejected."""
    return packets.filter("image_index is not null and total_size is not null and rx_ms is not null")


def reassembly_stream(packets: DataFrame, keys: tuple[str, ...] = KEYS, late: str | None = None, **options: int) -> DataFrame:
    """Complete frames (reason null) and evictions (with a reason) of packets(keys, arrival_seq, rx_ms, ..), payloads BINARY or STRING.

    Null keys are keys, a null payload has no bytes; see whole_packets() for what is rejected. late: how far rx_ms may lie
    behind the largest one; with it a frame also goes when the largest, less `late`, passes its stall or age limit
    while its channel is silent; packets that come behind that are dropped."""
    packets = whole_packets(packets)
    processor = ReassemblyProcessor(keys, packets.schema["payload"].dataType.simpleString(), options, late is not None)
    schema = _frame_schema(packets, keys)
    if late is None:
        return packets.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "None")
    timed = packets.withColumn("__at", F.timestamp_millis("rx_ms")).withWatermark("__at", late)
    return timed.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


class PairProcessor(StatefulProcessor):
    """The first frame of each channel of a request; kept until `keep_ms` after its first snapshot, whether paired or not."""

    def __init__(self, keep_ms: int):
        self.keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "rgb bigint, bw bigint, done boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:
        pdf, had = pd.concat(list(rows)).sort_values(["ts", "frame_no"], kind="stable"), self.state.exists()
        rgb, bw, done = self.state.get() if had else (None, None, False)
        for channel, frame in zip(pdf["channel"].tolist(), pdf["frame_no"].tolist()):
            if channel == "RGB" and rgb is None:
                rgb = int(frame)
            elif channel == "BW" and bw is None:
                bw = int(frame)
        whole = rgb is not None and bw is not None
        self.state.update((rgb, bw, whole))
        if not had:
            self.handle.registerTimer(int(pdf["ts"].iloc[0].timestamp() * 1000) + self.keep)
        yield pd.DataFrame([(key[0], rgb, bw)] if whole and not done else [], columns=["request_id", "rgb_frame", "bw_frame"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=["request_id", "rgb_frame", "bw_frame"])

    def close(self) -> None:
        pass


def snapshot_pair_stream(snapshots: DataFrame, late: str = "10 seconds", keep_ms: int = 60_000) -> DataFrame:
    """The streaming twin of frames.snapshot_pair: a request's pair in the batch that completes it, once.

    snapshots(request_id, channel, ts, frame_no). A request is remembered until the watermark (the largest ts less
    `late`) is keep_ms behind its first snapshot; times without zone are cast. Rows without ts or frame are left out."""
    kind = snapshots.schema["request_id"].dataType.simpleString()
    timed = snapshots.filter("ts is not null and frame_no is not null").select("request_id", "channel", F.col("ts").cast("timestamp").alias("ts"), F.col("frame_no").cast("long").alias("frame_no")).withWatermark("ts", late)
    return timed.groupBy("request_id").transformWithStateInPandas(PairProcessor(keep_ms), f"request_id {kind}, rgb_frame bigint, bw_frame bigint", "Append", "EventTime")


def command_reply_stream(commands: DataFrame, replies: DataFrame, limit_s: int = 5, late: str = "10 seconds") -> DataFrame:
    """The streaming twin of messages.command_reply_match: cmd_id, device_id, cmd, ts, reply_ts, latency_s.

    An outer stream join bounded in time, then the first reply of each command. The join's keys hold a slot of limit_s seconds, so that a
    reply meets the commands of its time and not all of its device that state still holds. A command comes out, answered or not,
    when the watermarks of both streams have passed its limit; state behind that is dropped. Times are cast to TIMESTAMP."""
    from ..functions import messages as m

    asked = commands.select("cmd_id", "device_id", "cmd", F.col("ts").cast("timestamp").alias("ts"), m.command_text(F.col("cmd")).alias("__cmd")).withWatermark("ts", late)
    answers = replies.select(F.col("device_id").alias("__device"), m.reply_command(F.col("reply")).alias("__said"), F.col("ts").cast("timestamp").alias("reply_ts")).withWatermark("reply_ts", late)
    near = F.col("reply_ts").between(F.col("ts"), F.col("ts") + F.expr(f"INTERVAL {limit_s} SECONDS"))
    slot = lambda c: F.floor(F.unix_micros(c) / F.lit(max(1, limit_s) * 1_000_000)).cast("long")
    asked = asked.withColumn("__slot", F.explode(F.array(slot("ts"), slot("ts") + 1)))  # a reply in time lies in one of the two
    answers = answers.withColumn("__at", slot("reply_ts"))
    pairs = asked.join(answers, (F.col("device_id") == F.col("__device")) & (F.col("__cmd") == F.col("__said")) & (F.col("__slot") == F.col("__at")) & near, "leftOuter")
    first = pairs.groupBy("cmd_id", "device_id", "cmd", "ts").agg(F.min("reply_ts").alias("reply_ts"))
    return first.withColumn("latency_s", (F.unix_micros("reply_ts") - F.unix_micros("ts")) / F.lit(1e6))


class _Part:
    """A packet's payload for a BufferPool: its length, and where it is found."""

    __slots__ = ("at", "size")

    def __init__(self, at: tuple, size: int | None):
        self.at, self.size = at, size or 0

    def __len__(self) -> int:
        return self.size


def reassembly_batch(packets: DataFrame, keys: tuple[str, ...] = KEYS, **options: int) -> DataFrame:
    """The batch twin of reassembly_stream: a channel's packets stream through one task, the pool is its state.

    That task reads the packets' numbers and sizes alone and names each frame's packets by arrival_seq and a hash; payloads
    are joined to them frame by frame."""
    kind = packets.schema["payload"].dataType.simpleString()
    numbers = ["image_index", "total_size", "rx_ms"]
    rows = whole_packets(packets).select(*keys, "arrival_seq", *numbers, "payload", F.xxhash64(*numbers, "payload").alias("__hash"))
    columns = [*keys, *(c for c in _FRAME if c != "payload"), "parts"]
    schema = _frame_schema(packets, keys).replace(f" payload {kind},", "") + ", parts array<struct<seq:bigint,hash:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, pool, named = (), BufferPool(**options), pa.list_(pa.struct([("seq", pa.int64()), ("hash", pa.int64())]))
        for batch in batches:
            out, kinds = [], [batch.schema.field(k).type for k in keys] + [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), named]
            fields = [batch.column(c).to_pylist() for c in (*numbers, "arrival_seq", "__hash", "__size")]
            for key, index, total, now, seq, digest, size in zip(zip(*[batch.column(k).to_pylist() for k in keys]), *fields):
                if key != who:
                    who, pool = key, BufferPool(**options)
                done, evicted = pool.add(int(index), int(total), _Part((seq, digest), size), int(now))
                out += [(*key, i, g, e, n, held, None, [{"seq": p.at[0], "hash": p.at[1]} for p in parts]) for i, g, e, n, held, parts in done]
                out += [(*key, i, None, pool.epoch, None, None, why, None) for i, why in evicted]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], columns)

    order = [*keys, "arrival_seq", "__hash"]
    sizes = rows.select(*order[:-1], *numbers, "__hash", F.octet_length("payload").alias("__size"))
    found = written(sizes.repartition(*keys).sortWithinPartitions(*order).mapInArrow(run, schema).withColumn("__frame", F.monotonically_increasing_id()), "frames")
    each = rows.groupBy(*order).agg(F.first("payload").alias("payload")).select(*[F.col(c).alias(f"__of_{c}") for c in order], "payload")  # alike packets once
    parts = found.select("__frame", *keys, F.posexplode("parts").alias("__nth", "p")).select("__frame", "__nth", *keys, F.col("p.seq").alias("arrival_seq"), F.col("p.hash").alias("__hash"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in order])
    whole = parts.join(each, same).groupBy("__frame").agg(F.expr("listagg(payload) within group (order by __nth)").alias("payload"))
    payload = F.when(F.col("reason").isNull(), F.coalesce("payload", F.lit("").cast(kind)))
    return found.drop("parts").join(whole, "__frame", "left").withColumn("payload", payload).select(*keys, *_FRAME)


class DetectionProcessor(_OneState):
    """throttle, then detection throttle, then one flag per target, then the lap reset; a clear event lowers the flags."""

    state_schema = "seen bigint, looked bigint, prev double, lap bigint, found array<int>, epoch bigint"

    def __init__(self, targets: list[int], frame_ms: int, detect_ms: int, tolerance: float, clears: bool = False):
        self.targets, self.frame_ms, self.detect_ms, self.tolerance, self.clears = targets, frame_ms, detect_ms, tolerance, clears

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        pdf["clear"] = pdf["clear"].astype(bool) if self.clears else False
        pdf = pdf.sort_values(["ms", "clear", "frame_no"], ascending=[True, False, True], kind="stable")
        seen, looked, prev, lap, found, epoch = self.value() or (None, None, None, 0, [], 0)
        found, out = set(found), []
        for r in pdf.itertuples():
            if r.clear:
                found, epoch = set(), epoch + 1
                continue
            if seen is not None and r.ms - seen < self.frame_ms:
                continue
            seen = int(r.ms)
            if looked is None or r.ms - looked >= self.detect_ms:
                looked = int(r.ms)
                for t in self.targets:
                    d = abs(r.angle_deg - t)
                    if t not in found and min(d, 360 - d) < self.tolerance:
                        found.add(t)
                        out.append((*key, lap, t, int(r.frame_no), epoch))
            if prev is not None and prev > 300 and r.angle_deg < 60:
                lap, found = lap + 1, set()
            prev = float(r.angle_deg)
        self.state.update((seen, looked, prev, int(lap), sorted(found), int(epoch)))
        got = pd.DataFrame(out, columns=["device_id", "channel", "lap_id", "target", "frame_no", "epoch"])
        yield got if self.clears else got.drop(columns="epoch")


def detection_stream(frames: DataFrame, targets: list[int], frame_ms: int = 33, detect_ms: int = 120, tolerance: float = 2.0) -> DataFrame:
    """Detections of frames(device_id, channel, ms, frame_no, angle_deg) for a short list of targets.

    Frames with a column clear (see clearing.with_clears) hold clear events among them: each lets the targets be found anew, and
    the column epoch counts them."""
    clears = "clear" in frames.columns
    schema = "device_id bigint, channel string, lap_id bigint, target int, frame_no bigint" + (", epoch bigint" if clears else "")
    return frames.groupBy("device_id", "channel").transformWithStateInPandas(DetectionProcessor(targets, frame_ms, detect_ms, tolerance, clears), schema, "Append", "None")


class CoverageProcessor(_OneState):
    """Filled tiles of a (device, channel); a clear event or another segment count empties them."""

    state_schema = "segments int, tiles array<bigint>"

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        segments, tiles = self.value() or (0, [])
        tiles = set(tiles)
        for r in pdf.itertuples():
            if r.clear or r.segments != segments:
                segments, tiles = int(r.segments), set()
            if not r.clear and 0 <= r.tile_index < segments:
                tiles.add(int(r.tile_index))
        self.state.update((segments, sorted(tiles)))
        yield pd.DataFrame({"device_id": [key[0]], "channel": [key[1]], "segments": [segments], "tiles": [len(tiles)], "full": [segments > 0 and len(tiles) == segments]})


def coverage_stream(events: DataFrame) -> DataFrame:
    """Coverage after each micro-batch, of events(device_id, channel, seq, tile_index, segments, clear)."""
    return events.groupBy("device_id", "channel").transformWithStateInPandas(CoverageProcessor(), "device_id bigint, channel string, segments int, tiles int, full boolean", "Update", "None")


def mosaic_stream(frames: DataFrame, segments: int = 32, half_turn: bool = True) -> DataFrame:
    """The latest frame per tile, in update mode: write it with foreachBatch as an upsert.

    Frames with a column clear (see clearing.with_clears) hold clear events among them: a (device, channel) then has one more row,
    of null tile, whose cleared is the time of its last one, and mosaic_table leaves out the tiles before it. Frame numbers
    must rise with time there."""
    from ..operators.frames import mosaic_latest

    if "clear" not in frames.columns:
        return mosaic_latest(frames, segments, half_turn)
    marked = frames.withColumn("__cleared", F.when(F.col("clear"), F.col("ts")))
    tile = F.col("tile_index")
    if half_turn:
        tile = F.when(F.col("channel") == "BW", angles.half_turn_shift(tile, segments)).otherwise(tile)
    return marked.withColumn("tile_index", tile).groupBy("device_id", "channel", "tile_index").agg(
        F.max("frame_no").alias("frame_no"), F.max_by("ts", "frame_no").alias("ts"), F.max("__cleared").alias("cleared"))


class RechunkProcessor(StatefulProcessor):
    """Images of a session laid side by side; state is the columns that wait for more, and the next frame's number."""

    def __init__(self, width: int, depth: int):
        self.width, self.depth = width, depth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "next bigint, height int, rest binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("image_no", kind="stable")
        number, height, rest = self.state.get() if self.state.exists() else (0, 0, b"")
        left, line = np.frombuffer(rest, np.uint8).reshape(height, -1) if height else np.zeros((0, 0), np.uint8), self.width * self.depth

        def beside(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """a and b side by side, the lower one filled with zeros."""
            out = np.zeros((max(len(a), len(b)), a.shape[1] + b.shape[1]), np.uint8)
            out[: len(a), : a.shape[1]], out[: len(b), a.shape[1] :] = a, b
            return out

        out, held, names = [], 0, ["session", "frame_no", "height", "width", "data"]
        for h, w, data in zip(pdf["height"].tolist(), pdf["width"].tolist(), pdf["data"].tolist()):
            image, at = np.frombuffer(data, np.uint8).reshape(int(h), int(w) * self.depth), 0
            while left.shape[1] + image.shape[1] - at >= line:
                take = line - left.shape[1]
                frame, left, at = beside(left, image[:, at : at + take]), np.zeros((0, 0), np.uint8), at + take
                out.append((key[0], number, len(frame), self.width, frame.tobytes()))
                number, held = number + 1, held + frame.size
                if held > 1 << 22 or len(out) >= 5000:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            if at < image.shape[1]:
                left = beside(left, image[:, at:])
        self.state.update((int(number), len(left), left.tobytes()))
        if out:
            yield pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def rechunk_stream(images: DataFrame, width: int = WIDTH, depth: int = 1) -> DataFrame:
    """The streaming twin of pixels.rechunk_pixels: a frame comes out with the image that completes it.

    images(session, image_no, height, width, data) in the order of image_no; those without a session or number, and what
    whole_rasters() rejects, are left out. State is less than one frame a session."""
    kind = images.schema["session"].dataType.simpleString()
    own = whole_rasters(images, depth).filter("session is not null and image_no is not null").select("session", "image_no", "height", "width", "data")
    return own.groupBy("session").transformWithStateInPandas(RechunkProcessor(width, depth), f"session {kind}, frame_no bigint, height int, width bigint, data binary", "Append", "None")


def rx_stats_stream(events: DataFrame, seconds: int = 3, late: str = "10 seconds") -> DataFrame:
    """Tumbling receive statistics by event time (messages.rx_aggregates); rows come out once the watermark passes their window.

    Times without zone are cast, as a watermark needs a TIMESTAMP."""
    timed = events.withColumn("rx_ts", F.col("rx_ts").cast("timestamp")).withWatermark("rx_ts", late)
    out = timed.groupBy("device_id", F.window("rx_ts", f"{seconds} seconds").alias("w")).agg(*rx_aggregates(events))
    return out.select("device_id", F.unix_seconds("w.start").alias("win_start"), *[c for c in out.columns if c not in ("device_id", "w")])


class TotalsProcessor(_OneState):
    """Totals over a device's windows in their order; state is the totals and the last window's packets."""

    state_schema = "packets bigint, wakes bigint, last bigint"

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("win_start", kind="stable")
        packets, wakes, last = self.value() or (0, 0, 0)
        n = pdf["packets"].astype("int64")
        out = pdf.assign(total_packets=packets + n.cumsum(), delta_packets=n.diff().fillna(n - last).astype("int64"))
        if "wakes" in pdf:
            out["total_wakes"] = wakes + pdf["wakes"].astype("int64").cumsum()
            wakes = int(out["total_wakes"].iloc[-1])
        self.state.update((int(out["total_packets"].iloc[-1]), wakes, int(n.iloc[-1])))
        yield out


def running_totals_stream(stats: DataFrame) -> DataFrame:
    """The streaming twin of messages.running_totals, over rx_stats_stream's rows: a second stateful operator behind the windows.

    Windows come out in the order of the watermark, so their totals are final."""
    extra = ", total_packets bigint, delta_packets bigint" + (", total_wakes bigint" if "wakes" in stats.columns else "")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema) + extra
    return stats.groupBy("device_id").transformWithStateInPandas(TotalsProcessor(), schema, "Append", "None")
