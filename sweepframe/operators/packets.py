"""Datagrams and frames: classification, decoding, counter epochs, reassembly, eviction.

Frames are keyed by device or image type and by image index. Everything is ordered by
arrival_seq; the operators shuffle on their key and sort within it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import wire
from . import folds
from .folds import counter_epoch  # noqa: F401
from .sliced import running

RESET_GAP, WINDOW, STALL_MS, HARD_MS, SWEEP, MAX_OPEN = 1000, 30, 1500, 5000, 64, 128


def packet_classify(raw: DataFrame, column: str = "datagram") -> DataFrame:
    """raw with kind: `binary` (header code and 20 bytes), `text` (a path message) or `reject`."""
    text = F.try_to_utf8_string(column) if hasattr(F, "try_to_utf8_string") else F.try_validate_utf8(F.col(column).cast("string"))
    from ..functions.messages import path_type

    return raw.withColumn("kind", F.when(wire.is_packet(F.col(column)), "binary").when(path_type(text).isNotNull(), "text").otherwise("reject"))


def packet_header_decode(raw: DataFrame, column: str = "datagram") -> DataFrame:
    """The seven header fields and the payload of binary datagrams; others are dropped before any shuffle."""
    d = F.col(column)
    keep = [c for c in raw.columns if c != column]
    return raw.filter(wire.is_packet(d)).select(*keep, *wire.header_fields(d), F.substring(d, wire.HEADER_BYTES + 1, 1 << 30).alias("payload"))


def turntable_frame_decode(frames: DataFrame, column: str = "frame") -> DataFrame:
    """angle_deg of valid angle frames: seven bytes, 0xFF first, right checksum, second command 0x59."""
    d = F.col(column)
    b = [wire.byte_at(d, i) for i in range(7)]
    good = (F.length(d) == 7) & (b[0] == 0xFF) & (wire.checksum(*b[1:6]) == b[6]) & (b[3] == 0x59)
    keep = [c for c in frames.columns if c != column]
    return frames.filter(good).select(*keep, b[3].cast("int").alias("cmd2"), F.pmod((b[4] * 256 + b[5]) / F.lit(100.0), F.lit(360.0)).alias("angle_deg"))


def turntable_command_encode(commands: DataFrame) -> DataFrame:
    """commands(cmd, speed, ..) with frame_hex, the seven bytes sent for them; null for unknown names."""
    table = F.broadcast(commands.sparkSession.createDataFrame(list(wire.COMMANDS), "cmd string, c1 int, c2 int, d1 int, d2 int"))  # eight rows
    arg = F.col("speed").cast("int")
    high = F.when(F.col("cmd") == "setOrthoLength", F.shiftright(arg, 8)).otherwise(arg).bitwiseAND(F.lit(0xFF))
    joined = commands.join(table, "cmd", "left")
    d1, d2 = F.coalesce("d1", high), F.coalesce("d2", arg.bitwiseAND(F.lit(0xFF)))
    return joined.withColumn("frame_hex", F.when(F.col("c1").isNotNull(), wire.command_hex(F.col("c1"), F.col("c2"), d1, d2))).drop("c1", "c2", "d1", "d2")


def resync(buffer: bytes, compat: bool = False) -> tuple[list[tuple[int, float]], bytes]:
    """(cmd2, angle) of the angle frames in a buffer, and the bytes that wait for more.

    Bytes before 0xFF are skipped; a bad checksum drops one byte. compat keeps the last 512 bytes of
    a buffer beyond 4096 before looking."""
    if compat and len(buffer) > 4096:
        buffer = buffer[-512:]
    found, at = [], 0
    while True:
        at = buffer.find(b"\xff", at)
        if at < 0:
            return found, b""
        if len(buffer) - at < 7:
            return found, buffer[at:]
        f = buffer[at : at + 7]
        if sum(f[1:6]) & 0xFF != f[6]:
            at += 1
            continue
        if f[3] == 0x59:
            found.append((f[3], (f[4] * 256 + f[5]) / 100.0 % 360.0))
        at += 7


def turntable_resync(chunks: DataFrame, compat: bool = False, slices: int | None = None) -> DataFrame:
    """Angle frames of serial chunks(device_id, rx_ts, chunk_seq, data): device_id, ts, chunk_seq, nth, cmd2, angle_deg.

    A device's chunks are one stream in the order of chunk_seq (nulls first), in slices that different tasks
    scan. Null data is no bytes, rows without device are one device."""
    return folds.turntable_resync(chunks, resync, compat, slices)


def seq_watermark(packets: DataFrame, keys: list[str], window: int = WINDOW) -> DataFrame:
    """packets with kept: whether the frame number was not yet more than `window` behind when it came."""
    seen = running(packets, keys, ["arrival_seq"], {"__top": ("max", F.col("image_index"), False)})
    return seen.withColumn("kept", F.col("image_index") >= F.col("__top") - window).drop("__top")


def stall_timeout(packets: DataFrame, channel: list[str], stall_ms: int = STALL_MS, hard_ms: int = HARD_MS) -> DataFrame:
    """packets with stalled and old: the frame had been idle, or open, too long when this packet came.

    It is stalled if another packet of the channel came in between, more than stall_ms after the frame's packet
    before, and old if that was more than hard_ms after the frame's first packet (it is then that the
    sweep finds the frame without new bytes)."""
    frame = Window.partitionBy(*channel, "image_index").orderBy("arrival_seq")
    out = running(packets, channel, ["arrival_seq"], {"__near": ("last", F.struct("rx_ms", "arrival_seq"), True)})
    out = out.withColumn("__last", F.lag("rx_ms").over(frame)).withColumn("__seq", F.lag("arrival_seq").over(frame)).withColumn("__first", F.first("rx_ms").over(frame))
    between = F.col("__near.arrival_seq") > F.col("__seq")
    late = lambda since, limit: F.coalesce(between & (F.col("__near.rx_ms") - F.col(since) > limit), F.lit(False))
    return out.withColumn("stalled", late("__last", stall_ms)).withColumn("old", late("__first", hard_ms)).drop("__last", "__seq", "__first", "__near")


def size_of(payload) -> int:
    """Bytes of a payload; text counts as UTF-8, null as nothing."""
    return 0 if payload is None else len(payload.encode()) if isinstance(payload, str) else len(payload)


def _type(rows: DataFrame, name: str) -> str:
    return rows.schema[name].dataType.simpleString()


def frame_reassembly(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Frames from packets(.., image_index, arrival_seq, total_size, payload) in arrival order, block numbers ignored: one row per generation.

    The bytes received count, whatever the header says of its block. A frame's total size is the first one
    above zero; it is complete once its bytes reach that, and later packets of the same index begin the next
    generation. payload keeps its type, BINARY or STRING. One shuffle by frame; a task holds one open
    generation and puts its payload together where the packets come by."""
    own = ["image_index", "arrival_seq", "total_size", "payload"]
    rows = packets.select(*keys, *own)
    who = [*keys, "image_index"]
    schema = ", ".join([*(f"`{c}` {_type(rows, c)}" for c in who), "generation bigint", "packets bigint", "bytes bigint", f"payload {_type(rows, 'payload')}", "complete boolean"])
    text = _type(rows, "payload") == "string"
    kinds = [*(rows.schema[c].dataType for c in who)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [*(to_arrow_type(k) for k in kinds), pa.int64(), pa.int64(), pa.int64(), pa.string() if text else pa.binary(), pa.bool_()]
        names = [*who, "generation", "packets", "bytes", "payload", "complete"]
        now, generation, got, total, parts, out, held = None, 0, 0, 0, [], [], 0

        def close(complete: bool) -> None:
            nonlocal held
            out.append((*now, generation, len(parts), got, ("" if text else b"").join(p for p in parts if p is not None), complete))
            held += got

        def flush() -> pa.RecordBatch:
            nonlocal held
            ready = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out.clear()
            held = 0
            return ready

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*who, "total_size", "payload")]
            for *key, size, payload in zip(*columns):
                if key != now:
                    if parts:
                        close(False)
                    now, generation, got, total, parts = key, 0, 0, 0, []
                total = total or size or 0
                got += size_of(payload)
                parts.append(payload)
                if total > 0 and got >= total:
                    close(True)
                    generation, got, total, parts = generation + 1, 0, 0, []
                    if held >= 1 << 22:
                        yield flush()
        if parts:
            close(False)
        if out:
            yield flush()

    return rows.repartition(*who).sortWithinPartitions(*who, "arrival_seq").mapInArrow(run, schema)


def frame_reassembly_ordered(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Frames from distinct blocks in block order; complete when their bytes add up to the total size.

    Of a block that came twice the first packet counts. payload keeps its type, BINARY or STRING."""
    first = packets.groupBy(*keys, "image_index", "block_index").agg(F.min_by(F.struct("total_size", "payload"), "arrival_seq").alias("p"))
    nothing = F.lit("").cast(_type(packets, "payload"))
    out = first.groupBy(*keys, "image_index").agg(
        F.count("*").alias("blocks"), F.coalesce(F.sum(F.octet_length("p.payload")), F.lit(0)).cast("long").alias("bytes"), F.max("p.total_size").cast("long").alias("total_size"),
        F.coalesce(F.expr("listagg(p.payload) within group (order by block_index)"), nothing).alias("payload"))
    return out.withColumn("complete", F.col("bytes") == F.col("total_size"))


def payload_blocks(frames: DataFrame, payload: str = "payload", size: int = 8000) -> DataFrame:
    """frames cut into blocks of bytes: block_index, block_size, offset, total_size, block; an empty or null payload has none."""
    data = F.col(payload).cast("binary")
    n = F.length(data)
    keep = [c for c in frames.columns if c != payload]
    at = F.explode(F.sequence(F.lit(0), (F.ceil(n / F.lit(size)) - 1).cast("int")))
    out = frames.filter(n > 0).withColumn("block_index", at)
    block = F.substring(data, F.col("block_index") * size + 1, size)
    return out.select(*keep, "block_index", F.length(block).alias("block_size"), (F.col("block_index") * size).cast("long").alias("offset"), n.alias("total_size"), block.alias("block"))


class BufferPool:
    """Open frames of one device and channel, with the eviction rules; used by the batch and the streaming form.

    add() returns (complete frames, evicted (index, reason)). sweep: every so many packets, and when more
    than max_open frames are open, frames are evicted that are `window` behind the largest index, or had
    no new bytes since the sweep before and are idle for stall_ms or old for hard_ms. A total size of zero
    waits for the next one. A sweep also forgets the generations of frames behind the window, so
    state is bounded. touched: the frames to write back."""

    def __init__(self, window: int = WINDOW, stall_ms: int = STALL_MS, hard_ms: int = HARD_MS, sweep: int = 1, max_open: int = MAX_OPEN, gap: int = RESET_GAP):
        self.window, self.stall, self.hard, self.sweep, self.most, self.gap = window, stall_ms, hard_ms, sweep, max_open, gap
        self.top, self.epoch, self.seen = 0, 0, 0
        self.open: dict[int, list] = {}  # index: [total, bytes, parts, created, updated, bytes at last sweep, generation]
        self.generation: dict[int, int] = {}
        self.touched: set[int] = set()

    def add(self, index: int, total: int, payload, now: int) -> tuple[list[tuple], list[tuple[int, str]]]:
        evicted = []
        if self.top != 0 and index + self.gap < self.top:
            evicted += [(i, "reset") for i in self.open]
            self.open.clear()
            self.generation.clear()
            self.top, self.epoch = index, self.epoch + 1
        else:
            self.top = max(self.top, index)
        self.seen += 1
        f = self.open.setdefault(index, [0, 0, [], now, now, 0, self.generation.get(index, 0)])
        self.touched.add(index)
        if not f[0]:
            f[0], f[3], f[5] = total, now, 0
        f[1] += size_of(payload)
        f[2].append(payload)
        f[4] = now
        gone = False
        if self.seen % self.sweep == 0 or len(self.open) > self.most:
            for i in list(self.open):
                o = self.open[i]
                reason = None
                if i < self.top - self.window:
                    reason = "late" if i == index else "behind"
                elif o[1] == o[5]:
                    reason = "stalled" if now - o[4] > self.stall else "old" if now - o[3] > self.hard else None
                else:
                    o[5] = o[1]
                    self.touched.add(i)
                if reason:
                    evicted.append((i, reason))
                    gone = gone or i == index
                    del self.open[i]
            for i in [i for i in self.generation if i < self.top - self.window]:
                del self.generation[i]
        done = []
        if not gone and f[0] > 0 and f[1] >= f[0]:
            done.append((index, f[6], self.epoch, len(f[2]), f[1], f[2]))
            del self.open[index]
            self.generation[index] = f[6] + 1
        return done, evicted

    def expire(self, now: int) -> list[tuple[int, str]]:
        """Frames that are idle or old at a time at which no packet came: (index, reason)."""
        gone = [(i, "stalled" if now - o[4] > self.stall else "old") for i, o in self.open.items() if now - o[4] > self.stall or now - o[3] > self.hard]
        for i, _ in gone:
            del self.open[i]
        return gone

    def due(self) -> int | None:
        """The first time at which expire() finds one of the open frames."""
        return min((min(o[4] + self.stall, o[3] + self.hard) + 1 for o in self.open.values()), default=None)
