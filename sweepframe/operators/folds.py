"""Folds whose state depends on every row before, over slices of a key.

A key's rows are cut into slices of their order, which different tasks read. A slice's effect is a function of
the state that enters it, and each of these folds has one that is small however long the slice is:

* a throttle's last kept time is a step function of the clock that enters, with at most a step for each
  millisecond of the gap, as only rows within one gap of the slice's start can be the first kept;
* a counter's epoch follows from the first reset, which is at one of the slice's record lows, of which
  at most gap + 1 come before the slice resets by itself;
* a serial line's waiting bytes are at most six, and whatever waits, the scan soon runs in step.

The functions are composed along each key, a row a slice, and then every slice is folded by itself
from the state that enters it. Null keys are keys like any other."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .sliced import slice_of


def _schema(rows: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)


def _sorted(table: pa.Table, order: list[str]) -> pa.Table:
    """In Spark's order: nulls first."""
    return table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in order], null_placement="at_start"))


def _sliced_fold(
    rows: DataFrame, keys: list[str], order: list[str], needed: list[str], effect: Callable[[pa.Table], dict], effect_kinds: dict[str, str],
    compose: Callable[[list[dict]], list[dict]], state_kinds: dict[str, str], apply: Callable[[pa.RecordBatch, dict | None], tuple[pa.RecordBatch, dict]], out_schema: str, slices: int | None) -> DataFrame:
    """rows folded along keys. effect: a slice's function of the state; compose: the state that enters each slice, of
    the effects in order; apply: the output of a stretch of rows and the state after it, from the state before.

    Three passes: the quantiles of the order, the columns `needed` for the effects, and the rows, which are made once for them."""
    rows = written(rows, "fold")
    dealt = rows.withColumn("__slice", slice_of(rows, order[0], slices))
    listed = lambda kinds: ", ".join(f"__{n} {k}" for n, k in kinds.items())
    head = f"{_schema(rows, keys)}{', ' * bool(keys)}__slice int"

    def effects(group: pa.Table) -> pa.Table:
        first = {k: group.column(k)[:1] for k in (*keys, "__slice")}
        return pa.table({**first, **{f"__{k}": pa.array([v], kind) for k, (v, kind) in effect(_sorted(group, order)).items()}})

    def enter(group: pa.Table) -> pa.Table:
        group = _sorted(group, ["__slice"])
        lists = {n: group.column(f"__{n}").to_pylist() for n in effect_kinds}
        states = compose([dict(zip(lists, row)) for row in zip(*lists.values())])
        kinds = {"bigint": pa.int64(), "double": pa.float64()}
        return pa.table({**{k: group.column(k) for k in (*keys, "__slice")}, **{f"__{n}": pa.array([s[n] for s in states], kinds[k]) for n, k in state_kinds.items()}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None
        for batch in batches:
            own = batch.column("__own").to_numpy(zero_copy_only=False)
            edges = [0, *np.flatnonzero(own == 0).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if lo < hi and own[lo] == 0:  # the row in front of a slice
                    state = {n: batch.column(f"__{n}")[lo].as_py() for n in state_kinds}
                    lo += 1
                if lo < hi:
                    out, state = apply(batch.slice(lo, hi - lo), state)
                    if out.num_rows:
                        yield out

    used = list(dict.fromkeys([*keys, "__slice", *order, *needed]))
    found = dealt.select(*used).groupBy(*keys, "__slice").applyInArrow(effects, f"{head}, {listed(effect_kinds)}")
    came = found.groupBy(*keys).applyInArrow(enter, f"{head}, {listed(state_kinds)}")
    both = dealt.withColumn("__own", F.lit(1)).unionByName(came.withColumn("__own", F.lit(0)), allowMissingColumns=True)
    return both.repartition(*keys, "__slice").sortWithinPartitions(*keys, "__slice", "__own", *order).mapInArrow(run, out_schema)


# -- throttling -------------------------------------------------------------------------------


def throttle(rows: DataFrame, keys: list[str], time_ms: str, gap_ms: int, order: list[str] | None = None, passes: str | None = None, slices: int | None = None) -> DataFrame:
    """Rows at least gap_ms after the last kept one of their key; the first is kept.

    passes names a boolean column whose true rows are always kept and move the clock; null is false. Rows go by
    time_ms and then by `order`. A row without a time is kept and leaves the clock alone, null keys are a key of
    their own, and of rows at one time the first in order counts."""
    order = list(dict.fromkeys([time_ms, *(order or [])]))
    names = rows.columns
    kind = "double" if rows.schema[time_ms].dataType.typeName() in ("float", "double", "decimal") else "bigint"
    arrow = pa.float64() if kind == "double" else pa.int64()

    def parts(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of rows with a time, their times, and whether they pass."""
        column = table.column(time_ms)
        at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.is_valid().to_numpy())
        time = column.take(pa.array(at)).cast(arrow)
        free = table.column(passes).fill_null(False).take(pa.array(at)) if passes else None
        to = lambda c: c.to_numpy() if isinstance(c, pa.ChunkedArray) else c.to_numpy(zero_copy_only=False)
        return at, to(time), to(free).astype(bool) if passes else np.zeros(len(at), bool)

    def afterwards(t: np.ndarray, free: np.ndarray) -> np.ndarray:
        """The next kept row of each, if it is kept."""
        n = len(t)
        after = np.maximum(np.searchsorted(t, t + gap_ms), np.arange(n) + 1)
        if free.any():
            at = np.flatnonzero(free)
            after = np.minimum(after, np.append(at, n)[np.searchsorted(at, np.arange(n), "right")])
        return after

    def effect(table: pa.Table) -> dict:
        _, t, free = parts(table)
        upto, ends, alone, sure = [], [], None, len(t)
        if n := len(t):
            after = afterwards(t, free)
            last = np.where(after < n, after, np.arange(n))
            while not np.array_equal(further := last[last], last):
                last = further
            # The first kept row: the first at its time, up to one that is kept whatever came before.
            sure = min(int(np.searchsorted(t, t[0] + gap_ms)), int(np.flatnonzero(free)[0]) if free.any() else n, n)
            first = np.flatnonzero(np.append(True, t[1:] != t[:-1])[: sure + 1])
            if sure < n and first[-1] != sure:
                first = np.append(first, sure)
            reached = t[last[first]]
            step = np.append(reached[1:] != reached[:-1], True)
            upto, ends, alone, sure = t[first][step].tolist(), reached[step].tolist(), t[last[0]].item(), sure < n
        return {"upto": (upto, pa.list_(arrow)), "ends": (ends, pa.list_(arrow)), "alone": (alone, arrow), "sure": (bool(sure), pa.bool_())}

    def compose(effects: list[dict]) -> list[dict]:
        clock, states = None, []
        for e in effects:
            states.append({"clock": clock})
            if e["upto"]:
                if clock is None:
                    clock = e["alone"]
                else:
                    k = bisect_left(e["upto"], clock + gap_ms)
                    if k < len(e["upto"]):
                        clock = e["ends"][k]
                    elif e["sure"]:
                        clock = e["ends"][-1]
        return states

    def apply(batch: pa.RecordBatch, state: dict | None) -> tuple[pa.RecordBatch, dict]:
        clock = state["clock"] if state else None
        at, t, free = parts(batch)
        keep = np.ones(batch.num_rows, bool)
        keep[at] = False
        if n := len(t):
            i = 0 if clock is None else min(int(np.searchsorted(t, clock + gap_ms)), int(np.flatnonzero(free)[0]) if free.any() else n)
            after = afterwards(t, free).tolist()
            kept = []
            while i < n:
                kept.append(i)
                i = after[i]
            if kept:
                keep[at[kept]], clock = True, t[kept[-1]].item()
        return batch.select(names).filter(pa.array(keep)), {"clock": clock}

    return _sliced_fold(rows, keys, order, [c for c in (time_ms, passes) if c], effect, {"upto": f"array<{kind}>", "ends": f"array<{kind}>", "alone": kind, "sure": "boolean"}, compose, {"clock": kind}, apply, _schema(rows, names), slices)


# -- counter epochs ---------------------------------------------------------------------------


def _known(column) -> np.ndarray:
    """Indices, -1 where there is none."""
    x = pc.fill_null(column.cast(pa.int64()), -1)
    return np.maximum(x.to_numpy() if isinstance(x, pa.ChunkedArray) else x.to_numpy(zero_copy_only=False), -1)


def _next_reset(x: np.ndarray, start: int, top: int, gap: int) -> tuple[int, int]:
    """(place of the first reset from start on, or the end; the largest seen before it), read in growing stretches."""
    width = 256
    while start < len(x):
        part = x[start : start + width]
        before = np.maximum.accumulate(np.concatenate([[top], part]))
        hit = np.flatnonzero((part >= 0) & (part + gap < before[:-1]))
        if len(hit):
            return start + int(hit[0]), int(before[hit[0]])
        top, start, width = int(before[-1]), start + len(part), min(2 * width, 1 << 16)
    return len(x), top


def counter_epoch(stream: DataFrame, key: str = "device_id", order: str = "seq", index: str = "image_index", gap: int = 1000, slices: int | None = None) -> DataFrame:
    """stream with epoch and max_seen: a new epoch where the index falls more than `gap` below the largest seen in this one.

    Null and negative indices change nothing. Null keys are a key, rows without an order come first."""
    names = [c for c in stream.columns if c not in ("epoch", "max_seen")]

    def effect(table: pa.Table) -> dict:
        x = _known(table.column(index))
        outcome: dict[int, tuple[int, int]] = {}  # of a reset there: epochs begun from it on, and the largest seen at the end

        def follow(at: int) -> tuple[int, int]:
            way, top = [], 0
            while at < len(x) and at not in outcome:
                way.append(at)
                at, top = _next_reset(x, at + 1, int(x[at]), gap)
            epochs, top = outcome[at] if at < len(x) else (0, top)
            for place in reversed(way):
                epochs += 1
                outcome[place] = epochs, top
            return epochs, top

        own, top = _next_reset(x, 0, 0, gap)
        ahead = np.where(x[:own] >= 0, x[:own], np.iinfo(np.int64).max)
        low = np.flatnonzero(ahead < np.append(np.iinfo(np.int64).max, np.minimum.accumulate(ahead)[:-1])) if own else ahead
        ends = [follow(int(i)) for i in low]
        epochs, last = follow(own) if own < len(x) else (0, top)
        lists = [[int(x[i]) for i in low], [e for e, _ in ends], [t for _, t in ends]]
        return {**{k: (v, pa.list_(pa.int64())) for k, v in zip(("lows", "begun", "tops"), lists)}, "resets": (own < len(x), pa.bool_()), "epochs": (epochs, pa.int64()), "top": (last, pa.int64())}

    def compose(effects: list[dict]) -> list[dict]:
        epoch, top, states = 0, 0, []
        for e in effects:
            states.append({"before": epoch, "largest": top})
            k = bisect_left([-v for v in e["lows"]], gap - top + 1)  # lows fall; the first below top - gap
            if k < len(e["lows"]):
                epoch, top = epoch + e["begun"][k], e["tops"][k]
            elif e["resets"]:
                epoch, top = epoch + e["epochs"], e["top"]
            else:
                top = max(top, e["top"])
        return states

    def apply(batch: pa.RecordBatch, state: dict | None) -> tuple[pa.RecordBatch, dict]:
        epoch, top = (state["before"], state["largest"]) if state else (0, 0)
        x, at = _known(batch.column(index)), 0
        epochs, tops = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        while at < len(x):
            end, largest = _next_reset(x, at, top, gap)
            epochs[at:end] = epoch
            tops[at:end] = np.maximum(np.maximum.accumulate(x[at:end]), top)
            top, at = largest, end
            if end < len(x):
                epoch, top = epoch + 1, int(x[end])
                epochs[end], tops[end], at = epoch, top, end + 1
        out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(epochs), pa.array(tops)], [*names, "epoch", "max_seen"])
        return out, {"before": epoch, "largest": top}

    kinds = {"lows": "array<bigint>", "begun": "array<bigint>", "tops": "array<bigint>", "resets": "boolean", "epochs": "bigint", "top": "bigint"}
    out = f"{_schema(stream, names)}, epoch bigint, max_seen bigint"
    return _sliced_fold(stream.select(*names), [key], [order], [index], effect, kinds, compose, {"before": "bigint", "largest": "bigint"}, apply, out, slices)


# -- serial lines -----------------------------------------------------------------------------

_WAIT = 7  # 0 to 6 bytes can wait
_FOUND = "chunk_seq bigint, nth int, cmd2 int, angle_deg double, mask int, heads array<struct<ts:{ts},chunk_seq:bigint,data:binary>>, exits array<int>, tail binary"


def turntable_resync(chunks: DataFrame, resync: Callable[[bytes, bool], tuple[list, bytes]], compat: bool = False, slices: int | None = None) -> DataFrame:
    """Angle frames of serial chunks; see packets.turntable_resync.

    A slice's first chunks, up to six bytes or more, are its head. Behind it the bytes that wait are an end of the head, and
    only how many is open: the scan is run from each number that can be, as one run where they have come together.
    A frame says in its mask from which numbers it is found, the slice with how many it ends from each. The fold over a
    device's slices reads the heads, and frames not found from all numbers are filtered by what it says."""
    ts = chunks.schema["rx_ts"].dataType.simpleString()
    rows = chunks.select(F.col("device_id").cast("long").alias("device_id"), F.col("rx_ts").alias("ts"), F.col("chunk_seq").cast("long").alias("chunk_seq"), F.col("data").cast("binary").alias("data"))
    dealt = rows.withColumn("slice", slice_of(rows, "chunk_seq", slices))
    schema = f"device_id bigint, slice int, ts {ts}, {_FOUND.format(ts=ts)}"
    names = ["device_id", "slice", "ts", "chunk_seq", "nth", "cmd2", "angle_deg", "mask", "heads", "exits", "tail"]

    def ends_of(tail: bytes) -> list[bytes]:
        """What can wait at the end of a stream, by its length; one that can't is as if nothing did."""
        return [tail[len(tail) - k :] if 0 < k <= len(tail) and tail[len(tail) - k] == 0xFF else b"" for k in range(_WAIT)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        who, heads, size, waits, tail, out = (), [], 0, [], b"", []

        def ended() -> None:
            if heads:
                out.append((*who, None, None, None, None, None, None, heads, [len(w) for w in waits] or None, tail))

        for batch in batches:
            kinds = kinds or batch.schema
            for device, piece, when, seq, data in zip(*(batch.column(c).to_pylist() for c in ("device_id", "slice", "ts", "chunk_seq", "data"))):
                data = data or b""
                if who != (device, piece):
                    ended()
                    who, heads, size, waits, tail = (device, piece), [], 0, [], b""
                if size < _WAIT - 1:
                    heads.append({"ts": when, "chunk_seq": seq, "data": data})
                    size += len(data)
                else:
                    waits = waits or ends_of(tail)
                    for wait in dict.fromkeys(waits):
                        frames, rest = resync(wait + data, compat)
                        mask = sum(1 << k for k in range(_WAIT) if waits[k] == wait)
                        out += [(device, piece, when, seq, k, cmd, angle, mask, None, None, None) for k, (cmd, angle) in enumerate(frames)]
                        waits = [(rest,) if w == wait else w for w in waits]  # marked, lest it be taken for another that is still to do
                    waits = [w[0] if isinstance(w, tuple) else w for w in waits]
                tail = (tail + data)[-(_WAIT - 1) :]
            if out:
                yield rows_of(out, kinds)
                out.clear()
        ended()
        if out:
            yield rows_of(out, kinds)

    def rows_of(found: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
        when = kinds.field("ts").type
        types = [pa.int64(), pa.int32(), when, pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.struct([("ts", when), ("chunk_seq", pa.int64()), ("data", pa.binary())])), pa.list_(pa.int32()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

    def enter(group: pa.Table) -> pa.Table:
        """How many bytes wait behind each slice's head (mask: its bit), and the frames that end in a head."""
        group = _sorted(group, ["slice"])
        device, wait, out = group.column("device_id")[0].as_py(), b"", []
        for piece, heads, exits, tail in zip(*(group.column(c).to_pylist() for c in ("slice", "heads", "exits", "tail"))):
            for head in heads:
                frames, wait = resync(wait + head["data"], compat)
                out += [(device, piece, head["ts"], head["chunk_seq"], k, cmd, angle, None) for k, (cmd, angle) in enumerate(frames)]
            out.append((device, piece, None, None, None, None, None, 1 << len(wait)))
            if exits is not None:
                left = exits[len(wait)]
                wait = tail[len(tail) - left :] if left else b""
        types = [pa.int64(), pa.int32(), group.column("heads").type.value_type.field("ts").type, pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names[:8])

    found = written(dealt.repartition("device_id", "slice").sortWithinPartitions("device_id", "slice", "chunk_seq").mapInArrow(scan, schema), "resync")
    entered = found.filter("heads is not null").select("device_id", "slice", "heads", "exits", "tail").groupBy("device_id").applyInArrow(enter, f"device_id bigint, slice int, ts {ts}, chunk_seq bigint, nth int, cmd2 int, angle_deg double, mask int")
    entered = written(entered, "resync-states")
    result = ["device_id", "ts", "chunk_seq", "nth", "cmd2", "angle_deg"]
    every = (1 << _WAIT) - 1
    frames = found.filter("heads is null")
    states = entered.filter("mask is not null").select(F.col("device_id").alias("d"), F.col("slice").alias("s"), F.col("mask").alias("bit"))
    some = frames.filter(F.col("mask") != every).join(states, F.col("device_id").eqNullSafe(F.col("d")) & (F.col("slice") == F.col("s"))).filter(F.col("mask").bitwiseAND(F.col("bit")) != 0)
    return frames.filter(F.col("mask") == every).select(*result).unionByName(some.select(*result)).unionByName(entered.filter("mask is null").select(*result))
