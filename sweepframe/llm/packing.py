"""Packing token sequences by cutting-stock column generation.

A document is cut into full pieces of `capacity` tokens, each a sequence of its own, and one rest.
The rests' lengths, rounded up to `grain` tokens, form a histogram of at most capacity / grain
classes. Over it a linear program chooses how often each pattern (a multiset of classes that fits
a sequence) is used; a knapsack by dynamic programming prices new patterns until none helps. Its
nearly full patterns are used, rounded down and topped up while the histogram covers them. All
other rests are laid end to end, the longest first, and cut where a sequence ends, so only the last
sequence has room left. Patterns take documents by their rank within a class; where a rest lies in
the line follows from its class and rank, too.

Only the histogram reaches the driver. Ranks come from counts per (task, class) and a running sum
over tasks, so no task sees all documents of a class."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder, utf8

#: (times used, [(class, how many)]) with classes in units of the grain.
Pattern = tuple[int, list[tuple[int, int]]]


# -- the linear program -----------------------------------------------------------------------


def _knapsack(value: np.ndarray, size: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits, by dynamic programming over the room."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fit = int(np.searchsorted(size, c, "right"))
        best[c] = best[c - 1]
        if fit:
            gain = value[:fit] + best[c - size[:fit]]
            k = int(np.argmax(gain))
            if gain[k] > best[c] + 1e-12:
                best[c], pick[c] = gain[k], k
    count, c = np.zeros(len(size)), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            count[pick[c]] += 1
            c -= int(size[pick[c]])
    return float(best[room]), count


def _first_fit(size: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """One pattern: the largest class first, as many as fit and are left."""
    count, free, k = np.zeros(len(size), left.dtype), room, len(size)
    while free and k:
        k = min(k, int(np.searchsorted(size, free, "right"))) - 1
        if k < 0:
            break
        take = min(left[k], free // int(size[k]))
        count[k] = take
        free -= int(take) * int(size[k])
    return count


def _start(size: np.ndarray, need: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A feasible basis, its use and its inverse: first-fit patterns, each used until a class runs out, which becomes its row.

    A pattern has no class that ran out before, so the matrix is triangular in that order and its
    inverse follows row by row. Nothing here calls LAPACK or threaded BLAS: after a session has
    started, those can hang in the driver's process."""
    m = len(size)
    basis, x, left, order = np.zeros((m, m)), np.zeros(m), need.astype(float), []
    open_ = left > 1e-9
    while open_.any():
        c = _first_fit(size, np.where(open_, np.ceil(left), 0).astype(np.int64), room).astype(float)
        ratio = np.where(c > 0, left / np.maximum(c, 1), np.inf)
        r = int(np.argmin(ratio))
        basis[:, r], x[r] = c, ratio[r]
        left = left - ratio[r] * c
        gone = open_ & ((left <= 1e-9) | (np.arange(m) == r))
        for k in np.flatnonzero(gone):
            left[k] = 0
            if k != r:
                basis[k, k] = room // size[k]
        order += [r, *(k for k in np.flatnonzero(gone).tolist() if k != r)]
        open_ &= ~gone
    inverse = np.zeros((m, m))
    for i, r in enumerate(order):
        before = np.array(order[:i], np.int64)
        before = before[basis[r, before] != 0]
        inverse[r] = -(basis[r, before][:, None] * inverse[before]).sum(0)
        inverse[r, r] += 1
        inverse[r] /= basis[r, r]
    return basis, x, inverse


def column_generation(size: np.ndarray, need: np.ndarray, room: int, gap: float = 2e-3, most: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, how often each is used) of the relaxed cutting-stock problem.

    Ends when no column prices out, when the bound `value / best price` or the tokens themselves show
    the value within `gap` of the optimum, or after `most` pivots; what it has then is feasible."""
    basis, x, inverse = _start(size, need, room)
    floor = float((size * need).sum()) / room
    for _ in range(most):
        if x.sum() <= floor * (1 + gap):
            break
        value, column = _knapsack(inverse.sum(0), size, room)
        if value <= 1 + gap:
            break
        step = (inverse * column).sum(1)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        r = int(np.argmin(ratio))
        theta = ratio[r]
        x = np.maximum(x - theta * step, 0)
        x[r] = theta
        basis[:, r] = column
        row = inverse[r] / step[r]
        inverse -= np.outer(step, row)
        inverse[r] = row
    return basis, x


#: A sequence of cut rests: (rest, from, units), rests numbered in the order of the list of their classes.
Bin = list[tuple[int, int, int]]


def full_patterns(histogram: dict[int, int], room: int, fill: float = 0.995) -> tuple[list[Pattern], list[tuple[int, int]]]:
    """Patterns that are full to `fill`, and (class, how many) of all other rests, the longest first.

    The program's patterns are used as often as its solution says, rounded down, then once more
    where the histogram still covers them, then first-fit patterns of what is left."""
    size = np.array(sorted(k for k, n in histogram.items() if n), np.int64)
    if not len(size):
        return [], []
    left = np.array([histogram[int(s)] for s in size], np.int64)
    basis, x = column_generation(size, left.astype(float), room)
    used: dict[tuple, int] = {}

    def use(count: np.ndarray, times: int) -> None:
        nonlocal left
        left = left - count * times
        key = tuple((int(size[k]), int(count[k])) for k in np.flatnonzero(count))
        used[key] = used.get(key, 0) + times

    columns = np.rint(basis).astype(np.int64)
    order = np.argsort(-(x - np.floor(x)), kind="stable")
    for j in order:
        c = columns[:, j]
        if int((c * size).sum()) < fill * room:
            continue
        if times := min(int(np.floor(x[j] + 1e-9)), int((left[c > 0] // c[c > 0]).min())):
            use(c, times)
    for j in order:  # the most fractional first
        c = columns[:, j]
        if int((c * size).sum()) >= fill * room and (left[c > 0] >= c[c > 0]).all():
            use(c, 1)
    while left.any():
        c = _first_fit(size, left, room)
        if int((c * size).sum()) < fill * room:
            break
        use(c, int((left[c > 0] // c[c > 0]).min()))
    return [(n, list(key)) for key, n in used.items()], [(int(s), int(n)) for s, n in zip(size[::-1], left[::-1]) if n]


def plan(histogram: dict[int, int], room: int, fill: float = 0.995) -> tuple[list[Pattern], list[int], list[Bin]]:
    """Patterns, classes of rests that are cut, and the sequences of their parts; every rest is taken once.

    It lists each cut rest, so it is for small tables; layout() has the same by arithmetic on ranks."""
    patterns, line = full_patterns(histogram, room, fill)
    rests = [cls for cls, n in line for _ in range(n)]
    bins: list[Bin] = []
    free = 0
    for i, units in enumerate(rests):
        at = 0
        while at < units:
            if not free:
                bins.append([])
                free = room
            take = min(free, units - at)
            bins[-1].append((i, at, take))
            at, free = at + take, free - take
    return patterns, rests, bins


# -- pieces -----------------------------------------------------------------------------------

PIECES = "shard int, row bigint, piece int, doc_id bigint, start bigint, length int, doc_tokens bigint, cls int, rank bigint, ids binary"


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, separator: str, end_id: int, capacity: int, grain: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    shard, row = TaskContext.get().partitionId(), 0
    enc, seen = encoder(vocabulary, separator), np.zeros(capacity // grain + 2, np.int64)
    names = [x.split()[0] for x in PIECES.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    for batch in batches:
        docs, (data, offsets) = batch.column("doc_id").to_pylist(), utf8(batch.column("text"))
        lo = 0
        while lo < len(docs):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (1 << 20), "right")) - 1)
            ids, at = enc.encode(data, offsets[lo : hi + 1])
            out: list[list] = [[] for _ in names]
            for i in range(lo, hi):
                raw = np.append(ids[at[i - lo] : at[i - lo + 1]], np.uint32(end_id)).astype("<u4").tobytes()
                n = len(raw) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    cls = 0 if length == capacity else -(-length // grain)  # 0: a full sequence
                    for column, v in zip(out, (shard, row, piece, docs[i], start, length, n, cls, int(seen[cls]), raw[4 * start : 4 * (start + length)])):
                        column.append(v)
                    seen[cls] += 1
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
            lo = hi


def pieces(docs: DataFrame, vocabulary: str, separator: str, end_id: int, capacity: int = 2048, grain: int = 4) -> DataFrame:
    """Tokenise docs(doc_id, text) where they lie, cut them and write the pieces with their ids.

    shard, row and piece name a piece; cls is its length class (0: a full piece) and rank its place
    among its task's pieces of that class. Null texts have the end token alone."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    common.small_batches(docs.sparkSession)
    cut = rows.mapInArrow(lambda it: _pieces(it, vocabulary, separator, end_id, capacity, grain), PIECES)
    return common.written(cut, "pieces", compression="zstd")


def layout(cut: DataFrame, capacity: int = 2048, grain: int = 4) -> DataFrame:
    """sequence_id and offset of every piece of pieces(), beside its columns but ids, cls and rank.

    A rest that is cut further gives two rows; skip says how many of the piece's tokens come before.
    The table of patterns is broadcast. It has at most capacity / grain patterns from the basis and about
    as many from what rounding leaves, of capacity / grain classes each, and a row for each class of
    the rests laid end to end, whatever the input."""
    spark, room = cut.sparkSession, capacity // grain
    counts = cut.groupBy("shard", "cls").agg(F.count("*").alias("n"))
    run = Window.partitionBy("cls").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "cls", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
    histogram = {r["cls"]: r["n"] for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect()}
    full = histogram.pop(0, 0)
    patterns, line = full_patterns(histogram, room)
    taken: dict[int, int] = {}
    entries, sequence = [(0, 0, full, 0, 1, 0, None)], full  # class, ranks, first sequence, how many in each, slot, units before it in the line

    def claim(cls: int, n: int) -> int:
        taken[cls] = taken.get(cls, 0) + n
        return taken[cls] - n

    for times, items in patterns:
        slot = 0
        for cls, count in sorted(items, reverse=True):
            lo = claim(cls, times * count)
            entries.append((cls, lo, lo + times * count, sequence, count, slot, None))
            slot += count
        sequence += times
    units = 0
    for cls, n in line:
        lo = claim(cls, n)
        entries.append((cls, lo, lo + n, sequence, 1, 0, units))
        units += cls * n
    table = F.broadcast(spark.createDataFrame(entries, "cls int, lo bigint, hi bigint, first bigint, per bigint, slot bigint, origin bigint"))
    meta = cut.drop("ids").join(base, ["shard", "cls"]).withColumn("at", F.col("rank") + F.col("before"))
    nth, whole = F.col("at") - F.col("lo"), F.when(meta["cls"] == 0, room).otherwise(meta["cls"]).cast("long")
    start = F.col("origin") + nth * meta["cls"]  # of a rest in the line, in units
    own = F.least(whole, room - start % room)
    sequence_id = (F.col("first") + F.floor(start / room)).cast("long")

    def part(skip, units, sequence_id, slot):
        return F.struct(*[c.cast("long").alias(name) for c, name in ((skip, "skip"), (units, "units"), (sequence_id, "sequence_id"), (slot, "slot"))])

    uncut = F.array(part(F.lit(0), whole, F.col("first") + F.floor(nth / F.col("per")), F.col("slot") + nth % F.col("per")))
    two = F.array(part(F.lit(0), own, sequence_id, start % room), part(own, whole - own, sequence_id + 1, F.lit(0)))
    parts = F.when(F.col("origin").isNull(), uncut).otherwise(F.filter(two, lambda x: x["units"] > 0))
    skip = F.col("p.skip") * grain
    names = [c for c in cut.columns if c not in ("ids", "cls", "rank", "start", "length")]
    placed = meta.join(table, (meta["cls"] == table["cls"]) & (meta["at"] >= table["lo"]) & (meta["at"] < table["hi"])).select(
        *[meta[c] for c in names], meta["start"], meta["length"], whole.alias("whole"), F.explode(parts).alias("p")).select(
        *names, (F.col("start") + skip).alias("start"), F.least(F.col("length") - skip, F.col("p.units") * grain).cast("int").alias("length"),
        skip.alias("skip"), (F.col("p.units") < F.col("whole")).alias("is_part"), "p.sequence_id", "p.slot")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("slot")


def _part(ids: str):
    return F.substring(F.col(ids), (F.col("skip") * 4 + 1).cast("int"), F.col("length") * 4)


def sequences(cut: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (little-endian unsigned 32-bit), docs (doc_id, start, length, offset)."""
    rows = placed.join(cut.select("shard", "row", "piece", "ids"), ["shard", "row", "piece"])
    part = F.struct("offset", "doc_id", "start", "length", _part("ids").alias("ids"))
    packed = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    return packed.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("docs"))


def digest(docs: DataFrame, vocabulary: str, separator: str, end_id: int = 1, capacity: int = 2048, few: int = 200_000) -> DataFrame:
    """Pieces with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The checksums are taken from the ids in the written pieces. Those of parts need their piece's
    ids once more: up to `few` parts are broadcast to them, more are joined by merge."""
    cut = pieces(docs, vocabulary, separator, end_id, capacity)
    placed = common.written(layout(cut.withColumn("ids_crc32", F.crc32("ids")), capacity), "layout")
    keys = ["shard", "row", "piece"]
    parts = placed.filter("is_part").drop("ids_crc32")
    parts = F.broadcast(parts) if parts.count() <= few else parts.hint("merge")
    again = cut.filter("cls > 0").select(*keys, "ids").join(parts, keys).withColumn("ids_crc32", F.crc32(_part("ids"))).select(*placed.columns)
    out = placed.filter("not is_part").unionByName(again)
    return out.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")
