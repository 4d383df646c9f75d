"""Packs token sequences into as few bins as it can by bin completion, a branch-and-bound search.

Documents longer than a sequence are cut: full pieces are sequences of their own, and the first piece
takes what is left over. So there is one rest a document, of 1 to `capacity` tokens, and the search
needs only how many rests of each length there are.

A step takes the longest rest left and completes its sequence with a multiset of other rests. Only
fillings are tried that no other one dominates: a single rest that fits exactly dominates all others,
and a filling falls to one in which a rest that is left takes the place of one or more smaller ones.
They come in the order of the room they waste, and end where the waste would exceed what the best
solution so far allows. A filling is used as often as the lengths last, and, as a second branch, once.
Below a node no solution can have fewer sequences than its waste bound says. The first incumbent is
best-fit decreasing; the search ends when it meets the bound of all rests (the packing is optimal
then), when nothing is left to try, or with the best packing found after `most_nodes` nodes or `LOOKS` times as many
fillings looked at: a node may refuse any number of dominated ones, so its nodes alone do not bound a search's time.

The histogram has at most `capacity` entries, whatever the input, and so has what comes back: a table of
which ranks of a length go where. Ranks come from counts per task and length, so no task sees all rests
of one length."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder, utf8

#: (times used, ((length, how many), ...)), the longest first.
Pattern = tuple[int, tuple[tuple[int, int], ...]]

LOOKS = 10


# -- bounds and incumbents --------------------------------------------------------------------


def waste_bound(have: np.ndarray) -> int:
    """The fewest sequences that have[length] rests can need.

    For every a: rests over capacity - a go alone or with others below a, those over half of the capacity
    one a sequence, and rests of a to half of it only fill what these leave; room that nothing can fill is waste."""
    cap = len(have) - 1
    size = np.arange(cap + 1)
    n, total = np.cumsum(have), np.cumsum(have * size)
    half = cap // 2
    a = np.arange(0, half + 1)
    alone = n[cap] - n[cap - a]
    large, large_sum = n[cap - a] - n[half], total[cap - a] - total[half]
    small = total[half] - np.where(a > 0, total[np.maximum(a - 1, 0)], 0)
    more = -(-(small - (large * cap - large_sum)) // cap)
    return int((alone + large + np.maximum(more, 0)).max())


def best_fit(have: np.ndarray) -> tuple[int, list[Pattern]]:
    """Best-fit decreasing over a histogram: sequences that are alike are filled together."""
    cap = len(have) - 1
    groups: dict[int, list[list]] = {}  # room left: [how many, pattern]
    for size in range(cap, 0, -1):
        left = int(have[size])
        for room in range(size, cap):
            if not left:
                break
            for group in groups.pop(room, []):
                each, count = room // size, group[0]
                filled = min(count, left // each)
                rest = left - filled * each if filled < count else 0
                same = count - filled - (rest > 0)
                for n, pattern, free in ((filled, group[1] + ((size, each),), room - each * size), (int(rest > 0), group[1] + ((size, rest),), room - rest * size), (same, group[1], room)):
                    if n:
                        groups.setdefault(free, []).append([n, pattern])
                left -= filled * each + rest
        each = cap // size
        for n, k in ((left // each, each), (1, left % each)):
            if n and k:
                groups.setdefault(cap - k * size, []).append([n, ((size, k),)])
    found = [(n, pattern) for same in groups.values() for n, pattern in same]
    return sum(n for n, _ in found), found


# -- fillings ---------------------------------------------------------------------------------


def _sums(reach: int, size: int, count: int, mask: int) -> int:
    """The sums in reach (a set of bits) after up to count rests of a size are added."""
    step = 1
    while count > 0:
        take = min(step, count)
        reach |= (reach << (size * take)) & mask
        count -= take
        step *= 2
    return reach


def _dominated(filling: list[tuple[int, int]], out: int, waste: int) -> bool:
    """Whether a rest that is left out (a set of bits by size) could take the place of some of the filling, more tightly or as one for several."""
    none, one, many = 1, 0, 0
    for size, n in filling:
        for _ in range(n):
            many |= (many << size) | (one << size)
            one |= none << size
    if many & out:
        return True
    every, d = none | one | many, 1
    while d <= waste:
        if (every << d) & out:
            return True
        d += 1
    return False


def fillings(have: np.ndarray, room: int, most_waste: int, looks: list[int] | None = None) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(waste, filling) of the fillings of a room that none dominates, the tightest first; [] if nothing fits.

    looks holds how many fillings may still be looked at, dominated or not, and is counted down."""
    looks = [1 << 62] if looks is None else looks
    if room == 0:
        yield 0, []
        return
    if have[room]:
        yield 0, [(room, 1)]
        return
    sizes = [int(s) for s in np.flatnonzero(have[: room + 1]) if s]
    number = {s: int(have[s]) for s in sizes}
    mask, all_sizes = (1 << (room + 1)) - 1, sum(1 << s for s in sizes)
    reach = [1]  # by the smallest sizes so far
    for s in sizes:
        reach.append(_sums(reach[-1], s, min(number[s], room // s), mask))

    def exact(target: int, upto: int) -> Iterator[list[tuple[int, int]]]:
        if target == 0:
            yield []
            return
        for j in range(bisect_right(sizes, target, 0, upto), 0, -1):
            if not reach[j] >> target & 1:
                return  # fewer sizes reach no more
            s = sizes[j - 1]
            for k in range(min(number[s], target // s), 0, -1):
                if reach[j - 1] >> (target - k * s) & 1:
                    for rest in exact(target - k * s, j - 1):
                        yield [(s, k), *rest]

    for waste in range(min(room, most_waste) + 1):
        if reach[-1] >> (room - waste) & 1:
            for filling in exact(room - waste, len(sizes)):
                if looks[0] <= 0:
                    return
                looks[0] -= 1
                used_up = sum(1 << s for s, k in filling if number[s] == k)
                if not _dominated(filling, all_sizes ^ used_up, waste):
                    yield waste, filling


# -- the search -------------------------------------------------------------------------------


def _branches(have: np.ndarray, most_waste: int, looks: list[int]) -> Iterator[Pattern]:
    """The ways to complete the longest rest's sequence, each as often as it can be used and then once."""
    cap, longest = len(have) - 1, int(np.flatnonzero(have)[-1])
    have = have.copy()
    have[longest] -= 1
    once = []
    for _, filling in fillings(have, cap - longest, most_waste, looks):
        count = {longest: 1}
        for s, k in filling:
            count[s] = count.get(s, 0) + k
        pattern = tuple(sorted(count.items(), reverse=True))
        times = min((int(have[s]) + (s == longest)) // k for s, k in pattern)
        yield times, pattern
        if times > 1:
            once.append((1, pattern))
            yield once[-1]


def complete(have: np.ndarray, most_nodes: int = 20_000) -> tuple[list[Pattern], int, int]:
    """(patterns, lower bound, nodes) of a packing of have[length] rests, have[0] being ignored."""
    have = have.astype(np.int64).copy()
    have[0] = 0
    cap, size = len(have) - 1, np.arange(len(have))
    least, (best, found), nodes = waste_bound(have), best_fit(have), 0
    used, path, stack, looks = 0, [], [], [LOOKS * most_nodes]  # stack: (what is left, branches)

    def opened(left: np.ndarray) -> None:
        slack = (best - 1 - used) * cap - int((left * size).sum())
        stack.append((left, _branches(left, slack, looks) if slack >= 0 else iter(())))

    if best > least:
        opened(have)
    while stack and best > least and nodes < most_nodes and looks[0] > 0:
        left, branches = stack[-1]
        step = next(branches, None)
        if step is None:
            stack.pop()
            if path:
                used -= path.pop()[0]
            continue
        nodes += 1
        times, pattern = step
        after = left.copy()
        for s, k in pattern:
            after[s] -= times * k
        if not after.any():
            if used + times < best:
                best, found = used + times, [*path, step]
            continue
        if used + times + waste_bound(after) >= best:
            continue
        path.append(step)
        used += times
        opened(after)
    return found, least, nodes


# -- pieces -----------------------------------------------------------------------------------

PIECES = "shard int, row bigint, piece int, doc_id bigint, start bigint, length int, rank bigint, ids_crc32 bigint, ids binary"


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, separator: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    shard, row = TaskContext.get().partitionId(), 0
    enc, seen = encoder(vocabulary, separator), np.zeros(capacity + 1, np.int64)
    names = [x.split()[0] for x in PIECES.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
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
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for piece, (start, end) in enumerate(zip(cuts, cuts[1:])):
                    own = raw[4 * start : 4 * end]
                    for column, v in zip(out, (shard, row, piece, docs[i], start, end - start, int(seen[end - start]), zlib.crc32(own), own)):
                        column.append(v)
                    seen[end - start] += 1
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
            lo = hi


def pieces(docs: DataFrame, vocabulary: str, separator: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """Tokenise docs(doc_id, text) where they lie, cut them and write the pieces with their ids.

    shard, row and piece name a piece; rank is its place among its task's pieces of its length. Null and
    empty texts have the end token alone; rows of one doc_id, and rows without one, are packed each on its own."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    common.small_batches(docs.sparkSession)
    cut = rows.mapInArrow(lambda it: _pieces(it, vocabulary, separator, end_id, capacity), PIECES)
    return common.written(cut, "rests", compression="zstd")


def layout(cut: DataFrame, capacity: int = 1024, most_nodes: int = 20_000) -> DataFrame:
    """sequence_id and offset of every piece of pieces(), beside its columns but ids and rank.

    Full pieces take the first sequences, in the order of their ranks. All rests of a slot have one length,
    so offsets follow from the pattern and no sequence is gathered. The broadcast table has a row for
    each length of each pattern; a pattern uses some length up or is one of the search's single uses."""
    counts = cut.groupBy("shard", "length").agg(F.count("*").alias("n"))
    run = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "length", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
    have = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row a length
        have[r["length"]] = r["n"]
    sequence, have[capacity] = int(have[capacity]), 0
    entries = [(capacity, 0, sequence, 0, 1, 0)]  # length, ranks, first sequence, how many in each, offset
    taken: dict[int, int] = {}
    for times, pattern in complete(have, most_nodes)[0]:
        offset = 0
        for size, each in pattern:
            lo = taken.get(size, 0)
            taken[size] = lo + times * each
            entries.append((size, lo, lo + times * each, sequence, each, offset))
            offset += each * size
        sequence += times
    where = F.broadcast(cut.sparkSession.createDataFrame(entries, "length int, lo bigint, hi bigint, first bigint, each bigint, base bigint"))
    ranked = cut.drop("ids").join(base, ["shard", "length"]).withColumn("at", F.col("rank") + F.col("before"))
    placed = ranked.join(where, (ranked["length"] == where["length"]) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    nth = F.col("at") - F.col("lo")
    return placed.select(
        *[ranked[c] for c in cut.columns if c not in ("ids", "rank")], (F.col("first") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + nth % F.col("each") * ranked["length"]).cast("long").alias("offset"))


def sequences(cut: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (little-endian unsigned 32-bit), docs (doc_id, start, length, offset)."""
    rows = placed.join(cut.select("shard", "row", "piece", "ids"), ["shard", "row", "piece"])
    packed = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("p"))
    return packed.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("docs"))


def digest(docs: DataFrame, vocabulary: str, separator: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; an empty table gives no rows."""
    placed = layout(pieces(docs, vocabulary, separator, end_id, capacity), capacity)
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
