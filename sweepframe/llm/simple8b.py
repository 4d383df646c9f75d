"""Token ids in Simple-8b words: a file format for tokenised corpora.

A file set is a Parquet table in which each row is one group of whole documents, in ascending
doc_id order over (shard, group):

  shard, grp       position of the group in the order of the file set
  doc_ids          ids of its documents (null kept)
  doc_tokens       tokens of each document, end token included
  n_ids            tokens of the group
  words            the 64-bit words, little endian
  word_at          word offset of every block of BLOCK ids, so that any block is decoded alone
  esc_at, esc_id   escapes: positions and values of ids that need more than 60 bits

A word has a 4-bit selector on top; _SLOTS says how many ids of how many bits it holds. The last
word of a block is filled up with zeros. An escaped id stands as zero in its word."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import encoder, utf8

#: Fixed values of the format: (ids per word, bits per id) by selector 1..14; selector 0 is not used.
_SLOTS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
BLOCK = 4096
_WIDTH = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)
GROUP_IDS = 1 << 16
SCHEMA = "shard int, grp int, doc_ids array<bigint>, doc_tokens array<bigint>, n_ids bigint, words binary, word_at array<bigint>, esc_at array<bigint>, esc_id array<decimal(20,0)>"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offset of each block, escape positions, escaped values) of unsigned ids."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    esc_at = np.flatnonzero(ids >> np.uint64(60))
    esc_id = ids[esc_at]
    if len(esc_at):
        ids = ids.copy()
        ids[esc_at] = 0
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), esc_at, esc_id
    blocks = -(-n // BLOCK)
    wide = np.zeros((blocks, BLOCK + 64), np.uint8)
    width = np.zeros(blocks * BLOCK, np.uint8)
    if ids.max() < len(_WIDTH):
        width[:n] = _WIDTH[ids]
    else:
        width[:n] = np.frexp(ids.astype(np.float64))[1]
        big = np.flatnonzero(ids >= 1 << 52)  # doubles round there
        width[big] = [int(x).bit_length() for x in ids[big].tolist()]
    wide[:, :BLOCK] = width.reshape(blocks, BLOCK)
    # Widest of the next `count` ids from each place on, grown from the smallest count to the largest.
    take = np.ones((blocks, BLOCK), np.uint8)
    selector = np.full((blocks, BLOCK), len(_SLOTS), np.uint8)
    widest, have = wide.copy(), 1
    for s in range(len(_SLOTS) - 2, -1, -1):
        count, bits = _SLOTS[s]
        while have < count:
            step = min(have, count - have)
            widest[:, :-step] = np.maximum(widest[:, :-step], widest[:, step:])
            have += step
        fits = widest[:, :BLOCK] <= bits
        if not fits.any():
            if count >= 12:
                break
            continue
        take[fits], selector[fits] = count, s + 1
    step = take.tobytes()
    starts, first = [], []
    for b in range(blocks):
        at, end = b * BLOCK, min(n, (b + 1) * BLOCK)
        first.append(len(starts))
        while at < end:
            starts.append(at)
            at += step[at]
    starts = np.array(starts)
    sel = selector.reshape(-1)[starts]
    padded = np.zeros((blocks, BLOCK + 64), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = ids
    padded[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    place = (starts // BLOCK) * (BLOCK + 64) + starts % BLOCK
    padded = padded.reshape(-1)
    words = np.zeros(len(starts), np.uint64)
    for s, (count, bits) in enumerate(_SLOTS, 1):
        k = np.flatnonzero(sel == s)
        if not len(k):
            continue
        word = np.full(len(k), s << 60, np.uint64)
        for j in range(count):
            word |= padded[place[k] + j] << np.uint64(j * bits)
        words[k] = word
    return words, np.array(first, np.int64), esc_at, esc_id


def unpack(words: np.ndarray, word_at: np.ndarray, n: int, esc_at=(), esc_id=()) -> np.ndarray:
    """The n ids of pack(); all words of one selector are decoded at once."""
    count = np.array([0, *(c for c, _ in _SLOTS), 0])
    sel = (words >> np.uint64(60)).astype(np.int64)
    held = count[sel]
    block = np.searchsorted(word_at, np.arange(len(words)), "right") - 1
    before = np.cumsum(held) - held
    place = block * BLOCK + before - before[word_at[block]] if len(words) else before
    out = np.zeros(n + 64, np.uint64)
    for s, (c, bits) in enumerate(_SLOTS, 1):
        k = np.flatnonzero(sel == s)
        if not len(k):
            continue
        end = np.minimum((block[k] + 1) * BLOCK, n)
        for j in range(c):
            p = place[k] + j
            ok = p < end
            out[p[ok]] = (words[k[ok]] >> np.uint64(j * bits)) & np.uint64((1 << bits) - 1)
    out = out[:n]
    if len(esc_at):
        out[np.asarray(esc_at, np.int64)] = np.array([int(x) for x in esc_id], np.uint64)
    return out


def _groups(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Tokenise the sorted rows of shards and write groups of whole documents."""
    enc, state = encoder(vocabulary, "\n"), {"shard": None, "grp": 0, "docs": [], "lens": [], "ids": [], "n": 0}
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def flush():
        ids = np.concatenate(state["ids"])
        words, at, esc_at, esc_id = pack(ids)
        from decimal import Decimal

        row = [state["shard"], state["grp"], state["docs"], state["lens"], len(ids), words.tobytes(), at.tolist(), esc_at.tolist(), [Decimal(int(x)) for x in esc_id]]
        types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.decimal128(20, 0))]
        state.update(grp=state["grp"] + 1, docs=[], lens=[], ids=[], n=0)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

    for batch in batches:
        shards, docs = batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist()
        data, offsets = utf8(batch.column("text"))
        lo = 0
        while lo < len(docs):  # a few documents at a time, whatever the batch holds
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (1 << 20), "right")) - 1)
            ids, at = enc.encode(data, offsets[lo : hi + 1])
            for i in range(lo, hi):
                if state["n"] and (shards[i] != state["shard"] or state["n"] >= GROUP_IDS):
                    yield flush()
                if shards[i] != state["shard"]:
                    state.update(shard=shards[i], grp=0)
                own = np.append(ids[at[i - lo] : at[i - lo + 1]], np.uint32(end_id))
                state["docs"].append(docs[i])
                state["lens"].append(len(own))
                state["ids"].append(own)
                state["n"] += len(own)
            lo = hi
    if state["n"]:
        yield flush()


def write(docs: DataFrame, vocabulary: str, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Tokenise docs(doc_id, text) and write them as a Simple-8b file set in ascending doc_id order.

    Rows are dealt to ranges of doc_id by quantiles of that column, so one shuffle moves each text
    once; a shard is sorted and streamed by one task, which holds one group at a time. Null texts
    are empty documents (the end token alone); null doc_ids come first; rows of equal doc_id follow
    each other by text. An empty table gives an empty file set."""
    spark = docs.sparkSession
    n = shards or common.partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("shard", common.id_shards(rows, "doc_id", n).cast("int"))
    dealt = rows.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "text")
    common.small_batches(spark)
    files = dealt.mapInArrow(lambda it: _groups(it, vocabulary, end_id), SCHEMA)
    return common.written(files, "simple8b", compression="zstd")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            lens = row["doc_tokens"]
            ids = unpack(np.frombuffer(row["words"], np.uint64), np.array(row["word_at"], np.int64), row["n_ids"], row["esc_at"], row["esc_id"])
            raw = ids.astype("<u4").tobytes()
            ends = np.cumsum(lens).tolist()
            part = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends, lens)]
            m = len(lens)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]] * m, pa.int32()), pa.array([row["grp"]] * m, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array([e - k for e, k in zip(ends, lens)], pa.int64()), pa.array(lens, pa.int64()), pa.array(part, pa.binary()), pa.array([zlib.crc32(p) for p in part], pa.int64())],
                ["shard", "grp", "doc_id", "start", "n_tokens", "ids", "ids_crc32"],
            )


def read(files: DataFrame) -> DataFrame:
    """Decode a file set: shard, grp, doc_id, start (ids before it in its group), n_tokens, ids, ids_crc32."""
    return files.mapInArrow(_documents, "shard int, grp int, doc_id bigint, start bigint, n_tokens bigint, ids binary, ids_crc32 bigint")


def starts(files: DataFrame) -> Column:
    """Ids before each group, as a Column over (shard, grp).

    Totals by shard go to the driver (as many numbers as the file set has shards); within a shard the
    groups are summed where the rows are joined."""
    totals = {r["shard"]: r["n"] for r in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    before, run = [], 0
    for s in range(max(totals, default=-1) + 1):
        before.append(run)
        run += totals.get(s, 0)
    return F.element_at(F.array(*[F.lit(x).cast("long") for x in before or [0]]), F.col("shard") + 1)


def digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write docs, read them back and describe each document: doc_id, start, n_tokens, ids_crc32."""
    from pyspark.sql import Window

    files = write(docs, vocabulary)
    run = Window.partitionBy("shard").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    at = files.select("shard", "grp", (starts(files) + F.coalesce(F.sum("n_ids").over(run), F.lit(0))).alias("group_start"))
    got = read(files).drop("ids")
    return got.join(at, ["shard", "grp"]).select("doc_id", (F.col("group_start") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
