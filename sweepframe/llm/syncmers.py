"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the least hash among its inner s-mers is its first or its
last one. Whether it is depends on the k-mer alone, so a shared passage gives the same anchors
wherever it stands. A fingerprint holds all anchors of a text with their positions; two
fingerprints are alike by the runs of anchors, equal in hashes and gaps, that they share anywhere.

Every text has anchors of 24 code points. Where a text is short these are few, so it has finer ones beside
them, and two fingerprints are compared by the finest anchors that both have: what a text is like does not
hang on which side of a bound its own length is."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K, S, RUN = 24, 8, 3
#: k, s and the code points below which a text has such anchors, the coarsest first.
SCALES = ((K, S, None), (8, 4, 256), (2, 1, 64))
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _B
    return h ^ (h >> np.uint64(29))


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the closed syncmers of a text, whole; none of a text shorter than k.

    s must be a power of two and divide k."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    if len(c) < k:
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    h, step, by = (c + _C) * _A, 1, int(_B)
    while step < s:  # hashes of 2, 4, .. s code points
        h = h[:-step] * np.uint64(by) + h[step:]
        step, by = 2 * step, by * by % (1 << 64)
    inner = _mixed(h)
    window, least, have = k - s + 1, inner, 1
    while have < window:
        step = min(have, window - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    n = len(c) - k + 1
    at = np.flatnonzero((inner[:n] == least[:n]) | (inner[window - 1 : window - 1 + n] == least[:n]))
    whole = np.zeros(len(at), np.uint64)
    for j in range(0, k, s):
        whole = whole * _C + h[at + j]
    return (_mixed(whole) >> np.uint64(32)).astype(np.uint32), at.astype(np.uint32)


def sketch(text: str) -> list[np.ndarray]:
    """Rows (hash, position) of all anchors, by position, of each scale that the text has; one code point alone is an anchor."""
    out = [np.stack(anchors(text, k, s), 1) for k, s, below in SCALES if below is None or len(text) < below]
    if len(text) == 1:
        out[-1] = np.array([[int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=4).digest(), "big"), 0]], np.uint32)
    return out


def to_hex(scales: list[np.ndarray]) -> str:
    """Hash and position of each anchor as 16 hexadecimal digits, scales parted by a slash; an empty text has none."""
    return "/".join(rows.astype(">u4").tobytes().hex() for rows in scales) if any(map(len, scales)) else ""


def _grams(rows: np.ndarray, run: int) -> np.ndarray:
    """One hash for each `run` consecutive anchors: their hashes and the gaps between them."""
    h, at = rows[:, 0].astype(np.uint64), rows[:, 1].astype(np.uint64)
    n = len(rows) - run + 1
    out = _mixed((h[:n] + _C) * _A)
    for j in range(1, run):
        out = _mixed((out ^ h[j : j + n]) * _A + (at[j : j + n] - at[j - 1 : j - 1 + n] + _C) * _B)
    return out


def _covered(place: np.ndarray, limit: np.ndarray, run: int) -> int:
    """How many anchors lie in the first limit[p] grams of every place p."""
    order = np.argsort(place, kind="stable")
    own = place[order]
    nth = np.empty(len(own), np.int64)
    nth[order] = np.arange(len(own)) - np.searchsorted(own, own)
    hit = nth < limit[place]
    cover = np.zeros(len(place) + run - 1, bool)
    for j in range(run):
        cover[j : j + len(place)] |= hit
    return int(cover.sum())


def likeness(a: list[np.ndarray], b: list[np.ndarray], run: int = RUN) -> float:
    """0 to 1: how alike two sketches are by the finest anchors that both have; see alike()."""
    if not any(map(len, a)) and not any(map(len, b)):
        return 1.0
    at = min(len(a), len(b)) - 1
    return alike(a[at], b[at], run)


def alike(a: np.ndarray, b: np.ndarray, run: int = RUN) -> float:
    """The share of anchors of both in common runs of at least `run` anchors (or all that one side has), on any diagonal.

    A run that one side repeats counts there as often as the other side has it."""
    if not len(a) or not len(b):
        return 0.0
    run = min(run, len(a), len(b))
    x, y = _grams(a, run), _grams(b, run)
    values, place = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = place[: len(x)], place[len(x) :]
    limit = np.minimum(np.bincount(x, minlength=len(values)), np.bincount(y, minlength=len(values)))
    return (_covered(x, limit, run) + _covered(y, limit, run)) / (len(a) + len(b))


def with_next(docs: DataFrame, shards: int | None = None) -> tuple[DataFrame, int]:
    """Deal docs(doc_id, text) to shards of ascending doc_id, each with the first row of the next one.

    Columns: target, peek (true: only to be looked at), key, doc_id, text. The driver gets the
    least doc_id of every shard; one shuffle moves each text once, and one text per shard twice."""
    n = shards or common.partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    rows = rows.withColumn("shard", common.id_shards(rows, "doc_id", n).cast("int"))
    heads = {r["shard"]: r["key"] for r in rows.groupBy("shard").agg(F.min("key").alias("key")).collect()}
    order = sorted(heads)
    before = {s: order[i - 1] for i, s in enumerate(order)}
    head = F.array(*[F.lit(heads.get(s)).cast("long") for s in range(n)])
    prev = F.array(*[F.lit(before.get(s)).cast("int") for s in range(n)])
    own = F.struct(F.col("shard").alias("target"), F.lit(False).alias("peek"))
    ahead = F.struct(F.element_at(prev, F.col("shard") + 1).alias("target"), F.lit(True).alias("peek"))
    to = F.when(F.col("key") == F.element_at(head, F.col("shard") + 1), F.array(own, ahead)).otherwise(F.array(own))
    dealt = rows.select("doc_id", "text", "key", F.explode(to).alias("to")).select("to.target", "to.peek", "key", "doc_id", "text")
    return dealt.repartitionById(n, F.col("target")).sortWithinPartitions("target", "peek", "key", "text"), n


#: Bytes of fingerprints in a batch, which are a few times as long as their texts.
_OUT = 1 << 22
SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held, done = None, True  # (doc_id, text, sketch) that waits for the next text

    def flush() -> pa.RecordBatch:
        nonlocal out, size
        ready = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
        out, size = [[] for _ in names], 0
        return ready

    out: list[list] = [[] for _ in names]
    size = 0  # bytes of fingerprints in out
    for batch in batches:
        for doc, text, peek in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("peek").to_pylist()):
            if peek and done:  # a further row of the same doc_id
                continue
            own = sketch(text)
            if held is not None:
                n = len(held[1])
                half = n // 2
                edited = held[1][: n - half] + text[:half]
                changed = sketch(edited)
                row = (held[0], n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), to_hex(held[2]), to_hex(changed), likeness(held[2], changed), likeness(held[2], own))
                for column, v in zip(out, row):
                    column.append(v)
                size += len(row[3]) + len(row[4])
                if size >= _OUT:
                    yield flush()
            held, done = (None, True) if peek else ((doc, text, own), False)
        if out[0]:
            yield flush()


def compare_edited(docs: DataFrame) -> DataFrame:
    """Whole fingerprints of docs(doc_id, text) and of their edited texts, and how alike they are.

    The edited text has its last floor(n_chars / 2) code points replaced by as many (or all) from
    the start of the next document by doc_id; the last document's next is the first. Null texts are
    empty; null doc_ids come first; rows of equal doc_id follow each other by text."""
    common.small_batches(docs.sparkSession)
    dealt, _ = with_next(docs)
    return dealt.select("doc_id", "text", "peek").mapInArrow(_compare, SCHEMA)
