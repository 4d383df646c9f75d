"""SimHash fingerprints and their near-duplicate components by generalised pigeonhole.

The 64 bits are cut into parts of correlated bits. Two fingerprints that differ in at most
`distance` bits must, in at least one part, differ in no more than that part's own threshold, if
the thresholds t satisfy sum(t + 1) = distance + 1 (a part may have t = -1 and is then not
probed). Which part gets which threshold is settled by dynamic programming on candidate counts,
taken from exact histograms of all fingerprints. Rows that share a probe key meet in a bucket,
and every candidate is verified on all 64 bits there.

A row is dealt to all values within ceil(t / 2) bits of its part: of two rows that differ in t bits
of a part, one meets the other half way.

Exact copies share a fingerprint, so the search runs on distinct fingerprints. A bucket gives a
forest of links, not all its pairs; buckets beyond a limit are cut by the same principle on
the bits left (or, where rows have sizes, by classes of size) and, if one still is too large,
compared block by block over many tasks.

components() links by fingerprints alone. near_copies() takes a wider distance for its candidates
and verifies every link by the similarity of the texts' word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import utf8



def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one UTF-8 text, whole: ASCII lower case, words between ASCII white space."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, votes = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for lo in range(0, len(starts), 1 << 16):
        raw = b"".join([digest(line[a:b], seed) for a, b in zip(starts[lo : lo + (1 << 16)], ends[lo : lo + (1 << 16)])])
        rows = np.frombuffer(raw, np.uint8).reshape(-1, 8)
        if len(rows) < 400:
            votes += np.unpackbits(rows, axis=1).sum(0, dtype=np.int64)
        else:
            for j in range(8):
                votes[8 * j : 8 * j + 8] += np.bincount(rows[:, j], minlength=256) @ _BITS
    return int.from_bytes(np.packbits(2 * votes > len(starts)).tobytes(), "big")


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of docs(doc_id, text); null and wordless texts give 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column("text"))
            raw = memoryview(data)
            fps = [fingerprint(bytes(raw[i:j]), shingle, seed) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    common.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


# -- parts and thresholds ---------------------------------------------------------------------


def _pair_counts(nodes: DataFrame) -> tuple[np.ndarray, int]:
    """How many fingerprints have bits i and j set, over all of them; 2080 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64)), 0
        for b in batches:
            x = np.unpackbits(b.column("fp").to_numpy().view(np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += x.T @ x
            n += len(x)
        i, j = np.triu_indices(64)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(both[i, j], n).astype(np.int64))], ["i", "j", "c"])

    sums = nodes.select("fp").mapInArrow(run, "i bigint, j bigint, c bigint").groupBy("i", "j").agg(F.sum("c").alias("c")).collect()
    out, n = np.zeros((64, 64)), 0
    for r in sums:
        if r["i"] < 0:
            n = r["c"]
        else:
            out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["c"]
    return out, n


def parts_of(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Cut the bits into equal parts, most correlated bits together."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    phi = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(phi, 0)
    left, out = list(range(64)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        sub = phi[np.ix_(left, left)]
        i, j = divmod(int(np.argmax(sub)), len(left)) if len(left) > 1 else (0, 0)
        part = sorted({left[i], left[j]})[:size]
        while len(part) < size:
            rest = [b for b in left if b not in part]
            part.append(rest[int(np.argmax(phi[np.ix_(rest, part)].sum(1)))])
        out.append(sorted(part))
        left = [b for b in left if b not in part]
    return out


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _radius(t: int) -> int:
    """How far a row is dealt so that rows which differ in t bits meet half way."""
    return (t + 1) // 2


def _flips(bits: list[int], t: int) -> list[int]:
    return [_mask(list(c)) for k in range(t + 1) for c in combinations(bits, k)]


def thresholds_of(sizes: list[np.ndarray], distance: int, row_cost: float = 100.0) -> list[int]:
    """Thresholds with sum(t + 1) = distance + 1 and the least estimated work.

    sizes[i] has the rows of every value of part i (bits packed). With threshold t each row is
    dealt to all values within ceil(t / 2) bits; the work is the comparisons within buckets and
    the rows moved. Radii beyond two bits are too dear to be considered."""
    cost = []
    for cnt in sizes:
        width, own, ball = int(len(cnt)).bit_length() - 1, [0.0], cnt.astype(np.float64)
        for r in range(min(2, _radius(distance)) + 1):
            if r:
                ball = ball + sum(cnt[np.arange(len(cnt)) ^ f] for f in _flips(list(range(width)), r)[sum(comb(width, k) for k in range(r)) :])
            own += [float((ball * ball).sum()) / 2 + row_cost * float(ball.sum())] * (2 if r else 1)
        own += [float("inf")] * (distance + 2 - len(own))
        cost.append(own)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in cost:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, distance + 1):
                if used + t + 1 <= distance + 1 and (used + t + 1 not in nxt or c + own[t + 1] < nxt[used + t + 1][0]):
                    nxt[used + t + 1] = (c + own[t + 1], [*ts, t])
        best = nxt
    return best[distance + 1][1]


# -- buckets ----------------------------------------------------------------------------------


def forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect exactly what lies within `distance` bits, step by step, in one bucket."""
    left, a, b = np.unique(fp), [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                got = left[near]
                left = left[~near]
                a.append(np.full(len(got), x))
                b.append(got)
                queue.extend(got)
    none = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _bucket_links(key: np.ndarray, fp: np.ndarray, distance: int, small: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Links in all the buckets of sorted keys: small buckets at once, by comparing each row with the d-th next."""
    edge = np.flatnonzero(np.diff(key)) + 1
    start, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
    a, b = [], []
    for i in np.flatnonzero(end - start > small):
        x, y = forest(fp[start[i] : end[i]], distance)
        a.append(x)
        b.append(y)
    keep = np.repeat((end - start > 1) & (end - start <= small), end - start)
    key, fp = key[keep], fp[keep]
    for d in range(1, small):
        same = key[d:] == key[:-d]
        if not same.any():
            break
        k = np.flatnonzero(same & (np.bitwise_count(fp[d:] ^ fp[:-d]) <= distance) & (fp[d:] != fp[:-d]))
        a.append(fp[k])
        b.append(fp[k + d])
    return np.concatenate(a or [fp[:0]]), np.concatenate(b or [fp[:0]])


def _near_rows(key: np.ndarray, fp: np.ndarray, ids: np.ndarray, size: np.ndarray, distance: int, ratio: float, most: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs a, b of ids in buckets of rows sorted by key and size, and which of them are left open.

    A pair counts if its bits differ in at most `distance` places and the lesser size is `ratio` of
    the other or more. A bucket with more than `most` pairs a row gives each row's two nearest
    neighbours and a forest that connects what all the pairs connect; ties go to the lesser id, so
    a group that meets in many buckets gives much the same pairs in each. A pair that is not among these has two
    rows of one tree with more than two neighbours each: such rows come as open pairs of the tree's
    least id with their own, and what else they pair with is left to _across()."""
    edge = np.flatnonzero(np.diff(key)) + 1
    start = np.concatenate([[0], edge])
    rows = np.diff(np.concatenate([start, [len(key)]]))
    bucket, pairs = np.repeat(np.arange(len(start)), rows), np.zeros(len(start), np.int64)
    a, b, at, d = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.arange(len(key)), 0
    while len(at):
        d += 1
        at = at[at + d < len(key)]
        at = at[(bucket[at] == bucket[at + d]) & (size[at] >= ratio * size[at + d])]  # sizes ascend, so a pair that fails stays out
        hit = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= distance]
        pairs += np.bincount(bucket[hit], minlength=len(start))
        at = at[pairs[bucket[at]] <= most * rows[bucket[at]]]
        a.append(hit)
        b.append(hit + d)
    x, y = np.concatenate(a), np.concatenate(b)
    dense = pairs > most * rows
    keep = ~dense[bucket[x]]
    a, b, unnamed = [ids[x[keep]]], [ids[y[keep]]], [np.zeros(int(keep.sum()), bool)]
    for k in np.flatnonzero(dense).tolist():
        lo, hi = int(start[k]), int(start[k] + rows[k])
        order = lo + np.argsort(ids[lo:hi], kind="stable")
        i, j, first, many = _dense_pairs(fp[order], size[order].astype(np.float32), distance, ratio)
        a += [ids[order[i]], ids[order[first[many]]]]
        b += [ids[order[j]], ids[order[many]]]
        unnamed.append(np.repeat([False, True], [len(i), int(many.sum())]))
    return np.concatenate(a), np.concatenate(b), np.concatenate(unnamed)


def _dense_pairs(fp: np.ndarray, size: np.ndarray, distance: int, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A forest over the rows of one bucket, and the two nearest neighbours of each, by row numbers; the first row of each row's tree, and whether it has more than two neighbours."""
    n = len(fp)
    free, queue, a, b = np.arange(n), [], [], []
    first, many = np.arange(n), np.zeros(n, bool)
    while len(free):
        if not queue:
            queue, free = [int(free[0])], free[1:]
        i = queue.pop(0)
        near = (np.bitwise_count(fp[free] ^ fp[i]) <= distance) & (np.minimum(size[free], size[i]) >= ratio * np.maximum(size[free], size[i]))
        got, free = free[near], free[~near]
        queue.extend(got.tolist())
        first[got] = first[i]
        a.append(np.full(len(got), i))
        b.append(got)
    for lo in range(0, n, 256):
        far = np.bitwise_count(fp[lo : lo + 256, None] ^ fp)
        w = size[lo : lo + 256, None]
        far[(np.minimum(w, size) < ratio * np.maximum(w, size))] = 99
        mine = np.arange(len(far))
        far[mine, lo + mine] = 99
        many[lo : lo + 256] = (far <= distance).sum(1) > 2
        for _ in range(2):
            nearest = far.argmin(1)
            ok = np.flatnonzero(far[mine, nearest] <= distance)
            a.append(lo + ok)
            b.append(nearest[ok])
            far[mine, nearest] = 99
    return np.concatenate(a), np.concatenate(b), first, many


def _links(rows: DataFrame, distance: int, ratio: float) -> DataFrame:
    """a, b: links of rows(key, fp), or a, b, open: candidate pairs of rows(key, fp, id, size), bucket by bucket.

    A task keeps one bucket and one batch in memory."""
    names = [c for c in ("key", "fp", "id", "size") if c in rows.columns]

    def out(key, fp, *more):
        if more:
            columns = _near_rows(key, fp.view(np.uint64), *more, distance, ratio)
        else:
            columns = [v.view(np.int64) for v in _bucket_links(key, fp.view(np.uint64), distance)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "open"][: len(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64) for _ in names]
        for batch in batches:
            held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, names)]
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if last and len(held[0]) >= 1 << 14:
                yield out(*[h[:last] for h in held])
                held = [h[last:] for h in held]
        if len(held[0]):
            yield out(*held)

    n = common.partitions(rows.sparkSession)
    return rows.select(*names).repartition(n, "key").sortWithinPartitions("key", names[-1]).mapInArrow(run, "a bigint, b bigint" + (", open boolean" if "id" in names else ""))


def links(nodes: DataFrame, distance: int = 3, parts: int = 4, limit: int = 2048, ratio: float = 0.0) -> DataFrame:
    """Links a, b between distinct fingerprints nodes(fp) that connect whatever `distance` bits connect.

    Of nodes(fp, id, size) it gives candidate pairs a, b of ids, some of them more than once, that
    connect what `distance` bits and sizes within `ratio` of each other connect. Where a bucket has too many pairs
    to name, those not named are between ids b that come with the same a in `open` rows. limit: rows of a bucket that one task compares; larger buckets are cut on the bits left and
    then compared block by block, so no case is dropped. The histograms on the driver have at most
    parts * 2**(64 / parts) entries, whatever the input."""
    if 64 % parts or 64 // parts > 16:
        raise ValueError("parts must divide 64 into at most 16 bits each")
    both, n = _pair_counts(nodes)
    cut = parts_of(both, n, parts)
    masks = [_mask(p) for p in cut]
    more = [c for c in ("id", "size") if c in nodes.columns]
    probes = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for i, m in enumerate(masks)])
    hist = nodes.select(F.explode(probes).alias("p")).groupBy("p.part", "p.value").count().toArrow()
    sizes = [np.zeros(1 << len(p), np.int64) for p in cut]

    part, value, count = (hist.column(c).to_numpy() for c in ("part", "value", "count"))
    for i, bits in enumerate(cut):
        own = part == i
        place = sum(((value[own] >> b & 1) << k for k, b in enumerate(bits)), np.zeros(int(own.sum()), np.int64))
        np.add.at(sizes[i], place, count[own])
    t = thresholds_of(sizes, distance)
    keyed, hot = [], []
    for i, m in enumerate(masks):
        if t[i] < 0:
            continue
        width, ball = len(cut[i]), np.zeros_like(sizes[i])
        for f in _flips(list(range(width)), _radius(t[i])):
            ball += sizes[i][np.arange(1 << width) ^ f]
        for v in np.flatnonzero(ball > limit).tolist():
            hot.append((i, _signed(sum(1 << b for k, b in enumerate(cut[i]) if v >> k & 1))))
        own = F.col("fp").bitwiseAND(F.lit(_signed(m)))
        values = F.array(*[own.bitwiseXOR(F.lit(_signed(f))) for f in _flips(cut[i], _radius(t[i]))])
        keyed.append(nodes.select("fp", *more, F.lit(i).alias("part"), F.explode(values).alias("value")))
    rows = keyed[0]
    for own in keyed[1:]:
        rows = rows.unionByName(own)
    key = F.xxhash64("part", "value")
    if not hot:
        return _links(rows.select("fp", *more, key.alias("key")), distance, ratio)
    spark = nodes.sparkSession
    listed = F.broadcast(spark.createDataFrame(hot, "part int, value bigint"))  # at most parts * 2**16 rows
    cool = rows.join(listed, ["part", "value"], "left_anti").select("fp", *more, key.alias("key"))
    warm = rows.join(listed, ["part", "value"], "left_semi").withColumn("k0", key)
    if more:  # sizes apart by more than `ratio` don't meet: rows go to their own class of sizes and the one below
        step = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / -math.log(ratio)).cast("int")
        second = warm.select("fp", *more, "k0", F.explode(F.array(step, step - 1)).alias("class")).select("fp", *more, F.xxhash64("k0", "class").alias("key"))
    else:
        subs = []
        for m in masks:
            rest = [b for b in range(64) if not m >> b & 1]
            subs.append(F.array(*[F.struct(F.lit(s).alias("sub"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(rest[s :: distance + 1])))).alias("rest")) for s in range(distance + 1)]))
        which = F.when(F.col("part") == 0, subs[0])
        for i in range(1, parts):
            which = which.when(F.col("part") == i, subs[i])
        second = warm.select("fp", "k0", F.explode(which).alias("s")).select("fp", F.xxhash64("k0", "s.sub", "s.rest").alias("key"))
    cutter = common.written(second, "simhash-second")
    large = cutter.groupBy("key").count().filter(F.col("count") > limit)
    cool = cool.unionByName(cutter.join(large, "key", "left_anti").select("fp", *more, "key"))
    blocks = F.ceil(F.col("count") / F.lit(limit)).cast("int")
    own_block = F.pmod(F.xxhash64("fp", *more), F.col("blocks")).cast("int")
    dealt = cutter.join(large, "key").withColumn("blocks", blocks).withColumn("mine", own_block)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("fp", *more, F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"))
    return _links(cool.unionByName(dealt), distance, ratio)


# -- components -------------------------------------------------------------------------------


def connected(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that links a, b reach, for every node with a link.

    Labels go to the neighbours and then jump to their label's label, until nothing changes; each
    round is written to the shared folder, so a lost executor costs one round at most."""
    both = common.written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = common.written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("m", "node").alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        step = common.written(labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "m").alias("root")), "labels")
        up = step.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        labels = common.written(step.join(up, "root").select("node", F.least("root", "higher").alias("root"), (F.least("root", "higher") < F.col("was")).alias("moved")), "labels")
        moved = labels.filter("moved").limit(1).count()
        labels = labels.drop("moved")
        if not moved:
            return labels


def components(docs: DataFrame, distance: int = 3, shingle: int = 3, seed: int = 42, limit: int = 2048) -> DataFrame:
    """doc_id, fp, component_id of docs(doc_id, text): one row per row of docs.

    component_id is the smallest doc_id reachable by links of at most `distance` differing bits,
    the document's own included. Texts without words, null ones too, have fingerprint 0 and are
    linked like others. Rows without doc_id link as well; they have no say in component_id. An
    empty table gives no rows."""
    fps = common.written(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = common.written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprints-distinct")
    roots = common.written(connected(links(nodes, distance, limit=limit)), "roots")
    mine = common.written(nodes.join(roots.withColumnRenamed("node", "fp"), "fp"), "members")
    least = common.written(mine.groupBy("root").agg(F.min("rep").alias("component_id")), "components")
    linked = mine.join(least, "root").select("fp", "component_id")
    alone = nodes.join(roots.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", F.col("rep").alias("component_id"))
    of = common.written(linked.unionByName(alone), "components-of")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


# -- near copies ------------------------------------------------------------------------------


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct XXH64 hashes, sorted, of a text's word shingles; the whole text if it has fewer words, none without words."""
    import xxhash

    line = b" ".join(text.lower().split())
    if not line:
        return np.empty(0, np.int64)
    ends = [*np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist(), len(line)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    k = min(words, len(ends))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b]) for a, b in zip(starts, ends[k - 1 :])), np.uint64, len(ends) - k + 1).view(np.int64))


def _distinct(words: list[bytes], k: int) -> int:
    """How many different shingles of k words there are, by hashes that hold within one process."""
    k = min(k, len(words))
    if not k:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    n, out = len(h) - k + 1, np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return len(np.unique(out))


def _prints(docs: DataFrame, words: int, shingle: int) -> DataFrame:
    """doc_id, row (a hash of doc_id and text), node (a hash of the text's words), fp and size of every row."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column("text"))
            raw, node, fps, size = memoryview(data), [], [], []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                text = bytes(raw[i:j])
                own = text.lower().split()
                node.append(xxhash.xxh3_64_intdigest(b" ".join(own)))
                fps.append(fingerprint(text, shingle))
                size.append(_distinct(own, words))
            columns = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fps)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), *columns, pa.array(size, pa.int64())], ["doc_id", "row", "node", "fp", "size"])

    common.small_batches(docs.sparkSession)
    return _keyed(docs.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, row bigint, node bigint, fp bigint, size bigint")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("row", F.xxhash64("doc_id", "text"))


#: Named rows (16 bytes each) that are broadcast to the texts at most; more are joined by merge.
FEW = 2_000_000


def _sent(rows: DataFrame, n: int, few: int) -> DataFrame:
    return F.broadcast(rows) if n <= few else rows.hint("merge")


def _sets(ends: DataFrame, n: int, docs: DataFrame, rows: DataFrame, words: int, few: int) -> DataFrame:
    """node, shingles of the texts of ends(node), about n of them; only these texts are moved.

    rows(node, doc_id, row) names one row of docs for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column("text"))
            sets = [shingles(bytes(data[i:j]), words) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            values = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets)) if sets else pa.array([], pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("node"), values], ["node", "shingles"])

    named = rows.join(ends, "node").select("node", F.col("doc_id").alias("__id"), "row")
    texts = _keyed(docs.select("doc_id", "text")).join(_sent(named, n, few), "row").filter(F.col("doc_id").eqNullSafe(F.col("__id"))).select("node", "text")
    return common.written(texts.mapInArrow(run, "node bigint, shingles array<bigint>").dropDuplicates(["node"]), "shingles")


def _alike(pairs: DataFrame, n: int, sets: DataFrame, similarity: float, few: int) -> DataFrame:
    """Those of n pairs(a, b) whose sets have a Jaccard similarity of `similarity` or more."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).join(_sent(pairs, n, few), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, similarity: float, words: int, few: int) -> DataFrame:
    """Those of pairs(a, b) whose texts' shingle sets have a Jaccard similarity of `similarity` or more."""
    n = pairs.count()
    return _alike(pairs, n, _sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), 2 * n, docs, rows, words, few), similarity, few)


# -- pairs across groups ----------------------------------------------------------------------

#: Cells of the table of shingle counts that rare shingles are told by.
CELLS = 1 << 16
#: Bits of a text's map, in which every shingle turns one over.
MAP = 1024


def _prefixes(batches: Iterator[pa.RecordBatch], counts: np.ndarray, similarity: float) -> Iterator[pa.RecordBatch]:
    """(node, key): each text's rarest shingles, as many as leave fewer than any alike text shares with it."""
    for batch in batches:
        nodes, keys = [], []
        for node, own in zip(batch.column("node").to_numpy(), batch.column("shingles")):
            own = np.asarray(own.values)
            take = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1
            rare = own[np.lexsort((own, counts[own & (CELLS - 1)]))[:take]]
            nodes.append(np.full(len(rare), node))
            keys.append(rare)
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(keys))], ["node", "key"])


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, map): two maps differ in no more bits than their texts in shingles."""
    for batch in batches:
        maps = [np.packbits((np.bincount(np.asarray(own.values) >> 24 & (MAP - 1), minlength=MAP) & 1).astype(np.uint8)).tobytes() for own in batch.column("shingles")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(maps, pa.binary())], ["node", "map"])


def _asked(batches: Iterator[pa.RecordBatch], distance: int, ratio: float, nearest: bool) -> Iterator[pa.RecordBatch]:
    """a, b: rows of side 0 with rows of their group that lie in another root's set, are near by bits, alike in
    size, and whose maps don't say that they differ in too many shingles; of each such set all, or the one nearest by its map."""
    names = ["g", "side", "node", "fp", "size", "root"]

    def out(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        g, side, node, fp, size, root, maps = cols
        fp, size = fp.view(np.uint64), size.astype(np.float64)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1, [len(g)]])
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            ask = lo + int(np.searchsorted(side[lo:hi], 1))
            for at in range(lo, ask, 128):
                i, j = slice(at, min(at + 128, ask)), slice(ask, hi)
                near = np.bitwise_count(fp[i, None] ^ fp[j]) <= distance
                near &= (root[i, None] != root[j]) & (np.minimum(size[i, None], size[j]) >= ratio * np.maximum(size[i, None], size[j]))
                x, y = np.nonzero(near)
                x, y = x + at, y + ask
                parted = np.concatenate([np.bitwise_count(maps[x[k : k + 4096]] ^ maps[y[k : k + 4096]]).sum(1, dtype=np.int64) for k in range(0, len(x), 4096)] or [x])
                can = parted <= (1 - ratio) / (1 + ratio) * (size[x] + size[y]) + 1e-6
                x, y, parted = x[can], y[can], parted[can]
                if nearest and len(x):
                    by = np.lexsort((node[y], parted, root[y], x))
                    x, y = x[by], y[by]
                    first = np.append(True, (x[1:] != x[:-1]) | (root[y[1:]] != root[y[:-1]]))
                    x, y = x[first], y[first]
                if len(x):
                    a, b = node[x], node[y]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    held = [*(np.empty(0, np.int64) for _ in names), np.empty((0, MAP // 64), np.uint64)]
    for batch in batches:
        maps = np.frombuffer(b"".join(batch.column("map").to_pylist()), np.uint64).reshape(-1, MAP // 64)
        held = [np.concatenate([h, c]) for h, c in zip(held, [*(batch.column(c).to_numpy() for c in names), maps])]
        last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if last and len(held[0]) >= 1 << 14:
            yield from out([h[:last] for h in held])
            held = [h[last:] for h in held]
    if len(held[0]):
        yield from out(held)


def _open(trees: DataFrame, roots: DataFrame) -> DataFrame:
    """node: the texts of trees(tree, node) whose tree is not all in one group of roots(node, root) yet."""
    rooted = trees.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = rooted.groupBy("tree").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("tree")
    return trees.join(apart, "tree").select("node").distinct()


def _across(dense: DataFrame, docs: DataFrame, nodes: DataFrame, roots: DataFrame, similarity: float, words: int, distance: int, limit: int, few: int) -> DataFrame:
    """roots(node, root) after all links between texts of dense(node) that lie in different groups so far.

    Two sets alike to `similarity` share one of the rarest shingles of each (whatever counts as rare, as long as
    it is one order for all), so texts meet by these. Of the texts that meet by one shingle, those of its largest group
    are not compared with each other, only the others with all: what is linked costs nothing more. Large meetings
    are cut into blocks of `limit` rows on either side. Pairs that the texts' maps rule out are not named. A first
    round names the nearest text of every other group alone, which joins most of what is linked; the second one
    names all pairs between the groups that are left."""
    spark = docs.sparkSession
    named = common.written(nodes.join(dense, "node").select("node", "best.doc_id", "best.row", "fp", "size"), "dense")
    sets = _sets(named.select("node"), named.count(), docs, named.select("node", "doc_id", "row"), words, few)
    counts = np.zeros(CELLS, np.int64)
    cell = F.col("s").bitwiseAND(F.lit(CELLS - 1))
    table = sets.select(F.explode("shingles").alias("s")).groupBy(cell.alias("c")).count().toArrow()  # a row a cell
    counts[table.column("c").to_numpy()] = table.column("count").to_numpy()
    shared = spark.sparkContext.broadcast(counts)
    keyed = common.written(sets.mapInArrow(lambda it: _prefixes(it, shared.value, similarity), "node bigint, key bigint"), "rare")
    maps = common.written(named.select("node", "fp", "size").join(sets.mapInArrow(_maps, "node bigint, map binary"), "node"), "maps")
    block = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    for nearest in (True, False):
        wide = common.written(maps.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "maps-of-roots")
        known = keyed.join(wide.select("node", "root"), "node")
        of_root = known.groupBy("key", "root").count().groupBy("key").agg(F.sum("count").alias("n"), F.max(F.struct("count", "root")).alias("top"))
        met = of_root.filter(F.col("n") > F.col("top.count")).select(
            "key", F.col("top.root").alias("major"), F.ceil(F.col("n") / limit).cast("int").alias("all_blocks"), F.ceil((F.col("n") - F.col("top.count")) / limit).cast("int").alias("ask_blocks"))
        rows = keyed.join(common.written(met, "met"), "key").join(wide, "node")
        asking = rows.filter(F.col("root") != F.col("major")).withColumn("i", block("ask_blocks")).withColumn("j", each("all_blocks")).withColumn("side", F.lit(0).cast("long"))
        asked = rows.withColumn("j", block("all_blocks")).withColumn("i", each("ask_blocks")).withColumn("side", F.lit(1).cast("long"))
        both = asking.unionByName(asked).select(F.xxhash64("key", "i", "j").alias("g"), "side", "node", "fp", "size", "root", "map")
        found = both.repartition(common.partitions(spark), "g").sortWithinPartitions("g", "side").mapInArrow(lambda it, own=nearest: _asked(it, distance, similarity, own), "a bigint, b bigint")
        pairs = common.written(found.distinct(), "pairs-across")
        links = common.written(_alike(pairs, pairs.count(), sets, similarity, few), "near-across")
        if not links.isEmpty():
            roots = connected(links.unionByName(roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return roots


def near_copies(docs: DataFrame, similarity: float = 0.8, words: int = 5, distance: int = 11, shingle: int = 2, limit: int = 2048, few: int = FEW) -> DataFrame:
    """doc_id, row, copies, stays: one row for each doc_id and text of docs(doc_id, text), and whether it is the one that stays of its group.

    Two texts are linked if their sets of `words`-word shingles (A-Z lower-cased, words between ASCII
    white space) are alike to `similarity` or more, among the candidates whose SimHashes of
    `shingle`-word shingles differ in at most `distance` bits; links add up to groups. Where too many
    candidates meet for all pairs to be named, some are, and the links between the groups that these leave are
    found by rare shingles that the texts of unnamed pairs share, so no link among candidates is lost. Texts of equal
    words are one text. Of a group the row with the least doc_id stays, null ids last, then by a hash
    of the text. `copies` says how many rows of docs have this doc_id and text; `row` is
    xxhash64(doc_id, text). Null, empty and wordless texts are alike. An empty table gives no rows."""
    prints = common.written(_prints(docs, words, shingle), "prints")
    rows = common.written(prints.groupBy("node", "doc_id", "row").agg(F.count("*").alias("copies"), F.min("fp").alias("fp"), F.min("size").alias("size")), "rows")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    nodes = common.written(rows.groupBy("node").agg(best, F.min("fp").alias("fp"), F.min("size").alias("size")), "texts")
    found = links(nodes.select("fp", F.col("node").alias("id"), "size"), distance, limit=limit, ratio=similarity)
    pairs = common.written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "open").distinct(), "pairs")
    sure = common.written(_verified(pairs.filter("not open").select("a", "b"), docs, nodes.select("node", "best.doc_id", "best.row"), similarity, words, few), "near")
    roots = connected(sure)
    dense = common.written(_open(pairs.filter("open").select(F.col("a").alias("tree"), F.col("b").alias("node")), roots), "open")
    if not dense.isEmpty():
        roots = _across(dense, docs, nodes, roots, similarity, words, distance, limit, few)
    rooted = common.written(nodes.select("node", "best").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    first = rooted.groupBy("root").agg(F.min("best").alias("first"))
    mine = rooted.join(first, "root").select("node", F.col("first.doc_id").alias("first_id"), F.col("first.row").alias("first_row"))
    stays = (F.col("row") == F.col("first_row")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    return rows.join(mine, "node").select("doc_id", "row", "copies", stays.alias("stays"))


def deduplicate(docs: DataFrame, few: int = FEW, **options) -> DataFrame:
    """docs, all columns kept, without the rows that near_copies() leaves out; of rows alike in doc_id and text one stays.

    Up to `few` rows that go are broadcast to the texts, which then stay where they are; more are joined by merge."""
    names = docs.columns
    other = near_copies(docs, few=few, **options).filter("not stays or copies > 1")
    listed = common.written(other.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("stays").alias("__stays")), "listed-rows")
    own = F.col("doc_id").cast("long")
    judged = docs.join(_sent(listed, listed.count(), few), (F.xxhash64(own, F.col("text")) == F.col("__row")) & own.eqNullSafe(F.col("__id")), "left")
    columns = [F.col(f"`{c}`") for c in names]
    kept = judged.filter("__row is null").select(*columns)
    if listed.filter("__stays").isEmpty():
        return kept
    again = judged.filter("__stays").groupBy("__row", "__id").agg(F.min(F.struct(*columns)).alias("__best"))
    return kept.unionByName(again.select("__best.*"))
