"""Ranked lexical search by dual trees: the best documents for every item of a query table.

A document is a vector with one coordinate a term, its saturated term frequency; an item has weight
times occurrences; a score is their product. Both sides get a tree. An item node holds, for each
term, the largest coordinate of its items, a document node that of its documents, so the product of
two nodes bounds every score between them. A pair of nodes is dropped with all its batches if the
bound is below the weakest k-th score that its items have so far; what can tie stays. All
coordinates are whole numbers, so bounds and scores are exact.

Documents are read twice: their texts once, into a table of the items' terms in each document, and
that table once by the search. In a task of the search, documents come a few thousand at a time; these are halved
again and again between two unlike ones, so that like documents share nodes, and the items' trees, which
all tasks get, meet the tree of every such chunk. Thresholds hold on from chunk to chunk. A task gives its best k
for each item, and one window ranks these.

Items are broadcast in blocks of at most `block_terms` terms, each block one search of the table of terms;
inside a block they are in groups of `group_items`, each with a tree of its own. A task holds one chunk
and one group's vectors at a time (kept where a block has few groups)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of UTF-8 to bytes of terms, separators to a space; only A-Z are lower-cased.
_TO_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b > 0x7F or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_TERMS).split()


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


# -- reading texts ----------------------------------------------------------------------------

ENTRIES = "doc_id bigint, n bigint, terms array<int>, tf array<int>"


def _entries(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    known = {t: i for i, t in enumerate(shared.value)}
    width = max(1, len(known))
    for batch in batches:
        sizes, parts = [], []
        for text in batch.column(1):
            words = terms_of(text.as_py())
            sizes.append(len(words))
            found = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
            parts.append(found[found >= 0])
        doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        key, tf = np.unique(doc * width + np.concatenate(parts) if parts else np.empty(0, np.int64), return_counts=True)
        offsets = pa.array(np.searchsorted(key, np.arange(len(parts) + 1) * width), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (key % width, tf)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [Counter(terms_of(t.as_py())) for t in batch.column(1)]
        lists = [pa.array([[t.decode() for t in c] for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["item_id", "terms", "counts"])


# -- trees ------------------------------------------------------------------------------------


def _order(ptr: np.ndarray, term: np.ndarray, value: np.ndarray, width: int, leaf: int) -> np.ndarray:
    """Rows of a sparse table in an order where halves, quarters and so on are alike: each stretch is parted
    at the median of how much more a row is like the one than like the other of two rows unlike each other."""
    rows, todo, dense = np.arange(len(ptr) - 1), [(0, len(ptr) - 1)], np.zeros(width, np.float64)
    value = value.astype(np.float64)
    norm = np.sqrt(np.maximum(np.add.reduceat(np.append(value**2, 0), ptr[:-1]) * (np.diff(ptr) > 0), 1e-9))

    def likeness(which: np.ndarray, to: int) -> np.ndarray:
        own = slice(ptr[to], ptr[to + 1])
        dense[term[own]] = value[own]
        size = ptr[which + 1] - ptr[which]
        at = np.repeat(ptr[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out = np.bincount(np.repeat(np.arange(len(which)), size), dense[term[at]] * value[at], len(which)) / norm[which]
        dense[term[own]] = 0
        return out / norm[to]

    while todo:
        lo, hi = todo.pop()
        if hi - lo <= leaf:
            continue
        which = rows[lo:hi]
        a = which[int(np.argmin(likeness(which, int(which[0]))))]
        to_a = likeness(which, int(a))
        b = which[int(np.argmin(to_a))]
        rows[lo:hi] = which[np.argsort(to_a - likeness(which, int(b)), kind="stable")]
        half = leaf
        while 2 * half < hi - lo:
            half *= 2  # whole leaves on the left
        todo += [(lo, lo + half), (lo + half, hi)]
    return rows


def _taken(ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and places of the entries of rows."""
    size = ptr[rows + 1] - ptr[rows]
    return np.concatenate([[0], np.cumsum(size)]), np.repeat(ptr[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Items:
    """A group of items as dense rows over their own terms, and a tree of `fan` children a node over them."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], leaf: int = 4, fan: int = 4):
        ptr = np.concatenate([[0], np.cumsum([len(t) for t, _ in vectors])]).astype(np.int64)
        term, value = np.concatenate([t for t, _ in vectors]), np.concatenate([v for _, v in vectors])
        self.terms, local = np.unique(term, return_inverse=True)
        width = max(1, len(self.terms))
        self.order = _order(ptr, local, value, width, leaf)  # place in the tree to item of the group
        own, at = _taken(ptr, self.order)
        rows = np.zeros((len(vectors), width), np.int64)
        rows[np.repeat(np.arange(len(vectors)), np.diff(own)), local[at]] = value[at]
        self.rows, self.starts, self.levels = rows, [], []  # levels from the root down; starts: a node's first child
        step = leaf
        while True:
            cuts = np.arange(0, len(rows), step)
            below = rows if step == leaf else self.levels[0]
            first = cuts if step == leaf else np.arange(0, len(below), fan)
            self.levels.insert(0, np.maximum.reduceat(below, first, axis=0))
            self.starts.insert(0, np.append(first, len(below)))
            if len(cuts) == 1:
                break
            step *= fan
        self.first = [np.arange(0, len(rows), leaf * fan ** (len(self.levels) - 1 - i)) for i in range(len(self.levels))]

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        start, end = self.starts[level][nodes], self.starts[level][nodes + 1]
        size = end - start
        return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Documents:
    """A chunk of documents as a tree: sparse coordinate maxima of each node, leaves of `leaf` documents, `fan` children a node."""

    def __init__(self, doc_id: np.ndarray, ptr: np.ndarray, term: np.ndarray, value: np.ndarray, weight: np.ndarray, leaf: int = 16, fan: int = 4):
        order = _order(ptr, term, value * weight[term], len(weight), leaf)
        own, at = _taken(ptr, order)
        self.doc_id, self.ptr, self.term, self.value, self.leaf, self.fan = doc_id[order], own, term[at], value[at], leaf, fan
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # from the root down
        node, term, value, width = np.repeat(np.arange(len(order)) // leaf, np.diff(own)), self.term, self.value, len(weight)
        nodes = -(-len(order) // leaf)
        while True:
            key = node * width + term
            by = np.argsort(key, kind="stable")
            key, first = np.unique(key[by], return_index=True)
            value = np.maximum.reduceat(value[by], first) if len(first) else value
            node, term = key // width, key % width
            self.levels.insert(0, (np.searchsorted(node, np.arange(nodes + 1)), term, value))
            if nodes == 1:
                break
            node, nodes = node // fan, -(-nodes // fan)

    def node(self, level: int, i: int) -> tuple[np.ndarray, np.ndarray]:
        ptr, term, value = self.levels[level]
        return term[ptr[i] : ptr[i + 1]], value[ptr[i] : ptr[i + 1]]

    def children(self, level: int, i: int) -> range:
        return range(i * self.fan, min((i + 1) * self.fan, len(self.levels[level + 1][0]) - 1))


class Best:
    """The best k of each item so far: higher scores first, then smaller ids; ids of null come last."""

    def __init__(self, items: int, k: int):
        self.k, self.order = k, np.arange(items)  # order: a row's item in its group
        self.score, self.doc, self.null = np.zeros((items, k), np.int64), np.zeros((items, k), np.int64), np.ones((items, k), bool)

    def weakest(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], 1)  # a score of 0 is no match

    def add(self, item: int, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = np.concatenate([self.score[item], score]), np.concatenate([self.doc[item], doc]), np.concatenate([self.null[item], null])
        by = np.lexsort((doc, null, -score))[: self.k]
        self.score[item], self.doc[item], self.null[item] = score[by], doc[by], null[by]


class Search:
    """Meets one group's tree with one chunk's; best is in the order of the items' tree."""

    def __init__(self, items: Items, docs: Documents, null: np.ndarray, best: Best, column: np.ndarray):
        self.items, self.docs, self.null, self.best, self.column = items, docs, null, best, column
        self.pairs = 0
        self._weakest()

    def _weakest(self) -> None:
        self.kth = self.best.weakest()
        self.weak = [np.minimum.reduceat(self.kth, first) for first in self.items.first]

    def _local(self, term: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.column[term]
        ours = at >= 0
        return at[ours], value[ours]

    def run(self) -> None:
        self.visit(0, 0, 0, np.zeros(1, np.int64))

    def visit(self, level: int, node: int, depth: int, alive: np.ndarray) -> None:
        """Documents' node against the items' nodes `alive` of a level; both go down where bounds allow it."""
        at, value = self._local(*self.docs.node(level, node))
        if not len(at):
            return
        last = len(self.items.levels) - 1
        while True:
            self.pairs += len(alive)
            bound = self.items.levels[depth][np.ix_(alive, at)] @ value
            alive = alive[bound >= self.weak[depth][alive]]
            if not len(alive):
                return
            if depth == last:
                break
            alive, depth = self.items.children(depth, alive), depth + 1
            if level + 1 < len(self.docs.levels):
                break  # one step down on either side in turn
        if level + 1 == len(self.docs.levels):
            self.score(node, self.items.children(last, alive), at, value)
            return
        for child in self.docs.children(level, node):
            self.visit(level + 1, child, depth, alive)

    def score(self, leaf: int, items: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        """Items against the documents of a leaf, after one more bound for each item alone."""
        items = items[self.items.rows[np.ix_(items, at)] @ value >= self.kth[items]]
        if not len(items):
            return
        lo, hi = leaf * self.docs.leaf, min((leaf + 1) * self.docs.leaf, len(self.docs.doc_id))
        own = slice(self.docs.ptr[lo], self.docs.ptr[hi])
        at = self.column[self.docs.term[own]]
        dense = np.zeros((hi - lo, self.items.rows.shape[1]), np.int64)
        dense[np.repeat(np.arange(hi - lo), np.diff(self.docs.ptr[lo : hi + 1]))[at >= 0], at[at >= 0]] = self.docs.value[own][at >= 0]
        used = np.unique(at[at >= 0])
        scores = self.items.rows[np.ix_(items, used)] @ dense[:, used].T
        better = scores >= self.kth[items][:, None]
        for i in np.flatnonzero(better.any(1)).tolist():
            which = np.flatnonzero(better[i])
            self.best.add(int(items[i]), scores[i, which], self.docs.doc_id[lo + which], self.null[lo + which])
        if better.any():
            self._weakest()


# -- the search on Spark ----------------------------------------------------------------------

FOUND = "item int, doc_id bigint, score bigint"


def _searched(batches: Iterator[pa.RecordBatch], shared, n_docs: int, n_terms: int, k: int, group_items: int, chunk: int) -> Iterator[pa.RecordBatch]:
    weight, vectors = shared.value
    groups = [vectors[i : i + group_items] for i in range(0, len(vectors), group_items)]
    trees: dict[int, Items] = {}
    best = [Best(len(g), k) for g in groups]
    held: list[pa.RecordBatch] = []

    def meet() -> None:
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        ids = rows.column("doc_id").combine_chunks()
        terms, tf = (pa.concat_arrays(rows.column(c).chunks) for c in ("terms", "tf"))
        sizes = terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        n = rows.column("n").to_numpy()
        m = 25 + np.array([75 * int(x) * n_docs // n_terms for x in n], np.int64)
        value = saturated(tf.flatten().to_numpy().astype(np.int64), np.repeat(m, sizes))
        docs = Documents(np.arange(len(n)), np.concatenate([[0], np.cumsum(sizes)]), terms.flatten().to_numpy().astype(np.int64), value, weight)
        place = docs.doc_id
        null = ids.is_null().to_numpy(zero_copy_only=False)[place]
        docs.doc_id = ids.fill_null(0).to_numpy(zero_copy_only=False)[place]
        for i, group in enumerate(groups):
            tree = trees.get(i) or Items(group)
            if len(groups) <= 4:
                trees[i] = tree
            column = np.full(len(weight), -1, np.int64)
            column[tree.terms] = np.arange(len(tree.terms))
            best[i].order = tree.order
            Search(tree, docs, null, best[i], column).run()

    count = 0
    for batch in batches:
        for at in range(0, batch.num_rows, chunk):
            part = batch.slice(at, chunk)
            held.append(part)
            count += part.num_rows
            if count >= chunk:
                meet()
                count = 0
    if count:
        meet()
    for i, own in enumerate(best):
        row, col = np.nonzero(own.score > 0)
        if len(row):
            ids = pa.array(own.doc[row, col], mask=own.null[row, col])
            yield pa.RecordBatch.from_arrays([pa.array((own.order[row] + i * group_items).astype(np.int32)), ids, pa.array(own.score[row, col])], ["item", "doc_id", "score"])


def _blocks(items: DataFrame, block_terms: int) -> Iterator[list[tuple]]:
    """Items with a term, as (item_id, terms, counts), in blocks of at most block_terms terms (or one item)."""
    block, size = [], 0
    for r in items.orderBy("item_id", F.col("terms").cast("string")).toLocalIterator():
        if block and size + len(r["terms"]) > block_terms:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["terms"], r["counts"]))
        size += len(r["terms"])
    if block:
        yield block


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = 1 << 20, group_items: int = 256, chunk: int = 4096) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of docs(doc_id, text) for each row of items(item_id, text).

    Null and empty texts have no terms: such items give no rows, such documents are never found. Equal items rank
    each on its own, rows of one doc_id are documents of their own, and documents without doc_id come last among equal
    scores. An item may have any number of terms, but one item is never split between blocks."""
    spark = docs.sparkSession
    common.small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select("item_id", F.col("text").cast("string").alias("text"))
    kind = asked.schema["item_id"].dataType.simpleString()
    vectors = common.written(asked.mapInArrow(_item_terms, f"item_id {kind}, terms array<string>, counts array<bigint>").filter("size(terms) > 0"), "items")
    out = None
    for block in _blocks(vectors, block_terms):
        known = {t: i for i, t in enumerate(dict.fromkeys(t for _, terms, _ in block for t in terms))}
        words = spark.sparkContext.broadcast([t.encode() for t in known])
        entries = common.written(texts.mapInArrow(lambda it, w=words: _entries(it, w), ENTRIES).filter("n > 0"), "terms", compression="zstd")
        words.destroy()
        n_docs, n_terms = entries.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        df = entries.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weighed = df.select("term", F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).alias("w")).collect()  # a row a term of the block
        weight = np.zeros(len(known), np.int64)  # a term that no document has counts nothing
        for r in weighed:
            weight[r["term"]] = r["w"]
        own = [(at := np.array([known[t] for t in terms], np.int64), np.array(counts, np.int64) * weight[at]) for _, terms, counts in block]
        shared = spark.sparkContext.broadcast((weight, own))
        found = entries.filter("size(terms) > 0").mapInArrow(lambda it, s=shared, n=n_docs, t=n_terms: _searched(it, s, n, t, k, group_items, chunk), FOUND)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        names = spark.createDataFrame([(i, b[0]) for i, b in enumerate(block)], f"item int, item_id {kind}")
        best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).join(F.broadcast(names), "item")
        best = common.written(best.select("item_id", "rank", "doc_id", "score"), "ranked")
        out = best if out is None else out.unionByName(best)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
