"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' normalised words are put into one automaton, which is broadcast. A document's words
run through it and the longest match that ends at each word is tracked. A match of `window` words
or more covers its words; an item shorter than the window counts when it occurs whole.

The automaton has at most two states per item word. Its size is bounded by `block_words`: a larger
benchmark is cut into blocks of items, each with its own automaton and its own pass. One automaton
at a time is built and broadcast; what the passes found is put together before anything is judged."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .tokens import utf8

#: Fixed values of the normal form: A-Z to a-z; of ASCII only a-z and 0-9 are word bytes.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Automaton:
    """Suffix automaton of several word sequences; items are (item_id, words)."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.window, self.ids = window, [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.length, self.link, self.next = [0], [-1], [{}]
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words] for _, words in items]
        for seq in coded:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        self.least = min([window, *(len(s) for s in coded if s)])
        # Where a state's longest match ends with a window: the state that stands for the window itself.
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.gram = [-1] * len(order)
        for s in order[1:]:
            up = self.link[s]
            self.gram[s] = -1 if self.length[s] < window else s if self.length[up] < window else self.gram[up]
        self.owners: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for k, seq in enumerate(coded):
            s = 0
            for i, w in enumerate(seq):
                s = self.next[s][w]
                if i + 1 >= window:
                    self.owners.setdefault(self.gram[s], set()).add(k)
            if 0 < len(seq) < window:
                self.short.setdefault(s, []).append((len(seq), k))
        self._pack()
        self.marked = array("i", [-1] * len(order))  # the nearest state, itself included, at which a short item ends
        if self.short:
            for s in order[1:]:
                self.marked[s] = s if s in self.short else self.marked[self.link[s]]

    def _pack(self) -> None:
        """Keep the one way on that most states have in two arrays, and dictionaries for the few states with several."""
        self.word, self.to = array("i", [-1] * len(self.next)), array("i", [-1] * len(self.next))
        self.more: dict[int, dict[int, int]] = {}
        for s, ways in enumerate(self.next):
            if len(ways) > 1:
                self.more[s] = ways
            elif ways:
                ((self.word[s], self.to[s]),) = ways.items()
        del self.next
        self.length, self.link, self.gram = array("i", self.length), array("i", self.link), array("i", self.gram)

    def _new(self, length: int, link: int, nxt: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(nxt)
        return len(self.length) - 1

    def _split(self, p: int, w: int) -> int:
        """The state for the longest word sequence of p followed by w, made apart if it isn't its own state yet."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Covered stretches [start, end) of words, merged, and the indexes of the items that occur."""
        get = self.vocabulary.get
        codes = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        known = np.concatenate([[0], (codes > 0).astype(np.int8), [0]])
        change = np.flatnonzero(np.diff(known))
        found: set[int] = set()
        spans: list[tuple[int, int]] = []

        def cover(a: int, b: int) -> None:
            while spans and spans[-1][1] >= a:
                a, b = min(a, spans[-1][0]), max(b, spans[-1][1])
                spans.pop()
            spans.append((a, b))

        length, link, word, to, more, gram, window = self.length, self.link, self.word, self.to, self.more, self.gram, self.window
        none: dict[int, int] = {}
        for lo, hi in zip(change[::2].tolist(), change[1::2].tolist()):
            if hi - lo < self.least:
                continue
            s = size = 0
            for i, w in enumerate(codes[lo:hi].tolist(), lo):
                while True:
                    on = to[s] if word[s] == w else more.get(s, none).get(w, -1)
                    if on >= 0 or not s:
                        break
                    s = link[s]
                    size = length[s]
                s, size = (on, size + 1) if on >= 0 else (0, 0)
                if size >= window:
                    cover(i + 1 - size, i + 1)
                    g = s
                    while length[link[g]] >= size:  # a shorter match of this state's class
                        g = link[g]
                    found |= self.owners.get(gram[g], set())
                m = self.marked[s]
                while m > 0:
                    for n, k in self.short.get(m, ()):
                        if n <= size:
                            cover(i + 1 - n, i + 1)
                            found.add(k)
                    m = self.marked[link[m]] if link[m] >= 0 else -1
        return spans, found


def blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Automaton]:
    """Automata of benchmark(item_id, text), each of at most block_words words (an item is never cut)."""
    held: list[tuple[int, list[bytes]]] = []
    n = 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        words = words_of((r["text"] or "").encode())
        if r["item_id"] is None or not words:
            continue
        if held and n + len(words) > block_words:
            yield Automaton(held, window)
            held, n = [], 0
        held.append((r["item_id"], words))
        n += len(words)
    yield Automaton(held, window)


_SPANS = "array<struct<start:bigint,end:bigint>>"


def _pass(docs: DataFrame, shared) -> DataFrame:
    """doc_id, text_hash, n_words, spans, items of every row of docs for one broadcast automaton."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        for b in batches:
            data, at = utf8(b.column("text"))
            raw, n, spans, items = memoryview(data), [], [], []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                words = words_of(bytes(raw[i:j]))
                got, found = a.scan(words)
                n.append(len(words))
                spans.append([{"start": x, "end": y} for x, y in got])
                items.append(sorted({a.ids[k] for k in found}))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n_words", "spans", "items"])

    common.small_batches(docs.sparkSession)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return kept.mapInArrow(run, f"doc_id bigint, text_hash bigint, n_words bigint, spans {_SPANS}, items array<bigint>")


def _joined(spans: Column) -> Column:
    """Stretches in any order and overlapping, as the fewest ascending ones."""

    def add(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (last["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.expr(f"cast(array() as {_SPANS})"), add)


def _matched(docs: DataFrame, first: Automaton, others: Iterator[Automaton]) -> tuple[DataFrame, int]:
    """One row for each (doc_id, text_hash) of docs with `rows`, and the shortest match there is: the automata of all blocks one after the other."""
    sc, found, least = docs.sparkSession.sparkContext, None, first.least
    for k, automaton in enumerate(chain([first], others)):
        shared = sc.broadcast(automaton)
        least = min(least, automaton.least)
        rows = _pass(docs, shared)
        own = common.written(rows.withColumn("block", F.lit(k)) if k == 0 else rows.filter(F.size("spans") > 0).withColumn("block", F.lit(k)), "matches")
        shared.unpersist()
        found = own if found is None else found.unionByName(own)
    out = found.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"), F.count_if(F.col("block") == 0).alias("rows"), _joined(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return out, least


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> tuple[Automaton, Iterator[Automaton] | None]:
    """The first automaton, and the others if there are any."""
    made = blocks(benchmark, window, block_words)
    first = next(made)
    second = next(made, None)
    return first, None if second is None else chain([second], made)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 100_000) -> DataFrame:
    """doc_id, n_words, spans (covered words [start, end), merged), items (ids that occur), per row of docs.

    Null and wordless texts have no words; null or wordless items and items without id are left
    out; an id that several items share stands once. With one block of items this is one pass
    without a shuffle; with more, the passes' rows are merged by document."""
    first, others = _blocks(benchmark, window, block_words)
    if others is None:
        return _pass(docs, docs.sparkSession.sparkContext.broadcast(first)).drop("text_hash")
    out, _ = _matched(docs, first, others)
    return out.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select("doc_id", "n_words", "spans", "items")


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 10, min_words: int = 10, max_coverage: float = 0.5, block_words: int = 100_000) -> DataFrame:
    """docs without the benchmark passages, all columns kept.

    Stretches of at least min_words covered words (of as many as the shortest item has, if that is
    less) are cut out of the text, and n_chars, where there is one, is counted anew. A document of
    whose words more than max_coverage are covered is dropped. Other rows, null texts too, stay as
    they are. Stretches are judged once, over all blocks of items, so block_words changes no result."""
    first, others = _blocks(benchmark, window, block_words)
    names = docs.columns
    if others is None:
        return _cut(docs, names, docs.sparkSession.sparkContext.broadcast(first), min(min_words, first.least), max_coverage)
    found, least = _matched(docs, first, others)
    found = common.written(found.filter(F.size("spans") > 0), "spans").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans"))
    own = docs.join(found.hint("merge"), (F.xxhash64("text") == F.col("__hash")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left")
    return _cut(own.select(*[F.col(f"`{c}`") for c in names], "__spans"), names, None, min(min_words, least), max_coverage)


_WORD = rb"[0-9A-Za-z\x80-\xff]+"


def _cut(docs: DataFrame, names: list[str], shared, least: int, max_coverage: float) -> DataFrame:
    """Cut and drop by the stretches that a broadcast automaton finds, or, without one, by the column __spans."""
    import re

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column("text"))
            given = None if shared else b.column("__spans").to_pylist()
            raw, texts, keep = memoryview(data), {}, np.ones(len(b), bool)
            for k, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                if given is not None and not given[k]:
                    continue
                text = bytes(raw[i:j])
                words = words_of(text)
                spans = [(s["start"], s["end"]) for s in given[k]] if given is not None else shared.value.scan(words)[0]
                spans = [s for s in spans if s[1] - s[0] >= least]
                if not spans:
                    continue
                if sum(y - x for x, y in spans) > max_coverage * len(words):
                    keep[k] = False
                    continue
                where = [m.span() for m in re.finditer(_WORD, text)]
                left, end = [], 0
                for x, y in spans:
                    left.append(text[end : where[x][0]])
                    end = where[y - 1][1]
                texts[k] = b"".join([*left, text[end:]]).decode("utf-8", "replace")
            columns = {c: b.column(c) for c in names}
            changed = np.zeros(len(b), bool)
            changed[list(texts)] = True
            for c, of in (("text", lambda t: t), ("n_chars", len)):
                if texts and c in columns:
                    columns[c] = pc.replace_with_mask(columns[c], pa.array(changed), pa.array([of(texts[k]) for k in sorted(texts)], columns[c].type))
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names).filter(pa.array(keep))

    common.small_batches(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in names]))


def digest(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The contract's columns per document from matches()."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return matches(docs, benchmark, window).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
