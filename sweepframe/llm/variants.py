"""Groups spelling variants of the words of a corpus.

Words are counted where the texts lie and summed by one shuffle. Every word then has its edits
generated: each code point left out, and each replaced by every letter that comes after it, which
finds each pair of words at one edit from one of its two sides (an inserted code point is one left
out of the other). Edits are hashes taken from running sums, so no string is made for them; they
are looked up in blocked Bloom filters, one for each word length, that are broadcast. Only what the
filters answer yes to is shuffled: it is joined to the vocabulary by its hash, and the edit is then
made and compared as text, so neither a false positive nor two words of one hash gives a pair.

Filters are broadcast in groups of at most `most_bytes`. A longer vocabulary makes more groups, and a
length with more words than a group holds is dealt to several by hash; every group is one pass over
the vocabulary. So the broadcast has one bound for all inputs, and no word is left out."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Letters of a word: A-Z (as a-z) and U+00C0 to U+00FF.
LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
#: Latin-1 bytes of a text to bytes of words, all else to a space.
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in LETTERS else 32 for b in range(256))
#: Lengths from here on share filters by their number of bits.
_OWN_LENGTH = 64


# -- counting ---------------------------------------------------------------------------------


def _spelled(doc_id: int | None, words: Counter, slip: int) -> Iterator[tuple[bytes, int]]:
    """(word, occurrences) of a document; a word whose crc32 beside the id is a multiple of slip loses a letter."""
    prefix = None if doc_id is None else zlib.crc32(b"%d:" % doc_id)
    for word, n in words.items():
        if prefix is not None:
            h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), prefix)
            if h % slip == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
        yield word, n


def _counts(batches: Iterator[pa.RecordBatch], least_length: int, slip: int, most: int = 300_000) -> Iterator[pa.RecordBatch]:
    total: dict[bytes, int] = {}

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            runs = (text.as_py() or "").encode("latin-1", "replace").translate(_TO_WORDS).split()
            for word, n in _spelled(doc_id, Counter([r for r in runs if len(r) >= least_length]), slip):
                if len(word) >= least_length:
                    total[word] = total.get(word, 0) + n
            if len(total) > most:
                yield rows()
                total.clear()
    yield rows()


def vocabulary(docs: DataFrame, least_length: int = 6, least: int = 5, slip: int = 199) -> DataFrame:
    """word, n, len, h of the words of docs(doc_id, text) with at least `least` occurrences; a written table.

    Null and empty texts have none. Rows of one doc_id, and equal rows, count each on its own. In a
    row without doc_id no letter is left out. h is the 64-bit hash that the filters and joins use."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = rows.mapInArrow(lambda it: _counts(it, least_length, slip), "word string, n bigint")
    kept = seen.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return common.written(kept.mapInArrow(_hashed, "word string, n bigint, len int, h bigint"), "vocabulary")


# -- hashes -----------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _values(codes: np.ndarray) -> np.ndarray:
    """A number for each code point."""
    return _mixed(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))


def _final(sums: np.ndarray, length: int) -> np.ndarray:
    return _mixed(sums + np.uint64(length * 0xD6E8FEB86659FD93 % (1 << 64)))


def _powers(length: int) -> np.ndarray:
    p = np.full(length, _BASE, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def _by_length(words: list[str], cells: int = 1 << 19) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places of words of that length), at most `cells` code points at a time."""
    sizes = np.array([len(w) for w in words], np.int64)
    for length in np.unique(sizes):
        at = np.flatnonzero(sizes == length)
        step = max(1, cells // max(1, int(length)))
        for i in range(0, len(at), step):
            yield int(length), at[i : i + step]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        size, h = np.zeros(len(words), np.int32), np.zeros(len(words), np.uint64)
        for length, at in _by_length(words):
            size[at] = length
            h[at] = _final((_values(_codes([words[i] for i in at], length)) * _powers(length)).sum(1, dtype=np.uint64), length)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(h.view(np.int64))], ["word", "n", "len", "h"])


# -- filters ----------------------------------------------------------------------------------

_SALT = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)
_LOW = np.uint64(0xFFFFFFFF)
#: Blocks of 8 words of 64 bits in a slice, the unit in which filters are built.
_SLICE = 4096


def _shard(length: int) -> int:
    return length if length < _OWN_LENGTH else _OWN_LENGTH + length.bit_length()


def _bit(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th word's bit of each hash."""
    return np.uint64(1) << (((h & _LOW) * _SALT[k] & _LOW) >> np.uint64(26))


class Plan:
    """Where each shard's filter lies: its parts by hash, and the group, first block and blocks of each part."""

    def __init__(self, words: dict[int, int], bits: int, most_bytes: int):
        self.parts: dict[int, int] = {}
        self.place: dict[tuple[int, int], tuple[int, int, int]] = {}
        room, group, at = max(1, most_bytes // 64), 0, 0
        for shard, n in sorted(words.items()):
            blocks = max(1, math.ceil(n * bits / 512))
            self.parts[shard] = parts = math.ceil(blocks / room)
            own = min(room, math.ceil(blocks / parts))
            for part in range(parts):
                if at + own > room:
                    group, at = group + 1, 0
                self.place[shard, part] = (group, at, own)
                at += own
        self.groups = group + 1 if words else 0

    def of_group(self, group: int) -> dict[tuple[int, int], tuple[int, int]]:
        return {k: (at, n) for k, (g, at, n) in self.place.items() if g == group}

    def blocks(self, group: int) -> int:
        return max(at + n for at, n in self.of_group(group).values())


def _shard_column() -> Column:
    return F.when(F.col("len") < _OWN_LENGTH, F.col("len")).otherwise(_OWN_LENGTH + F.length(F.bin(F.col("len").cast("long")))).cast("int")


def _slices(table: pa.Table) -> pa.Table:
    """One slice of a group's filters, from all hashes that fall into it."""
    h, block = table.column("h").to_numpy().view(np.uint64), table.column("block").to_numpy() % _SLICE
    words = np.zeros((_SLICE, 8), np.uint64)
    for k in range(8):
        np.bitwise_or.at(words[:, k], block, _bit(h, k))
    return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int32()), "words": pa.array([words.tobytes()], pa.binary())})


def _filters(vocab: DataFrame, plan: Plan, group: int) -> np.ndarray:
    """The filters of one group, (blocks, 8) words: what is collected is at most the bound of a group."""
    spark = vocab.sparkSession
    rows = [(shard, part, at, n) for (shard, part), (at, n) in plan.of_group(group).items()]
    where = spark.createDataFrame(rows, "shard int, part int, at bigint, blocks bigint")
    parts = F.create_map(*[F.lit(x) for kv in plan.parts.items() for x in kv])
    placed = vocab.select("h", _shard_column().alias("shard")).withColumn("part", F.pmod(F.col("h"), parts[F.col("shard")]).cast("int")).join(F.broadcast(where), ["shard", "part"])
    block = F.col("at") + F.shiftright(F.shiftrightunsigned("h", 33) * F.col("blocks"), 31)
    built = placed.select("h", block.alias("block")).withColumn("slice", F.floor(F.col("block") / _SLICE).cast("int")).groupBy("slice").applyInArrow(_slices, "slice int, words binary")
    out = np.zeros((plan.blocks(group) // _SLICE + 1, _SLICE * 8), np.uint64)
    for r in built.toLocalIterator():
        out[r["slice"]] = np.frombuffer(r["words"], np.uint64)
    return out.reshape(-1, 8)


class _Probe:
    """Looks hashes of one length up in the filters of one group."""

    def __init__(self, words: np.ndarray, where: dict[tuple[int, int], tuple[int, int]], parts: dict[int, int]):
        self.words, self.parts = words, parts
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for shard in {s for s, _ in where}:
            at, n = np.full(parts[shard], -1, np.int64), np.zeros(parts[shard], np.int64)
            for part in range(parts[shard]):
                at[part], n[part] = where.get((shard, part), (-1, 0))
            self.at[shard] = at, n

    def has(self, length: int) -> bool:
        return _shard(length) in self.at

    def positives(self, h: np.ndarray, length: int) -> np.ndarray:
        """Places in h that the filter may hold."""
        at, blocks = self.at[_shard(length)]
        found = np.arange(len(h))
        if len(at) == 1:
            first, n = at[0], blocks[0]
        else:
            part = h.view(np.int64) % len(at)
            found = np.flatnonzero(at[part] >= 0)
            h, first, n = h[found], at[part[found]], blocks[part[found]]
        block = first + (((h >> np.uint64(33)).astype(np.int64) * n) >> 31)
        for k in range(8):
            bit = _bit(h, k)
            yes = np.flatnonzero(self.words[block, k] & bit)
            found, h, block = found[yes], h[yes], block[yes]
        return found


#: Of an edit: the word's hash, the edit's, the place (from 0), and the letter put there (empty: it was left out).
EDITS = "h bigint, edit bigint, at int, letter string"


def _edits(batches: Iterator[pa.RecordBatch], shared, where: dict, parts: dict[int, int], letters: list[int]) -> Iterator[pa.RecordBatch]:
    probe, letters = _Probe(shared.value, where, parts), sorted(letters)
    of_letter = _values(np.array(letters, np.uint32))
    for batch in batches:
        words, hashes = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, str]] = []

        def note(own: np.ndarray, places: np.ndarray, edits: np.ndarray, row: np.ndarray, length: int, letter: str) -> None:
            yes = probe.positives(edits, length)
            if len(yes):
                out.append((own[row[yes]], edits[yes].view(np.int64), places[yes].astype(np.int32), letter))

        for length, at in _by_length(words):
            shorter, same = probe.has(length - 1), probe.has(length)
            if not (shorter or same):
                continue
            codes, own, powers = _codes([words[i] for i in at], length), hashes[at], _powers(length)
            values = _values(codes)
            run = np.zeros((len(at), length + 1), np.uint64)
            np.cumsum(values * powers, axis=1, out=run[:, 1:])
            if shorter:  # of equal neighbours one is enough
                row, place = np.nonzero(np.concatenate([np.ones((len(at), 1), bool), codes[:, 1:] != codes[:, :-1]], 1))
                left = run[row, place] + (run[row, -1] - run[row, place + 1]) * np.uint64(_UNBASE)
                note(own, place, _final(left, length - 1), row, length - 1, "")
            if same:
                rest = run[:, -1:] - values * powers
                for code, value in zip(letters, of_letter):
                    row, place = np.nonzero(codes < code)
                    note(own, place, _final(rest[row, place] + value * powers[place], length), row, length, chr(code))
        if out:
            letters_ = [x for own, _, _, letter in out for x in [letter] * len(own)]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate([o[k] for o in out])) for k in range(3)), pa.array(letters_, pa.string())], ["h", "edit", "at", "letter"])


def near_words(vocab: DataFrame, letters: list[int] = LETTERS, bits: int = 16, most_bytes: int = 32 << 20) -> DataFrame:
    """All pairs of vocabulary words at one inserted, left out or replaced code point: word, n, near, near_n; each pair from both sides.

    letters: code points that a replacement may put, all that the vocabulary has. bits a word and most_bytes
    a broadcast set the filters' size; smaller ones cost more false positives or more passes, never a pair."""
    spark = vocab.sparkSession
    sizes = {r["shard"]: r["n"] for r in vocab.groupBy(_shard_column().alias("shard")).agg(F.count("*").alias("n")).collect()}  # a row a shard
    plan, found = Plan(sizes, bits, most_bytes), None
    spread = vocab.select("word", "h", "n").repartition(common.partitions(spark), "h")
    for group in range(plan.groups):
        shared = spark.sparkContext.broadcast(_filters(vocab, plan, group))
        where, parts = plan.of_group(group), plan.parts
        edits = common.written(spread.select("word", "h").mapInArrow(lambda it, s=shared, w=where: _edits(it, s, w, parts, letters), EDITS), "edits")
        shared.destroy()
        found = edits if found is None else found.unionByName(edits)
    if found is None:
        found = spark.createDataFrame([], EDITS)
    other = vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("h").alias("edit"))
    known = found.join(other, "edit")  # false positives end here
    made = F.concat(F.expr("substring(word, 1, at)"), F.col("letter"), F.expr("substring(word, at + 2)"))
    pairs = known.join(vocab.select("word", "n", "h"), "h").filter(made == F.col("near")).select("word", "n", "near", "near_n")
    side = lambda a, b: F.struct(F.col(a).alias("word"), F.col(f"{'near_' if a == 'near' else ''}n").alias("n"), F.col(b).alias("near"), F.col(f"{'near_' if b == 'near' else ''}n").alias("near_n"))
    return pairs.select(F.inline(F.array(side("word", "near"), side("near", "word"))))


# -- forms ------------------------------------------------------------------------------------


def forms(vocab: DataFrame, pairs: DataFrame, ratio: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n of every vocabulary word; a written table.

    The form is the near word of largest n (ties: the smallest), where that is at least ratio times the word's n."""
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b"))
    joined = vocab.select("word", "n").join(best, "word", "left")
    is_form = -F.col("b.less") >= ratio * F.col("n")
    return common.written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("b.near")).alias("form"), F.when(is_form, -F.col("b.less")).alias("form_n")), "forms")


def rooted(found: DataFrame, ratio: int = 5) -> DataFrame:
    """Adds root: where the forms lead from each word.

    n grows at least ratio-fold from form to form, so a way has at most log(most n) / log(ratio) steps, and
    jumps of doubled length reach its end in the logarithm of that many joins."""
    most = found.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(most) / math.log(ratio)))
    link = found.filter("form is not null").select("word", F.col("form").alias("root"))
    for i in range(math.ceil(math.log2(steps + 1))):
        on = link.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        link = common.written(link.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), f"roots-{i}")
    return found.join(link, "word", "left").withColumn("root", F.coalesce("root", "word"))


def digest(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of docs(doc_id, text); see vocabulary() for odd rows. An empty table gives no rows."""
    vocab = vocabulary(docs)
    return rooted(forms(vocab, near_words(vocab))).select("word", "form", "root", "n", "n_near", "form_n")
