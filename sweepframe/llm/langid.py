"""Language identification by prediction by partial matching (PPM).

For every language a byte context tree up to `order` bytes deep is counted on labelled rows. A
symbol's probability in a context is its share there; a symbol not seen there escapes, with
method C's escape probability, to the context one byte shorter, where the symbols already seen are
excluded; below the empty context all symbols are alike. A tree has all that the sample has, so every
gram's suffix is in it. With the statistics frozen, every symbol's code length in every context of a tree is worked out once, so a text is
scored whole and exactly by looking up each of its bytes.

Bytes are folded first: A-Z to a-z, other ASCII but letters to a blank. All other bytes are symbols
of their own, and the number of languages is free: trees of some languages at a time share their
look-ups."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .tokens import utf8

_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)
#: Folded symbols: a blank, the letters and all bytes from 128 on.
SYMBOLS = 155
#: Languages whose trees share their look-ups.
TOGETHER = 8
UNKNOWN = "und"


@dataclass
class Trees:
    """Context trees of some languages. Depth k has the sorted grams (k bytes of context, one symbol)
    that any of the languages has, with code lengths, and the sorted contexts with escapes' code lengths."""

    languages: list[str]
    grams: list[np.ndarray]
    bits: list[np.ndarray]  # (grams, languages)
    contexts: list[np.ndarray]
    escape: list[np.ndarray]  # (contexts, languages); 0 where a language has no such context


@dataclass
class Model:
    languages: list[str]
    order: int
    trees: list[Trees]
    limits: np.ndarray  # bits a byte of each language's own texts, at most


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """Each byte with its `order` predecessors (blanks before the start), packed into 32 or 64 bits."""
    padded = np.concatenate([np.full(order, 32, np.uint8), _FOLD[data]]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(order + 1):
        out = (out << np.uint64(8)) | padded[k : k + len(data)]
    return out


def count(rows: DataFrame, order: int) -> DataFrame:
    """lang, depth, gram, n over rows(lang, text): how often each symbol came in each context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column("lang").to_pylist()
            data, at = utf8(b.column("text"))
            grams: dict[str, list] = {}
            for lang, i, j in zip(langs, at[:-1].tolist(), at[1:].tolist()):
                grams.setdefault(lang, []).append(_grams(data[i:j], order))
            for lang, parts in grams.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    common.small_batches(rows.sparkSession)
    counted = rows.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    depths = F.array(*[F.struct(F.lit(k).alias("depth"), F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("gram")) for k in range(order + 1)])
    return counted.select("lang", "n", F.explode(depths).alias("d")).groupBy("lang", "d.depth", "d.gram").agg(F.sum("n").alias("n"))


def _counts(counts: DataFrame, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sorted grams and their counts, by depth, of one language's counts(depth, gram, n)."""
    table = counts.select("depth", "gram", "n").toArrow()
    depth, gram, n = (table.column(c).to_numpy() for c in ("depth", "gram", "n"))
    gram = gram.view(np.uint64)
    grams, numbers = [], []
    for k in range(order + 1):
        own = np.flatnonzero(depth == k)
        own = own[np.argsort(gram[own])]
        grams.append(gram[own])
        numbers.append(n[own].astype(np.float64))
    return grams, numbers


def _own(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """One language's code lengths of its grams, its contexts, and their escapes, from sorted grams and their counts."""
    bits, contexts, escape = [], [], []
    for k, (g, n) in enumerate(zip(grams, counts)):
        ctx, first, of = np.unique(g >> np.uint64(8), return_index=True, return_inverse=True)
        total, kinds = np.bincount(of, n, len(ctx)), np.bincount(of, minlength=len(ctx))
        if k:
            below = 2.0 ** -bits[k - 1][np.searchsorted(grams[k - 1], g & np.uint64((1 << 8 * k) - 1))]
        else:
            below = np.full(len(g), 1 / SYMBOLS)
        left = np.maximum(1 - np.bincount(of, below, len(ctx)), 1e-9)  # what exclusion leaves below
        bits.append(-np.log2(n / (total + kinds)[of]))
        contexts.append(ctx)
        escape.append(-np.log2(kinds / (total + kinds) / left))
    return bits, contexts, escape


def _look(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in a sorted table, -1 if it isn't there."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def trees_of(languages: list[str], found: dict[str, tuple[list[np.ndarray], list[np.ndarray]]], order: int) -> Trees:
    """Trees from each language's sorted grams and counts by depth."""
    own = {lang: _own(*found[lang]) for lang in languages}
    out = Trees(languages, [], [], [], [])
    for k in range(order + 1):
        grams = np.unique(np.concatenate([found[lang][0][k] for lang in languages]))
        contexts = np.unique(grams >> np.uint64(8))
        escape, bits = np.zeros((len(contexts), len(languages))), np.full((len(grams), len(languages)), np.nan)
        for j, lang in enumerate(languages):
            escape[np.searchsorted(contexts, own[lang][1][k]), j] = own[lang][2][k]
            bits[np.searchsorted(grams, found[lang][0][k]), j] = own[lang][0][k]
        below = out.bits[k - 1][np.searchsorted(out.grams[k - 1], grams & np.uint64((1 << 8 * k) - 1))] if k else np.log2(SYMBOLS)
        escaped = escape[np.searchsorted(contexts, grams >> np.uint64(8))] + below
        out.grams.append(grams)
        out.contexts.append(contexts)
        out.escape.append(escape)
        out.bits.append(np.where(np.isnan(bits), escaped, bits))
    out.escape, out.bits = [x.astype(np.float32) for x in out.escape], [x.astype(np.float32) for x in out.bits]
    return out


def fit(labelled: DataFrame, order: int = 3, per_language: int = 400, margin: float = 1.25, apart: float = 0.25) -> Model:
    """Context trees from labelled(doc_id, text, lang), null texts and languages left out.

    per_language: the bound of the sample; about so many whole rows of each language are taken by a
    hash of doc_id, and `apart` times as many others to see how many bits a byte the language's own texts
    take; `margin` times the most that 99 of 100 take is the language's limit (infinite if there are no such
    rows). The trees' counts reach the driver as Arrow columns, one language at a time."""
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(rows)
    if not languages:
        return Model([], order, [], np.empty(0))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(per_language / rows[lang], 1 / (1 + apart)))])
    place = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 20)) / float(1 << 20) / share[F.col("lang")]
    counts = common.written(count(known.filter(place < 1), order), "contexts")
    trees = []
    for lo in range(0, len(languages), TOGETHER):
        some = languages[lo : lo + TOGETHER]
        found = {lang: _counts(counts.filter(F.col("lang") == lang), order) for lang in some}
        trees.append(trees_of(some, found, order))
    model = Model(languages, order, trees, np.full(len(languages), np.inf))
    others = known.filter((place >= 1) & (place < 1 + apart)).select(F.col("lang").alias("__own"), "text")
    mine = annotate(others, model, rate_as="__rate").filter(F.col("__own") == F.col("lang_pred"))
    for r in mine.groupBy("__own").agg(F.percentile_approx("__rate", 0.99).alias("most")).collect():
        model.limits[languages.index(r["__own"])] = margin * r["most"]
    return model


def code_lengths(model: Model, data: np.ndarray, at: np.ndarray, stretch: int = 1 << 18) -> np.ndarray:
    """Bits of each text data[at[i]:at[i + 1]] under each language; the bytes are taken in stretches."""
    lo, hi = int(at[0]), int(at[-1])
    data, at = _FOLD[data[lo:hi]], np.asarray(at, np.int64) - lo
    out, order = np.zeros((len(at) - 1, len(model.languages))), model.order
    for a in range(0, len(data), stretch):
        b = min(len(data), a + stretch)
        first, last = int(np.searchsorted(at, a, "right")) - 1, int(np.searchsorted(at, b))
        texts = np.arange(first, last)
        texts = texts[at[texts + 1] > at[texts]]
        begin = np.maximum(at[texts], a)
        where = np.arange(a, b) - np.repeat(at[texts], np.minimum(at[texts + 1], b) - begin)  # place in its text
        gram = np.zeros(b - a, np.uint64)
        for j in range(order, -1, -1):
            own = np.full(b - a, 32, np.uint8)  # blanks stand before a text
            own[max(0, j - a) :] = data[max(0, a - j) : b - j]
            own[where < j] = 32
            gram = (gram << np.uint64(8)) | own
        column = 0
        for t in model.trees:
            bits, todo = np.zeros((b - a, len(t.languages)), np.float32), np.arange(b - a)
            for k in range(order, -1, -1):
                g = gram[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
                row = _look(t.grams[k], g)
                known = row >= 0
                bits[todo[known]] += t.bits[k][row[known]]
                todo, g = todo[~known], g[~known]
                row = _look(t.contexts[k], g >> np.uint64(8))
                known = row >= 0
                bits[todo[known]] += t.escape[k][row[known]]
            bits[todo] += np.log2(SYMBOLS)
            out[texts, column : column + len(t.languages)] += np.add.reduceat(bits, begin - a, dtype=np.float64)
            column += len(t.languages)
    return out


def predict(docs: DataFrame, model: Model, evidence: int = 200) -> DataFrame:
    """docs' doc_id with lang_pred and score, row by row.

    score is the best language's share among the languages' likelihoods, where a text counts as at
    most `evidence` bytes. Texts that are null or have no letter get `und` and 0.0; so does every
    text if nothing was learned. Ties go to the first language by name."""
    return annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, evidence).drop("text")


def annotate(docs: DataFrame, model: Model, evidence: int = 200, pred_as: str = "lang_pred", score_as: str = "score", rate_as: str | None = None) -> DataFrame:
    """docs with the two columns of predict() added under the given names (columns of these names are replaced).

    rate_as: a third one, the bits a byte of the whole text under the predicted language, over the
    language's limit (over 1 in fit(), where limits are yet to be found); 0 for `und`."""
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop(pred_as, score_as, *([rate_as] if rate_as else []))
    names = base.columns
    added = [T.StructField(pred_as, T.StringType()), T.StructField(score_as, T.DoubleType())] + ([T.StructField(rate_as, T.DoubleType())] if rate_as else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            data, at = utf8(b.column("text"))
            raw = memoryview(data)
            letter = np.array([_has_letter(bytes(raw[i:j])) for i, j in zip(at[:-1].tolist(), at[1:].tolist())], bool)
            score = rate = np.zeros(len(b))
            if m.languages:
                size = np.maximum(np.diff(at), 1)
                bits = code_lengths(m, data, at)
                nats = bits * np.log(2) * np.minimum(1, evidence / size)[:, None]
                like = np.exp(nats.min(1, keepdims=True) - nats)
                best = nats.argmin(1)
                score = np.where(letter, like[np.arange(len(best)), best] / like.sum(1), 0.0)
                limit = m.limits[best]
                rate = np.where(letter, bits[np.arange(len(best)), best] / size / np.where(np.isinf(limit), 1, limit), 0.0)
            else:
                letter[:] = False
            pred = [m.languages[best[k]] if letter[k] else UNKNOWN for k in range(len(b))]
            columns = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())][: len(added)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *columns], [*names, *(f.name for f in added)])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *added]))


_ASCII_LETTERS = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


def _has_letter(text: bytes) -> bool:
    if text[:4096].translate(_ASCII_LETTERS).strip() or text.translate(_ASCII_LETTERS).strip():
        return True
    return not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace"))


def held_out(modulus: int = 4, kept: int = 2) -> Column:
    return F.coalesce(common.crc_mod("doc_id", modulus) == kept, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from rows that are not held out."""
    model = fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
