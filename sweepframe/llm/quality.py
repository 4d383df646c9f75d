"""Quality scores: random-indexing word vectors, pooled per document, and a small numpy network.

Every unit (a frequent word, or else a word's shape) has a sparse random index vector, made from
its hash. A unit's vector is its index vector plus those of its neighbours, summed over all
documents in whole numbers, so no order of the sums matters. A document is the mean of its units'
vectors, with the shares of repeated words and word triples as units of their own. A network with
one hidden layer, trained on a bounded labelled sample, scores it, and a temperature fitted on rows
apart makes the scores probabilities.

Words are counted and neighbours summed in one pass each, with partial sums per task; the sample's
document vectors are made where the texts lie and meet in one task, which trains the network."""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import utf8

DIMENSIONS, NONZERO, HIDDEN, REACH = 128, 6, 32, 2
_SHAPE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else b for b in range(256))
_TWICE = re.compile(rb"(.)\1+", re.S)
AGAIN, SEEN, OTHER = b"\x01again", b"\x01seen", b"\x01other"


@dataclass
class Model:
    units: dict[bytes, int]
    vectors: np.ndarray  # (units, DIMENSIONS)
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float


def name(word: bytes) -> bytes:
    """A word as a unit: itself, or a hash of the whole of a very long one."""
    if len(word) <= 64:
        return word
    import xxhash

    return b"\x03" + xxhash.xxh3_128_digest(word)


_squeezed: dict[bytes, bytes] = {}


def shape(word: bytes) -> bytes:
    """Letters as a or A, digits as 9, repeats squeezed: `ERUNG!!` gives `A!`. Many words share what is squeezed; it is remembered, within bounds."""
    wide = word.translate(_SHAPE)
    found = _squeezed.get(wide)
    if found is None:
        found = name(b"\x02" + _TWICE.sub(rb"\1", wide))
        if len(wide) <= 64:
            if len(_squeezed) > 100_000:
                _squeezed.clear()
            _squeezed[wide] = found
    return found


def index_vectors(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the non-zero entries of each unit's index vector."""
    import xxhash

    h = np.array([xxhash.xxh64_intdigest(u, 5) for u in units], np.uint64)[:, None] + np.arange(DIMENSIONS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    places = np.sort(np.argpartition(h, NONZERO, axis=1)[:, :NONZERO], axis=1)
    signs = np.where(np.take_along_axis(h, places, 1) >> np.uint64(20) & np.uint64(1), 1, -1)
    return places.astype(np.int64), signs.astype(np.int64)


def _codes(words: list[bytes], units: dict[bytes, int], shapes: dict[bytes, int]) -> np.ndarray:
    """Unit numbers; words outside the units go by their shape. shapes remembers that, within bounds."""
    codes = list(map(units.get, words))
    if None in codes:
        other = units[OTHER]
        if len(shapes) > 200_000:
            shapes.clear()
        for i, c in enumerate(codes):
            if c is None:
                w = words[i]
                c = shapes.get(w)
                if c is None:
                    c = units.get(name(w)) if len(w) > 64 else None
                    c = units.get(shape(w), other) if c is None else c
                    if len(w) <= 64:
                        shapes[w] = c
                codes[i] = c
    return np.array(codes, np.int64)


def _repeats(words: list[bytes]) -> tuple[float, float]:
    """Shares of words equal to the one before, and of word triples that stood before in the text."""
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    if len(h) < 2:
        return 0.0, 0.0
    again = float((h[1:] == h[:-1]).mean())
    if len(h) < 3:
        return again, 0.0
    triple = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + (h[2:] ^ (h[2:] >> np.uint64(7)))
    return again, 1 - len(np.unique(triple)) / len(triple)


def pooled(text: bytes, units: dict[bytes, int], vectors: np.ndarray, shapes: dict[bytes, int]) -> np.ndarray:
    """The document vector of a whole text; zeros if it has no word. Long texts are summed in stretches."""
    words = text.split()
    out = np.zeros(DIMENSIONS + 3, np.float32)
    if not words:
        return out
    total = np.zeros(DIMENSIONS)
    for lo in range(0, len(words), 1 << 15):
        k, n = np.unique(_codes(words[lo : lo + (1 << 15)], units, shapes), return_counts=True)
        total += n.astype(np.float32) @ vectors[k]
    again, seen = _repeats(words)
    total = total / len(words) + again * vectors[units[AGAIN]] + seen * vectors[units[SEEN]]
    out[:DIMENSIONS] = total
    out[DIMENSIONS:] = np.log1p(len(words)), again, seen
    return out


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, at = utf8(batch.column("text"))
    raw = memoryview(data)
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        yield bytes(raw[i:j])


def unit_counts(docs: DataFrame) -> DataFrame:
    """unit, is_shape, n over all of docs(text): how often each word and each shape stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            names, shapes = Counter(), Counter()
            for w, n in seen.items():
                names[name(w)] += n
                shapes[shape(w)] += n
            seen.clear()
            units = [*names, *shapes]
            return pa.RecordBatch.from_arrays([pa.array(units, pa.binary()), pa.array([False] * len(names) + [True] * len(shapes)), pa.array([*names.values(), *shapes.values()], pa.int64())], ["unit", "is_shape", "n"])

        for b in batches:
            size = 0
            for t in _texts(b):
                seen.update(t.split())
                size += len(t)
                if len(seen) > 200_000 or size > 1 << 25:
                    yield out()
                    size = 0
        yield out()

    common.small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "unit binary, is_shape boolean, n bigint").groupBy("unit", "is_shape").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, most: int) -> list[bytes]:
    """The units: three of their own, the `most` most frequent words of docs and as many shapes."""
    counts = common.written(unit_counts(docs), "units")
    top = [counts.filter(F.col("is_shape") == kind).orderBy(F.desc("n"), "unit").limit(most).select("unit").collect() for kind in (False, True)]
    return list(dict.fromkeys([AGAIN, SEEN, OTHER, *(bytes(r["unit"]) for rows in top for r in rows)]))


def neighbour_sums(docs: DataFrame, names: list[bytes]) -> np.ndarray:
    """For every unit the sum of the index vectors of the units up to REACH words away, over all of docs(text).

    A task sends its sums of the units it met; they are added up unit by unit on the executors, and
    the driver gets one row of DIMENSIONS whole numbers for each unit."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(names)
    width = len(names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = {u: i for i, u in enumerate(shared.value)}
        places, signs = index_vectors(shared.value)
        sums, shapes, held, size = np.zeros(width * DIMENSIONS, np.int64), {}, [], 0
        gap = np.full(REACH, -1, np.int64)

        def add() -> None:
            c, pairs = np.concatenate(held), []
            for d in range(1, REACH + 1):
                left, right = c[:-d], c[d:]
                both = np.flatnonzero((left >= 0) & (right >= 0))
                pairs += [left[both] * width + right[both], right[both] * width + left[both]]
            pair, n = np.unique(np.concatenate(pairs), return_counts=True)  # each pair of units once
            of, near = np.divmod(pair, width)
            np.add.at(sums, (of[:, None] * DIMENSIONS + places[near]).ravel(), (signs[near] * n[:, None]).ravel())

        for b in batches:
            for t in _texts(b):
                words = t.split()
                for lo in range(0, len(words), 1 << 15):  # stretches of a long text follow each other without a gap
                    held.append(_codes(words[lo : lo + (1 << 15)], units, shapes))
                    size += len(held[-1])
                held.append(gap)
                if size > 1 << 17:
                    add()
                    held.clear()
                    size = 0
        if held:
            add()
        rows = sums.reshape(-1, DIMENSIONS)
        met = np.flatnonzero(rows.any(1))
        for lo in range(0, len(met), 4096):
            k = met[lo : lo + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array([r.tobytes() for r in rows[k]], pa.binary())], ["unit", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(DIMENSIONS, np.int64)
        for b in batches:
            done = []
            for unit, raw in zip(b.column("unit").to_pylist(), b.column("sums").to_pylist()):
                if unit != now:
                    if now is not None:
                        done.append((now, sums.tobytes()))
                    now, sums = unit, np.zeros(DIMENSIONS, np.int64)
                sums += np.frombuffer(raw, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in done], pa.int64()), pa.array([s for _, s in done], pa.binary())], ["unit", "sums"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["unit", "sums"])

    parts = docs.select("text").mapInArrow(partial, "unit bigint, sums binary")
    n = common.partitions(spark)
    sums = parts.repartition(n, "unit").sortWithinPartitions("unit").mapInArrow(total, "unit bigint, sums binary")
    out = np.zeros((width, DIMENSIONS), np.int64)
    for r in sums.collect():
        out[r["unit"]] = np.frombuffer(r["sums"], np.int64)
    return out


def unit_vectors(names: list[bytes], sums: np.ndarray) -> np.ndarray:
    """A unit's index vector and its neighbours' sum, both of length one, added."""
    places, signs = index_vectors(names)
    own = np.zeros((len(names), DIMENSIONS))
    np.put_along_axis(own, places, signs / np.sqrt(NONZERO), 1)
    near = sums / np.maximum(np.sqrt((sums.astype(np.float64) ** 2).sum(1, keepdims=True)), 1e-6)
    return (own + near).astype(np.float32)


def _forward(x: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.tanh(x @ w1 + b1)
    return hidden, hidden @ w2 + b2[0]


def _train(x: np.ndarray, y: np.ndarray, seed: int = 3, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 128):
            k = order[lo : lo + 128]
            hidden, z = _forward(x[k], layers)
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[k]) / len(k)
            back = np.outer(g, layers[2]) * (1 - hidden**2)
            grads = [x[k].T @ back + decay * layers[0], back.sum(0), hidden.T @ g + decay * layers[2], np.array([g.sum()])]
            step += 1
            for i, d in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * d
                second[i] = 0.999 * second[i] + 0.001 * d * d
                layers[i] = layers[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return layers


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by a search over a grid."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    return float(min(grid, key=lambda t: float(np.logaddexp(0, -np.where(y == 1, z, -z) / t).sum())))


def _learn(x: np.ndarray, y: np.ndarray) -> dict | None:
    """mean, scale, layers and temperature from document vectors and labels; None if all labels are alike."""
    if len(set(y.tolist())) < 2:
        return None
    apart = np.arange(len(x)) % 5 == 0
    if len(set(y[apart].tolist())) < 2 or len(set(y[~apart].tolist())) < 2:
        apart = np.zeros(len(x), bool)
    mean, scale = x[~apart].mean(0), x[~apart].std(0) + 1e-3
    z = (x - mean) / scale
    layers = _train(z[~apart], y[~apart])
    kept = apart if apart.any() else ~apart
    return {"mean": mean, "scale": scale, "layers": layers, "temperature": _temperature(_forward(z[kept], layers)[1], y[kept])}


def fit(docs: DataFrame, labels: DataFrame, most: int = 6000, units: int = 20_000) -> Model | None:
    """A model from docs(doc_id, text) and labels(doc_id, quality); None without labels of both kinds.

    units: the words and shapes in the vocabulary, the most frequent of all documents. most: the
    bound of the labelled sample that the network is trained on, about so many whole rows chosen by
    a hash of doc_id. Null labels are left out; of several labels of a doc_id the largest counts."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    n = known.count()
    if not n:
        return None
    names = vocabulary(docs, units)
    vectors = unit_vectors(names, neighbour_sums(docs, names))
    model = Model({u: i for i, u in enumerate(names)}, vectors, np.empty(0), np.empty(0), [], 1.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, shapes = shared.value, {}
        for b in batches:
            rows = [pooled(t, m.units, m.vectors, shapes).astype(np.float64).tobytes() for t in _texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(rows, pa.binary())], ["doc_id", "quality", "x"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column("x").to_pylist(), b.column("quality").to_pylist())]
        if rows:
            found = _learn(np.stack([np.frombuffer(x) for x, _ in rows]), np.array([float(q >= 1) for _, q in rows]))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["model"])

    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < most / n * (1 << 20)).select("doc_id", F.col("quality").cast("double").alias("quality"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    sample = common.written(rows.mapInArrow(pool, "doc_id bigint, quality double, x binary"), "sample")
    got = sample.coalesce(1).sortWithinPartitions("doc_id", "x").mapInArrow(train, "model binary").first()
    found = pickle.loads(got["model"]) if got else None
    return found and Model(model.units, vectors, **found)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of docs(doc_id, text), row by row; 0.5 without a model.

    Null and empty texts are scored too, as documents without words."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, remembered = shared.value, {}
        for b in batches:
            data, at = utf8(b.column("text"))
            raw = memoryview(data)
            x = np.array([pooled(bytes(raw[i:j]), m.units, m.vectors, remembered) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]).reshape(len(b), -1)
            z = _forward((x - m.mean) / m.scale, m.layers)[1] / m.temperature if len(b) else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id bigint, score double")


def held_out() -> Column:
    return F.coalesce(common.crc_mod("doc_id", 5) == 0, F.lit(False))


def digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out rows are never read into the model."""
    model = fit(docs, labels.filter(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
