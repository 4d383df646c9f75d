"""Spelling variants, bin completion and dual-tree search against brute force, and their edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("sweepframe.llm")
import public_tokenizers as P  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from sweepframe.llm import completion, ranked, variants  # noqa: E402

from .test_corpus_operators import AWKWARD, table  # noqa: E402

ODD = [*AWKWARD, (None, "Aiment aiment"), (12, "ÀÉÎÕÜß àéîõüß × ÷ ſtraße Ωaiment"), (13, "x" * 3000 + " " + "x" * 2999)]


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


# -- variants ---------------------------------------------------------------------------------


def plain_variants(rows, least=5):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= least}
    holes, near = {}, {w: set() for w in n}
    for w in n:
        for i in range(len(w)):
            holes.setdefault((i, w[:i], w[i + 1 :]), set()).add(w)
            if (v := w[:i] + w[i + 1 :]) in n:
                near[w].add(v)
                near[v].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 5 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def variant_rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def made_words(seed, docs):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcé", k=rng.randint(5, 8))) for _ in range(25)] + ["straße", "ÿÿÿÿÿÿ", "a" * 70, "a" * 71, "ab" * 40]
    out = []
    for i in range(docs):
        words = []
        for w in rng.choices(base, weights=[1 / (k + 1) ** 2 for k in range(len(base))], k=60):
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "a", "é", "þ", w[at] * 2]) + w[at + 1 :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        out.append((i if rng.random() < 0.95 else None, rng.choice([" ", ", ", "1", "Ā"]).join(words)))
    return out


def test_variants_as_brute_force(spark):
    chain = [(None, " ".join(["colour"] * 700 + ["colours"] * 130 + ["coloures"] * 26 + ["colouresé"] * 5))]  # each the form of the next
    rows = made_words(1, 300) + [(7, None), (8, "")] + ODD + chain
    got = variant_rows(variants.digest(table(spark, rows)))
    want = plain_variants(rows)
    assert got == want and sum(r[1] is not None for r in want) > 50 and ("colouresé", "coloures", "colour", 5, 1, 26) in want


@pytest.mark.parametrize("bits,most_bytes", [(16, 256), (1, 64), (16, 1 << 14)])
def test_filters_of_any_size_give_the_same_pairs(spark, bits, most_bytes):
    vocab = variants.vocabulary(table(spark, made_words(2, 40)), least=2)
    pairs = lambda **kw: sorted(tuple(r) for r in variants.near_words(vocab, **kw).collect())
    want = pairs()
    assert pairs(bits=bits, most_bytes=most_bytes) == want and len(want) == len(set(want)) > 20


def test_slice_count_of_a_filter_beyond_one_slice():
    plan = variants.Plan({6: 3_000_000, 7: 10}, 16, 1 << 20)
    assert plan.parts == {6: 6, 7: 1} and plan.groups == 6 and max(plan.blocks(g) for g in range(6)) <= (1 << 20) // 64
    assert variants.Plan({}, 16, 64).groups == 0


def test_equal_hashes_make_no_pair(spark):
    rows = [("abcdef", 9, 6, 5), ("zzzzzz", 9, 6, 5), ("abcdeg", 50, 6, 7)]
    vocab = spark.createDataFrame(rows, "word string, n bigint, len int, h bigint")
    assert variants.near_words(vocab).count() in (0, 2)  # hashes that aren't the words' own find nothing false


def test_variants_of_nothing(spark, empty):
    assert variants.digest(empty).collect() == []
    assert variants.digest(table(spark, [(1, "short words only")])).collect() == []


def test_variants_keep_clashing_columns_apart(spark):
    rows = made_words(3, 60)
    df = table(spark, rows)
    for c in ("word", "n", "h", "len", "form", "root", "near", "edit", "at"):
        df = df.selectExpr("*", f"'x' AS {c}")
    assert variant_rows(variants.digest(df)) == plain_variants(rows)


# -- bin completion ---------------------------------------------------------------------------


def fewest(items, cap):
    items, best = sorted(items, reverse=True), [len(items)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins) if b + items[i] <= cap}.values():
            put(i + 1, [*bins[:j], bins[j] + items[i], *bins[j + 1 :]])
        put(i + 1, [*bins, items[i]])

    put(0, [])
    return best[0]


def used(patterns, cap):
    have = np.zeros(cap + 1, np.int64)
    for times, pattern in patterns:
        assert times > 0 and sum(s * k for s, k in pattern) <= cap
        for s, k in pattern:
            have[s] += times * k
    return have


def test_small_packings_are_optimal():
    rng = random.Random(5)
    for _ in range(400):
        cap, n = rng.choice([10, 17, 30, 60]), rng.randint(0, 10)
        items = [rng.randint(1, cap) if rng.random() < 0.6 else rng.randint(max(1, cap // 6), cap // 2) for _ in range(n)]
        have = np.bincount(items, minlength=cap + 1)
        found, least, _ = completion.complete(have)
        assert (used(found, cap) == have).all() and (used(completion.best_fit(have)[1], cap) == have).all()
        assert least <= fewest(items, cap) == sum(t for t, _ in found) <= completion.best_fit(have)[0]


def test_completion_beats_best_fit():
    have = np.bincount([44, 24, 24, 22, 21, 17, 8, 8, 6, 6] * 3, minlength=61)
    found, least, _ = completion.complete(have)
    assert sum(t for t, _ in found) == least == 9


def test_refused_fillings_count_against_the_search(monkeypatch):
    """Sizes of one step and a room they cannot fill: nearly all fillings are dominated, and a node may refuse any number of them."""
    looked, judge = [0], completion._dominated

    def counted(*args):
        looked[0] += 1
        return judge(*args)

    monkeypatch.setattr(completion, "_dominated", counted)
    have = np.bincount(20 * np.random.default_rng(1).integers(2, 12, 1500), minlength=1025)
    found, least, nodes = completion.complete(have, most_nodes=200)
    assert (used(found, 1024) == have).all() and least <= sum(t for t, _ in found) <= completion.best_fit(have)[0]
    assert 0 < nodes <= 200 and 0 < looked[0] <= 200 * 10


def test_large_histograms_stay_near_the_bound():
    have = np.bincount(np.random.default_rng(1).integers(1, 1025, 200_000), minlength=1025) * 5000
    found, least, nodes = completion.complete(have, most_nodes=2000)
    assert (used(found, 1024) == have).all() and sum(t for t, _ in found) <= 1.001 * least and len(found) < 3000


def test_fillings_are_undominated():
    have = np.bincount([5, 4, 3, 2], minlength=11)
    assert list(completion.fillings(have, 5, 9)) == [(0, [(5, 1)])]  # 3 + 2 falls to 5
    assert [f for _, f in completion.fillings(np.bincount([4, 3, 2], minlength=11), 5, 9)] == [[(3, 1), (2, 1)], [(4, 1)]]  # but not 3 alone


def ids(text):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def packed_right(rows, got, capacity, end=2):
    by_doc, at = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = {}
    for doc, text in rows:
        all_ids = [*ids(text), end]
        first = (len(all_ids) - 1) % capacity + 1
        starts = [0, *range(first, len(all_ids), capacity)]
        for p, s in enumerate(starts):
            own = all_ids[s : starts[p + 1] if p + 1 < len(starts) else None]
            want.setdefault(doc, []).append((p, s, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert {d: sorted(x) for d, x in by_doc.items()} == {d: sorted(x) for d, x in want.items()}
    for spans in at.values():
        upto = 0
        for offset, length in sorted(spans):
            assert offset == upto
            upto += length
        assert upto <= capacity


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing_of_odd_rows(spark, capacity):
    got = completion.digest(table(spark, ODD), P.path("byte_bpe_50k.json"), "\n", capacity=capacity).collect()
    packed_right(ODD, got, capacity)


def test_packing_of_nothing(spark, empty):
    assert completion.digest(empty, P.path("byte_bpe_50k.json"), "\n").collect() == []


def test_sequences_hold_their_documents(spark):
    rows = [(i, "word " * (i * 37 % 900)) for i in range(60)]
    cut = completion.pieces(table(spark, rows), P.path("byte_bpe_50k.json"), "\n", 2)
    texts, n = {}, 0
    for r in completion.sequences(cut, completion.layout(cut)).collect():
        own = np.frombuffer(r.ids, "<u4")
        n += len(own)
        assert len(own) <= 1024
        for d in r.docs:
            texts[d.doc_id] = list(own[d.offset : d.offset + d.length])
    assert all(texts[i] == [*ids(t), 2] for i, t in rows) and n == sum(map(len, texts.values()))


# -- ranked search ----------------------------------------------------------------------------


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_top(docs, items, k=10):
    bags = [(d, Counter(plain_terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, size = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for d, b in bags:
            m = 25 + 75 * sum(b.values()) * n // size
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in plain_terms(text) if b[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def made_texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)] + ["Über", "naïve", "日本", "X9"]
    topic = [rng.sample(words, 12) for _ in range(6)]
    return [(i, " ".join(rng.choices(topic[rng.randrange(6)], k=rng.randint(1, 40)) + rng.choices(words, k=3))) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"group_items": 3, "chunk": 7}, {"group_items": 1, "chunk": 64}, {"chunk": 33, "block_terms": 120}])
def test_search_as_brute_force(spark, options):
    docs = made_texts(1, 300) + made_texts(1, 20) + ODD
    asked = [(i, t) for i, t in made_texts(2, 23)] + [(3, "w1 w1 w2"), (50, None), (51, ""), (52, "!!"), (53, "nowhere"), (None, "w5 Über"), (54, "ÜBER über"), (55, "word " * 400)]
    got = ranked.top_documents(table(spark, docs).repartition(3), items_of(spark, asked), **options)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == plain_top(docs, asked)


def test_search_of_nothing(spark, empty):
    asked = items_of(spark, [(1, "a b")])
    assert ranked.top_documents(empty, asked).collect() == []
    assert ranked.top_documents(table(spark, ODD), items_of(spark, [])).collect() == []
    assert ranked.top_documents(table(spark, ODD), items_of(spark, [(1, "zzz")])).collect() == []


def test_equal_scores_rank_by_id(spark):
    docs = [(i, "same text here") for i in range(50, 0, -1)] + [(None, "same text here"), (99, "other")]
    got = ranked.top_documents(table(spark, docs), items_of(spark, [(1, "same")]), k=60, chunk=8).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [*range(1, 51), None] and len({r.score for r in got}) == 1


def test_bounds_prune_and_hold():
    """Node bounds are never below a score under them, and most pairs go without being scored."""
    rng = np.random.default_rng(3)
    width, topics = 600, 12
    def rows(n):
        out = []
        for i in range(n):
            own = np.unique(rng.integers(0, 50, 25)) + 50 * (i % topics)
            out.append((own.astype(np.int64), rng.integers(1, 1000, len(own))))
        return out
    items, docs = ranked.Items(rows(64)), rows(2000)
    ptr = np.concatenate([[0], np.cumsum([len(t) for t, _ in docs])])
    tree = ranked.Documents(np.arange(2000), ptr, np.concatenate([t for t, _ in docs]), np.concatenate([v for _, v in docs]), np.ones(width, np.int64))
    dense = np.zeros((2000, width), np.int64)
    dense[np.repeat(np.arange(2000), np.diff(tree.ptr)), tree.term] = tree.value
    full = np.zeros((64, width), np.int64)
    full[:, items.terms] = items.rows
    for level in range(len(tree.levels)):
        span = tree.leaf * tree.fan ** (len(tree.levels) - 1 - level)
        for i in range(len(tree.levels[level][0]) - 1):
            term, value = tree.node(level, i)
            top = np.zeros(width, np.int64)
            top[term] = value
            assert (top == dense[i * span : (i + 1) * span].max(0)).all()
    column = np.full(width, -1, np.int64)
    column[items.terms] = np.arange(len(items.terms))
    best = ranked.Best(64, 10)
    search = ranked.Search(items, tree, np.zeros(2000, bool), best, column)
    search.run()
    scores = full @ dense.T
    want = np.sort(scores, 1)[:, ::-1][:, :10]
    assert (best.score == want).all() and search.pairs < 64 * 2000 / 8
