"""The queries over the smallest tables, held against brute force."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

pytest.importorskip("sweepframe.llm")
import public_tokenizers as P  # noqa: E402
import xxhash  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from sweepframe.llm import queries  # noqa: E402

DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "pages", "conversations", "labels")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return duck.sql("select doc_id, coalesce(text, '') from documents order by 1").fetchall()


def run(spark, name, key="doc_id"):
    return queries.QUERIES[name](spark, DIR).orderBy(key).collect()


def ids_of(file, text):
    t = Tokenizer.from_file(P.path(file))
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_duckdb(spark, duck, name):
    ours, theirs = queries.QUERIES[name](spark, DIR).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    columns = list(theirs.columns)
    whole = lambda x: int(x) if isinstance(x, float) and x.is_integer() else x  # noqa: E731  long columns with nulls
    rows = lambda f: sorted(str(tuple(map(whole, r))) for r in f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None))
    assert sorted(ours.columns) == sorted(columns) and rows(ours) == rows(theirs)


def test_op1(spark, docs):
    at = 0
    got = run(spark, "op1_simple8b_tokens")
    assert len(got) == len(docs)
    for (doc, text), r in zip(docs, got):
        ids = ids_of("byte_bpe_50k.json", text) + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op2(spark, docs):
    text = dict(docs)
    known = re.compile(r'AKIA[A-Z0-9]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = ")[0-9a-f]{40}')
    want = {(d, hashlib.sha256(m.encode()).hexdigest()) for d, t in docs for m in known.findall(t)}
    got = run(spark, "op2_secret_forest")
    for r in got:
        assert hashlib.sha256(text[r.doc_id][r.start : r.start + r.length].encode()).hexdigest() == r.secret_sha256
    assert {(r.doc_id, r.secret_sha256) for r in got if r.is_secret} == want


def test_op4(spark, docs):
    got = run(spark, "op4_closed_syncmers")
    assert len(got) == len(docs)
    for i, ((doc, text), r) in enumerate(zip(docs, got)):
        half = len(text) // 2
        edited = text[: len(text) - half] + docs[(i + 1) % len(docs)][1][:half]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (doc, len(text), hashlib.sha256(edited.encode()).hexdigest())
    long = [r for r in got if r.n_chars > 400]
    assert np.mean([r.near_edited for r in long]) > 0.4 and np.mean([r.near_next for r in got]) < 0.05


def test_op6(spark, docs):
    got = queries.QUERIES["op6_cutting_stock_packing"](spark, DIR).toPandas()
    for doc, text in docs:
        ids = np.array(ids_of("word_bpe_49k.json", text) + [1], "<u4")
        own, at = got[got.doc_id == doc].sort_values("start"), 0
        for r in own.itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.length.cumsum() - s.length == s.offset).all() and s.length.sum() <= 2048


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(ids, fps, distance):
    root = dict.fromkeys(range(len(fps)))
    for i in root:
        root[i] = i

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(fps)):
        least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return [least[find(i)] for i in range(len(fps))]


def test_op7(spark, docs):
    got = run(spark, "op7_simhash_components")
    fps = [simhash(t) for _, t in docs]
    assert [r.fingerprint for r in got] == [f"{x:016x}" for x in fps]
    assert [r.component_id for r in got] == components([d for d, _ in docs], fps, 3)


def test_op8(spark, duck):
    lang = dict(duck.sql("select doc_id, lang from documents").fetchall())
    got = run(spark, "op8_ppm_language")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95


def test_op10(spark, duck):
    quality = dict(duck.sql("select doc_id, quality from labels").fetchall())
    got = run(spark, "op10_indexed_quality")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(r.score, quality[r.doc_id]) for r in got if r.held_out and r.doc_id in quality]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert not bad or np.mean([[g > b for b in bad] for g in good]) > 0.8


def test_pipeline(spark, docs):
    import corpus_pipeline as cp

    table = spark.read.parquet(f"{DIR}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    rows = table
    for k, (name, stage) in enumerate(cp.STAGES):
        out, previous = stage(spark, rows, DIR), rows
        if k < len(cp.STAGES) - 1:
            assert out.columns == table.columns
        rows = cp.common.written(out, "test-stage")
        if name == "near_duplicates":
            left, before = rows.collect(), previous.collect()
            sets = {r.doc_id: shingles(r.text) for r in before}
            near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
            kept = sorted(r.doc_id for r in left)
            assert not any(near(sets[a], sets[b]) for i, a in enumerate(kept) for b in kept[:i])
            assert all(any(near(sets[d], sets[k]) for k in sets if k != d) for d in set(sets) - set(kept))  # nothing else went
        if name == "benchmark_passages":
            words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
            grams = {tuple(w[i : i + 10]) for w in map(words, bench) for i in range(max(1, len(w) - 9))}
            for r in rows.collect():
                w = words(r.text)
                assert r.n_chars == len(r.text) and not any(tuple(w[i : i + 10]) in grams for i in range(len(w)))
        if name == "secrets":
            assert not any(re.search(r"AKIA[A-Z0-9]{16}|password=[0-9a-f]{18}", r.text) for r in rows.collect())
            kept = rows.count()
    assert rows.select("doc_id").distinct().count() == kept and kept > 0.8 * len(docs)


def test_op12(spark, docs):
    from .test_variants_completion_ranked import packed_right

    got = run(spark, "op12_bin_completion")
    packed_right(docs, got, 1024)
    tokens = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) <= 1.01 * tokens / 1024 + 1
