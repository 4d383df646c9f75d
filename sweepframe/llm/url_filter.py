"""URL filters by Bloom filter cascades: exact membership in rule lists without joining them.

A url's keys are its host's suffixes of as many labels as rules have, followed by its path's
prefixes of the lengths that rules have. Level 0 of a cascade encodes the listed keys; the keys of the whole corpus that it
takes in wrongly are encoded by level 1, what that takes in wrongly of the listed ones by level 2,
and so on until nothing is wrong. As the corpus's complete key universe was tested, the cascade
answers for each of its keys exactly.

Bits are set and tested by two 64-bit hashes that Spark computes. A level's words are gathered
with bit_or, so the driver gets the filter and never the keys."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A cascade's filters together have at most about so many bits; larger lists are cut into shards.
MOST_BITS = 1 << 28


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for i in range(self.hashes):
            at = (h1 + np.uint64(i) * h2) % np.uint64(self.bits)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Membership: the first level that refuses a key decides, by being an even or an odd one."""
        out, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
        for k, level in enumerate(self.levels):
            yes = level.has(h1[open_], h2[open_])
            out[open_[~yes]] = k % 2 == 1
            open_ = open_[yes]
        out[open_] = len(self.levels) % 2 == 1
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and for urls without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def keys(host: Column, path: Column, depths: list[int], lengths: list[int]) -> Column:
    """array<struct<size, host_size, key>> of the keys that a rule could be, longest first.

    depths: how many labels rules' hosts have; lengths: how many signs their paths have."""
    suffix = F.array_distinct(F.filter(F.array(*[F.when(F.size(F.split(host, r"\.", -1)) >= n, F.substring_index(host, ".", -n)) for n in depths]), lambda h: h.isNotNull()))

    def with_prefix(n: int) -> Column:
        return F.transform(suffix, lambda h: F.when(F.length(path) >= n, F.struct((F.length(h) + n).alias("size"), F.length(h).alias("host_size"), F.concat(h, F.substring(path, 1, n)).alias("key"))))

    made = [with_prefix(n) for n in lengths]
    return F.sort_array(F.filter(F.concat(*made), lambda k: k.isNotNull()), asc=False)


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2)).bitwiseOR(F.lit(1))


def _prime(least: int, taken: set[int]) -> int:
    """The first prime from `least` on that is not taken."""
    n = least | 1
    while n in taken or any(n % d == 0 for d in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


def _build(rows: DataFrame, n: int, rate: float, taken: set[int]) -> Level:
    """The Bloom filter of rows(h1, h2).

    Its number of bits is a prime that no other level has, so keys that collide on one level don't on all."""
    bits = _prime(max(67, int(np.ceil(-n * np.log(rate) / np.log(2) ** 2))), taken)
    hashes = max(1, round(-np.log2(rate)))
    at = rows.select(F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))).alias("i"), "h1", "h2")
    at = at.withColumn("sum", F.expr("cast(h1 as decimal(38,0)) + case when h1 < 0 then 18446744073709551616 else 0 end + i * (cast(h2 as decimal(38,0)) + case when h2 < 0 then 18446744073709551616 else 0 end)"))
    at = at.select(F.expr(f"cast((sum % 18446744073709551616) % {bits} as bigint)").alias("at"))
    words = at.groupBy(F.expr("at div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("x")).collect()
    out = np.zeros(-(-bits // 64), np.int64)
    for r in words:
        out[r["w"]] = r["x"]
    return Level(bits, hashes, out.view(np.uint64))


def _tested(rows: DataFrame, level: Level) -> DataFrame:
    """The rows(h1, h2) that a level takes in."""
    shared = rows.sparkSession.sparkContext.broadcast(level)

    @F.pandas_udf("boolean")
    def takes(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(shared.value.has(h1.to_numpy().view(np.uint64), h2.to_numpy().view(np.uint64)))

    return rows.filter(takes("h1", "h2"))


def cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade for listed(key) that is exact on universe(key); both distinct, nulls left out."""
    h1, h2 = _hashes(F.col("key"))
    inside = common.written(listed.filter("key is not null").select(h1.alias("h1"), h2.alias("h2")), "listed")
    outside = common.written(universe.filter("key is not null").join(listed, "key", "left_anti").select(h1.alias("h1"), h2.alias("h2")), "unlisted")
    n, other = inside.count(), outside.count()
    out = Cascade()
    encode, test = inside, outside
    while n:
        rate = 0.5 if out.levels else min(0.5, max(1e-6, n * 0.7 / max(other, 1)))
        level = _build(encode, n, rate, {x.bits for x in out.levels})
        out.levels.append(level)
        wrong = common.written(_tested(test, level), "wrong")
        encode, test, n = wrong, encode, wrong.count()
    return out


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", most_bits: int = MOST_BITS) -> DataFrame:
    """urls(.., url) with host, path, rule and verdict added.

    rules(host, path, verdict): a rule fits its host and all subdomains if the path starts with its
    own; the longest (host and path together, then the host) wins. Of one rule listed twice,
    `allow` wins. Urls that no rule fits get the default, the cascades' answer for keys that are not
    listed. Null urls, and those without `://`, have an empty host and path. Columns of urls named host,
    path, rule or verdict are replaced; repeated rows and urls of any length are judged like others."""
    listed = rules.select(F.concat(F.translate("host", UPPER, LOWER), F.col("path")).alias("key"), "verdict", F.length("path").alias("n")).filter("key is not null")
    lengths = sorted(r["n"] for r in listed.select("n").distinct().collect())
    depths = sorted(r["n"] for r in rules.filter("host is not null").select(F.size(F.split("host", r"\.", -1)).alias("n")).distinct().collect())
    depths, lengths = depths or [1], lengths or [0]
    host, path = host_and_path(F.col("url"))
    parsed = urls.withColumn("host", host).withColumn("path", path)
    parsed = parsed.withColumn("__keys", keys(F.col("host"), F.col("path"), depths, lengths))
    universe = common.written(parsed.select(F.explode("__keys.key").alias("key")).union(listed.select("key")).distinct(), "key-universe")
    shards = 1 + listed.count() * 40 // most_bits
    place = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(shards))
    spark = urls.sparkSession
    out = parsed.withColumn("__code", F.transform("__keys", lambda k: F.lit(0)))
    h1 = F.transform("__keys", lambda k: _hashes(k["key"])[0])
    h2 = F.transform("__keys", lambda k: _hashes(k["key"])[1])
    mine = F.transform("__keys", lambda k: F.pmod(F.xxhash64(k["key"], F.lit(3)), F.lit(shards)))
    for shard in range(shards):
        part = [cascade(listed.filter((F.col("verdict") == v) & (place == shard)).select("key").distinct(), universe.filter(place == shard)) for v in ("allow", "block")]
        shared = spark.sparkContext.broadcast(part)
        out = out.withColumn("__code", _codes(shared, shard)("__code", h1, h2, mine))
    first = F.filter(F.arrays_zip(F.col("__keys.key").alias("key"), F.col("__code").alias("code")), lambda x: x["code"] > 0)
    hit = F.try_element_at(first, F.lit(1))
    return out.withColumn("rule", hit["key"]).withColumn("verdict", F.when(hit["code"] == 1, "allow").when(hit["code"] == 2, "block").otherwise(default)).drop("__keys", "__code")


def _codes(shared, shard: int):
    """Per key: 1 if the allow cascade has it, 2 if only the block cascade has it; other shards' codes stay."""

    @F.pandas_udf("array<int>")
    def codes(old: pd.Series, h1: pd.Series, h2: pd.Series, place: pd.Series) -> pd.Series:
        sizes = [len(x) for x in h1]
        if not sum(sizes):
            return pd.Series([[] for _ in sizes])
        a, b = (np.concatenate([np.asarray(x, np.int64) for x in h]).view(np.uint64) for h in (h1, h2))
        at = np.concatenate([np.asarray(x, np.int64) for x in place])
        out = np.concatenate([np.asarray(x, np.int32) for x in old])
        allow, block = shared.value
        code = np.where(allow.has(a, b), 1, np.where(block.has(a, b), 2, 0))
        out = np.where(at == shard, code, out).astype(np.int32)
        return pd.Series(np.split(out, np.cumsum(sizes)[:-1]))

    return codes


#: The rules of the query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def digest(pages: DataFrame, rules: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")
