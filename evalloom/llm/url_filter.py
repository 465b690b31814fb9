"""URL filters: the longest fitting rule decides; else the membership of the host in a block list, held as a filter cascade.

The cascade is a list of Bloom filters over the corpus's complete key universe (its distinct hosts). Level 1 encodes the listed
keys; level 2 the unlisted keys that level 1 lets through; level 3 the listed keys that level 2 lets through; and so on until a level
lets no wrong key through. A key of the universe is listed if the first level that rejects it is an even one (counting from 1), or
if all accept and their number is odd. So membership is exact and the large table is never joined or shuffled for it.

The cascade takes about 1.44 * log2(unlisted / listed) + 4 bits a listed key. It is sent to the workers only up to MOST_BITS;
for a longer list the keys are parted by their hash, and each part's cascade is made, applied and forgotten before the next one's turn (a table is written between).

Nulls: a null url, or one without "://", has an empty host and path and is allowed, as no rule fits an empty host and no list has it. Null hosts of a
list are left out, repeated ones count once. Repeated rows give repeated results, an empty table none; an empty list blocks nothing. Further columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, written

MOST_BITS = 1 << 28
#: The registered query's block list, in place of an outside one: hosts whose SHA-256 begins with one of these.
LISTED_DIGITS = ("0", "7", "e")
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


@dataclass(frozen=True)
class Level:
    bits: np.ndarray  # uint64 words
    m: int
    k: int

    def passes(self, a: int, b: int, at: int) -> bool:
        for p in positions(a, b, at, self.m, self.k):
            if not int(self.bits[p >> 6]) >> (p & 63) & 1:
                return False
        return True


def key_hash(key: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"))
    return h >> 64, h & (1 << 64) - 1


def positions(a: int, b: int, level: int, m: int, k: int) -> list[int]:
    """Double hashing, another sequence for each level."""
    a = xxhash.xxh64_intdigest(a.to_bytes(8, "little"), seed=level)
    return [(a + j * (b | 1)) % m for j in range(k)]


def is_listed(levels: list[Level], key: str) -> bool:
    a, b = key_hash(key)
    for i, level in enumerate(levels):
        if not level.passes(a, b, i):
            return i % 2 == 1
    return len(levels) % 2 == 1


def _passing(keys: DataFrame, levels: list[Level]) -> DataFrame:
    """The keys that all levels let through."""
    if not levels:
        return keys
    shared = keys.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            hashes = [key_hash(x) for x in part.column("key").to_pylist()]
            yield part.filter(pa.array([all(level.passes(a, b, i) for i, level in enumerate(shared.value)) for a, b in hashes], pa.bool_()))

    return keys.mapInArrow(run, keys.schema)


def _encoded(keys: DataFrame, n: int, at: int, rate: float) -> Level:
    """A Bloom filter of n keys: the tasks set bits of 64-bit words, which are joined by bit_or."""
    k = max(1, round(-math.log2(rate)))
    m = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            at_bit = np.array([p for x in part.column("key").to_pylist() for p in positions(*key_hash(x), at, m, k)], np.int64)
            words, where = np.unique(at_bit >> 6, return_inverse=True)
            bits = np.zeros(len(words), np.uint64)
            np.bitwise_or.at(bits, where, np.uint64(1) << (at_bit & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(bits.view(np.int64))], names=["word", "bits"])

    words = np.zeros(m // 64 + 1, np.uint64)
    found = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # m / 64 rows at most
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Level(words, m, k)


def build_cascade(universe: DataFrame) -> list[Level]:
    """universe: key, listed; each key once. Levels until none is let through wrongly; no level for an empty list."""
    counts = {x["listed"]: x["count"] for x in universe.groupBy("listed").count().collect()}
    n, rest = counts.get(True, 0), counts.get(False, 0)
    levels: list[Level] = []
    if not n:
        return levels
    rate = min(0.5, n / rest * math.sqrt(0.5)) if rest else 0.5
    encode_listed = True
    while n:
        keys = universe.filter(F.col("listed") == encode_listed).select("key")
        others = universe.filter(F.col("listed") != encode_listed).select("key")
        levels.append(_encoded(_passing(keys, list(levels)), n, len(levels), rate))
        n = _passing(others, list(levels)).count()
        encode_listed, rate = not encode_listed, 0.5
    return levels


def _member(levels):
    @F.pandas_udf("boolean")
    def member(keys: pd.Series) -> pd.Series:
        known = {x: is_listed(levels.value, x) for x in keys.unique()}
        return keys.map(known).astype(bool)

    return member


def part_count(universe: DataFrame, most_bits: int = MOST_BITS) -> int:
    """Parts of the keys so that the cascade of each takes about `most_bits` at most."""
    n, total = universe.agg(F.count_if("listed"), F.count("*")).first()
    return max(1, math.ceil(n * (1.44 * max(1.0, math.log2(max(2, total) / max(1, n))) + 4) / most_bits))


def with_listed(df: DataFrame, universe: DataFrame, key: str = "host", out: str = "is_listed", most_bits: int = MOST_BITS) -> DataFrame:
    """df with the boolean column `out`: the membership of its key. universe: key, listed; all keys of df, each once.

    One cascade, a narrow map; or one for each part of the keys, one after the other, so that the driver and the workers hold one at a time."""
    context, parts = df.sparkSession.sparkContext, part_count(universe, most_bits)
    result = df.withColumn(out, F.lit(False))
    for i in range(parts):
        levels = build_cascade(universe.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == i) if parts > 1 else universe)
        if levels:
            shared = context.broadcast(levels)
            mine = F.pmod(F.xxhash64(key), F.lit(parts)) == i
            result = result.withColumn(out, F.when(mine, _member(shared)(F.col(key))).otherwise(F.col(out)))
            if parts > 1:
                result = written(result, "listed")
                shared.destroy()
    return result


UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOW)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda x: len(x[1] + x[2])):  # the last, and so the longest, is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict. listed: a DataFrame of blocked hosts (column host)."""
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    hosts = parts.select(F.col("host").alias("key")).distinct()
    known = listed.select(F.col("host").cast("string").alias("key"), F.lit(True).alias("listed")).filter("key is not null").distinct()
    universe = cut(hosts.join(known, "key", "left").select("key", (F.coalesce("listed", F.lit(False)) & (F.col("key") != "")).alias("listed")))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return with_listed(parts, universe).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("is_listed"), "block").otherwise("allow")).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    host = url_host(F.col("url"))
    listed = pages.select(host.alias("host")).filter(F.substring(F.sha2("host", 256), 1, 1).isin(*LISTED_DIGITS)).distinct()
    return judge_urls(pages, listed)


def _rule_sql() -> str:
    cases = sorted(RULES, key=lambda x: -len(x[1] + x[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, kind) for kind, h, p in cases]
    rule = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits)
    digits = ", ".join(f"'{x}'" for x in LISTED_DIGITS)
    return f"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOW}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN host <> '' AND sha256(host)[1] IN ({digits}) THEN 'block' ELSE 'allow' END AS verdict
FROM p"""


QUERIES = {"op7_url_filter": op7_url_filter}
SQL = {"op7_url_filter": _rule_sql()}
