"""Exact URL filtering by a cascade of Bloom filters over the corpus's own keys.

Level 1 holds the listed keys; level 2 those keys of the corpus that level 1 takes for
listed by mistake; level 3 the listed ones that level 2 takes for mistakes; and so on until
a level makes no mistake. For every key of that universe the first level that lacks it tells
whether it is listed. Lookups need no join, and the filters' size follows the list: level
1's error rate is set so that about as many mistakes are left as there are listed keys.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, mix, stored

ALLOW, BLOCK = "allow", "block"
#: Bits of filters that a task holds at once, for each of two lists; a longer list is taken shard by shard.
MOST_BITS = 1 << 30


@dataclass(frozen=True)
class Rule:
    """Fits the host and its subdomains where the url's path starts with path."""

    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


#: The rules that the registered query judges by (fixed values).
RULES = (
    Rule(ALLOW, "org", "/"),
    Rule(BLOCK, "example.org", "/es/"),
    Rule(BLOCK, "example.org", "/en/1"),
    Rule(ALLOW, "com", "/fr/"),
    Rule(BLOCK, "com", "/de/"),
)


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def candidates(name: str, where: str, lengths: Sequence[int]) -> list[str]:
    """Every key that a rule fitting this url could have, for rules with these path lengths, longest first."""
    labels = name.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))] if name else []
    found = {h + where[:n] for h in hosts for n in lengths if n <= len(where)}
    return sorted(found, key=lambda k: (-len(k), k))


def hashes(keys: Sequence[str]) -> np.ndarray:
    """[keys, 2] halves of 128-bit hashes."""
    import xxhash

    data = b"".join(xxhash.xxh128_digest(k.encode()) for k in keys)
    return np.frombuffer(data, ">u8").astype(np.uint64).reshape(-1, 2)


@dataclass
class Bloom:
    """A filter over hashes(); its number among the levels makes its own places of them."""

    bits: int
    times: int
    level: int
    words: np.ndarray = field(repr=False)

    @staticmethod
    def size(n: int, error: float) -> int:
        return max(64, math.ceil(-max(n, 1) * math.log(error) / math.log(2) ** 2 / 64) * 64)

    @classmethod
    def sized(cls, n: int, error: float, level: int) -> Bloom:
        bits = cls.size(n, error)
        return cls(bits, max(1, round(bits / max(n, 1) * math.log(2))), level, np.zeros(bits // 64, np.uint64))

    def places(self, h: np.ndarray) -> np.ndarray:
        """[keys, times] bits."""
        with np.errstate(over="ignore"):
            start, step = mix(h[:, 0], self.level), h[:, 1] | np.uint64(1)
            return (start[:, None] + np.arange(self.times, dtype=np.uint64) * step[:, None]) % np.uint64(self.bits)

    def filled(self, h: np.ndarray) -> dict[str, np.ndarray]:
        """The words that these keys set bits in, and the bits."""
        p = np.unique(self.places(h).reshape(-1))
        word, first = np.unique(p >> np.uint64(6), return_index=True)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (p & np.uint64(63)), first) if len(p) else p
        return {"word": word.astype(np.int64), "bits": bits.view(np.int64)}

    def has(self, h: np.ndarray) -> np.ndarray:
        p = self.places(h)
        return ((self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).all(1)


@dataclass
class Cascade:
    """Levels of filters; exact for the listed keys and for every key of the universe."""

    levels: list[Bloom]

    def has(self, h: np.ndarray) -> np.ndarray:
        out, left = np.full(len(h), bool(len(self.levels) % 2)), np.arange(len(h))
        for i, level in enumerate(self.levels):
            inside = level.has(h[left])
            out[left[~inside]] = bool(i % 2)
            left = left[inside]
        return out

    def __contains__(self, key: str) -> bool:
        return bool(self.has(hashes([key]))[0])


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return mix(h[:, 1], 77) % np.uint64(shards)


def shards_for(listed: DataFrame, universe: DataFrame, error: float = 1 / 32, most_bits: int = MOST_BITS) -> int:
    """How many cascades keep every filter within most_bits."""
    n, size = (df.agg(F.approx_count_distinct("key").alias("n")).first().n for df in (listed, universe))
    return max(1, math.ceil(Bloom.size(n, min(error, n / max(size, 1)) if n else error) / most_bits))


def build(listed: DataFrame, universe: DataFrame, error: float = 1 / 32, shards: int = 1) -> list[Cascade]:
    """A cascade for each shard of the keys (see shard_of), from tables with a column key; repeats and nulls don't matter.

    universe holds every key that will be asked for. Both sides are brought together once, each
    key with whether it is listed. Level by level one side's keys fill a filter, in the
    tasks, and what the filter mistakes of the other side's is left for the next. Only
    filter bits come to the driver, never keys.
    """
    both = listed.select("key", F.lit(True).alias("listed")).unionByName(universe.select("key", F.lit(False).alias("listed")))
    keys = stored(both.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("listed").alias("listed")), "keys")
    out = []
    for shard in range(shards):

        def passing(batch: dict, shard: int = shard, level: Bloom | None = None) -> dict:
            h = hashes(batch["key"])
            keep = shard_of(h, shards) == shard if level is None else level.has(h)
            return {"key": [k for k, x in zip(batch["key"], keep.tolist(), strict=True) if x]}

        sides = [keys.where("listed").select("key"), keys.where("NOT listed").select("key")]
        if shards > 1:
            sides = [stored(mapped(s, passing, "key string"), "shard") for s in sides]
        counts = [s.count() for s in sides]
        levels: list[Bloom] = []
        while counts[0]:
            now = len(levels) % 2
            rate = error if levels else min(error, counts[0] / max(sum(counts), 1))
            level = Bloom.sized(counts[now], rate, len(levels))

            def bits(batch: dict, level: Bloom = level) -> dict:
                return level.filled(hashes(batch["key"]))

            for r in mapped(sides[now], bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
                level.words[r.word] = np.uint64(r.bits & 0xFFFFFFFFFFFFFFFF)
            levels.append(level)
            other = 1 - now
            sides[other] = stored(mapped(sides[other], lambda b, f=passing, level=level: f(b, level=level), "key string"), "mistaken")  # noqa: B023
            counts[other] = sides[other].count()
            if not counts[other]:
                break
        out.append(Cascade(levels))
    return out


def table_of(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")


def judge(pages: DataFrame, rules: Sequence[Rule] | DataFrame = RULES, most_bits: int = MOST_BITS) -> DataFrame:
    """Per page its host, path, the longest rule that fits and the verdict.

    pages has page_id and url; other columns are ignored. A null url or one without ://
    has an empty host and path and fits no rule; a very long one is read whole. A url that fits
    no rule isn't listed, which this method allows. Of equal keys a block stands. Repeated rows
    give repeated results, an empty table an empty one.

    rules may be a table (verdict, host, path) of any size: tasks get filters alone, no more
    than most_bits of them at once. The lengths of the rules' paths come to the driver.
    """
    spark = pages.sparkSession
    given = rules if isinstance(rules, DataFrame) else table_of(spark, rules)
    lengths = sorted(r.n for r in given.select(F.length("path").alias("n")).distinct().collect())
    listed = given.select(F.concat("host", "path").alias("key"), (F.col("verdict") == BLOCK).alias("block")).groupBy("key").agg(F.max("block").alias("block"))

    rows = stored(pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")), "urls")

    def all_keys(batch: dict) -> dict:
        return {"key": list(dict.fromkeys(k for h, p in zip(batch["host"], batch["path"], strict=True) for k in candidates(h, p, lengths)))}

    universe = stored(mapped(rows.select("host", "path").distinct(), all_keys, "key string").distinct(), "universe")
    shards = shards_for(listed, universe, most_bits=most_bits)
    known = build(listed, universe, shards=shards)
    blocked = build(listed.where("block"), universe, shards=shards)

    rows = rows.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(ALLOW))
    for shard in range(shards):

        def run(batch: dict, shard: int = shard, cascade: Cascade = known[shard], block: Cascade = blocked[shard]) -> dict:
            each = [candidates(h, p, lengths) for h, p in zip(batch["host"], batch["path"], strict=True)]
            keys = list(dict.fromkeys(k for c in each for k in c))
            h = hashes(keys)
            fits = cascade.has(h) & (shard_of(h, shards) == shard)
            bad = dict(zip([k for k, x in zip(keys, fits.tolist(), strict=True) if x], block.has(h[fits]).tolist(), strict=True))
            for i, c in enumerate(each):
                best = next((k for k in c if k in bad), None)  # the longest comes first
                old = batch["rule"][i]
                if best is not None and (old is None or len(best) > len(old)):
                    batch["rule"][i], batch["verdict"][i] = best, BLOCK if bad[best] else ALLOW
            return batch

        rows = mapped(rows, run, "page_id long, host string, path string, rule string, verdict string")
        if shard + 1 < shards:
            rows = stored(rows, "judged")
    return rows


#: The same judgement in DuckDB's SQL.
SQL = """
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages
), h AS (
  SELECT page_id,
         translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM u
), r(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fit AS (
  SELECT h.page_id, h.host, h.path, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
  FROM h LEFT JOIN r ON (h.host = r.rhost OR ends_with(h.host, '.' || r.rhost)) AND starts_with(h.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE k = 1
"""
