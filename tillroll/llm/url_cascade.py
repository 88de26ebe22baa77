"""URL filters: a Bloom filter cascade over all keys of the corpus.

Level 1 holds the listed keys; level 2 holds the other corpus keys that level 1
takes for listed; level 3 the listed keys that level 2 holds by mistake, and so
on until a level holds nothing by mistake. A key of the corpus is listed if and
only if the first level that lacks it is even (or, if none lacks it, the number
of levels is odd). The answer is exact for the whole key universe and needs no
join: the levels reach the rows as one scalar subquery value.

Size bound: a shard's levels take at most ``MAX_SHARD_KEYS`` x 10 bits for level
1 (4 MB) and less for each further level. A longer list is cut by key hash into
more shards; each shard has its own cascade and its own pass over the url
column, so a task never holds more than one shard.

Built-in functions only: probes are bits of ``array<bigint>`` words found by
``xxhash64`` of key and level.

Defined results: a null url, or one without ``://``, has empty host and path;
repeated rows get equal verdicts; an empty list or table gives no levels; other
columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import fresh, scratch, stored

BITS_PER_KEY = 10
PROBES = 7
MAX_SHARD_KEYS = 3_000_000
MAX_LEVELS = 40

#: (host, path, verdict), as one rule each; the longest that fits wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@dataclass(frozen=True)
class Cascade:
    """Levels of one shard: per level a one-row table of its words, and its number of bits."""

    levels: tuple
    bits: tuple


def host(url: Column) -> Column:
    """Host of a url, A-Z lower-cased; empty for a null or a url without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """Path of a url, up to the query or fragment; empty for a url without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_key(url: Column) -> Column:
    """Key of a url: host and path, without scheme, query and fragment."""
    return F.concat(host(url), path(url))


def rule_of(host_: Column, path_: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host_ == h) | F.endswith(host_, F.lit("." + h))) & F.startswith(path_, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
                     ).otherwise(out)
    return out


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    h = F.xxhash64(key, F.lit(level))
    step = F.xxhash64(key, F.lit(-level))
    return [F.pmod(F.xxhash64(h, step, F.lit(i)), F.lit(bits)) for i in range(PROBES)]


def _holds(words: Column, key: Column, level: int, bits: int) -> Column:
    """Whether all probed bits of the key are set (``words``: a scalar subquery)."""
    out = F.lit(True)
    for p in _positions(key, level, bits):
        word = F.get(words, F.shiftright(p, 6).cast("int"))
        out = out & (F.getbit(word, (p % 64).cast("int")) == 1)
    return out


def _level(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """The words of a level's filter as one row, in order."""
    spark = keys.sparkSession
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("p")).select(
        F.shiftright("p", 6).alias("i"),
        F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int")).alias("w"))
    empty = spark.range(0, bits // 64, 1, 1).select(F.col("id").alias("i"),
                                                    F.lit(0).cast("long").alias("w"))
    words = at.unionByName(empty).groupBy("i").agg(F.bit_or("w").alias("w"))
    return words.groupBy().agg(F.sort_array(F.collect_list(F.struct("i", "w"))).alias("x")).select(
        F.col("x.w").alias("words"))


def build(universe: DataFrame) -> Cascade:
    """Cascade of a stored (key, listed) table that holds every key once."""
    spark = universe.sparkSession
    base = scratch(spark)
    bits, levels = [], []
    inner = universe.filter("listed").select("key")   # keys that the next level encodes
    outer = universe.filter("not listed").select("key")  # keys it is tested against
    for level in range(1, MAX_LEVELS + 1):
        n = inner.count()
        if n == 0:
            break
        bits.append(max(64, -(-n * BITS_PER_KEY // 64) * 64))
        one = stored(_level(inner, level, bits[-1]), f"{base}/level-{level}")
        levels.append(one)
        wrong = outer.filter(_holds(one.select("words").scalar(), F.col("key"), level, bits[-1]))
        inner, outer = stored(wrong, f"{base}/keys-{level}"), inner
    else:
        raise RuntimeError(f"the cascade did not end within {MAX_LEVELS} levels")
    return Cascade(tuple(levels), tuple(bits))


def listed(cascade: Cascade, key: Column) -> Column:
    """Whether a key of the universe is listed."""
    out = F.lit(len(cascade.bits) % 2 == 1)
    for i in range(len(cascade.bits), 0, -1):  # the first level that lacks the key decides
        words = cascade.levels[i - 1].select("words").scalar()
        out = F.when(~_holds(words, key, i, cascade.bits[i - 1]), F.lit(i % 2 == 0)).otherwise(out)
    return out


def judge(pages: DataFrame, blocked: DataFrame, url: str = "url", rules=RULES,
          shard_keys: int = MAX_SHARD_KEYS) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    A page's verdict is its rule's; without a rule, pages whose key is in
    ``blocked`` (one column ``key``) are blocked and the others allowed.
    """
    key = url_key(F.col(f"`{url}`"))
    ours = pages.select(key.alias("key"), F.lit(False).alias("listed"))
    theirs = blocked.select("key", F.lit(True).alias("listed")).filter("key is not null")
    universe = stored(ours.unionByName(theirs).groupBy("key").agg(
        F.max("listed").alias("listed")))
    shards = max(1, -(-universe.filter("listed").count() // shard_keys))

    out = ("host", "path", "rule", "verdict")
    k, r = fresh(pages, "key", "rule")
    keep = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in out]
    h, p = host(F.col(f"`{url}`")), path(F.col(f"`{url}`"))
    keyed = pages.select(*keep, h.alias("host"), p.alias("path"), key.alias(k),
                         rule_of(h, p, rules).alias(r))
    parts = None
    for i in range(shards):
        mine = F.pmod(F.xxhash64(F.col("key"), F.lit("shard")), F.lit(shards)) == i
        cascade = build(universe.filter(mine) if shards > 1 else universe)
        rows = keyed.filter(F.pmod(F.xxhash64(F.col(k), F.lit("shard")), F.lit(shards)) == i
                            ) if shards > 1 else keyed
        verdict = F.when(F.col(r).isNotNull(), F.col(f"{r}.verdict")).when(
            listed(cascade, F.col(k)), F.lit("block")).otherwise(F.lit("allow"))
        part = rows.select(*keep, "host", "path", F.col(f"{r}.rule").alias("rule"),
                           verdict.alias("verdict"))
        parts = part if parts is None else parts.unionByName(part)
    return parts
