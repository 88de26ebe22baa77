"""Mixing sources to target weights by Pareto order sampling.

1. Every document gets a size (words) and a preference level; sizes are summed
   per (source, level), the only table that grows with the number of sources.
2. :func:`water_fill` turns weights into targets: each source takes
   ``min(cap x size, c x weight)`` with one ``c`` for all, which is the fixed
   point of resharing the excess of full sources by weight. The same function
   spreads a source's target over its preference levels, which gives every
   document its expected number of copies (at most ``cap``).
3. The whole part of the expected copies is certain. The fraction ``p`` is an
   inclusion probability: documents are ranked by Pareto's key
   ``(u / (1 - u)) / (p / (1 - p))``, ``u`` a keyed hash of the id, and taken
   in that order up to the source's remaining words (the document on the limit
   is taken if that comes nearer). So the sample has a fixed size in words.

No source is gathered in one task: the cut is found from a histogram of the
key (65,536 bins, partial sums before the shuffle), and only the bin that
holds the cut is ranked. The result per row is a function of its id, size and
source and of a small plan table, so reruns and recomputed tasks agree.

Defined results: a null source is a source of its own, last in code-point
order; a null text has size 0 and is never taken twice over its size; null ids
share one random number; rows with equal id and source share their fate; an
empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import fresh, scratch, small, stored, word_count

BINS = 65_536


@dataclass(frozen=True)
class Mix:
    """Parameters of a mix: source weights (repeating, by code point), the mixed
    share of all words, the most copies of a document and the random seed."""

    weights: tuple = (5, 2, 1)
    share: float = 1.5
    cap: float = 2.0
    seed: str = "mix-1"


def length_preference(size: Column) -> Column:
    """1 to 4 by the order of magnitude of the size: long texts bear repetition better."""
    return (F.when(size >= 1000, 4).when(size >= 100, 3).when(size >= 10, 2).otherwise(1)
            ).cast("long")


def water_fill(items: DataFrame, by: list[str], total: str, weight: str, cap: str,
               out: str) -> DataFrame:
    """``out = min(cap, c x weight)``, with ``c`` such that a group's sum is ``total``.

    Items fill up in the order of ``cap / weight``; an item is full if the water
    at its own level stays within the total. Weights are positive.
    """
    level, full = fresh(items, "level", "full")
    upto = Window.partitionBy(*by).orderBy(level).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*by)
    df = items.withColumn(level, F.col(cap) / F.col(weight))
    caps, rest = fresh(df, "caps", "rest")
    df = (df.withColumn(caps, F.sum(cap).over(upto))
          .withColumn(rest, F.sum(weight).over(after) - F.sum(weight).over(upto))
          .withColumn(full, F.col(caps) + F.col(level) * F.col(rest) <= F.col(total)))
    used = F.coalesce(F.sum(F.when(F.col(full), F.col(cap))).over(after), F.lit(0.0))
    free = F.sum(F.when(~F.col(full), F.col(weight))).over(after)
    c = (F.col(total) - used) / free
    return df.withColumn(out, F.when(F.col(full), F.col(cap)).otherwise(
        F.least(F.col(cap), c * F.col(weight)))).drop(level, full, caps, rest)


def source_targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Targets of (source, source_size): one row per source, all in one window."""
    k = len(mix.weights)
    order = Window.partitionBy("_all").orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(float(w)) for w in mix.weights]),
                   ((F.row_number().over(order) - 1) % k))
    ranked = (sizes.withColumn("_all", F.lit(0)).withColumn("_weight", weight)
              .withColumn("_cap", F.col("source_size") * F.lit(float(mix.cap)))
              .withColumn("_total", F.sum("source_size").over(Window.partitionBy("_all"))
                          * F.lit(float(mix.share))))
    return water_fill(ranked, ["_all"], "_total", "_weight", "_cap", "target").select(
        "source", "source_size", "target")


def random_unit(doc_id: Column, seed: str) -> Column:
    """A uniform number in (0, 1) with 52 random bits, keyed by the id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2 ** 52))


def pareto_key(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds (null for ``p = 0``)."""
    return F.when(p > 0, (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p)))


def mixing_plan(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The plan of a stored (source, size, level, u): per source and level the target, the
    certain copies, the inclusion probability and where the key is cut."""
    groups = sized.groupBy("source", "level").agg(F.sum("size").alias("level_size"))
    sources = source_targets(groups.groupBy("source").agg(
        F.sum("level_size").alias("source_size")), mix)
    same = F.col("g.source").eqNullSafe(F.col("s.source"))
    levels = groups.alias("g").join(sources.alias("s"), same).select(
        "g.source", "level", "level_size", "source_size", "target",
        (F.col("level") * F.col("level_size")).cast("double").alias("_weight"),
        (F.col("level_size") * F.lit(float(mix.cap))).alias("_cap"))
    none = levels.filter("level_size = 0").select(
        "source", "level", "level_size", "source_size", "target", F.lit(0.0).alias("copies"))
    some = water_fill(levels.filter("level_size > 0").withColumn("_src", F.struct("source")),
                      ["_src"], "target", "_weight", "_cap", "_words").select(
        "source", "level", "level_size", "source_size", "target",
        (F.col("_words") / F.col("level_size")).alias("copies"))
    rest = (some.unionByName(none)
            .withColumn("whole", F.floor("copies").cast("long"))
            .withColumn("p", F.col("copies") - F.col("whole"))
            .withColumn("remaining", F.col("target") - F.sum(
                F.col("whole") * F.col("level_size")).over(Window.partitionBy(F.struct("source")))))
    rest = small(stored(rest))

    same = F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.level") == F.col("r.level"))
    keyed = sized.alias("d").join(rest.alias("r"), same).select(
        "d.source", "size", "remaining", pareto_key(F.col("u"), F.col("p")).alias("key")).filter(
        F.col("key").isNotNull() & (F.col("size") > 0))
    keyed = keyed.withColumn("bin", key_bin(F.col("key")))
    upto = Window.partitionBy("_src").orderBy("bin").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    bins = (keyed.groupBy("source", "bin").agg(F.sum("size").alias("words"),
                                               F.first("remaining").alias("remaining"))
            .withColumn("_src", F.struct("source"))
            .withColumn("before", F.sum("words").over(upto) - F.col("words"))
            .filter(F.col("before") + F.col("words") > F.col("remaining")))
    cut = bins.groupBy("source").agg(F.min(F.struct("bin", "before")).alias("cut")).select(
        "source", F.col("cut.bin").alias("cut_bin"), F.col("cut.before").alias("before"))
    cut = small(stored(cut))

    upto = Window.partitionBy("_src").orderBy("key").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    inside = keyed.alias("k").join(cut.alias("c"), F.col("k.source").eqNullSafe(F.col("c.source"))
                                   & (F.col("bin") == F.col("cut_bin"))).select(
        "k.source", "key", "size", "remaining", "before")
    units = (inside.groupBy("source", "key").agg(
        F.sum("size").alias("words"), F.first("remaining").alias("remaining"),
        F.first("before").alias("before"))
        .withColumn("_src", F.struct("source"))
        .withColumn("upto", F.col("before") + F.sum("words").over(upto))
        .filter(F.col("upto") - F.col("words") / F.lit(2.0) <= F.col("remaining")))
    last = units.groupBy("source").agg(F.max("key").alias("cut_key"))
    r, c, m = rest.alias("r"), cut.alias("c"), last.alias("m")
    return r.join(c, F.col("r.source").eqNullSafe(F.col("c.source")), "left").join(
        m, F.col("r.source").eqNullSafe(F.col("m.source")), "left").select(
        "r.source", "level", "source_size", "target", "whole", "p", "cut_bin", "cut_key")


def key_bin(key: Column) -> Column:
    """Bin of a key: ``key / (1 + key)`` lies in (0, 1) and keeps the order."""
    return F.floor(key / (key + F.lit(1.0)) * F.lit(float(BINS))).cast("long")


def mix_sources(docs: DataFrame, mix: Mix = Mix(), doc_id: str = "doc_id", text: str = "text",
                source: str = "source") -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (copies x size).

    Columns of ``docs`` with these names are replaced.
    """
    spark = docs.sparkSession
    size = word_count(F.col(f"`{text}`"))
    sized = docs.select(F.col(f"`{source}`").alias("source"), size.alias("size"),
                        random_unit(F.col(f"`{doc_id}`"), mix.seed).alias("u")).withColumn(
        "level", length_preference(F.col("size")))
    plan = small(stored(mixing_plan(stored(sized), mix), scratch(spark)))

    out = ("size", "source_size", "target", "copies", "taken")
    keep = [c for c in docs.columns if c.lower() not in out]
    (s,) = fresh(docs, "size")
    d = docs.select("*", size.alias(s)).alias("d")
    same = F.col(f"d.`{source}`").eqNullSafe(F.col("m.source")) & (
        length_preference(F.col(f"d.{s}")) == F.col("m.level"))
    key = pareto_key(random_unit(F.col(f"d.`{doc_id}`"), mix.seed), F.col("m.p"))
    picked = F.coalesce((F.col(f"d.{s}") > 0) & key.isNotNull() & (
        F.col("m.cut_bin").isNull() | (key_bin(key) < F.col("m.cut_bin"))
        | ((key_bin(key) == F.col("m.cut_bin")) & (key <= F.col("m.cut_key")))), F.lit(False))
    copies = F.col("m.whole") + picked.cast("long")
    return d.join(plan.alias("m"), same).select(
        *[F.col(f"d.`{c}`") for c in keep], F.col(f"d.{s}").alias("size"),
        F.col("m.source_size"), F.col("m.target"), copies.alias("copies"),
        (copies * F.col(f"d.{s}")).alias("taken"))


def mixed_corpus(docs: DataFrame, mix: Mix = Mix(), **names) -> DataFrame:
    """The mixed corpus itself: every row of ``docs`` as often as the mix takes it."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    (n,) = fresh(docs, "n")
    whole = docs.select(F.struct(*columns).alias("row"), *[
        F.col(f"`{names.get(k, k)}`").alias(k) for k in ("doc_id", "text", "source")])
    mixed = mix_sources(whole, mix)
    return mixed.filter("copies > 0").select(
        "row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias(n)).select("row.*")
