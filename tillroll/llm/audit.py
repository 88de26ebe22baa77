"""Filter interaction audit: what each filter removes, in every order.

1. One projection tells for every document which of the filters on its own text it
   fails, as the bits of a mask.
2. The filter on copies is an existential self-join: a left semi join on the text's
   hash, the exact text and a smaller id. Its right side is one row per text that
   occurs twice or more, with the smallest id; its left side is only the documents
   whose hash occurs twice or more. These hashes are broadcast, or beyond a counted
   number a bit map of them; it lets other documents pass too, which are no copies and are
   left to the join. A group of copies is dealt over as many tasks as
   its counted size asks for (salt), and the right side's few rows go to each.
3. The ids that the join returns are united with the documents' own masks and
   combined by document; then documents are counted by (part, mask). There are at
   most ``2 ** filters`` masks a part, and all orders are worked out from these counts.

What is broadcast is bounded by count. All other joins are told to shuffle, as the planner
goes by the bytes of compressed files and would collect millions of rows in the driver.

Defined results: a null text is an empty one; a null id is neither smaller nor larger
than another, so its document is not a copy and makes none; every row is a document,
so repeated rows count as often as they occur and are no copies of each other
(their ids are equal); a null id has no labels; a null part is the empty string; of several labels of one id a 1
counts; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import BROADCAST_ROWS, let, small, stored, words

#: Rows of one group of copies that go to one task.
GROUP_ROWS = 20_000
#: Bits of the map of hashes (32 MB at most), and of each of its rows as ``bitmap_construct_agg`` makes them.
MAP_BITS = 1 << 28
ROW_BITS = 1 << 15


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters A to D on a text (fixed values: 200 words, half of
    them distinct, 2 capitals in 100 characters, the symbols)."""
    t = F.coalesce(text, F.lit(""))
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
    both = let(words(t), lambda w: F.struct(F.size(w).alias("n"),
                                            F.size(F.array_distinct(w)).alias("distinct")))
    return {
        "A": both["n"] < 200,
        "B": both["distinct"] * 100 < both["n"] * 50,
        "C": capitals * 100 > F.length(t) * 2,
        "D": F.rlike(t, F.lit(r"[#$%&*|]")),
    }


def mapped(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """The rows whose ``h`` is in ``hashes``, and others that share a bit of a map of bounded size with one."""
    def bit(h):
        return F.pmod(F.xxhash64(h), F.lit(MAP_BITS))

    # dealt by row of the map, so that a row is made in one task
    bits = hashes.select(F.floor(bit("h") / ROW_BITS).alias("row"), (bit("h") % ROW_BITS).alias("at")).repartition(
        "row").groupBy("row").agg(F.bitmap_construct_agg("at").alias("map"))
    at = bit("r.h") % ROW_BITS
    byte = F.conv(F.hex(F.substring("m.map", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.alias("r").join(F.broadcast(bits).alias("m"), (F.floor(bit("r.h") / ROW_BITS) == F.col("m.row"))
                                & (F.getbit(byte, (at % 8).cast("int")) == 1), "left_semi")


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
           keep: tuple[str, ...] = (), hashes: DataFrame | None = None) -> DataFrame:
    """``id, h`` and the columns ``keep`` of the rows whose text a smaller id has too.

    ``hashes``: a frame ``id, h`` of all rows, if it has been stored already.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.md5(t).alias("h"), t.alias("t"),
                       *[F.col(f"`{c}`") for c in keep]).filter("id IS NOT NULL")
    if hashes is None:
        hashes = rows.select("id", "h")
    counted = hashes.filter("id IS NOT NULL").groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    again = stored(counted.filter("lo < hi").select("h", "n"))

    few, group, how = small(again), GROUP_ROWS, "inner"
    if few is again:  # too many to broadcast: only those of large groups are, whose number is bounded
        total = again.agg(F.sum("n")).first()[0] or 0
        group, how = max(GROUP_ROWS, -(-total // BROADCAST_ROWS)), "left"
        rows, few = mapped(rows, again), F.broadcast(again.filter(F.col("n") > group))
    shared = rows.join(few.select("h", F.ceil(F.col("n") / F.lit(group)).cast("int").alias("salts")), "h", how)
    shared = shared.withColumn("salts", F.coalesce("salts", F.lit(1)))
    # one row per text and, by partial aggregation, few on the way there
    first = shared.groupBy("h", "t", "salts").agg(F.min("id").alias("first")).select(
        "h", "t", "first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    later = shared.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    a, b = later.alias("a"), first.hint("merge").alias("b")
    return a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.salt") == F.col("b.salt"))
                  & (F.col("a.t") == F.col("b.t")) & (F.col("b.first") < F.col("a.id")),
                  "left_semi").select("id", "h", *[F.col(f"`{c}`") for c in keep])


def failure_masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  part: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the set of filters that they fail.

    Bit ``i`` of the mask is the ``i``-th letter of ABCDE.
    """
    source = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t"),
                         F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"))
    own = F.lit(0)
    for i, failed in enumerate(text_filters(F.col("t")).values()):
        own = own + F.when(failed, F.lit(1 << i)).otherwise(F.lit(0))
    base = stored(source.select("id", F.md5(F.coalesce("t", F.lit(""))).alias("h"), "part",
                                own.alias("mask")))
    alike = copies(source, "id", "t", ("part",), base.select("id", "h")).select(
        "id", "h", "part", F.lit(1 << 4).alias("mask"), F.lit(0).alias("n"))
    united = base.withColumn("n", F.lit(1)).unionByName(alike)
    each = united.groupBy("id", "h", "part").agg(F.bit_or("mask").alias("mask"),
                                                 F.sum("n").alias("n"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    return each.join(marks.hint("merge"), "id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def orders(letters: str) -> list[tuple[str, int, int, int]]:
    """(order, step, bit of the step's filter, bits of the filters before it) of all orders."""
    bit = {c: 1 << i for i, c in enumerate(letters)}
    return [("".join(p), k + 1, bit[c], sum(bit[x] for x in p[:k]))
            for p in permutations(letters) for k, c in enumerate(p)]


def interactions(masks: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """All orders and steps of every part, from its counts by mask.

    A part's counts (``2 ** len(letters)`` at most) are one array; no documents are read.
    """
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"),
                               F.lit(b).alias("bit"), F.lit(p).alias("before"))
                      for o, s, b, p in orders(letters)])
    held = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"))
    rows = held.withColumn("s", F.explode(steps)).select("part", "c", "s.*")
    total = factorial(len(letters))

    def over(fits, value=lambda x: x["n"]):
        return F.aggregate("c", F.lit(0).cast("long"), lambda acc, x: acc + F.when(
            fits(x["mask"]), value(x)).otherwise(F.lit(0)).cast("long"))

    def fails(m):
        return m.bitwiseAND(F.col("bit")) != 0

    def early(m):
        return m.bitwiseAND(F.col("before")) != 0

    def removed(m):
        return fails(m) & ~early(m)

    # among the filters that a document fails each comes first in equally many orders
    share = over(fails, lambda x: x["n"] * F.lit(total) / F.bit_count(x["mask"]))
    return rows.select(
        "part", "filter_order", "step",
        over(lambda m: ~fails(m) & ~early(m)).alias("kept"), over(removed).alias("removed"),
        over(lambda m: fails(m) & early(m)).alias("redundant"),
        over(lambda m: m == F.col("bit")).alias("unique_fails"),
        over(removed, lambda x: x["good"]).alias("good_lost"),
        over(removed, lambda x: x["toxic"]).alias("toxic_lost"), share.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          part: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step."""
    return interactions(failure_masks(docs, labels, doc_id, text, part))
