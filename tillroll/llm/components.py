"""Connected components of a link table by alternating large and small stars.

Every round is two aggregations (minimum neighbour of a node) and two joins on
narrow rows; nothing but counts reaches the driver. Rounds are stored in the
shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import scratch, stored

MAX_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Point the neighbours of every node at its smallest one.

    ``links``: (a, b) with a > b. Large: the larger neighbours of a node;
    small: its smaller neighbours and itself.
    """
    if large:
        both = links.select("a", "b").unionByName(
            links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        pairs = links.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").select(
            F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        pairs = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return pairs.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b: bigint); label is the smallest node.

    Null ends and loops are ignored; repeated links count once.
    """
    spark = links.sparkSession
    base = scratch(spark)
    now = stored(links.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{base}/0")
    state = None
    for i in range(1, MAX_ROUNDS + 1):
        now = stored(_star(_star(now, large=True), large=False), f"{base}/{i}")
        seen = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(seen) == state:  # the stars did not change
            break
        state = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle within {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
