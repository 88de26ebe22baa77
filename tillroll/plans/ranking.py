"""G1: ranking over a whole frame (or within groups) without one-task windows.

``Window.orderBy(...)`` with no ``partitionBy`` moves every row into a single
task, and ``partitionBy(key)`` does the same for a key that holds a third of
the rows. :func:`add_rankings` computes ``row_number``, ``rank``,
``dense_rank``, ``ntile`` and ``running_sum`` exactly, on one path for every
input size:

1. the input is stored with a row id;
2. it is range-partitioned by (group, order, ties, row id), in Spark's own
   ordering, and stored with the partition number, in ``rows / bucket_rows`` buckets (``MIN_BUCKETS`` at least). The row
   id closes the key, so equal values, and even copies of a row, are split;
3. windows within (bucket, group) give local ranks;
4. one row of statistics per bucket (its first and last group and value, and
   the local ranks of its last row) tells every bucket what precedes it. These
   carries are added to the bucket's first group, the only one that can have
   begun earlier.

All columns of one order are computed in one pass: one range shuffle of the
rows and one by bucket. Only the bucket statistics pass a window of their own
(one row per bucket). Columns of another order take another pass over the
result of the first.

Nulls sort last, ascending and descending alike; otherwise the order is
Spark's (NaN is the largest number).

:func:`add_rankings` runs jobs while it builds its result: it stores the input
(and counts it meanwhile), and stores it once more per order, by bucket.
Where most groups are small, :func:`add_group_rankings` sends only the large ones this way.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.plans.store import observed, stored

CONF_BUCKET_ROWS = "tillroll.ranking.bucketRows"
DEFAULT_BUCKET_ROWS = 500_000
MIN_BUCKETS = 4
KINDS = ("row_number", "rank", "dense_rank", "ntile", "running_sum")


@dataclass(frozen=True)
class RankSpec:
    """One ranking column.

    ``order``: ``(column, ascending)`` pairs.  ``ties``: extra ascending
    columns that make the order total (needed for deterministic
    ``row_number`` / ``ntile`` / ``running_sum``; ignored by ``rank`` /
    ``dense_rank``).  ``n``: buckets of ``ntile``; ``value``: the summed column
    of ``running_sum`` (row by row, not by peers).
    """

    name: str
    kind: str
    order: tuple = ()
    ties: tuple = ()
    n: int | None = None
    value: str | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        if self.kind == "ntile" and not self.n:
            raise ValueError("ntile needs n")
        if self.kind == "running_sum" and not self.value:
            raise ValueError("running_sum needs value")


def _sort_col(c: str, asc: bool) -> Column:
    return F.col(c).asc_nulls_last() if asc else F.col(c).desc_nulls_last()


def ntile_of_group(rn: Column, size: Column, n: int) -> Column:
    """NTILE(n) from a row number within a group of ``size`` rows (columns)."""
    q = F.floor(size / F.lit(n))
    r = size - q * n
    big = r * (q + 1)
    first = F.floor((rn - 1) / (q + 1)) + 1
    rest = F.floor((rn - 1 - big) / F.when(q == 0, F.lit(1)).otherwise(q)) + 1 + r
    return F.when(rn <= big, first).otherwise(rest).cast("bigint")


def add_rankings(df: DataFrame, specs, partition_by=(), *,
                 bucket_rows: int | None = None) -> DataFrame:
    """Return ``df`` with one column per :class:`RankSpec` (bigint; the sum's type for
    ``running_sum``)."""
    specs, groups = list(specs), list(partition_by)
    per_bucket = _bucket_rows(df, bucket_rows)
    out, seen = observed(df.withColumn("_rowid", F.monotonically_increasing_id()),
                         n=F.count(F.lit(1)))
    total = seen["n"]
    buckets = max(MIN_BUCKETS, math.ceil(total / per_bucket))
    for order, ties, same in _passes(specs):
        out = _ranked(out, same, groups, order, ties, total, buckets)
    return out.select(*df.columns, *[s.name for s in specs])


def add_group_rankings(df: DataFrame, specs, partition_by, *,
                       bucket_rows: int | None = None) -> DataFrame:
    """:func:`add_rankings` within groups of which most are small.

    The rows are stored and counted by group. Groups of at most ``bucket_rows`` rows are ordinary
    windows, one shuffle by group; only the rows of the others, of which there are at
    most ``rows / bucket_rows``, go through range buckets.
    """
    specs, groups = list(specs), list(partition_by)
    rows = stored(df)
    per = _bucket_rows(df, bucket_rows)
    hot, seen = observed(
        rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > per).drop("_n"),
        n=F.count(F.lit(1)))
    if not seen["n"]:
        return _windows(rows, specs, groups)
    a, b = rows.alias("a"), hot.alias("b")
    same = reduce(and_, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in groups])
    return _windows(a.join(b, same, "left_anti"), specs, groups).unionByName(
        add_rankings(a.join(b, same, "left_semi"), specs, groups, bucket_rows=per))


def _windows(df: DataFrame, specs, groups) -> DataFrame:
    """The ranking columns as plain windows, for groups that fit a task."""
    out = {}
    for s in specs:
        order = [_sort_col(c, a) for c, a in s.order]
        whole = Window.partitionBy(*groups).orderBy(*order, *[_sort_col(c, True) for c in s.ties])
        if s.kind in ("rank", "dense_rank"):
            col = getattr(F, s.kind)().over(Window.partitionBy(*groups).orderBy(*order))
        elif s.kind == "running_sum":
            col = F.sum(s.value).over(whole.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        else:
            col = (F.ntile(s.n) if s.kind == "ntile" else F.row_number()).over(whole)
        out[s.name] = col if s.kind == "running_sum" else col.cast("bigint")
    return df.select(*df.columns, *[v.alias(k) for k, v in out.items()])


def _bucket_rows(df: DataFrame, given: int | None) -> int:
    conf = df.sparkSession.conf.get(CONF_BUCKET_ROWS, None)
    return given or (int(conf) if conf else DEFAULT_BUCKET_ROWS)


def _passes(specs) -> list[tuple[tuple, tuple, list]]:
    """Specs that one sort serves: equal order, and equal ties or none."""
    out = []
    for s in specs:
        ties = () if s.kind in ("rank", "dense_rank") else s.ties
        for i, (order, held, same) in enumerate(out):
            if order == s.order and (not ties or not held or ties == held):
                out[i] = (order, held or ties, [*same, s])
                break
        else:
            out.append((s.order, ties, [s]))
    return out


def _ranked(base: DataFrame, specs, groups, order, ties, total: int, buckets: int,
            keep_bucket: bool = False) -> DataFrame:
    """All specs of one order: local ranks per bucket, plus what precedes the bucket."""
    group_cols = [_sort_col(c, True) for c in groups]
    order_cols = [_sort_col(c, a) for c, a in order]
    full = [*order_cols, *[_sort_col(c, True) for c in ties], F.col("_rowid").asc()]
    # stored: the bounds come from a sample, and statistics and rows must agree on them
    rows = stored(base.repartitionByRange(buckets, *group_cols, *full).withColumn(
        "_bucket", F.spark_partition_id()))
    group = F.struct(*groups) if groups else F.lit(0)
    value = F.struct(*[c for c, _ in order]) if order else F.lit(0)

    within = Window.partitionBy("_bucket", *groups)
    local = rows.withColumns({
        "_g": group, "_o": value,
        "_pos": F.row_number().over(Window.partitionBy("_bucket").orderBy(*group_cols, *full)),
        "_rn": F.row_number().over(within.orderBy(*full)),
        "_rk": F.rank().over(within.orderBy(*order_cols)) if order else F.lit(1),
        "_dr": F.dense_rank().over(within.orderBy(*order_cols)) if order else F.lit(1),
        "_n": F.count(F.lit(1)).over(within)})
    sums = [s for s in specs if s.kind == "running_sum"]
    upto = within.orderBy(*full).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = local.withColumns({f"_s{i}": F.sum(s.value).over(upto) for i, s in enumerate(sums)})

    carries = _carries(local, len(sums))
    joined = local.join(F.broadcast(carries), "_bucket")  # one row per bucket
    begun = F.col("_g").eqNullSafe(F.col("_first_g"))
    equal = begun & F.col("_o").eqNullSafe(F.col("_first_o"))

    def carried(c, when=begun):
        return F.when(when, F.col(c)).otherwise(F.lit(0))

    row = F.col("_rn") + carried("_rows_before")
    size = F.lit(total) if not groups else (
        F.col("_n") + carried("_rows_before")
        + F.when(F.col("_g").eqNullSafe(F.col("_last_g")), F.col("_rows_after")).otherwise(0))
    out = {}
    for s in specs:
        if s.kind == "row_number":
            out[s.name] = row
        elif s.kind == "ntile":
            out[s.name] = ntile_of_group(row, size, s.n)
        elif s.kind == "rank":
            out[s.name] = F.col("_rk") + carried("_rows_before") - carried("_equal_before", equal)
        elif s.kind == "dense_rank":
            out[s.name] = F.col("_dr") + F.when(begun, F.col("_values_before") - F.when(
                F.col("_equal_before") > 0, 1).otherwise(0)).otherwise(0)
    out = {k: v.cast("bigint") for k, v in out.items()}
    for i, s in enumerate(sums):
        before = F.when(begun, F.col(f"_sum_before{i}"))
        out[s.name] = F.when(before.isNull(), F.col(f"_s{i}")).otherwise(
            before + F.coalesce(F.col(f"_s{i}"), F.lit(0)))
    return joined.select(*base.columns, *[v.alias(k) for k, v in out.items()],
                         *(["_bucket"] if keep_bucket else []))


def _carries(local: DataFrame, n_sums: int) -> DataFrame:
    """Per bucket: its first and last group, and the rows, equal values, distinct values and
    sums of its first group in earlier buckets, and the rows of its last group in later ones.

    Groups lie in consecutive buckets, so a running sum over the buckets that
    end with a group covers all of it.
    """
    ends = local.groupBy("_bucket").agg(
        F.min_by(F.struct("_g", "_o", "_n"), "_pos").alias("f"),
        F.max_by(F.struct("_g", "_o", "_rn", "_rk", "_dr", *[f"_s{i}" for i in range(n_sums)]),
                 "_pos").alias("l"))
    # one row per bucket from here on
    every = Window.partitionBy(F.lit(0)).orderBy("_bucket")
    ends = ends.select(
        "_bucket", F.col("f._g").alias("_first_g"), F.col("f._o").alias("_first_o"),
        F.col("l._g").alias("_last_g"), F.col("l._o").alias("_last_o"),
        F.col("f._n").alias("_head"), F.col("l._rn").alias("_rows"),
        (F.col("l._rn") - F.col("l._rk") + 1).alias("_equal"), F.col("l._dr").alias("_values"),
        *[F.col(f"l._s{i}").alias(f"_sum{i}") for i in range(n_sums)],
        F.lag("l._g").over(every).alias("_prev_g"), F.lag("l._o").over(every).alias("_prev_o"),
        F.lead("f._g").over(every).alias("_next_g"),
        F.row_number().over(every).alias("_at"))
    goes_on = (F.col("_at") > 1) & F.col("_prev_g").eqNullSafe(F.col("_first_g"))
    same_value = goes_on & F.col("_prev_o").eqNullSafe(F.col("_first_o"))
    whole = F.col("_first_g").eqNullSafe(F.col("_last_g"))
    ends = ends.withColumn("_new_values", F.col("_values") - F.when(same_value & whole, 1).otherwise(0))
    by_group = Window.partitionBy("_last_g").orderBy("_bucket")
    by_value = Window.partitionBy("_last_g", "_last_o").orderBy("_bucket")
    later = Window.partitionBy("_first_g").orderBy(F.col("_bucket").desc())
    ends = ends.withColumns({
        "_c_rows": F.sum("_rows").over(by_group), "_c_values": F.sum("_new_values").over(by_group),
        "_c_equal": F.sum("_equal").over(by_value), "_c_head": F.sum("_head").over(later),
        **{f"_c_sum{i}": F.sum(f"_sum{i}").over(by_group) for i in range(n_sums)}})

    def before(c, when=goes_on):
        return F.when(when, F.lag(c).over(every)).otherwise(F.lit(0))

    return ends.select(
        "_bucket", "_first_g", "_first_o", "_last_g",
        before("_c_rows").alias("_rows_before"), before("_c_equal", same_value).alias("_equal_before"),
        before("_c_values").alias("_values_before"),
        *[F.when(goes_on, F.lag(f"_c_sum{i}").over(every)).alias(f"_sum_before{i}") for i in range(n_sums)],
        F.when(F.col("_next_g").eqNullSafe(F.col("_last_g")) & F.lead("_bucket").over(every).isNotNull(),
               F.lead("_c_head").over(every)).otherwise(F.lit(0)).alias("_rows_after"))
