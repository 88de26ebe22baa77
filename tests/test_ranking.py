"""G1: the range-bucketed ranking equals plain windows for every order, type and bucket size."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillroll.plans.ranking import RankSpec, _ranked, add_rankings
from tillroll.plans.store import stored


def _data(spark, n=1500, seed=1):
    rnd = random.Random(seed)
    doubles = [None, float("nan"), -0.0, 0.0, 1.0, 2.0, float("inf"), float("-inf"), 5.5]
    rows = []
    for i in range(n):
        rows.append((i, "hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", "c", None]),
                     7.0 if rnd.random() < 0.5 else rnd.choice(doubles),
                     rnd.choice(["x", "y", None, "", "zz"]),
                     rnd.choice([-2**63, 2**63 - 1, 0, None, 5]), rnd.randint(0, 3)))
    return stored(spark.createDataFrame(
        rows, "id long, g string, m double, t string, b long, d int"))


def _plain(df, specs, part):
    for s in specs:
        order = [F.col(c).asc_nulls_last() if a else F.col(c).desc_nulls_last() for c, a in s.order]
        if s.kind not in ("rank", "dense_rank"):
            order += [F.col(c).asc_nulls_last() for c in s.ties]
        w = Window.partitionBy(*(part or [F.lit(1)])).orderBy(*order)
        value = (F.sum(s.value).over(w.rowsBetween(Window.unboundedPreceding, 0))
                 if s.kind == "running_sum" else
                 {"row_number": F.row_number(), "rank": F.rank(), "dense_rank": F.dense_rank(),
                  "ntile": F.ntile(s.n or 1)}[s.kind].over(w))
        df = df.withColumn(s.name, value.cast("bigint"))
    return df


def _specs(order):
    return [RankSpec("rn", "row_number", order, ("id",)), RankSpec("rk", "rank", order),
            RankSpec("dr", "dense_rank", order), RankSpec("nt", "ntile", order, ("id",), n=7),
            RankSpec("rs", "running_sum", order, ("id",), value="d")]


def _rows(df):
    return sorted(tuple(r) for r in df.select("id", "rn", "rk", "dr", "nt", "rs").collect())


ORDERS = {"double_desc_nan": (("m", False),), "mixed": (("m", True), ("d", False)),
          "string_desc": (("t", False),), "smallest_long_desc": (("b", False),)}


@pytest.mark.parametrize("order", ORDERS.values(), ids=ORDERS)
@pytest.mark.parametrize("part", [[], ["g"]], ids=["global", "grouped"])
def test_equals_plain_windows(spark, order, part):
    df = _data(spark)
    want = _rows(_plain(df, _specs(order), part))
    for bucket_rows in (41, 500_000):
        assert _rows(add_rankings(df, _specs(order), part, bucket_rows=bucket_rows)) == want


def test_orders_of_different_passes_and_columns_kept(spark):
    df = _data(spark, 300)
    specs = [RankSpec("r1", "row_number", (("m", False),), ("id",)),
             RankSpec("r2", "row_number", (("t", True),), ("id",))]
    out = add_rankings(df, specs, bucket_rows=50)
    assert out.columns == [*df.columns, "r1", "r2"]
    want = _plain(df, specs, [])
    key = lambda x: sorted((r.id, r.r1, r.r2) for r in x.collect())
    assert key(out) == key(want)


def test_hot_value_and_copies_are_split(spark):
    rows = [(7 if i % 10 < 7 else i % 13, 1) for i in range(3000)]  # most rows are copies
    df = stored(spark.createDataFrame(rows, "m int, x int").withColumn(
        "_rowid", F.monotonically_increasing_id()))
    spec = RankSpec("rk", "rank", (("m", False),))
    out = _ranked(df, [spec], [], spec.order, (), 3000, 30, keep_bucket=True)
    sizes = [r["count"] for r in out.groupBy("_bucket").count().collect()]
    assert len(sizes) > 10 and max(sizes) <= 400
    got = {r.m: r.rk for r in out.select("m", "rk").distinct().collect()}
    assert got == {m: 1 + sum(v > m for v, _ in rows) for m in {v for v, _ in rows}}


def test_empty_and_fewer_rows_than_buckets(spark):
    df = spark.range(7).withColumn("m", F.col("id") * 2)
    spec = RankSpec("p", "ntile", (("m", True),), ("id",), n=100)
    assert sorted(r.p for r in add_rankings(df, [spec], bucket_rows=2).collect()) == list(range(1, 8))
    assert add_rankings(df.filter("id < 0"), [spec]).count() == 0


def test_bad_specs():
    for kw in ({"kind": "median"}, {"kind": "ntile"}, {"kind": "running_sum"}):
        with pytest.raises(ValueError):
            RankSpec("x", **kw)
