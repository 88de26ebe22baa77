"""Order statistics by refined histograms, against plain sorting and plain windows."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillroll.plans import selection
from tillroll.plans.ranking import RankSpec, add_group_rankings
from tillroll.plans.selection import Tiles, add_rank, ntiles, select, values_at
from tillroll.plans.store import stored


def in_order(rows, order, names):
    """Rows in Spark's order, nulls last."""
    for name, asc in reversed(order):
        k = names.index(name)
        rows = sorted((r for r in rows if r[k] is not None), key=lambda r: r[k], reverse=not asc) + [
            r for r in rows if r[k] is None]
    return rows


def hot_rows(n=900, seed=1):
    """A value that a third of the rows have, nulls, far outliers and neighbours."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x = rnd.random()
        value = 7 if x < .33 else None if x < .4 else rnd.choice([2 ** 62, -2 ** 62, 2 ** 53, 2 ** 53 + 1]) \
            if x < .45 else rnd.randrange(50) if x < .7 else rnd.randrange(10 ** 9)
        rows.append((i, value, None if value is None else Decimal(value % 10 ** 9) / 100,
                     dt.date(2000, 1, 1) + dt.timedelta(days=rnd.choice([0, 0, 5, rnd.randrange(9000)])),
                     rnd.choice(["", "a", "a\0", "ab", "é", "éa", "zz" * 9, "prefix-" * 4 + str(rnd.randrange(9)), None]),
                     rnd.choice([1.5, -0.0, 0.0, float("inf"), float("-inf"), 1e308, 1e-300, None, rnd.gauss(0, 1)])))
    return rows


SCHEMA = "id long, n long, m decimal(20,2), d date, s string, x double"
NAMES = ["id", "n", "m", "d", "s", "x"]


@pytest.fixture(scope="module")
def frame(spark):
    return stored(spark.createDataFrame(hot_rows(), SCHEMA).repartition(3))


@pytest.mark.parametrize("cells, leaf", [(4096, 256), (40, 3)])
def test_select_equals_sorting(frame, cells, leaf):
    rows = hot_rows()
    orders = [(("n", True), ("id", True)), (("n", False), ("id", True)), (("m", False), ("id", False)),
              (("d", True), ("s", False), ("id", True)), (("s", True), ("id", True)), (("d", False),)]
    places = [1, 2, 300, 301, 450, 880, 900]
    passes, found = select(frame, orders, lambda n: [[*places, 0, n + 1]] * len(orders), cells=cells, leaf=leaf)
    assert passes.total == 900
    for order, hits in zip(orders, found):
        want = [tuple(r[NAMES.index(c)] for c, _ in order) for r in in_order(rows, order, NAMES)]
        assert sorted(hits) == places
        for p, hit in hits.items():
            assert hit.key == want[p - 1]
            assert (hit.before, hit.equal) == (want.index(hit.key), want.count(hit.key))


@pytest.mark.parametrize("cells, leaf", [(4096, 256), (50, 2)])
def test_doubles_are_ordered_as_spark_does(frame, spark, cells, leaf):
    want = [r.x for r in frame.select("x").orderBy(F.col("x").asc_nulls_last()).collect()]
    places = list(range(1, 901, 37))
    _, got = values_at(frame, "x", lambda n: places, cells=cells, leaf=leaf)
    assert got == [want[p - 1] for p in places]
    nan = stored(spark.createDataFrame([(float("nan"),), (1.0,), (None,), (float("inf"),)], "x double"))
    _, got = values_at(nan, "x", lambda n: [1, 2, 3, 4])
    assert got[:2] == [1.0, float("inf")] and got[2] != got[2] and got[3] is None


@pytest.mark.parametrize("passes", [{}, {"cells": 300, "leaf": 2}])
@pytest.mark.parametrize("n", [1, 5, 10, 100, 2000])
def test_ntiles_equal_plain_windows(frame, n, passes):
    orders = {"a": (("n", True), ("id", True)), "b": (("n", False), ("id", True)), "c": (("s", False), ("id", True))}
    if n == 2000 and passes:
        return
    got = ntiles(frame, [Tiles(k, o, n) for k, o in orders.items()], **passes)
    for k, o in orders.items():
        w = Window.orderBy(*[F.col(c).asc_nulls_last() if a else F.col(c).desc_nulls_last() for c, a in o])
        got = got.withColumn(f"{k}_plain", F.ntile(n).over(w))
    assert got.filter("a <> a_plain OR b <> b_plain OR c <> c_plain").count() == 0


@pytest.mark.parametrize("asc", [True, False])
@pytest.mark.parametrize("bucket_rows", [None, 40, 290])
@pytest.mark.parametrize("column", ["n", "m", "d", "s"])
def test_rank_equals_the_plain_window(frame, column, bucket_rows, asc):
    c = F.col(column)
    w = Window.orderBy(c.asc_nulls_last() if asc else c.desc_nulls_last())
    got = add_rank(frame, "r", column, asc, bucket_rows=bucket_rows).withColumn("plain", F.rank().over(w))
    assert got.count() == 900 and got.filter("r <> plain").count() == 0


def test_a_hot_value_is_dealt_over_tasks(frame):
    dealt = add_rank(frame, "r", "n", bucket_rows=40)
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan
    # a rank window holds no more rows than a few buckets
    w = dealt.filter("n = 7")
    assert w.select("r").distinct().count() == 1


def test_passes_and_rows_to_the_driver_are_bounded(frame, monkeypatch):
    seen = {"passes": 0, "rows": 0}
    split, read = selection._Passes.split, selection._Passes.read

    def counted(self, cells):
        seen["passes"] += 1
        return split(self, cells)

    def reading(self, cells):
        seen["rows"] += sum(c.rows for c in cells)
        return read(self, cells)

    monkeypatch.setattr(selection._Passes, "split", counted)
    monkeypatch.setattr(selection._Passes, "read", reading)
    ntiles(frame, [Tiles("a", (("n", True), ("id", True)), 10), Tiles("b", (("m", False), ("id", True)), 10)],
           leaf=16)
    assert 1 <= seen["passes"] <= 8 and seen["rows"] <= 2 * 9 * 16


def test_degenerate_frames(spark, frame):
    none = stored(frame.limit(0))
    assert ntiles(none, [Tiles("a", (("n", True),), 5)]).count() == 0
    assert add_rank(none, "r", "n").count() == 0
    assert values_at(none, "n", lambda n: [1]) == (0, [None])
    nulls = stored(spark.createDataFrame([(None,)] * 7, "n long"))
    assert [r.a for r in ntiles(nulls, [Tiles("a", (("n", True),), 3)]).collect()] == [3] * 7  # equal rows share
    assert {r.r for r in add_rank(nulls, "r", "n", bucket_rows=2).collect()} == {1}
    with pytest.raises(TypeError):
        values_at(stored(spark.sql("SELECT timestamp'2020-01-01' AS t UNION ALL SELECT timestamp'2021-01-01'")),
                  "t", lambda n: [1])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-2 ** 63, 2 ** 63 - 1), st.integers(0, 3)), max_size=40),
       st.integers(1, 9))
def test_random_longs(spark, values, n):
    df = stored(spark.createDataFrame(list(enumerate(values)), "id long, n long"))
    got = ntiles(df, [Tiles("a", (("n", False), ("id", True)), n)], cells=64, leaf=1)
    w = Window.orderBy(F.col("n").desc_nulls_last(), "id")
    assert got.withColumn("p", F.ntile(n).over(w)).filter("a <> p").count() == 0


@pytest.mark.parametrize("per", [None, 1, 20, 400])
def test_groups_on_both_sides_of_the_limit(spark, per):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["hot", "hot", "hot", "b", None, f"g{i % 40}"]), rnd.choice([1, 2, None, rnd.randrange(99)]))
            for i in range(700)]
    df = spark.createDataFrame(rows, "id long, g string, v long")
    by = (("v", False),)
    specs = [RankSpec("rk", "rank", by), RankSpec("dr", "dense_rank", by), RankSpec("rn", "row_number", by, ("id",)),
             RankSpec("nt", "ntile", by, ("id",), n=7), RankSpec("s", "running_sum", by, ("id",), value="v")]
    got = add_group_rankings(df, specs, ["g"], bucket_rows=per)
    v = F.col("v").desc_nulls_last()
    w, t = Window.partitionBy("g").orderBy(v), Window.partitionBy("g").orderBy(v, "id")
    plain = {"rk": F.rank().over(w), "dr": F.dense_rank().over(w), "rn": F.row_number().over(t), "nt": F.ntile(7).over(t),
             "s": F.sum("v").over(t.rowsBetween(Window.unboundedPreceding, 0))}
    got = got.withColumns({f"p_{k}": c for k, c in plain.items()})
    assert got.count() == 700
    assert got.filter(" OR ".join(f"NOT {k} <=> p_{k}" for k in plain)).count() == 0
