"""Raw invoice lines derived from the star-schema test tables.

Mapping (deterministic; makes every cleaning rule and every label fire):

* invoice     = 'C' prefix when the line was returned, then the order key
* stockcode   = 'P' || part key; description = part name (null for every 97th part)
* quantity    = line quantity, negated for returned lines
* invoicedate = order date; country = the customer's nation name
* price       = part retail price as decimal(10,2), zero for every 53rd order
* customer_id = order customer, null for every 10th order

The same expressions are repeated as a SQL CTE by the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.schema import PRICE_TYPE

# --- fixed values of the test-data mapping ---
RETURN_FLAG = "R"
NULL_DESCRIPTION_EVERY = 97
ZERO_PRICE_EVERY = 53
NULL_CUSTOMER_EVERY = 10
# --- end of fixed values ---


def raw_lines_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ part → raw invoice lines.

    Only the columns used are read (Parquet column pruning).  ``nation`` is
    bounded by the number of countries, so it is broadcast explicitly.
    ``orders`` grows with the fact table (a quarter of its rows), so the
    fact-to-orders join is declared a sort-merge join on the order key: both
    sides are shuffled in parallel instead of building a hash table of all
    orders in every task.  Customer and part joins are left to the planner
    (AQE broadcasts them when the runtime size allows).
    """
    rd = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    li = rd("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    o = rd("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = rd("customer").select("c_custkey", "c_nationkey")
    n = rd("nation").select("n_nationkey", "n_name")
    p = rd("part").select("p_partkey", "p_name", "p_retailprice")

    cust_country = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(
        "c_custkey", "n_name")
    j = (li.join(o.hint("merge"), li.l_orderkey == o.o_orderkey)
           .join(cust_country, o.o_custkey == cust_country.c_custkey)
           .join(p, li.l_partkey == p.p_partkey))
    returned = F.col("l_returnflag") == F.lit(RETURN_FLAG)
    return j.select(
        F.concat(F.when(returned, F.lit("C")).otherwise(F.lit("")),
                 F.col("o_orderkey").cast("string")).alias("invoice"),
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("stockcode"),
        F.when(F.col("p_partkey") % NULL_DESCRIPTION_EVERY == 0, F.lit(None).cast("string"))
         .otherwise(F.col("p_name")).alias("description"),
        (F.col("l_quantity").cast("int") * F.when(returned, F.lit(-1)).otherwise(F.lit(1)))
        .alias("quantity"),
        F.col("o_orderdate").alias("invoicedate"),
        F.when(F.col("o_orderkey") % ZERO_PRICE_EVERY == 0, F.lit(0).cast(PRICE_TYPE))
         .otherwise(F.col("p_retailprice").cast(PRICE_TYPE)).alias("price"),
        F.when(F.col("o_orderkey") % NULL_CUSTOMER_EVERY == 0, F.lit(None).cast("bigint"))
         .otherwise(F.col("o_custkey")).alias("customer_id"),
        F.col("n_name").alias("country"),
    )


def load_tx(spark: SparkSession, sf_dir: str, on_violation: str = "raise") -> DataFrame:
    """Cleaned and typed transactions (O03 + O05) over the test tables.

    Loads check the contract; reports, which read lines already checked, pass
    ``'trust'`` and read only the columns they use.
    """
    from tillroll.operators.clean import clean_transactions, type_transactions

    return type_transactions(clean_transactions(raw_lines_from_tables(spark, sf_dir)), on_violation)
