"""Exact decimal helpers and the output contract.

Rules used everywhere:
* ``round`` on decimals is half away from zero (never ``bround``);
* means are ``round(sum / count, s)``, never ``round(avg(x), s)``, because
  ``avg(decimal)`` rounds to 6 places first and would round twice;
* divisions go through ``nullif(den, 0)`` so an empty base gives NULL, not
  an ANSI error;
* percentages multiply by a decimal ``100.0``, never by a double.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _hundred() -> Column:
    return F.lit(Decimal("100.0"))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _dec(x) -> Column:
    """Integral columns become decimals so the division below is exact."""
    return _c(x).cast("decimal(20,0)")


def round_ratio(num, den, scale: int = 2) -> Column:
    """``round(num / nullif(den, 0), scale)`` in decimal arithmetic."""
    return F.round(_c(num) / F.nullif(_c(den), F.lit(0)), scale)


def mean_of(sum_col, count_col, scale: int = 2) -> Column:
    """Mean from a decimal sum and an integer count, rounded once."""
    return F.round(_c(sum_col) / F.nullif(_dec(count_col), F.lit(0)), scale)


def pct(part, whole, scale: int = 2) -> Column:
    """``round(100.0 * part / whole, scale)``; NULL when ``whole`` is 0."""
    p = _c(part)
    return F.round(_hundred() * p / F.nullif(_c(whole), F.lit(0)), scale)


def to_contract(df: DataFrame) -> DataFrame:
    """Boundary types for result comparison: decimals → double, integer
    types → bigint; dates, timestamps and strings unchanged."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(cols)
