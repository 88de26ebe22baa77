"""O03 clean, O04 audit, O05 typing of invoice lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.schema import (CANCELLATION_PREFIX, MAX_LEN, PRICE_TYPE, REVENUE_TYPE,
                             RULE_CANCELLATION, RULE_MISSING_CUSTOMER, RULE_NON_POSITIVE)


def _is_cancellation(c="invoice"):
    # null-safe: a null invoice is *not* a cancellation (it is kept and then
    # rejected by the NOT NULL contract, as the database load would).
    return F.coalesce(F.col(c).startswith(CANCELLATION_PREFIX), F.lit(False))


def _first_failed_rule():
    """The first cleaning rule a raw line fails, or null if it passes all."""
    return (F.when(F.col("customer_id").isNull(), F.lit(RULE_MISSING_CUSTOMER))
             .when(_is_cancellation(), F.lit(RULE_CANCELLATION))
             .when(~F.coalesce((F.col("quantity") > 0) & (F.col("price") > 0), F.lit(False)),
                   F.lit(RULE_NON_POSITIVE)))


def clean_transactions(raw: DataFrame) -> DataFrame:
    """Drop lines without customer, cancellations, and non-positive
    quantity or price.  One filter; no deduplication."""
    return raw.filter(F.col("customer_id").isNotNull()
                      & ~_is_cancellation()
                      & (F.col("quantity") > 0) & (F.col("price") > 0))


def cleaning_audit(raw: DataFrame) -> DataFrame:
    """Rows dropped by each rule, counted sequentially (a row counts for
    the first rule it fails), plus ``input`` and ``valid`` totals.

    One pass and one tiny aggregate: partial counts are combined map-side.
    Output: ``rule, rows`` with rules in application order.
    """
    rules = [RULE_MISSING_CUSTOMER, RULE_CANCELLATION, RULE_NON_POSITIVE]
    counts = raw.agg(
        F.count(F.lit(1)).alias("input"),
        *[F.count_if(_first_failed_rule() == F.lit(r)).alias(r) for r in rules],
        F.count_if(_first_failed_rule().isNull()).alias("valid"),
    )
    names = ["input", *rules, "valid"]
    order = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    return (counts.unpivot([], names, "rule", "rows")
                  .withColumn("step", order[F.col("rule")].cast("int")))


def clean_with_audit(raw: DataFrame, name: str = "cleaning_audit"):
    """O03 with O04's counts collected on the fly: returns ``(clean, obs)``.

    ``obs`` is a :class:`pyspark.sql.Observation`; its ``get`` gives
    ``input`` and the per-rule drop counts once the first action on
    ``clean`` (e.g. the table write) has run.  No extra pass over the data.
    """
    from pyspark.sql import Observation

    obs = Observation(name)
    rule = _first_failed_rule()
    observed = raw.observe(
        obs, F.count(F.lit(1)).alias("input"),
        *[F.count_if(rule == F.lit(r)).alias(r)
          for r in (RULE_MISSING_CUSTOMER, RULE_CANCELLATION, RULE_NON_POSITIVE)])
    return clean_transactions(observed), obs


def _violations():
    """Comma-separated contract violations of one cleaned line ('' = valid).
    ``concat_ws`` skips the nulls of the checks that pass; all of it stays
    inside generated code."""
    checks = [
        (F.col("invoice").isNull(), "invoice is null"),
        (F.col("stockcode").isNull(), "stockcode is null"),
        (F.col("quantity").isNull(), "quantity is null"),
        (F.col("invoicedate").isNull(), "invoicedate is null"),
        (F.col("price").isNull(), "price is null"),
        (F.col("customer_id").isNull(), "customer_id is null"),
        (F.col("price").isNotNull() & _price().isNull(), "price out of range"),
        (F.col("price").isNotNull() & F.col("quantity").isNotNull() & _revenue().isNull(),
         "revenue out of range"),
    ] + [(F.length(c) > n, f"{c} longer than {n}") for c, n in MAX_LEN.items()]
    return F.concat_ws(", ", *[F.when(cond, F.lit(msg)) for cond, msg in checks])


def _price():
    """Price in cents precision, null if it does not fit."""
    return F.round(F.col("price").try_cast("decimal(20,6)"), 2).try_cast(PRICE_TYPE)


def _revenue():
    """Revenue from the unrounded price, rounded to cents; null if it does not fit."""
    exact = F.col("quantity").cast("decimal(10,0)") * F.col("price").try_cast("decimal(20,6)")
    return F.round(exact, 2).try_cast(REVENUE_TYPE)


def _typed_columns():
    return [
        F.col("invoice").cast("string").alias("invoice"),
        F.col("stockcode").cast("string").alias("stockcode"),
        F.col("description").cast("string").alias("description"),
        F.col("quantity").cast("int").alias("quantity"),
        F.col("invoicedate").cast("timestamp_ntz").alias("invoicedate"),
        _price().alias("price"),
        F.col("customer_id").cast("bigint").alias("customer_id"),
        F.col("country").cast("string").alias("country"),
        _revenue().alias("revenue"),
    ]


def type_transactions(clean: DataFrame, on_violation: str = "raise") -> DataFrame:
    """Cast to the transaction schema and derive ``revenue``.

    ``on_violation='raise'`` fails the job on the first NOT NULL / length /
    numeric range violation (as the table constraints would); ``'drop'`` keeps
    only valid rows (see :func:`transaction_rejects` for the others);
    ``'trust'`` checks nothing, for lines that were checked when loaded.
    """
    if on_violation not in ("raise", "drop", "trust"):
        raise ValueError("on_violation must be 'raise', 'drop' or 'trust'")
    if on_violation == "trust":
        return clean.select(_typed_columns())
    v = _violations()
    if on_violation == "drop":
        checked = clean.filter(v == F.lit(""))
    else:
        checked = clean.filter(F.when(v == F.lit(""), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("transaction contract: "), v)).cast("boolean")))
    return checked.select(_typed_columns())


def transaction_rejects(clean: DataFrame) -> DataFrame:
    """Rows of ``clean`` that violate the transaction contract, with reasons."""
    return clean.withColumn("violations", _violations()).filter(F.col("violations") != F.lit(""))
