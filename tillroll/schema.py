"""Schemas, column contracts and label constants."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw invoice lines as they arrive (before cleaning).  Every field may be
# null; prices may carry more than two decimals and quantities may be <= 0.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("invoice", T.StringType(), True),
        T.StructField("stockcode", T.StringType(), True),
        T.StructField("description", T.StringType(), True),
        T.StructField("quantity", T.IntegerType(), True),
        T.StructField("invoicedate", T.TimestampNTZType(), True),
        T.StructField("price", T.DecimalType(12, 4), True),
        T.StructField("customer_id", T.LongType(), True),
        T.StructField("country", T.StringType(), True),
    ]
)

# Cleaned, typed transaction lines (``tx``).
TX_SCHEMA = T.StructType(
    [
        T.StructField("invoice", T.StringType(), False),
        T.StructField("stockcode", T.StringType(), False),
        T.StructField("description", T.StringType(), True),
        T.StructField("quantity", T.IntegerType(), False),
        T.StructField("invoicedate", T.TimestampNTZType(), False),
        T.StructField("price", T.DecimalType(10, 2), False),
        T.StructField("customer_id", T.LongType(), False),
        T.StructField("country", T.StringType(), True),
        T.StructField("revenue", T.DecimalType(12, 2), False),
    ]
)

PRICE_TYPE = T.DecimalType(10, 2)
REVENUE_TYPE = T.DecimalType(12, 2)

# --- fixed values: labels and limits that must equal the source definitions ---
# Column length limits of the transaction table.
MAX_LEN = {"invoice": 20, "stockcode": 20, "country": 60}
# Invoice prefix that marks a cancellation (case-sensitive).
CANCELLATION_PREFIX = "C"
# RFM segments: (label, bounds of the recency, frequency and monetary scores),
# in rule order (first match wins), and the label of customers that fit no rule.
SEGMENT_RULES = (
    ("Champion", {"r": (4, 5), "f": (4, 5), "m": (4, 5)}),
    ("Big Spender", {"r": (3, 5), "m": (4, 5)}),
    ("Regular", {"r": (3, 5), "f": (3, 5)}),
    ("At-Risk", {"r": (1, 2), "f": (3, 5)}),
    ("Lost", {"r": (1, 2), "f": (1, 2)}),
)
SEG_OTHER = "Potential"
# Churn tiers, in business order, and their day cut-offs (< 30, < 60, < 90).
CHURN_TIERS = ("Active", "Watch", "At-Risk", "Churned")
CHURN_CUTS = (30, 60, 90)
# Win-back statuses and tiers (score cut-offs 16, 11, 6).
WINBACK_AT_RISK = "At-Risk"
WINBACK_CHURNED = "Churned"
WINBACK_TIERS = ("Tier 1 - Immediate", "Tier 2 - High", "Tier 3 - Medium", "Tier 4 - Low")
WINBACK_TIER_CUTS = (16, 11, 6)
WINBACK_MIN_DAYS = 60
WINBACK_CHURN_DAYS = 90
# Lifetime-value percentile tiers (NTILE(100) >= 90, >= 75, >= 50).
LTV_TIERS = ("Top 10%", "Top 25%", "Top 50%", "Bottom 50%")
LTV_TIER_CUTS = (90, 75, 50)
# Recovery rates of the win-back model.
RECOVERY_RATES = ("0.10", "0.20", "0.30")
# Cleaning rules, in the order they are applied.
RULE_MISSING_CUSTOMER = "missing_customer"
RULE_CANCELLATION = "cancellation"
RULE_NON_POSITIVE = "non_positive_quantity_or_price"
# --- end of fixed values ---

# Factor on the quantities of the test lines that pushes some revenues out of range.
BULK_SCALE = 1_000_000
