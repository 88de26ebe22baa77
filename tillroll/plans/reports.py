"""Customer-level reports from one shared customer summary.

Each operator can build the customer summary (B1) itself, which costs a
scan and a shuffle of the whole fact table.  When several reports are
wanted together, :func:`customer_reports` builds it once, stores it in the
shared folder (a table of one row per customer) and derives
every report from that, so the fact table is aggregated once instead of
once per report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillroll.functions.metrics import stored_summary
from tillroll.operators import churn, revenue, rfm, winback


def customer_reports(tx: DataFrame | None, as_of=None, summary: DataFrame | None = None) -> dict[str, DataFrame]:
    """``{name: DataFrame}`` for the customer-level reports (O07, O11, O15,
    O16, O21, O22, O23), all computed from one materialised summary: that of ``tx``,
    or ``summary``, such as :func:`tillroll.functions.summaries.read_summary` merges
    from the parts of a table's loads (``tx`` is then not read)."""
    s = summary if summary is not None else stored_summary(tx, as_of)
    flags = churn.churn_flags(tx, summary=s)
    return {
        "rfm_segments": rfm.rfm_segments(tx, summary=s),
        "top_customers": revenue.top_customers(tx, summary=s),
        "churn_flags": flags,
        "churn_summary": churn.churn_summary(churn.churn_flags(tx, summary=s, sort=False)),
        "winback_candidates": winback.winback_candidates(tx, summary=s),
        "winback_priority": winback.winback_priority(tx, summary=s),
        "recovery_potential": winback.recovery_potential(tx, summary=s),
    }
