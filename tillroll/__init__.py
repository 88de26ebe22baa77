"""tillroll: retail transaction analytics as lazy Spark DataFrame operators.

One cleaned invoice-line table (``tx``) goes in; customer segmentation,
revenue trends, churn tiers, cohort retention, win-back scores and window
reports come out.  Every operator is ``f(df, ...) -> DataFrame`` and stays
lazy; Catalyst plans the work.  The only component with actions of its own
is the skew-safe ranking in :mod:`tillroll.plans.ranking`.
"""

from tillroll.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
