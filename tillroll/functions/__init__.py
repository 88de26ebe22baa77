from tillroll.functions.metrics import (as_of_frame, customer_summary, fill_months, month_of,
                                        monthly_revenue, share_of_total, with_as_of)
from tillroll.functions.numeric import mean_of, pct, round_ratio, to_contract

__all__ = ["as_of_frame", "customer_summary", "fill_months", "month_of", "monthly_revenue",
           "share_of_total", "with_as_of", "mean_of", "pct", "round_ratio", "to_contract"]
