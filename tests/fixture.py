"""The 15-row micro fixture (raw invoice lines before cleaning)."""

import datetime as dt
from decimal import Decimal

from tillroll.schema import RAW_SCHEMA


def _ts(s):
    return dt.datetime.strptime(s, "%Y-%m-%d %H:%M")


ROWS = [
    ("A100", "10", "LAMP", 2, "2011-12-09 10:00", "5.00", 1, "UK"),
    ("A100", "11", "MUG", 1, "2011-12-09 10:00", "10.00", 1, "UK"),
    ("A090", "10", "LAMP RED", 1, "2011-11-09 09:00", "5.00", 1, "UK"),
    ("A091", "12", None, 4, "2011-11-09 09:00", "1.25", 1, "UK"),
    ("A080", "10", "LAMP", 1, "2011-10-10 08:00", "5.00", 2, "UK"),
    ("A070", "11", "MUG", 1, "2011-09-10 08:00", "10.00", 3, "EIRE"),
    ("A060", "12", "PEN", 8, "2011-09-09 08:00", "1.25", 4, None),
    ("A055", "12", "PEN", 1, "2011-11-09 00:00", "1.25", 5, "EIRE"),
    ("A050", "10", "LAMP", 1, "2011-06-01 12:00", "5.00", 3, "UK"),
    ("c113", "13", "TAG", 3, "2011-11-10 12:00", "0.335", 6, "UK"),
    ("C101", "10", "LAMP", -2, "2011-12-08 10:00", "5.00", 1, "UK"),
    ("C102", "10", "LAMP", -1, "2011-12-10 10:00", "5.00", None, "UK"),
    ("A110", "11", "MUG", 1, "2011-12-08 10:00", "10.00", None, "UK"),
    ("A111", "11", "MUG", 0, "2011-12-08 10:00", "10.00", 1, "UK"),
    ("A112", "11", "MUG", 1, "2011-12-08 10:00", "0.00", 2, "UK"),
]


def raw_frame(spark):
    rows = [(i, s, d, q, _ts(t), Decimal(p), c, co) for i, s, d, q, t, p, c, co in ROWS]
    return spark.createDataFrame(rows, RAW_SCHEMA)


def tx_frame(spark):
    from tillroll.operators.clean import clean_transactions, type_transactions
    return type_transactions(clean_transactions(raw_frame(spark)))
