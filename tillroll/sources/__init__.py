from tillroll.sources.adapter import raw_lines_from_tables, load_tx
from tillroll.sources.raw import read_raw, union_sources, normalize_columns
from tillroll.sources.sink import read_table, vacuum, write_and_reconcile, write_jdbc, write_load

__all__ = ["raw_lines_from_tables", "load_tx", "read_raw", "union_sources",
           "normalize_columns", "read_table", "vacuum", "write_and_reconcile", "write_jdbc", "write_load"]
