"""Query plans: skew-safe ranking (G1), the query catalog and its DuckDB
oracle used for result checks."""
