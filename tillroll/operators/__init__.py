"""User-level operators.  Each is ``f(df, ...) -> DataFrame`` and lazy,
except the ranked ones, which materialise their (small) input once."""
