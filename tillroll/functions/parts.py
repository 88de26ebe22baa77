"""Derived tables kept per load of a transaction table, so that a new load does not
reread the lines of earlier ones.

The parts of one kind lie in ``<path>/_<kind>/<load>``.  A load has its part once the
success marker of ``last``, the table of the part that is written last, is there; a
broken-off refresh is therefore done again.  Parts of loads that the table no longer
names are never read, and :func:`prune` removes them.  Run one refresh at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillroll.sources.sink import read_table, table_loads


def _folder(spark: SparkSession, pattern: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def finished(spark: SparkSession, path: str, kind: str, last: str = "") -> set[str]:
    """Names of the loads whose part is complete."""
    tail = f"{last}/_SUCCESS" if last else "_SUCCESS"
    fs, where = _folder(spark, f"{path}/_{kind}/*/{tail}")
    found = [s.getPath().getParent() for s in fs.globStatus(where) or []]
    return {(p.getParent() if last else p).getName() for p in found}


def refresh(spark: SparkSession, path: str, kind: str, write: Callable[[DataFrame, str], None],
            last: str = "") -> list[str]:
    """Write the parts that are missing: ``write(lines of one load, folder)``; returns the loads."""
    path = path.rstrip("/")
    have = finished(spark, path, kind, last)
    todo = [x for x in table_loads(spark, path) if x not in have]
    for load in todo:
        write(read_table(spark, path, loads=[load]), f"{path}/_{kind}/{load}")
    return todo


def folders(spark: SparkSession, path: str, kind: str, last: str = "") -> list[str]:
    """Folders of the parts of the loads that are the table now; an error names missing ones."""
    path = path.rstrip("/")
    loads, have = table_loads(spark, path), finished(spark, path, kind, last)
    if missing := [x for x in loads if x not in have]:
        raise ValueError(f"loads without {kind}, refresh them first: {missing}")
    if not loads:
        raise FileNotFoundError(f"no table at {path}")
    return [f"{path}/_{kind}/{x}" for x in loads]


def prune(spark: SparkSession, path: str, kind: str) -> list[str]:
    """Remove the parts of loads that the table no longer names; returns their names."""
    path = path.rstrip("/")
    keep = set(table_loads(spark, path))
    fs, where = _folder(spark, f"{path}/_{kind}/*")
    gone = [s.getPath() for s in fs.globStatus(where) or [] if s.getPath().getName() not in keep]
    for p in gone:
        fs.delete(p, True)
    return sorted(p.getName() for p in gone)
