"""Documents with the awkward cases that every operator must take."""

from __future__ import annotations

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def awkward(spark, seed=1, n=60):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, copies."""
    rnd = random.Random(seed)
    rows = [(i, "\n".join(words(rnd, rnd.randint(1, 40)) for _ in range(rnd.randint(1, 6))),
             "en", rnd.choice(["a", "b", "c", None]), 1) for i in range(n)]
    rows += [(n, None, None, None, None), (n + 1, "", "en", "a", 0), (n + 2, " \n\t ", "en", "b", 3),
             (None, rows[0][1], "en", "a", 1), (None, None, None, None, None),
             (n + 3, words(rnd, 20_000), "en", "c", 1), (n + 4, "x" * 100_000, "en", "c", 1)]
    rows += [rows[3]] * 3 + [(n + 5 + k, rows[4][1], "en", "a", 1) for k in range(3)]
    rows += [(5, "another text of an id that is taken already by one", "en", "b", 1)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


CLASHING = ("_doc", "_fp", "_size", "_counts", "_id", "_hash", "row", "words", "kept", "key", "bucket",
            "level", "rule", "n", "h", "target", "copies", "taken", "n_replaced", "n_cut", "n_lines")


def with_clashes(df):
    """The frame with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(c) for c in CLASHING if c not in df.columns})
