"""Quality rules: a threshold table compiled into one Spark projection.

:data:`RULES` lists (metric, lowest, highest). :func:`compile_rules` turns the
table into one boolean column over the metrics, and :func:`score` computes all
metrics of a text in the same projection, with built-in functions only: no
user function, no shuffle, one pass over the table.

Repeated five-word windows are found by 64-bit hashes of word hashes, sorted
with their positions only in texts that hold a repeated hash.

Defined results: a null or empty text has zero words and is rejected; a metric
whose denominator is zero is zero; repeated rows get equal results; other
columns do not matter, those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import fresh, let, words

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PCT = 20

# The commonest function words of the corpus languages.
STOP_WORDS = {
    "en": "the of and to in a is that for it was on are as with be at by this from or an have not he",
    "fr": "le la les de des du et en un une que qui dans pour est il sur ne pas au par avec ce se",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an",
    "es": "el la los las de del que y en un una por con no se para es al lo como su más o pero",
}

#: (metric, lowest allowed, highest allowed); None leaves a side open.
RULES = (
    ("mean_word_chars", 2.0, 15.0),
    ("symbol_ratio", None, 0.10),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.40),
    ("ellipsis_line_ratio", None, 0.30),
    ("bullet_line_ratio", None, 0.90),
    ("letter_word_ratio", 0.70, None),
)


def repeated_words(w: Column, n: int = WINDOW) -> Column:
    """Words of ``w`` inside ``n``-word windows that occur twice or more in it (int)."""
    def windows(h):  # the last n - 1 starts have no full window
        whole = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, n)]))
        return F.slice(whole, 1, F.greatest(F.size(h) - (n - 1), F.lit(0)))

    def spread(at):  # sorted starts: each adds its words not covered by the start before it
        steps = F.transform(at, lambda p, j: F.when(j == 0, F.lit(n)).otherwise(
            F.least(F.lit(n), p - F.get(at, j - 1))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def covered(g):
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: let(
            F.sort_array(F.transform(
                F.filter(s, lambda p, j: (F.coalesce(F.get(s, j - 1)["h"] == p["h"], F.lit(False)))
                         | F.coalesce(F.get(s, j + 1)["h"] == p["h"], F.lit(False))),
                lambda p: p["i"])), spread))

    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(
        windows(h), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0))
        .otherwise(covered(g))))


def _counts(text: Column) -> Column:
    """Struct of all counts of a text, each word and line array built once."""
    stop = sorted({x for ws in STOP_WORDS.values() for x in ws.split()})
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))

    def count(arr, cond):
        return F.size(F.filter(arr, cond))

    def fields(w, ln):
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(ln).cast("long").alias("n_lines"),
            count(w, lambda x: F.lower(x).isin(stop)).cast("long").alias("n_stop_words"),
            count(w, lambda x: F.rlike(x, F.lit(r"\p{L}"))).cast("long").alias("n_letter_words"),
            count(ln, lambda x: F.rlike(x, F.lit(r"(\.\.\.|…)[\x20\x09-\x0D]*$")))
            .cast("long").alias("n_ellipsis_lines"),
            count(ln, lambda x: F.rlike(x, F.lit(r"^[\x20\x09-\x0D]*[-*•‣◦]")))
            .cast("long").alias("n_bullet_lines"))

    return let(words(t), lambda w: let(lines, lambda ln: fields(w, ln)))


def _metrics(c) -> dict[str, Column]:
    def ratio(a, b):
        return F.when(c(b) == 0, F.lit(0.0)).otherwise(c(a) / c(b))

    return {
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "stop_word_ratio": ratio("n_stop_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "ellipsis_line_ratio": ratio("n_ellipsis_lines", "n_lines"),
        "bullet_line_ratio": ratio("n_bullet_lines", "n_lines"),
        "letter_word_ratio": ratio("n_letter_words", "n_words"),
    }


def compile_rules(rules, metrics: dict[str, Column]) -> Column:
    """One boolean column: every metric lies within its limits."""
    ok = F.lit(True)
    for name, low, high in rules:
        if low is not None:
            ok = ok & (metrics[name] >= F.lit(low))
        if high is not None:
            ok = ok & (metrics[name] <= F.lit(high))
    return ok


def score(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """``docs`` with the counts, the rule metrics, ``base_failed`` and ``kept``."""
    (held,) = fresh(docs, "counts")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
             "n_stop_words", "n_letter_words", "n_ellipsis_lines", "n_bullet_lines")

    def c(n):
        return F.col(f"{held}.{n}")

    metrics = _metrics(c)
    failed = (c("n_words") < MIN_WORDS) | (
        c("n_repeat_words") * 100 > c("n_words") * MAX_REPEAT_PCT)
    out = {n: c(n) for n in names} | metrics | {
        "base_failed": failed, "kept": ~failed & compile_rules(rules, metrics)}
    keep = [F.col(f"`{x}`") for x in docs.columns if x.lower() not in out]
    return docs.withColumn(held, _counts(F.col(f"`{text}`"))).select(
        *keep, *[v.alias(k) for k, v in out.items()])


def keep_good(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    (held, verdict) = fresh(docs, "counts", "kept")
    judged = docs.withColumn(held, _counts(F.col(f"`{text}`")))
    metrics = _metrics(lambda n: F.col(f"{held}.{n}"))
    failed = (F.col(f"{held}.n_words") < MIN_WORDS) | (
        F.col(f"{held}.n_repeat_words") * 100 > F.col(f"{held}.n_words") * MAX_REPEAT_PCT)
    return judged.select(*[F.col(f"`{c}`") for c in docs.columns],
                         (~failed & compile_rules(rules, metrics)).alias(verdict)).filter(
        F.col(verdict)).drop(verdict)
