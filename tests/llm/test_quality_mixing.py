"""Operators 1 and 2: contract columns against DuckDB and plain Python, awkward input."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpers import SF, awkward, empty, with_clashes
from oracle_check import compare, duck
from tillroll.llm import mixing, quality
from tillroll.llm.oracle import ORACLE
from tillroll.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_registered_queries_match_their_sql(spark, name):
    r = compare(spark, SF, name, QUERIES[name], ORACLE[name], duck(SF))
    assert r.get("match"), r


def plain_counts(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for k in range(5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


def test_counts_equal_plain_python(spark):
    rows = [(0, "a b c d e x a b c d e"), (1, "a a a a a a a"), (2, "one\n two \none\n\n two \n"),
            (3, "#a $b 日本 <|> x\x1fy"), (4, None), (5, ""), (6, "a b c d"), (7, "é " * 4000),
            (8, "a b c d e f a b c d e f a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(
        awkward(spark).select("doc_id", "text"))
    got = quality.score(df).collect()
    for r in got:
        text = next((t for i, t in rows if i == r.doc_id), None)
        if r.doc_id is not None and r.doc_id < 9 and text is not None and r.n_words == plain_counts(text)[0]:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(text)
    by_text = {t: plain_counts(t) for _, t in [tuple(r) for r in df.collect()]}
    key = lambda z: sorted(z, key=repr)
    assert key([(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got]) == \
        key([by_text[r.text] for r in df.collect()])


def test_quality_edges(spark):
    docs = awkward(spark)
    kept = quality.keep_good(with_clashes(docs))
    assert kept.columns == with_clashes(docs).columns
    assert quality.keep_good(empty(spark)).count() == 0
    assert not quality.score(docs.filter("text IS NULL")).select("kept").distinct().first().kept
    rule = [("mean_word_chars", 3.0, None)]
    one = spark.createDataFrame([(1, "ab cd " * 10), (2, "abcd efg " * 3 + "some more words are here to read on")],
                                "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality.score(one, rule).collect()}[1] is False


def plain_targets(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    """Targets by resharing the excess of full sources until none is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= cap * sizes[s]}
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def test_mix_targets_limits_and_reruns(spark):
    docs = awkward(spark, n=300).repartition(7).cache()
    got = mixing.mix_sources(docs).collect()
    assert len(got) == docs.count()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r.size == len(WORD.findall(r.text or "")) and r.taken in (0, r.size, 2 * r.size)
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = plain_targets(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= max(r.size for r in got if r.source == s)
    key = lambda rows: sorted(map(repr, rows))
    assert key(mixing.mix_sources(docs.repartition(3)).collect()) == key(got)


def test_mix_sample_is_pareto_and_corpus_repeats_rows(spark):
    from helpers import words
    import random
    rnd = random.Random(3)
    rows = [(i, words(rnd, 120 if i % 2 else 12), "s" if i < 1500 else "t") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r for r in mixing.mix_sources(df).collect() if r.source == "s"]
    expected = {}
    for r in got:  # unequal inclusion: longer texts come in more often, by their preference
        expected.setdefault(r.size > 100, []).append(r.copies)
    mean = {k: sum(v) / len(v) for k, v in expected.items()}
    assert mean[True] == pytest.approx(1.5 * mean[False], rel=0.2)
    corpus = mixing.mixed_corpus(with_clashes(df))
    assert corpus.columns == with_clashes(df).columns
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(df).collect()}
    seen = Counter(r.doc_id for r in corpus.collect())
    assert all(seen[i] == c for i, c in copies.items())


def test_mix_edges(spark):
    assert mixing.mix_sources(empty(spark)).count() == 0
    assert mixing.mixed_corpus(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r.size, r.taken) for r in mixing.mix_sources(blank).collect()] == [(0, 0), (0, 0)]
    same = spark.createDataFrame([(1, "a b c", "s")] * 50 + [(2, "a b", "t")] * 50,
                                 "doc_id long, text string, source string")
    assert len({(r.doc_id, r.taken) for r in mixing.mix_sources(same).collect()}) == 2
    out = mixing.mix_sources(with_clashes(same))
    assert set(with_clashes(same).columns) <= {*out.columns}


def test_hot_source_is_not_gathered(spark):
    """No task of the plan ranks all documents of a source: windows run on bins and on one bin."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"),
                                    F.lit("hot").alias("source"))
    got = mixing.mix_sources(df).agg(F.sum("taken").alias("t"), F.first("target").alias("g")).first()
    assert abs(got.t - got.g) <= 3
