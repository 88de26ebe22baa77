"""Operators 4 and 5: alignment and SimHash groups against brute force."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helpers import SF, awkward, empty, with_clashes, words
from tillroll.llm import line_dedup, simhash
from tillroll.llm.common import stored
from tillroll.llm.components import components
from tillroll.llm.queries import QUERIES


# ---- line dedup

def test_patience_aligns_in_order_and_completely():
    rnd = random.Random(2)
    for _ in range(300):
        a = [rnd.randrange(12) for _ in range(rnd.randrange(14))]
        b = [rnd.randrange(12) for _ in range(rnd.randrange(14))]
        pairs = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert bool(pairs) == bool(set(a) & set(b))
    unique = list(range(50))
    cut = unique[:10] + [99] + unique[20:]
    assert [i for i, _ in line_dedup.patience(cut, unique)] == [*range(10), *range(11, 41)]
    # texts without repeated lines: as long as the longest common run alignment
    a, b = [1, 2, 3, 4, 5, 6], [9, 2, 3, 8, 5, 6, 7]
    blocks = SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
    assert len(line_dedup.patience(a, b)) == sum(m.size for m in blocks)


def simhash_words(x):
    return x.encode().split()


def test_line_dedup_equals_the_plain_version(spark):
    rnd = random.Random(5)
    shared = [words(rnd, rnd.randint(1, 30)) for _ in range(25)]
    rows = []
    for i in range(120):
        lines = [rnd.choice(shared) if rnd.random() < 0.4 else rnd.choice(["", words(rnd, rnd.randint(1, 20))])
                 for _ in range(rnd.randint(1, 12))]
        rows.append((i, "\n".join(lines)))
    rows += [(200 + i, rows[i][1]) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert {k: [x for x in r.text.split("\n") if x.split()] for k, r in got.items()} == whole_dedup(rows)
    want = {k: r.text for k, r in got.items()}
    assert any(r.n_cut for r in got.values())
    left = {x for t in want.values() for x in t.split("\n")}
    assert all(x in left for _, t in rows for x in t.split("\n"))  # no line is lost altogether


def test_a_shared_passage_goes_from_all_but_the_first(spark):
    rnd = random.Random(6)
    passage = words(rnd, 60)
    rows = [(i, words(rnd, 30) + "\n" + passage + "\n" + words(rnd, 25)) for i in range(80)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    assert all(got[i] == rows[i][1].replace(passage + "\n", "") for i in range(1, 80))


def whole_dedup(docs, min_block=10):
    """Non-blank lines left without those in a block shared with any earlier document."""
    seqs = {k: [x for x in t.split("\n") if x.split()] for k, t in docs}

    def common(a, b):
        cut, ends = set(), {}
        for i in range(len(a)):  # longest common block that ends at each pair of lines
            ends = {j: ends.get(j - 1, 0) + 1 for j in range(len(b)) if a[i] == b[j]}
            for size in ends.values():
                if sum(len(x.split()) for x in a[i + 1 - size:i + 1]) >= min_block:
                    cut.update(range(i + 1 - size, i + 1))
        return cut

    out = {}
    for k, a in seqs.items():
        cut = set().union(*[common(a, b) for o, b in seqs.items() if o < k])
        out[k] = [x for i, x in enumerate(a) if i not in cut]
    return out


def _left(spark, rows):
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r.doc_id: [x for x in r.text.split("\n") if x.split()] for r in got}


def test_the_alignment_decides_what_goes(monkeypatch):
    rnd, cases = random.Random(6), []
    for _ in range(300):
        a, b = [[rnd.randrange(3) for _ in range(rnd.randrange(14))] for _ in range(2)]
        cases.append((a, b, line_dedup.cut_positions(a, [4] * len(a), b, 10)))
    assert sum(bool(cut) for _, _, cut in cases) > 30
    monkeypatch.setattr(line_dedup, "patience", lambda a, b: [])
    assert not any(line_dedup.cut_positions(a, [4] * len(a), b, 10) for a, b, _ in cases)


def test_registered_line_dedup_equals_alignment_with_all_earlier_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op4_line_dedup"](spark, SF).collect()
    assert {r.doc_id: [x for x in r.text.split("\n") if x.split()] for r in got} == whole_dedup(docs)


def test_a_passage_goes_whoever_holds_its_lines(spark):
    """Its lines have first holders of their own, in another order, and no pair of them."""
    a, b = "the first line has nine words in it now", "licensed under the terms of version two"
    rows = [(1, a + "\nx"), (2, "y\n" + b), (3, f"p\n{a}\n{b}\nq"), (4, f"r s\n{a}\n{b}\nt"),
            (5, f"{b}\nmiddle\n{a}\n{b}")]
    assert _left(spark, rows) == whole_dedup(rows)
    assert _left(spark, rows)[4] == ["r s", "t"]


def test_lines_of_few_words_make_blocks(spark):
    verse = "\n".join(f"short v{i} line" for i in range(20))
    rows = [(i, f"own{i}\n{verse}\nend {i}") for i in range(4)]
    assert _left(spark, rows) == whole_dedup(rows)
    assert _left(spark, rows)[3] == ["own3", "end 3"]


def test_line_dedup_equals_alignment_with_all_earlier_documents(spark):
    rnd = random.Random(8)
    shared = [words(rnd, rnd.choice([1, 2, 3, 4, 6, 9, 12])) for _ in range(9)]
    rows = [(i, "\n".join(rnd.choice([*shared, "", f"own {i} {k}"]) for k in range(rnd.randint(1, 14))))
            for i in range(90)]
    assert _left(spark, rows) == whole_dedup(rows)


def test_line_dedup_edges(spark):
    docs = with_clashes(awkward(spark))
    out = line_dedup.dedup_lines(docs)
    assert set(docs.columns) <= set(out.columns) and out.count() == docs.count()
    again = {repr((r.doc_id, r.text)): r for r in out.collect()}
    first = docs.filter("doc_id IS NULL AND text IS NOT NULL").first()
    assert repr((None, first.text)) in again           # null ids come first and keep their lines
    assert [r.text for r in out.filter("doc_id = 0").collect()] != [first.text]
    copies = [r.text for r in out.filter("doc_id = 3").collect()]
    assert len(copies) == 4 and len(set(copies)) == 1  # repeated rows share their fate
    assert out.filter("doc_id = 60").first().text is None
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


# ---- SimHash

def plain_fingerprint(text, n=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_groups(rows, bits=4):
    fps = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((repr(d), f"{fps[i]:016x}", repr(least.get(root(i)))) for i, (d, _) in enumerate(rows))


def near_copies(seed=7, n=60):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        base = words(rnd, rnd.randint(3, 150), 5000).split()
        rows.append((i, " ".join(base)))
        for k in range(rnd.randrange(4)):
            edited = list(base)
            for _ in range(rnd.randrange(1, 3)):
                edited[rnd.randrange(len(edited))] = "Edited"
            rows.append((1000 + len(rows), "  ".join(edited)))
    return rows + [(5000, None), (5001, ""), (5002, "one"), (None, rows[0][1]), rows[1], rows[1]]


def test_groups_equal_brute_force(spark):
    rows = near_copies()
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    got = simhash.groups(df).select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("f"), "component_id")
    assert sorted((repr(r[0]), r[1], repr(r[2])) for r in got.collect()) == plain_groups(rows)


def test_registered_groups_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op5_simhash_groups"](spark, SF).collect()
    assert sorted((repr(r[0]), r[1], repr(r[2])) for r in got) == plain_groups(rows)


def test_keep_one_row_per_group(spark):
    rows = near_copies()
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(r.doc_id for r in kept.collect())
    want = sorted({int(c) for _, _, c in plain_groups(rows) if c != "None"})
    assert got == want
    nulls = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u v")],
                                  "doc_id long, text string")
    assert simhash.keep_one(nulls).count() == 2
    assert simhash.groups(empty(spark)).count() == 0 and simhash.keep_one(empty(spark)).count() == 0


def test_tree_finds_all_links_of_clustered_fingerprints():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = centres[rng.integers(0, 40, 3000)]
    for _ in range(3):
        fps ^= np.uint64(1) << rng.integers(0, 64, len(fps), dtype=np.uint64)
    fps = np.unique(fps)
    a, b = np.nonzero(np.triu(simhash.distance(fps[:, None], fps[None, :]) <= 4, 1))
    want = {tuple(map(int, x)) for x in zip(*simhash.stars(fps[a], fps[b]))}
    assert {tuple(map(int, x)) for x in zip(*simhash.shard_links(fps, fps, 4))} == want
    tree, shards = simhash.routing_tree(fps[:500], 4)
    found, homes = [], 0
    for _, at, home in simhash.route(tree, fps, 4):
        homes += int(home.sum())
        found.append(simhash.shard_links(fps[at][home], fps[at], 4))
    assert homes == len(fps)
    both = simhash.stars(*map(np.concatenate, zip(*found)))
    assert {tuple(map(int, x)) for x in zip(*both)} == want


def clustered(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 1 + n // 75, dtype=np.uint64)
    fps = centres[rng.integers(0, len(centres), n)]
    for _ in range(3):
        fps ^= np.uint64(1) << rng.integers(0, 64, len(fps), dtype=np.uint64)
    return np.unique(fps)


@pytest.mark.parametrize("n", [600, 4800])
def test_parts_are_bounded_and_lose_no_link(spark, n):
    """Eight times the fingerprints: more parts, not larger ones; each stored row meets each asking row once."""
    fps, limits = clustered(2, n), {"shard_rows": 20, "block_rows": 50}
    df = stored(spark.createDataFrame([(int(x),) for x in fps.view("<i8")], "fp long"))
    parts = simhash.dealt(df, 4, **limits).groupBy("part").agg(
        F.count_if("home").alias("homes"), F.count_if("asks").alias("asks")).collect()
    # blocks are dealt by hash: three times the mean is far beyond what such counts vary by
    assert max(r.homes for r in parts) <= 3 * 20 and max(r.asks for r in parts) <= 3 * 50
    a, b = np.nonzero(np.triu(simhash.distance(fps[:, None], fps[None, :]) <= 4, 1))
    want = {tuple(map(int, x)) for x in zip(*simhash.stars(fps[a], fps[b]))}
    for how in (limits, {}):
        links = np.array(simhash.fingerprint_links(df, 4, **how).collect(), "<i8").view("<u8")
        assert {tuple(map(int, x)) for x in zip(*simhash.stars(links[:, 0], links[:, 1]))} == want


def test_simhash_of_awkward_rows_and_of_a_text_beyond_the_buffer(spark, monkeypatch):
    df = with_clashes(awkward(spark))
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = simhash.groups(df).select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("f"), "component_id")
    assert sorted((repr(r[0]), r[1], repr(r[2])) for r in got.collect()) == plain_groups(rows)
    long = " ".join(f"w{i % 977}" for i in range(5000))
    whole = simhash.fingerprint(long)
    monkeypatch.setattr(simhash, "PAIR_BUFFER", 256)
    assert simhash.fingerprint(long) == whole


def test_components_of_chains_stars_and_repeats(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(200, 260)] + [
        (1, 2), (2, 1), (3, 3), (5, 4), (5, 4), (None, 9), (-5, 4), (140, 259)]
    got = {r.node: r.label for r in components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[x] for x in range(100, 141)} == {7} and got[230] == 7 and got[7] == 7
    assert got[1] == got[2] == 1 and got[4] == got[5] == -5 and 3 not in got and 9 not in got
