"""Operators 11 to 13: importance resampling, suffix-array dedup and the filter audit against brute force."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import SF, awkward, empty, with_clashes, words
from tillroll.llm import audit, importance, suffix_dedup
from tillroll.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


# ---- importance resampling

def plain_features(text, max_n=2):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return len(w), [" ".join(w[i:i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def plain_draw(docs, target, buckets=10_000, percent=25):
    held = [(i, *plain_features(t)) for i, t in docs]

    def counts(features):
        out = {}
        for f in features:
            b = zlib.crc32(f.encode()) % buckets
            out[b] = out.get(b, 0) + 1
        return out

    s = counts([f for _, _, fs in held for f in fs])
    t = counts([f for x in target for f in plain_features(x)[1]])
    ns, nt = sum(s.values()) + buckets, sum(t.values()) + buckets
    rows = []
    for i, n, fs in held:
        gain = [math.floor(1000 * math.log((t.get(b, 0) + 1) * ns / ((s.get(b, 0) + 1) * nt)))
                for b in (zlib.crc32(f.encode()) % buckets for f in fs)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 2 ** 32)))))
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = [(r, k + 1) for k, r in enumerate(fit[:len(fit) * percent // 100])]
    return rows, drawn


def test_crc_of_any_run_from_two_prefixes():
    rnd, tables = random.Random(3), importance.shift_tables()
    raw = bytes(rnd.randrange(256) for _ in range(3000))
    prefix = np.array([zlib.crc32(raw[:i]) for i in range(len(raw) + 1)], np.uint32)
    i = np.array([rnd.randrange(3000) for _ in range(500)] + [0, 0, 7])
    j = np.array([rnd.randrange(a, 3001) for a in i[:500]] + [0, 3000, 7])
    got = prefix[j] ^ importance.shift(prefix[i], j - i, tables)
    assert got.tolist() == [zlib.crc32(raw[a:b]) for a, b in zip(i, j)]


@pytest.mark.parametrize("max_n", [1, 2, 3])
def test_grams_in_blocks_equal_plain_ones(monkeypatch, max_n):
    monkeypatch.setattr(importance, "BLOCK_WORDS", 5)
    monkeypatch.setattr(importance, "SPLIT_BYTES", 9)
    texts = ["One two-three  FOUR", "", "é ü x", "a", "  ", "long" * 100 + " b c d e f g h i j k"]
    held = [importance.running_crcs(t) for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(e) for e, _ in held])])
    ends, lengths = [np.concatenate([h[k] for h in held]) for k in (0, 1)]
    got = sorted(int(c) for _, crc in importance.grams(ends, lengths, bounds, max_n, importance.shift_tables())
                 for c in crc)
    assert got == sorted(zlib.crc32(f.encode()) for t in texts for f in plain_features(t, max_n)[1])


def check_draw(df, target):
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    bench = [r.text for r in target.select("text").collect()]
    got = importance.resample(df, target).collect()
    rows, drawn = plain_draw(docs, bench)
    key = repr
    assert sorted(map(key, [(r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got])) == \
        sorted(map(key, rows))
    have = sorted(((r["rank"], r.doc_id, r.score) for r in got if r["rank"] is not None))
    assert have == sorted((k, r[0], r[4]) for r, k in drawn)


def test_draw_of_awkward_documents(spark):
    check_draw(with_clashes(awkward(spark)), spark.createDataFrame(
        [(1, "w1 w2 w3 w4 W5"), (2, None), (3, "")], "item_id long, text string"))
    # no document of 20 words; no target; no documents
    short = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    check_draw(short, short.limit(0))
    assert importance.resample(empty(spark), short).count() == 0


def test_registered_draw_equals_the_plain_one(spark):
    docs, bench = [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark")]
    rows, drawn = plain_draw([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])
    ranks = {r[0]: k for r, k in drawn}
    want = sorted((i, n, w, s, ranks.get(i)) for i, _, n, w, s in rows)
    got = QUERIES["op11_importance_resampling"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got) == want


# ---- suffix arrays

def plain_cut(docs, least):
    """{(id, bytes): (bytes left, spans)} by a table of all strings."""
    first = {}
    low = -2 ** 63
    held = [(low if i is None else i, (t or "").encode()) for i, t in docs]
    for i, raw in held:
        for p in range(len(raw) - least + 1):
            s = raw[p:p + least]
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, raw in held:
        gone = bytearray(len(raw))
        for p in range(len(raw) - least + 1):
            if first[raw[p:p + least]] < i:
                gone[p:p + least] = b"\1" * least
        out[i, raw] = (bytes(x for x, g in zip(raw, gone) if not g),
                       len(re.findall(b"\1+", bytes(gone))))
    return out


def check_cut(spark, df, least=50, **sizes):
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = plain_cut(docs, least)
    got = suffix_dedup.dedup_bytes(df.withColumn("t0", F.col("text")), least=least, **sizes).collect()
    assert len(got) == len(docs)
    for r in got:
        raw = (r.t0 or "").encode()
        left, n = want[-2 ** 63 if r.doc_id is None else r.doc_id, raw]
        assert (bytes(r.kept), r.n_spans, r.n_bytes, r.n_removed) == (left, n, len(raw), len(raw) - len(left))
    return got


def test_suffix_arrays_and_common_prefixes(monkeypatch):
    rnd = random.Random(1)
    for _ in range(200):
        n = rnd.randrange(120)
        t = bytes(rnd.choice([97, 98, 0]) for _ in range(n)) if rnd.random() < .7 else b"ab\0" * (n // 3)
        monkeypatch.setattr(suffix_dedup, "LANES", rnd.choice([1, 3, 50, 4096]))
        x = suffix_dedup.words_at(np.frombuffer(t, np.uint8))
        order = suffix_dedup.suffix_array(x)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        shared = suffix_dedup.common_prefixes(x, order, 20)
        for k in range(1, len(t)):
            a, b = t[order[k]:], t[order[k - 1]:]
            c = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
            assert shared[k] == min(c, 20)


def test_merging_by_binary_search():
    rnd = random.Random(4)
    for _ in range(50):
        blocks = [np.sort(np.array([rnd.randrange(30) for _ in range(rnd.randrange(9))], np.uint64))
                  for _ in range(rnd.randrange(1, 8))]
        both = np.concatenate(blocks)
        order = suffix_dedup.merge_order(blocks)
        assert sorted(order.tolist()) == list(range(len(both)))
        assert both[order].tolist() == sorted(both.tolist())


def test_suffixes_of_a_text_too_long_to_pack():
    """Group, rank and position of a suffix of over a million bytes do not fit one number."""
    x = np.random.default_rng(1).integers(97, 99, 1_060_000).astype(np.uint8)
    x[-300:] = x[:300]
    order, t = suffix_dedup.suffix_array(suffix_dedup.words_at(x)), x.tobytes()
    assert (np.bincount(order, minlength=len(x)) == 1).all()
    assert all(t[a:a + 400] < t[b:b + 400] for a, b in zip(order[:-1].tolist(), order[1:].tolist()))


def test_equal_stretches_of_one_id_share_one_answer():
    """40 rows of one id, each in its own shard: their spans come at once, not stretch by stretch."""
    rnd = random.Random(12)
    same = words(rnd, 30, 60)
    held = [(1, f"{words(rnd, 9, 60)} {same} {words(rnd, 9, 60)}".encode())]
    held += [(5, f"{words(rnd, 9, 60)} {same} {words(rnd, 9, 60)}".encode())] * 40
    want = plain_cut([(i, t.decode()) for i, t in held], 50)
    out, text = [], b""
    for k, (i, raw) in enumerate(held):
        x = np.frombuffer(raw, np.uint8)
        for _, p, t in suffix_dedup.shard(x, np.array([0, len(x)]), np.array([i]), np.array([k]), np.array([0]), 50, 1):
            out.append(np.frombuffer(p, suffix_dedup._PIECE))
            text += t
    pieces = np.concatenate(out)
    found = list(suffix_dedup.merged_repeats(pieces, np.frombuffer(text, np.uint8), [len(x) for x in out], 50))
    gone = {k: set() for k in range(len(held))}
    for piece, lo, hi in found:
        for p, a, z in zip(piece, lo, hi):
            gone[int(pieces["h"][p])].update(range(pieces["pos"][p] + a, pieces["pos"][p] + z + 49))
    assert all(len(raw) - len(gone[k]) == len(want[i, raw][0]) for k, (i, raw) in enumerate(held))
    assert gone[1] and len(found) <= 3


def test_stretches_are_hashed_and_compared_by_words():
    """Less than 8 bytes of working memory per byte: a number per word, not several per byte."""
    rnd = np.random.default_rng(3)
    size = rnd.integers(60, 90, 20_000)
    start = np.cumsum(size) - size
    text = rnd.integers(0, 256, int(size.sum())).astype(np.uint8)
    for k in (1, 2, 3):  # differs in one byte: the first, one within, the last
        size[k] = size[0]
        text[start[k]:start[k] + size[k]] = text[:size[0]]
        text[start[k] + (0, 33, size[0] - 1)[k - 1]] ^= 1
    text[start[9]:start[9] + 60], text[start[10]:start[10] + 60] = text[start[8]:][:60], text[start[8]:][:60]
    size[8:10] = 60
    size[10] = 59
    tracemalloc.start()
    h = suffix_dedup._hash_strings(text, start, size)
    equal = suffix_dedup._equal(text, start, np.roll(start, 1), size, np.roll(size, 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert h[8] == h[9] != h[10] and len(set(h[:4].tolist())) == 4
    assert np.flatnonzero(equal).tolist() == [9]
    assert peak < 8 * len(text)


@pytest.mark.parametrize("shard_bytes, merge_bytes", [(512 << 10, 24 << 20), (400, 3000), (90, 700)])
def test_cut_across_small_shards(spark, shard_bytes, merge_bytes):
    rnd = random.Random(7)
    shared = [words(rnd, rnd.randint(5, 30), 60) for _ in range(12)]
    rows = [(i, " ".join(rnd.choice(shared) if rnd.random() < .4 else words(rnd, rnd.randint(1, 15), 60)
                         for _ in range(rnd.randint(1, 6)))) for i in range(60)]
    rows += [(rnd.randrange(60), "ab" * rnd.randrange(10, 90)) for _ in range(8)]
    rows += [(70 + i, rows[i][1]) for i in range(10)] + [(90, rows[3][1] + "é" * 40), (91, "ü" + "é" * 45)]
    rows += rows[:3] + [(None, rows[5][1]), (None, None), (95, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = check_cut(spark, df, shard_bytes=shard_bytes, merge_bytes=merge_bytes)
    assert any(r.n_spans > 1 for r in got) and any(r.n_removed == r.n_bytes > 0 for r in got)


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    """Every grouping by hash is followed by a comparison of the bytes."""
    monkeypatch.setattr(suffix_dedup, "_hash_strings", lambda text, start, size: np.zeros(len(start), np.uint64))
    rnd = random.Random(11)
    rows = [(i, words(rnd, 12, 6) + " the very same end of sixty bytes, and a little more of it " + words(rnd, 9, 6))
            for i in range(25)]
    held = [(x, y.encode()) for x, y in rows]
    want = plain_cut(rows, 50)
    out, blocks, text = [], [], b""
    for i, raw in held:
        x = np.frombuffer(raw, np.uint8)
        for _, p, t in suffix_dedup.shard(x, np.array([0, len(x)]), np.array([i]), np.array([i]), np.array([0]), 50, 1):
            out.append(np.frombuffer(p, suffix_dedup._PIECE))
            blocks.append(len(out[-1]))
            text += t
    pieces = np.concatenate(out)
    gone = {i: set() for i, _ in held}
    for piece, lo, hi in suffix_dedup.merged_repeats(pieces, np.frombuffer(text, np.uint8), blocks, 50):
        for p, a, z in zip(piece, lo, hi):
            gone[int(pieces["id"][p])].update(range(pieces["pos"][p] + a, pieces["pos"][p] + z + 49))
    assert all(len(raw) - len(gone[i]) == len(want[i, raw][0]) for i, raw in held)


def test_cut_of_awkward_documents(spark):
    docs = with_clashes(awkward(spark))
    got = check_cut(spark, docs)
    assert set(docs.columns) - {"text"} <= set(got[0].asDict())
    assert suffix_dedup.dedup_bytes(empty(spark)).count() == 0


def test_registered_cut_equals_the_plain_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = plain_cut([(r.doc_id, r.text) for r in docs], 50)
    for r, d in zip(QUERIES["op12_suffix_dedup"](spark, SF).orderBy("doc_id").collect(),
                    sorted(docs, key=lambda d: d.doc_id)):
        left, n = want[d.doc_id, (d.text or "").encode()]
        assert (r.kept_sha256, r.n_spans) == (hashlib.sha256(left).hexdigest(), n)


# ---- filter audit

def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}  # a null id has no labels
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, source in docs:
        t = text or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
                 "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
                 "D": any(c in "#$%&*|" for c in t),
                 "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)}
        rows.append((source or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for p in permutations("ABCDE"):
            left = mine
            for k, c in enumerate(p):
                gone = [r for r in left if c in r[1]]
                shapley[c] += len(gone)
                left = [r for r in left if c not in r[1]]
                out[part, "".join(p), k + 1] = [
                    len(left), len(gone), sum(c in r[1] for r in mine) - len(gone),
                    sum(r[1] == {c} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (q, order, step), v in out.items():
            if q == part:
                v.append(shapley[order[step - 1]])
    return out


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_audit_equals_the_plain_one(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(audit, "GROUP_ROWS", 3)  # groups of copies go to several tasks
    monkeypatch.setattr(audit, "small", lambda df: F.broadcast(df) if broadcast_rows else df)
    rnd = random.Random(9)
    texts = [words(rnd, n, v) + s for n, v in ((250, 400), (250, 60), (10, 9)) for s in ("", " #", " ABCDEFGHIJ" * 8)]
    rows = [(i, rnd.choice(texts), rnd.choice(["a", "", None, "b"])) for i in range(150)]
    rows += rows[:5] + [(None, texts[0], "a"), (None, None, None), (500, None, "a"), (501, "", "c")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 150, 2)] + [(2, 1, 1), (None, 1, 1)]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in got.collect()} == plain_audit(rows, labels)


def test_audit_of_awkward_documents(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = audit.audit(docs, labels).collect()
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in got} == plain_audit(rows, [])
    assert audit.audit(empty(spark), labels).count() == 0


def test_first_copies_go_to_every_salt(spark, monkeypatch):
    monkeypatch.setattr(audit, "GROUP_ROWS", 4)
    docs = spark.createDataFrame([(i, "same") for i in range(50)] + [(i, f"t{i}") for i in range(50, 60)],
                                 "doc_id long, text string")
    found = audit.copies(docs)
    assert sorted(r.id for r in found.collect()) == list(range(1, 50))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "salt" in plan


def test_only_counted_rows_are_broadcast(spark, monkeypatch):
    """A file's bytes decide nothing: joins are broadcast where asked for, all others are shuffled."""
    monkeypatch.setattr(audit, "small", lambda df: df)
    monkeypatch.setattr(audit, "GROUP_ROWS", 2)
    rows = [(i, f"text {i % 40}", "a") for i in range(120)]
    labels = [(i, 1, 0) for i in range(0, 120, 3)]
    got = audit.audit(spark.createDataFrame(rows, "doc_id long, text string, source string"),
                      spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    query = got._jdf.queryExecution()
    asked, plan = query.optimizedPlan().toString().count("strategy=broadcast"), query.executedPlan()
    assert plan.toString().count("BroadcastHashJoin") == asked
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in got.collect()} == plain_audit(rows, labels)
    final = plan.toString().split("Initial Plan")[0]
    assert final.count("BroadcastHashJoin") == asked and final.count("SortMergeJoin") == 2
    assert "sequence(0, 31" not in final  # no row for each hash and task


@pytest.mark.parametrize("bits, most", [(1 << 28, 5_010), (1 << 15, 8_000), (8, 20_000)])
def test_map_of_hashes_keeps_every_copy(spark, monkeypatch, bits, most):
    monkeypatch.setattr(audit, "MAP_BITS", bits)
    rows = spark.range(20_000).selectExpr("id", "md5(string(id)) AS h", "id AS map")
    passed = {r.id for r in audit.mapped(rows, rows.filter("id % 4 = 0").select("h")).collect()}
    assert passed >= set(range(0, 20_000, 4))
    assert len(passed) <= most
    monkeypatch.setattr(audit, "small", lambda df: df)
    monkeypatch.setattr(audit, "BROADCAST_ROWS", 2)  # groups of more rows for fewer groups
    monkeypatch.setattr(audit, "GROUP_ROWS", 3)
    docs = spark.createDataFrame([(i, f"t{min(i % 50, 9)}") for i in range(200)], "doc_id long, text string")
    assert sorted(r.id for r in audit.copies(docs).collect()) == list(range(10, 200))
