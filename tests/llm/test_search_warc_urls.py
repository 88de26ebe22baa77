"""Operators 8, 9 and 10, and the pipeline: salvage, recall, exact membership, stage by stage."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helpers import SF, empty, with_clashes
from tillroll.llm import mih, url_cascade, warc
from tillroll.llm.common import scratch

# ---- WARC


def pages(spark):
    rnd = random.Random(4)
    big = ["".join(rnd.choices("abcdefgh é", k=1500)) for _ in range(3)]
    rows = [(i, f"http://h/{i}?q=a b%\n", big[i % 3]) for i in range(40)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", "short"), (103, "u", "short"),
             (104, "u", "WARC/1.1\r\n\r\nfake " * 100), (105, "u", "\x1f\x8b\x08 not gzip"),
             (None, "u", "x" * 2000), (106, "u", "é" * 500), (107, "u", "é" * 500), (108, "u", "é" * 499),
             (39, "u", big[39 % 3])]
    return rows


@pytest.mark.parametrize("gzip", [True, False], ids=["members", "plain"])
def test_archives_round_trip(spark, gzip):
    rows = pages(spark)
    df = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string")).repartition(3)
    path = scratch(spark)
    warc.write_archives(warc.mark_revisits(df), path, gzip=gzip, records_per_file=7)
    records = warc.read_records(spark, path)
    assert warc.read_gaps(spark, path).count() == 0
    assert {r.url for r in records.collect()} == {u for _, u, _ in rows}
    got = sorted(map(repr, (tuple(r) for r in warc.resolve(records).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())))
    first = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            first[h] = max(i, first.get(h, i))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = h in first and first[h] != i
        want.append(repr((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response",
                          first[h] if again else None)))
    assert got == sorted(want)


def _archive(records, gzip):
    parts = []
    for i, body in enumerate(records):
        r = warc.record(i, "u", body, hashlib.sha1(body).hexdigest()) + b"\r\n\r\n"
        parts.append(warc._member(r) if gzip else r)
    return parts


@pytest.mark.parametrize("gzip", [True, False], ids=["members", "plain"])
@pytest.mark.parametrize("damage", ["flip", "cut", "insert", "drop_tail", "header"])
def test_salvage_recovers_later_records_and_logs_the_gap(gzip, damage):
    rnd = random.Random(9)
    bodies = [bytes(rnd.choices(range(256), k=400)) for _ in range(9)]
    parts = _archive(bodies, gzip)
    hurt = bytearray(parts[4])
    if damage == "flip":
        hurt[len(hurt) // 2] ^= 0xFF
    elif damage == "cut":
        del hurt[60:90]
    elif damage == "insert":
        hurt[50:50] = b"garbage\r\n\r\n"
    elif damage == "drop_tail":
        del hurt[-40:]
    else:
        hurt[:12] = b"\0" * 12
    data = b"".join([*parts[:4], bytes(hurt), *parts[5:]])
    out = list(warc.salvage("f", data))
    ids = [r[4] for k, r in out if k == "record"]
    assert ids == [0, 1, 2, 3, 5, 6, 7, 8]
    gaps = [r for k, r in out if k == "gap"]
    start = sum(map(len, parts[:4]))
    assert [(g[1], g[2]) for g in gaps] == [(start, len(hurt))] and gaps[0][3]
    covered = sum(r[2] for k, r in out)
    assert covered == len(data)  # every byte is in a record or in a gap


@pytest.mark.parametrize("level", [0, 6], ids=["stored", "deflated"])
@pytest.mark.parametrize("damage", ["payload", "flip", "tail"])
def test_salvage_inside_a_member_of_several_records(damage, level):
    rnd = random.Random(3)
    words = [bytes(rnd.choices(b"abcdefgh", k=6)) for _ in range(500)]
    plain = _archive([b" ".join(rnd.choices(words, k=2000)) for _ in range(30)], False)
    if damage == "payload":
        at = plain[12].index(b"\r\n\r\n") + 300
        plain[12] = plain[12][:at] + b"#" + plain[12][at + 1:]

    def member(data):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        return z.compress(data) + z.flush()

    one, after = bytearray(member(b"".join(plain))), member(_archive([b"x"], False)[0].replace(b":page:0", b":page:99"))
    if damage == "flip":
        one[len(one) // 2] ^= 0xFF
    if damage == "tail":
        del one[len(one) // 2:]
    out = list(warc.salvage("f", bytes(one) + after))
    ids = [r[4] for k, r in out if k == "record"]
    gaps = [r for k, r in out if k == "gap"]
    assert len(ids) == len(set(ids)) and ids[-1] == 99 and gaps
    if damage == "payload":
        assert ids == [*range(12), *range(13, 30), 99]
        assert [(g[1], g[2]) for g in gaps] == [(0, len(one))]
        assert f"bytes {sum(map(len, plain[:12]))} to {sum(map(len, plain[:13]))}" in gaps[0][3]
    else:
        assert ids[:12] == list(range(12))  # what lies before the damage
        assert any(g[1] == 0 for g in gaps)


def test_salvage_of_nothing_and_rubbish():
    assert list(warc.salvage("f", b"")) == []
    assert [k for k, _ in warc.salvage("f", b"no archive at all")] == ["gap"]
    mixed = b"".join(_archive([b"a", b"b"], True) + [b"??"] + _archive([b"c"], False))
    assert [k for k, _ in warc.salvage("f", mixed)] == ["record", "record", "gap", "record"]


def test_warc_empty_table(spark):
    path = scratch(spark)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(warc.mark_revisits(none), path)
    assert warc.resolve(warc.read_records(spark, path)).count() == 0


# ---- nearest neighbours

def _neighbours(df, k=20, **kw):
    out = {}
    for r in mih.nearest(df, F.col("vec_id") % 20 == 0, k=k, **kw).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def _brute(ids, x, q, k=20):
    s = (x * x[q]).sum(axis=1)
    best = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
    return [(ids[i], s[i]) for i in best]


@pytest.mark.parametrize("shape", ["sphere", "norms", "narrow"])
def test_recall_and_exact_scores(spark, shape):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 8 if shape == "narrow" else 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if shape == "norms":
        x *= rng.uniform(0.2, 2.0, size=(len(x), 1))
    ids = np.arange(len(x)) * 2
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = _neighbours(df)
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        want = _brute(ids, x, q)
        mine = got[ids[q]]
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert all(s == pytest.approx(float(x[v // 2] @ x[q]), abs=1e-12) for _, v, s in mine)
        assert [(-s, v) for _, v, s in mine] == sorted((-s, v) for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & {v for v, _ in want})
    assert hits / (20 * len(got)) >= 0.9


def test_every_code_within_the_radius_is_retrieved():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    asked = codes[:50] ^ (np.uint64(1) << rng.integers(0, 64, 50, dtype=np.uint64))
    for radius in (0, 3, 8, 19, 28, 30, 64):
        want = np.bitwise_count(asked[:, None] ^ codes[None, :]) <= radius
        assert (mih.within(codes, asked, radius) == want).all()


def test_short_queries_are_widened_and_odd_vectors_left_out(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(60)]
    bad = [(60, None), (61, [0.0] * 16), (62, [float("nan")] * 16), (63, [float("inf")] + [1.0] * 15),
           (64, [None] + [1.0] * 15), (65, [1.0, 2.0]), (None, rows[0][1]), (80, []), rows[3], rows[20]]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("query", F.lit(1))
    got = _neighbours(df, radius=0)  # nothing but equal codes at first
    assert set(got) == {0, 20, 40}
    x = np.array([v for _, v in rows])
    for q, mine in got.items():  # 20 each, as near as the radius they needed, with exact scores
        assert len({v for _, v, _ in mine} - {q}) == 20 and all(v < 60 for _, v, _ in mine)
        assert all(s == pytest.approx(float(x[v] @ x[q])) for _, v, s in mine)
    whole = _neighbours(df, radius=64)  # every code is within the whole radius: exact
    for q, mine in whole.items():
        assert [(v, pytest.approx(s)) for _, v, s in mine] == [(v, pytest.approx(s)) for v, s in _brute(np.arange(60), x, q)]
    few = _neighbours(df.filter("vec_id < 6 OR vec_id = 61"))
    assert [v for _, v, _ in few[0]] and len(few[0]) == 5
    assert mih.nearest(df.filter("vec_id < 0"), F.lit(True)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(100)], "vec_id long, embedding array<double>")
    assert [v for _, v, _ in _neighbours(same, k=5)[0]] == [1, 2, 3, 4, 5]  # ties to the smaller id


# ---- urls

def test_cascade_is_exact_over_its_universe_in_any_shards(spark):
    keys = [f"host{i}.example/{i % 7}" for i in range(4000)]
    urls = spark.createDataFrame([(i, f"http://{k}") for i, k in enumerate(keys)], "page_id long, url string")
    blocked = spark.createDataFrame([(k,) for k in keys[::3]] + [("elsewhere/x",)] + [(None,)], "key string")
    for shard_keys in (10_000, 300):
        got = url_cascade.judge(with_clashes(urls), blocked, shard_keys=shard_keys)
        assert {r.page_id: r.verdict for r in got.collect()} == {
            i: "block" if i % 3 == 0 else "allow" for i in range(4000)}


def test_cascade_needs_several_levels_and_no_join(spark):
    from tillroll.llm.common import stored
    universe = stored(spark.range(20_000).select(F.col("id").cast("string").alias("key"),
                                                 (F.col("id") % 4 == 0).alias("listed")))
    cascade = url_cascade.build(universe)
    assert len(cascade.bits) >= 3 and cascade.bits[0] > cascade.bits[2]
    out = universe.withColumn("got", url_cascade.listed(cascade, F.col("key")))
    assert out.filter("got <> listed").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan


def plain_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):], re.S)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p) for h, p, _ in url_cascade.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None


def test_hosts_paths_and_rules(spark):
    urls = ["http://a.net/x", "http://example.net/en/1", "http://sub.EXAMPLE.net/en/", "http://example.net/en",
            "http://example.net", "http://net/", "http://notnet/", "https://x.org/fr/é?u=http://b.net/", "org", None, "",
            "http://example.com/de/#f", "http://badexample.com/de/", "ftp://x.org#/fr/", "://net/q", "a://b://net/",
            "http://example.com/de\n/x", "HTTP://É.NET/p", "http://org/fr/a/b?c"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "key string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_cascade.judge(df, none).collect()}
    assert got == {i: plain_rule(u) for i, u in enumerate(urls)}
    assert url_cascade.judge(df.filter("page_id < 0"), none).count() == 0


# ---- pipeline

def test_pipeline_stage_by_stage(spark):
    """Each stage against a plain version on its own input, from the stage before."""
    from test_pairs import plain_groups, whole_dedup
    from tillroll.llm import quality
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "SimHash near-dedup", "mixing sources", "byte-level BPE"]
    stages = dict(corpus_pipeline.STAGES)
    from tillroll.llm.common import stored

    kept = stored(stages["quality rules"](spark, docs, SF))
    good = {r.doc_id for r in quality.score(docs).filter("kept").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == good and 0 < len(good) < docs.count()

    lines = stored(stages["line dedup"](spark, kept, SF))
    rows = [((r.doc_id, hashlib.md5(r.text.encode()).hexdigest()), r.text) for r in kept.collect()]
    want = {k[0]: t for k, t in whole_dedup(rows).items()}
    got = {r.doc_id: r for r in lines.collect()}
    assert lines.columns == docs.columns
    assert {i: [x for x in r.text.split("\n") if x.split()] for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())

    one = stored(stages["SimHash near-dedup"](spark, lines, SF))
    groups = plain_groups([(r.doc_id, r.text) for r in lines.collect()])
    assert sorted(r.doc_id for r in one.collect()) == sorted({int(c) for _, _, c in groups})

    mix = stored(stages["mixing sources"](spark, one, SF))
    from tillroll.llm import mixing
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(one).collect()}
    from collections import Counter
    assert mix.columns == docs.columns
    assert Counter(r.doc_id for r in mix.collect()) == Counter({i: c for i, c in copies.items() if c})

    ids = stages["byte-level BPE"](spark, mix, SF)
    import public_tokenizers
    import tiktoken
    from tillroll.llm import bpe
    from tillroll.llm.queries import VOCABULARY
    lib = tiktoken.Encoding("all", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=bpe.read_ranks(public_tokenizers.path(VOCABULARY)))
    text = {r.doc_id: r.text for r in mix.collect()}
    rows = ids.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in mix.collect())
    assert all(np.frombuffer(r.ids, "<u4").tolist() == lib.encode_ordinary(text[r.doc_id]) for r in rows)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    path = str(tmp_path)
    empty(spark).write.parquet(f"{path}/documents.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null"
