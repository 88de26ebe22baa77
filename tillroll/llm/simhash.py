"""SimHash near-duplicates, found by vantage-point trees over Hamming distance.

1. Every text gets a 64-bit fingerprint of its word shingles; equal fingerprints
   are one node from here on (an aggregation, so copies are never paired).
2. A routing tree is built from a bounded sample of fingerprints: a node holds a
   vantage point and the median distance to it. Every fingerprint is stored in
   exactly one leaf (shard) and queries every shard that the triangle bound
   cannot rule out: the inner side if ``d <= radius + bits``, the outer side if
   ``d > radius - bits``. The sample decides the balance only, never the result.
   Shards asked by many are cut into blocks of bounded size (:func:`dealt`).
3. Inside a shard the same split goes on with vantage points of its own until
   the parts are small, where fingerprints are compared exactly. Links are
   reduced to stars as they appear, so a shard emits at most one link per
   fingerprint and no group is written out as pairs.
4. Connected components of the star links give the groups.

Defined results: a null or empty text has fingerprint zero, linked like any
other; a text of fewer words than the shingle is one shingle; rows with a null
id take part, the component id is the smallest id that is not null (null if
there is none); repeated rows each get a row; an empty table gives none; other
columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import fresh, small, stored
from tillroll.llm.components import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
SAMPLE = 16_384          # fingerprints that the routing tree is built from
SHARD_ROWS = 1 << 18     # stored fingerprints a shard aims at
BLOCK_ROWS = 1 << 20     # asking fingerprints that a task takes at once
MIN_DEPTH = 4            # 16 shards at least, for parallel work
LEAF = 48                # fingerprints of a part that are compared without further splits
PAIR_BUFFER = 1 << 20


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """64-bit SimHash of the ``n``-word shingles of a text (0 without words)."""
    found = (text or "").encode("utf-8", "replace").lower().split()  # A-Z; ASCII white space
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate(([0], ends[:-1]))
    k = max(1, len(found) - n + 1)
    last = ends[min(n, len(found)) - 1:] - 1
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, k, PAIR_BUFFER):  # bounded memory for very long texts
        upto = min(k, at + PAIR_BUFFER)
        h = np.array([digest(joined[a:b], SEED) for a, b in
                      zip(starts[at:upto].tolist(), last[at:upto].tolist())], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(sum(1 << j for j in np.flatnonzero(2 * counts > k).tolist()))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, hash, fp): text hash and fingerprint as signed longs, one row per row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], dtype="<u8")
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("hash"), pa.array(fp.view("<i8"))],
                ["doc_id", "hash", "fp"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                       F.xxhash64(F.col(f"`{text}`")).alias("hash"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, hash bigint, fp bigint")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


@dataclass(frozen=True)
class Split:
    """A routing node: vantage point, radius, and the sides (splits or shard numbers)."""

    point: np.uint64
    radius: int
    inner: object
    outer: object


def _choose(fps: np.ndarray, seed: int) -> tuple[np.uint64, int] | None:
    """The vantage point, of a few tried, whose distances to a sample spread most; None if none splits."""
    rng = np.random.default_rng(seed)
    some = fps[rng.integers(0, len(fps), 512)] if len(fps) > 512 else fps
    best = None
    for point in fps[rng.integers(0, len(fps), 6)]:
        d = distance(some, point)
        radius = int(np.median(d))
        if radius >= d.max():
            radius -= 1
        if radius >= d.min() and (best is None or d.std() > best[0]):
            best = (d.std(), point, radius)
    return None if best is None else (best[1], best[2])


def routing_tree(sample: np.ndarray, depth: int) -> tuple[object, int]:
    """(tree, number of shards) of depth ``depth`` at most."""
    shards = 0

    def grow(fps, left, seed):
        nonlocal shards
        chosen = _choose(fps, seed) if left and len(fps) > 1 else None
        if chosen is None:
            shards += 1
            return shards - 1
        point, radius = chosen
        near = distance(fps, point) <= radius
        return Split(point, radius, grow(fps[near], left - 1, 2 * seed),
                     grow(fps[~near], left - 1, 2 * seed + 1))

    return grow(sample, depth, 1), shards


def route(tree, fps: np.ndarray, bits: int):
    """Yield (shard, indexes, stored): all shards that each fingerprint queries; stored is
    true for those whose own shard it is."""
    todo = [(tree, np.arange(len(fps)), np.ones(len(fps), bool))]
    while todo:
        node, at, home = todo.pop()
        if not len(at):
            continue
        if not isinstance(node, Split):
            yield node, at, home
            continue
        d = distance(fps[at], node.point).astype(np.int64)
        inner, outer = d <= node.radius + bits, d > node.radius - bits
        todo.append((node.inner, at[inner], home[inner] & (d[inner] <= node.radius)))
        todo.append((node.outer, at[outer], home[outer] & (d[outer] > node.radius)))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between the same components, one per node: (node, smallest node)."""
    nodes, inv = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = inv[:len(a)], inv[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)  # roots too, so that whole trees move
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def shard_links(own: np.ndarray, query: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links of all (own, query) pairs at ``bits`` or fewer differing bits, found by a
    vantage-point tree over ``own``."""
    links, held = [], 0

    def found(a, b):
        nonlocal links, held
        links.append((a, b))
        held += len(a)
        if held > PAIR_BUFFER:
            links = [stars(*map(np.concatenate, zip(*links)))]
            held = len(links[0][0])

    todo, seed = [(own, query)], 0
    while todo:
        mine, ask = todo.pop()
        if not len(mine) or not len(ask):
            continue
        seed += 1
        chosen = _choose(mine, seed) if len(mine) > LEAF else None
        if chosen is None:
            step = max(1, PAIR_BUFFER // len(ask))
            for i in range(0, len(mine), step):
                part = mine[i:i + step]
                r, c = np.nonzero(distance(part[:, None], ask[None, :]) <= bits)
                other = part[r] != ask[c]
                if other.any():
                    found(part[r][other], ask[c][other])
            continue
        point, radius = chosen
        dm, da = distance(mine, point), distance(ask, point).astype(np.int64)
        near = dm <= radius
        todo.append((mine[near], ask[da <= radius + bits]))
        todo.append((mine[~near], ask[da > radius - bits]))
    if not links:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return stars(*map(np.concatenate, zip(*links)))


def _blocks_of(fps: np.ndarray, homes: int, asks: int) -> tuple[np.ndarray, np.ndarray]:
    """The home block and the asking block of every fingerprint, by two independent hashes."""
    mixed = fps * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(40)) % np.uint64(homes)).astype(np.int64), (
        (mixed >> np.uint64(8) & np.uint64(0xFFFFFFFF)) % np.uint64(asks)).astype(np.int64)


def _longs(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("fp").to_numpy(zero_copy_only=False).astype("<i8").view("<u8")


def dealt(distinct: DataFrame, bits: int = MAX_BITS, shard_rows: int = SHARD_ROWS,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(part, fp, home, asks): every fingerprint in the parts where it is stored or asks.

    A shard whose counted stored rows pass ``shard_rows`` or whose asking rows pass
    ``block_rows`` is a grid of parts: a stored row lies in one row of the grid, an asking
    row in one column, so that each pair of them meets in exactly one part.  A part holds about
    ``shard_rows + block_rows`` rows at most, however many fingerprints a shard is asked by.
    The counts are one row per shard.
    """
    n = distinct.count()
    share = min(1.0, 2.0 * SAMPLE / max(n, 1))
    sample = np.array([r[0] for r in distinct.select("fp").sample(share, seed=1).limit(SAMPLE).collect()],
                      dtype="<i8").view("<u8")
    depth = max(MIN_DEPTH, int(np.ceil(np.log2(max(n, 1) / shard_rows))))
    tree, shards = routing_tree(sample, depth) if len(sample) else (0, 1)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored_rows, asking = np.zeros(shards, np.int64), np.zeros(shards, np.int64)
        for b in batches:
            for shard, at, home in route(tree, _longs(b), bits):
                stored_rows[shard] += home.sum()
                asking[shard] += len(at)
        used = np.flatnonzero(asking)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(stored_rows[used]),
                                          pa.array(asking[used])], ["shard", "homes", "asks"])

    homes, asks = np.ones(shards, np.int64), np.ones(shards, np.int64)
    counts = distinct.select("fp").mapInArrow(tell, "shard int, homes bigint, asks bigint")
    for r in counts.groupBy("shard").agg(F.sum("homes").alias("h"), F.sum("asks").alias("q")).collect():
        homes[r.shard], asks[r.shard] = max(1, -(-r.h // shard_rows)), max(1, -(-r.q // block_rows))
    first = np.concatenate(([0], np.cumsum(homes * asks)))

    def rows(part: np.ndarray, fps: np.ndarray, home: np.ndarray, ask: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(fps.view("<i8")), pa.array(home), pa.array(np.full(len(fps), ask))],
            ["part", "fp", "home", "asks"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            everything = _longs(b)
            for shard, at, home in route(tree, everything, bits):
                fps, h, q = everything[at], int(homes[shard]), int(asks[shard])
                own, column = _blocks_of(fps, h, q)
                for i in range(h):
                    yield rows(first[shard] + i * q + column, fps, home & (own == i), True)
                for j in range(q):
                    elsewhere = home & (column != j)
                    if elsewhere.any():
                        yield rows(first[shard] + own[elsewhere] * q + j, fps[elsewhere],
                                   np.ones(elsewhere.sum(), bool), False)

    return distinct.select("fp").mapInArrow(deal, "part bigint, fp bigint, home boolean, asks boolean")


def fingerprint_links(distinct: DataFrame, bits: int = MAX_BITS, shard_rows: int = SHARD_ROWS,
                      block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): star links that join the same fingerprints as all pairs within ``bits`` bits.

    ``distinct`` is a stored table with every fingerprint once (``fp``).
    """
    def search(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view("<u8")
        home, ask = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("home", "asks"))
        a, b = shard_links(fps[home], fps[ask], bits)
        return pa.table({"a": pa.array(a.view("<i8"), pa.int64()), "b": pa.array(b.view("<i8"), pa.int64())})

    return dealt(distinct, bits, shard_rows, block_rows).groupBy("part").applyInArrow(
        search, "a bigint, b bigint")


def _grouped(docs, doc_id, text, shingle, bits):
    """(stored fingerprints, stored (fp, label, component_id) with every fingerprint once)."""
    prints = stored(fingerprints(docs, doc_id, text, shingle))
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(fingerprint_links(distinct, bits))
    labelled = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("label", "fp").alias("label"), "least")
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    return prints, stored(labelled.join(least, "label").select("fp", "label", "component_id"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
           bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of ``docs``."""
    prints, named = _grouped(docs, doc_id, text, shingle, bits)
    return prints.join(small(named.select("fp", "component_id")), "fp").select(
        "doc_id", "fp", "component_id")


def hex_fingerprint(fp) -> Column:
    """A fingerprint column as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
             bits: int = MAX_BITS) -> DataFrame:
    """One row of each group, with the columns of ``docs``.

    The row of the smallest id stays (null ids last); of several texts with that
    id the one with the smallest hash, and of repeated rows any one.
    """
    prints, named = _grouped(docs, doc_id, text, shingle, bits)
    rows = stored(prints.join(small(named.select("fp", "label")), "fp").groupBy(
        "label", "doc_id", "hash").agg(F.count(F.lit(1)).alias("n")))
    best = rows.groupBy("label").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("late"), "doc_id", "hash")).alias("best"))
    marked = rows.join(best, "label").withColumn("stays", (F.col("hash") == F.col("best.hash"))
                                                 & F.col("doc_id").eqNullSafe(F.col("best.doc_id")))
    gone = small(stored(marked.filter("not stays").select("doc_id", "hash"))).alias("g")
    twice = small(stored(marked.filter("stays and n > 1").select("doc_id", "hash"))).alias("g")

    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    id_, hash_ = fresh(docs, "id", "hash")
    d = docs.withColumns({id_: F.col(f"`{doc_id}`").cast("long"),
                          hash_: F.xxhash64(F.col(f"`{text}`"))}).alias("d")
    same = F.col(f"d.{id_}").eqNullSafe(F.col("g.doc_id")) & (F.col(f"d.{hash_}") == F.col("g.hash"))
    kept = d.join(gone, same, "left_anti")
    if twice.isEmpty():
        return kept.select(*columns)
    kept = kept.alias("d")
    return kept.join(twice, same, "left_anti").select(*columns).unionByName(
        kept.join(twice, same, "left_semi").dropDuplicates([id_, hash_]).select(
            *[F.col(f"`{c}`") for c in docs.columns]))
