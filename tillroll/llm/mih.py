"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

1. Vectors get one more component that makes all norms equal, which turns the
   largest inner product into the smallest angle. A rotation is learned on a
   bounded sample (principal axes, then iterative quantisation); the signs of
   the rotated vector are its 64-bit code.
2. The code is cut into 8 substrings, each indexed by value. Two codes within
   ``r`` bits agree within ``r // 8`` bits in some substring (within one bit
   less in those after the first ``r % 8 + 1``), so probing all substring values
   that near retrieves every code within the radius; the full codes are then
   compared, and the vectors within the radius reranked by inner product.
3. The radius is calibrated on the sample: the smallest that holds the stated
   share of the neighbours that are as near, by rank, as the k-th of all rows.
   Queries that find fewer than k are searched again with a larger radius, up
   to the whole code, so none comes back short.

Every row is indexed. Rows are dealt by id into slices and queries into blocks
of bounded size; a task holds one slice, its 8 indexes and one block. Equal
vectors are spread over all slices, so no bucket grows with a common vector.

Defined results: vectors that are null, zero, of another length than most, or
with null or non-finite components take no part, nor do rows with a null id;
rows of equal id are one vector, the smallest; with fewer than k other vectors
all are returned; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import fresh, scratch, stored

BITS = 64
PARTS = 8
SAMPLE = 16_384
PROBE_QUERIES = 512      # sample rows the radius is calibrated with
TARGET_RECALL = 0.97     # share of sample neighbours within the radius
SLICE_ROWS = 32_768
BLOCK_QUERIES = 65_536
STEP_QUERIES = 128       # queries handled at once within a task
WIDER = 6
ITERATIONS = 40

_BALLS = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))


def valid(embedding: Column, dim: int) -> Column:
    """Whether an array is a vector that takes part."""
    fine = F.forall(embedding, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(embedding) == dim) & fine & F.exists(embedding, lambda x: x != 0),
                      F.lit(False))


def _squares(embedding: Column) -> Column:
    return F.aggregate(embedding, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


@dataclass(frozen=True)
class Coder:
    """Rotation and centre of the codes; ``norm`` is the largest norm of a vector."""

    norm: float
    centre: np.ndarray
    axes: np.ndarray  # (dim + 1, BITS)

    def codes(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Codes of the rows of ``x`` as unsigned longs."""
        own = np.sqrt((x * x).sum(axis=1))
        if query:
            full = np.column_stack((x / own[:, None], np.zeros(len(x))))
        else:
            rest = np.sqrt(np.maximum(self.norm ** 2 - own ** 2, 0.0))
            full = np.column_stack((x, rest)) / self.norm
        signs = (full - self.centre) @ self.axes > 0
        return np.packbits(signs, axis=1).view(">u8").ravel().astype("<u8")


def learn(sample: np.ndarray, norm: float, seed: int = 7) -> Coder:
    """Principal axes of the sample, rotated so that signs lose little (several rotations
    if the vectors have fewer than ``BITS`` components)."""
    own = (sample * sample).sum(axis=1)
    full = np.column_stack((sample, np.sqrt(np.maximum(norm ** 2 - own, 0.0)))) / norm
    centre = full.mean(axis=0)
    flat = full - centre
    _, _, vt = np.linalg.svd(flat, full_matrices=False)
    rng, axes = np.random.default_rng(seed), []
    width = min(BITS, len(vt))
    while sum(a.shape[1] for a in axes) < BITS:
        base = vt[:width].T
        low = flat @ base
        rot = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(ITERATIONS):
            u, _, v = np.linalg.svd(np.sign(low @ rot).T @ low)
            rot = (u @ v).T
        axes.append(base @ rot)
    return Coder(norm, centre, np.column_stack(axes)[:, :BITS])


def calibrate(coder: Coder, sample: np.ndarray, k: int, rows: int) -> int:
    """The radius for the k nearest of ``rows`` vectors, from the sample's own neighbours."""
    k = max(1, min(len(sample) - 1, round(k * len(sample) / max(rows, 1))))
    asked = np.arange(0, len(sample), max(1, len(sample) // PROBE_QUERIES))
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    codes, wanted = coder.codes(sample, False), coder.codes(sample[asked], True)
    d = np.bitwise_count(codes[near] ^ wanted[:, None])
    return int(np.quantile(d, TARGET_RECALL, method="higher"))


def _parts(codes: np.ndarray) -> np.ndarray:
    return codes.astype("<u8").view(np.uint8).reshape(-1, PARTS)


def within(codes: np.ndarray, asked: np.ndarray, radius: int) -> np.ndarray:
    """Boolean (asked, codes): all pairs within the radius, found by substring probes."""
    hits = np.zeros((len(asked), len(codes)), bool)
    mine, theirs = _parts(codes), _parts(asked)
    for t in range(PARTS):
        near = radius // PARTS - (t > radius % PARTS)
        if near < 0:
            continue
        order = np.argsort(mine[:, t], kind="stable")  # the index of this substring
        starts = np.searchsorted(mine[order, t], np.arange(257))
        for value in np.unique(theirs[:, t]):
            probes = np.flatnonzero(_BALLS[value] <= near)
            found = np.concatenate([order[starts[p]:starts[p + 1]] for p in probes])
            q = np.flatnonzero(theirs[:, t] == value)
            hits[q[:, None], found[None, :]] |= np.bitwise_count(
                asked[q][:, None] ^ codes[found][None, :]) <= radius
    return hits


def search(index: DataFrame, queries: DataFrame, coder: Coder, k: int, radius: int,
           slices: int, blocks: int) -> DataFrame:
    """(query_id, vec_id, score): the best k of every slice, for each query."""
    rows = index.select(F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"),
                        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                        F.lit(False).alias("asked"), "id", "x")
    ask = queries.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
                         F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int").alias("block"),
                         F.lit(True).alias("asked"), "id", "x")

    def vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Ids ascending with their vectors; of equal ids the smallest vector."""
        ids = table.column("id").to_numpy()
        if not len(ids):  # a slice without rows, or a block without queries
            return ids, np.empty((0, 0))
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x = x.astype(np.float64).reshape(len(ids), -1)
        if len(np.unique(ids)) < len(ids):
            order = np.lexsort((*x.T[::-1], ids))
            order = order[np.concatenate(([True], np.diff(ids[order]) != 0))]
        else:
            order = np.argsort(ids)
        return ids[order], x[order]

    def run(table: pa.Table) -> pa.Table:
        flags = table.column("asked")
        ids, x = vectors(table.filter(pa.compute.invert(flags)))
        q_ids, q = vectors(table.filter(flags))
        out = ([], [], [])
        if len(ids) and len(q_ids):
            codes, asked = coder.codes(x, False), coder.codes(q, True)
            for a in range(0, len(q_ids), STEP_QUERIES):
                hits = within(codes, asked[a:a + STEP_QUERIES], radius)
                for i, row in enumerate(hits, a):
                    found = np.flatnonzero(row & (ids != q_ids[i]))
                    score = (x[found] * q[i]).sum(axis=1)
                    if len(found) > 4 * k:  # the k best and all ties with the last of them
                        least = np.partition(score, len(score) - k)[len(score) - k]
                        found, score = found[score >= least], score[score >= least]
                    best = np.lexsort((ids[found], -score))[:k]
                    out[0].append(np.full(len(best), q_ids[i]))
                    out[1].append(ids[found][best])
                    out[2].append(score[best])
        cols = [np.concatenate(c) if c else np.empty(0) for c in out]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)),
                         "vec_id": pa.array(cols[1].astype(np.int64)),
                         "score": pa.array(cols[2].astype(np.float64))})

    return rows.unionByName(ask).groupBy("slice", "block").applyInArrow(
        run, "query_id bigint, vec_id bigint, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id",
            embedding: str = "embedding", radius: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k best other rows found."""
    spark = vectors.sparkSession
    base = scratch(spark)
    e = F.col(f"`{embedding}`")
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    common = vectors.filter(e.isNotNull()).groupBy(F.size(e).alias("n")).count().orderBy(
        F.desc("count"), "n").first()
    if common is None or common.n == 0:
        return spark.createDataFrame([], schema)
    (flag,) = fresh(vectors, "query")
    rows = vectors.withColumn(flag, F.coalesce(is_query, F.lit(False))).filter(
        valid(e, common.n) & F.col(f"`{vec_id}`").isNotNull()).select(
        F.col(f"`{vec_id}`").cast("long").alias("id"), e.alias("x"), F.col(flag).alias("query"))
    rows = stored(rows, f"{base}/rows")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("query").cast("long")).alias("q"),
                     F.max(_squares(F.col("x"))).alias("square")).first()
    if not facts.q:
        return spark.createDataFrame([], schema)
    sample = np.array([r.x for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()], np.float64)
    coder = learn(sample, float(np.sqrt(facts.square)))
    if radius is None:
        radius = calibrate(coder, sample, k, facts.n) if len(sample) > 1 else BITS

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    queries, index, parts = rows.filter("query").select("id", "x"), rows.select("id", "x"), None
    ids = rows.select("id").distinct().count()
    for turn in range(BITS):
        asked = queries.count() if turn else facts.q
        found = search(index, queries, coder, k, radius, max(8, -(-facts.n // SLICE_ROWS)),
                       max(1, -(-asked // BLOCK_QUERIES)))
        ranked = stored(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k),
                        f"{base}/found-{turn}")
        full = ranked.filter(F.col("rank") == min(k, ids - 1)).select(F.col("query_id").alias("id"))
        part = ranked if radius >= BITS else ranked.join(
            full.withColumnRenamed("id", "query_id"), "query_id", "left_semi")
        parts = part if parts is None else parts.unionByName(part)
        if radius >= BITS:
            break
        queries = stored(queries.join(full, "id", "left_anti"), f"{base}/short-{turn}")
        if queries.isEmpty():
            break
        radius = min(BITS, radius + WIDER)
    return parts.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
