"""Target-distribution importance resampling over hashed n-grams.

A document's features are its runs of 1 to ``max_n`` words, each hashed (CRC-32) into
one of ``buckets`` buckets. A bucket's gain says how much likelier the target texts
are to hold it than the raw documents; a document's weight is the mean gain of its
features, and the draw takes the highest sums of weight and Gumbel noise.

1. *One scan.* A document is normalised (words joined by one space) and its bytes are
   read once; the running CRC at the end of every word is stored with the words' lengths
   (8 bytes a word) in a table of the shared folder.
2. *Any n-gram from two prefixes.* With ``c(i)`` the CRC of the first ``i`` bytes,
   the CRC of the bytes ``i`` to ``j`` is ``c(j) xor shift(c(i), j - i)``: the shift by
   ``k`` zero bytes is linear over GF(2) and cancels what precedes the n-gram. Shifts are four
   table reads per length (below 64), or per power of two of the rest of a longer one.
3. Bucket counts are summed in the tasks and combined (one row per bucket); the gains
   (``buckets`` doubles, whatever the input) go back to the tasks that read the stored
   scan again for the weights. Long documents are split and hashed a block at a time.
4. The draw ranks (score, id) in range buckets; no task sees all documents.

Defined results: a null or empty text has no features and weight 0; a null id is the
empty string in the noise and comes last among ties; repeated rows are documents of
their own, and equal ids with equal scores are ranked in any order among
themselves; an empty table gives an empty table; other columns take no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import scratch, stored
from tillroll.plans.ranking import RankSpec, add_rankings

#: Bytes of a text that are split into words at once.
SPLIT_BYTES = 1 << 20
#: Words whose n-grams are hashed at once, and words of a batch of stored rows.
BLOCK_WORDS = 1 << 18
BATCH_WORDS = 1 << 20
SHORT = 64

_WORD_BYTES = bytes([b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80
                     else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)])


def shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """Byte tables of the shift by k zero bytes: for k below ``SHORT``, and for ``SHORT << i``.

    ``table[k, j, v]`` is ``v << 8 * j`` after k zero bytes have been fed to the register.
    """
    step = np.array([zlib.crc32(bytes([v]), 0xFFFFFFFF) ^ 0xFFFFFFFF for v in range(256)], np.uint32)
    tables = [np.array([[v << 8 * j for v in range(256)] for j in range(4)], np.uint32)]
    for _ in range(SHORT):
        t = tables[-1]
        tables.append(step[t & 0xFF] ^ (t >> np.uint32(8)))
    powers = [tables.pop()]
    for _ in range(24):
        powers.append(_apply(powers[-1], powers[-1]))
    return np.stack(tables), np.stack(powers)


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = table[0][x & 0xFF]
    for j in range(1, 4):
        out = out ^ table[j][x >> np.uint32(8 * j) & 0xFF]
    return out


def shift(x: np.ndarray, k: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """``x`` after ``k`` zero bytes, element by element."""
    short, powers = tables
    low = k & (SHORT - 1)
    out = short[low, 0, x & 0xFF]
    for j in range(1, 4):
        out ^= short[low, j, x >> np.uint32(8 * j) & 0xFF]
    rest, i = k >> 6, 0
    while rest.any():
        at = np.flatnonzero(rest & 1)
        out[at] = _apply(powers[i], out[at])
        rest, i = rest >> 1, i + 1
    return out


def normal_words(text: str) -> Iterator[list[bytes]]:
    """Lower-cased words of a text (runs of digits, ASCII letters and other than ASCII), in lists."""
    raw, start = text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES), 0
    while start < len(raw):
        stop = raw.find(b" ", start + SPLIT_BYTES)
        stop = len(raw) if stop < 0 else stop
        yield raw[start:stop].split()
        start = stop


def running_crcs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """CRC of the normalised text up to the end of every word, and the words' lengths (uint32)."""
    crc32, ends, lengths, c = zlib.crc32, [], [], 0
    for found in normal_words(text):
        out = []
        for w in found:
            c = crc32(w, c)
            out.append(c)
            c = crc32(b" ", c)
        ends.append(np.array(out, np.uint32))
        lengths.append(np.fromiter(map(len, found), np.uint32, len(found)))
    if not ends:
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    return np.concatenate(ends), np.concatenate(lengths)


def scan(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """``keep`` with ``n_words`` and the words' running CRCs and lengths (``ends``, ``lengths``)."""
    rows = docs.select(*keep, F.col(f"`{text}`").alias("t"))
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done, size, found = 0, 0, []
            for i, t in enumerate(b.column("t")):
                found.append(running_crcs(t.as_py() or ""))
                size += len(found[-1][0])
                if size >= BATCH_WORDS:
                    yield made(b, done, found)
                    done, size, found = i + 1, 0, []
            yield made(b, done, found)

    def made(b, start, found):
        return pa.RecordBatch.from_arrays(
            [*[b.column(n).slice(start, len(found)) for n in names],
             pa.array([len(e) for e, _ in found], pa.int64()),
             *[pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (0, 1)]],
            [*names, "n_words", "ends", "lengths"])

    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}n_words long, ends binary, lengths binary")


def grams(ends: np.ndarray, lengths: np.ndarray, bounds: np.ndarray, max_n: int,
          tables) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the first word, CRC-32) of all n-grams of consecutive documents, in blocks.

    ``bounds``: index of every document's first word, and behind the last one.
    """
    total, step = len(ends), tables[0][1, 0]
    first = np.zeros(total + 1, bool)
    first[bounds] = True
    last = np.repeat(bounds[1:], np.diff(bounds))
    for a in range(0, total, BLOCK_WORDS):
        z = min(a + BLOCK_WORDS, total)
        over = min(z + max_n - 1, total)
        end, size = ends[a:over], lengths[a:over].astype(np.int64)
        before = ends[a - 1:over - 1] if a else np.concatenate([end[:1], end[:-1]])
        # one more byte, the separator; the first word of a document has nothing before it
        start = np.where(first[a:over], np.uint32(0), start_crc(before, step))
        at, span = np.arange(z - a), size.copy()
        for n in range(1, max_n + 1):
            if n > 1:
                at = at[a + at + n <= last[a + at]]
                span = span[:len(size) - n + 1] + 1 + size[n - 1:]
            if not len(at):
                break
            yield a + at, end[at + n - 1] ^ shift(start[at], span[at], tables)


def start_crc(before: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Running CRC behind the separator that follows the running CRC ``before``."""
    register = before ^ np.uint32(0xFFFFFFFF)
    return step[(register ^ np.uint32(0x20)) & 0xFF] ^ (register >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)


def _held(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running CRCs, lengths and document bounds of a batch of stored rows."""
    ends, lengths = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32)
                     for c in ("ends", "lengths")]
    return ends, lengths, np.concatenate([[0], np.cumsum(b.column("n_words").to_numpy())])


def bucket_counts(scanned: DataFrame, max_n: int, buckets: int) -> DataFrame:
    """``bucket, n`` of all n-grams of a scan; tasks send one row per bucket that they met."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held = shift_tables(), np.zeros(buckets, np.int64)
        for b in batches:
            for _, crc in grams(*_held(b), max_n, tables):
                held += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        met = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(held[met])], ["bucket", "n"])

    part = scanned.select("n_words", "ends", "lengths").mapInArrow(run, "bucket long, n long")
    return part.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Floored 1000-fold log ratio of the smoothed target and raw shares, per bucket."""
    s_all, t_all = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log(
        float(target.get(b, 0) + 1) * s_all / (float(raw.get(b, 0) + 1) * t_all)))
        for b in range(buckets)], np.int64)


def weights(scanned: DataFrame, keep: list[str], gain: np.ndarray, max_n: int) -> DataFrame:
    """``keep`` with ``n_words, n_features, weight`` of every row of a scan."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shift_tables()
        for b in batches:
            ends, lengths, bounds = _held(b)
            total = np.zeros(b.num_rows, np.int64)
            owner = np.repeat(np.arange(b.num_rows), np.diff(bounds))
            for at, crc in grams(ends, lengths, bounds, max_n, tables):
                lo, hi = owner[at[0]], owner[at[-1]] + 1
                # sums of integers below 2 ** 53 are exact in doubles
                total[lo:hi] += np.bincount(owner[at] - lo, gain[crc % np.uint32(len(gain))],
                                            hi - lo).astype(np.int64)
            n_words = np.diff(bounds)
            n = sum(np.maximum(n_words - k, 0) for k in range(max_n))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], pa.array(n_words), pa.array(n),
                 pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))],
                [*keep, "n_words", "n_features", "weight"])

    rows = scanned.select(*keep, "n_words", "ends", "lengths")
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:len(keep)])
    return rows.mapInArrow(run, f"{kept}n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: str) -> Column:
    """Floored 1000-fold Gumbel noise from the first 32 bits of sha256(``seed:id``)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text",
             target_text: str = "text", max_n: int = 2, buckets: int = 10_000, percent: int = 25,
             min_words: int = 20, seed: str = "7") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row; ``rank`` is null if not drawn."""
    scanned = stored(scan(docs, text, [F.col(f"`{doc_id}`").alias("id")]), scratch(docs.sparkSession))
    raw, aim = [{r["bucket"]: r["n"] for r in bucket_counts(x, max_n, buckets).collect()}
                for x in (scanned, scan(target, target_text, []))]  # one row per bucket
    scored = stored(weights(scanned, ["id"], gains(raw, aim, buckets), max_n).withColumn(
        "score", F.col("weight") + gumbel(F.col("id"), seed)))
    fit = scored.filter(F.col("n_words") >= min_words)
    drawn = fit.count() * percent // 100
    ranked = add_rankings(fit, [RankSpec("rank", "row_number", (("score", False),), ("id",))])
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    out = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(rest)
    return out.withColumnRenamed("id", doc_id)
