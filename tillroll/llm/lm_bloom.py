"""Language-model scoring with a log-frequency Bloom filter.

1. The texts are cut into blocks of about ``block_words`` words, stored as packed
   word numbers, so that texts are tokenised once.
2. Every block sends its distinct n-grams (orders 1 to ``order``, with a start
   context and an end token per text), as 64-bit hashes with their counts in the
   block's training texts, to the filter's shards. A shard is a range of hashes;
   the number of shards follows the number of blocks, whatever the session's
   shuffle partitions, so that a shard is asked about ``SHARD_NGRAMS`` n-grams.
3. A shard's task sums the counts and fills its filter. A count ``c`` is kept as
   its quantum ``q = 1 + floor(log2 c)``: the filter holds the pairs (n-gram, 1)
   ... (n-gram, q), and a lookup probes 1, 2, ... until a pair is absent, so a
   false positive can only raise a count by one quantum, with geometrically
   falling odds. Every n-gram of the training texts is held, however rare and
   however large the corpus. The task probes the blocks' n-grams and sends the
   quanta back, for words also the exact counts of the base score.
4. A block's texts are scored where its quanta meet its words. No task or driver
   holds more than one shard or one block.

Scores: ``P(w | h) = max(c(h w) - D, 0) / c(h) + (1 - L) P(w | h')``, ``h'`` one
word shorter, down to ``(c(w) + 1) / (N + V + 1)``; all ``c`` by probes. Per order
``D = (n1 + 1) / (n1 + 2 n2 + 2)``, ``n1`` and ``n2`` the numbers of n-grams seen
once and twice, and ``L`` is the share of the corpus's n-grams that remains after
this discount; an unseen history passes all its mass to the shorter one. The base
score takes every word's exact count.

Defined results: a null or empty text is one end token; ids may be null or
repeated; an id's text for the split is empty for a null id; an empty table, or
one without training rows, gives N = V = 0 and scores without counts; other
columns do not matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.bpe import pack, unpack
from tillroll.llm.common import stored

ORDER = 2
BITS_PER_ENTRY = 10
PROBES = 6
SEGMENT_BITS = 1 << 19
BLOCK_WORDS = 1_000_000  # words of a block
BLOCK_DOCS = 100_000
SHARD_NGRAMS = 4_000_000  # n-grams, repeats over blocks included, that a shard's task is asked about

END = np.uint64(xxhash.xxh64_intdigest(b"\n"))          # no word holds white space
START = np.uint64(xxhash.xxh64_intdigest(b"\n\n"))
_ODD = np.uint64(0x9E3779B97F4A7C15)
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower().split()


class Vocabulary:
    """Numbers for words, in the order in which a task meets them; 0 is the end of a text."""

    def __init__(self):
        self.numbers = defaultdict(count().__next__)
        self.numbers[b"\n"]
        self.hashes = np.array([END])

    def __call__(self, found: list[bytes]) -> np.ndarray:
        out = np.zeros(len(found) + 1, np.int64)
        out[:-1] = np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found))
        return out

    def update(self) -> np.ndarray:
        """Hash the words met since the last update; returns their hashes."""
        new = [xxhash.xxh64_intdigest(w) for w in islice(self.numbers, len(self.hashes), None)]
        new = np.array(new, np.uint64)
        self.hashes = np.concatenate((self.hashes, new))
        return new


def ngrams(words: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """Per order 1 to ``order``, the hash of the n-gram that ends at each word, for the word
    hashes of texts laid end to end; ``starts``: where the texts begin."""
    out = [words]
    for n in range(2, order + 1):
        before = np.empty_like(words)
        before[1:] = out[-1][:-1]
        before[starts] = mix(np.array([int(START) * n & MASK], np.uint64))
        out.append(mix(before * _ODD + words))
    return out


@dataclass(frozen=True)
class Totals:
    """Totals of the training corpus."""

    total: int     # tokens
    distinct: int  # different tokens
    texts: int
    discount: tuple  # per order from 2: D
    shares: tuple    # per order from 2: L


@dataclass(frozen=True)
class Filter:
    """A shard's filter: its segments as one array of bytes."""

    bits: np.ndarray  # (segments, SEGMENT_BITS / 8)

    def holds(self, grams: np.ndarray, quantum: int) -> np.ndarray:
        """Whether (n-gram, quantum) is present, per n-gram."""
        flat = self.bits.reshape(-1)
        base = (grams % np.uint64(len(self.bits))).astype(np.int64) * (SEGMENT_BITS // 8)
        a, b = _probe_hashes(grams, quantum)
        at = np.arange(len(grams))
        for _ in range(PROBES):
            p = a & np.uint64(SEGMENT_BITS - 1)
            byte = flat[base + (p >> np.uint64(3)).astype(np.int64)]
            hit = (byte >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
            at, base, a, b = at[hit], base[hit], a[hit] + b[hit], b[hit]
        out = np.zeros(len(grams), bool)
        out[at] = True
        return out

    def quanta(self, grams: np.ndarray) -> np.ndarray:
        """Quanta of n-grams, 0 if absent."""
        quanta, at, q = np.zeros(len(grams), np.uint8), np.arange(len(grams)), 0
        while len(at) and q < 62:
            q += 1
            at = at[self.holds(grams[at], q)]
            quanta[at] = q
        return quanta

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """Expected counts of n-grams."""
        return expected(self.quanta(grams))


def expected(quanta: np.ndarray) -> np.ndarray:
    """The middle of each quantum's range of counts, 0 for 0."""
    return np.where(quanta > 0, 0.75 * 2.0 ** quanta.astype(np.float64) - 0.5, 0.0)


def _probe_hashes(grams: np.ndarray, quantum) -> tuple[np.ndarray, np.ndarray]:
    seeded = mix(grams ^ np.uint64(quantum * int(_ODD) & MASK))
    return seeded, mix(seeded) | np.uint64(1)


def discounted(n1: int, n2: int) -> float:
    """Absolute discount, from the numbers of n-grams seen once and twice; within (0, 1)."""
    return (n1 + 1) / (n1 + 2 * n2 + 2)


def set_bits(grams: np.ndarray, quanta: np.ndarray, segment: np.ndarray, segments: int) -> np.ndarray:
    """Bytes (segments, SEGMENT_BITS / 8) that hold the n-grams with all their quanta."""
    flags = np.zeros(segments * SEGMENT_BITS, bool)
    for q in range(1, int(quanta.max(initial=0)) + 1):
        own = quanta >= q
        a, b = _probe_hashes(grams[own], q)
        base = segment[own].astype(np.int64) * SEGMENT_BITS
        for i in range(PROBES):
            flags[base + ((a + np.uint64(i) * b) & np.uint64(SEGMENT_BITS - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").reshape(segments, -1)


def interpolated(f: Totals, counts: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """log10 P of every token, from the counts of the n-grams that end there, per order."""
    p = (counts[0] + 1.0) / (f.total + f.distinct + 1.0)
    for shorter, seen, discount, share in zip(counts, counts[1:], f.discount, f.shares):
        before = np.empty_like(shorter)
        before[1:] = shorter[:-1]
        before[starts] = f.texts  # the start precedes the first word of every training text
        rest = np.maximum(np.minimum(seen, before) - discount, 0.0)
        p = np.where(before > 0, rest / np.maximum(before, 1.0) + (1.0 - share) * p, p)
    return np.log10(np.minimum(p, 1.0))


def _offsets(lens: np.ndarray) -> np.ndarray:
    return np.cumsum(lens) - lens


def encode_blocks(rows: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Blocks of the texts of (doc_id, held_out, text): ids, lengths, word hashes and numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block():
            words.update()
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(id_type)), pa.array([out], pa.list_(pa.bool_())),
                 pa.array([pack(np.array([len(t) for t in held], np.int64))]),
                 pa.array([words.hashes.tobytes()], pa.binary()),
                 pa.array([pack(np.concatenate(held))], pa.binary())],
                ["ids", "held_out", "lens", "words", "tokens"])

        words, held, ids, out, size, id_type = Vocabulary(), [], [], [], 0, None
        for b in batches:
            id_type = b.column("doc_id").type
            for i, o, t in zip(b.column("doc_id"), b.column("held_out"), b.column("text")):
                ids.append(i.as_py())
                out.append(o.as_py())
                held.append(words(tokens(t.as_py())))
                size += len(held[-1])
                if size >= block_words or len(ids) >= BLOCK_DOCS:
                    yield block()
                    words, held, ids, out, size = Vocabulary(), [], [], [], 0
        if ids:
            yield block()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, (f"ids array<{kind}>, held_out array<boolean>, lens binary, "
                                 "words binary, tokens binary"))


def _unpack_block(row: dict, order: int):
    """(lengths, n-grams per order, starts) of a block."""
    lens = unpack(row["lens"]).astype(np.int64)
    flat = np.frombuffer(row["words"], "<u8")[unpack(row["tokens"])]
    return lens, ngrams(flat, _offsets(lens), order), _offsets(lens)


ASKED = "block bigint, n int, shard int, h binary, c binary"
ANSWERS = ("block bigint, n int, shard int, q binary, c binary, k bigint, words bigint, "
           "n1 bigint, n2 bigint, texts bigint")
_ASKED = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("shard", pa.int32()),
                    ("h", pa.binary()), ("c", pa.binary())])
_ANSWERS = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("shard", pa.int32()), ("q", pa.binary()),
                      ("c", pa.binary()), *[(x, pa.int64()) for x in ("k", "words", "n1", "n2", "texts")]])


def _ask(blocks: DataFrame, order: int, shards: int) -> DataFrame:
    """Per block, order and shard: the distinct n-grams in order, and their counts in training texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([-(-(k << 64) // shards) for k in range(1, shards)], np.uint64)
        for whole in batches:
            for at in range(whole.num_rows):
                row = whole.slice(at, 1).to_pylist()[0]
                lens, grams, _ = _unpack_block(row, order)
                learnt = np.repeat(~np.array(row["held_out"], bool), lens)
                for n, g in enumerate(grams, 1):
                    h, place = np.unique(g, return_inverse=True)
                    c = np.bincount(place[learnt], minlength=len(h))
                    cuts = [0, *np.searchsorted(h, edges).tolist(), len(h)]
                    out = [(row["block"], n, k, h[a:z].tobytes(), pack(c[a:z]))
                           for k, (a, z) in enumerate(zip(cuts, cuts[1:])) if a < z]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*out), _ASKED.types)], schema=_ASKED)

    return blocks.mapInArrow(run, ASKED)


def _answer(table: pa.Table) -> pa.Table:
    """A shard's filter, filled and probed: rows with quanta per block, and a row of statistics per order."""
    orders, shard = table.column("n").to_numpy(), table.column("shard")[0].as_py()
    found = {}
    for n in np.unique(orders).tolist():
        own = table.filter(pa.array(orders == n))
        parts = [np.frombuffer(x.as_py(), "<u8") for x in own.column("h")]
        h, place = np.unique(np.concatenate(parts), return_inverse=True)
        c = np.bincount(place, np.concatenate([unpack(x.as_py()) for x in own.column("c")]),
                        len(h)).astype(np.int64)
        found[n] = own.column("block").to_pylist(), [len(x) for x in parts], place, h, c
    grams = np.concatenate([h[c > 0] for *_, h, c in found.values()])
    quanta = np.concatenate([np.frexp(c[c > 0].astype(np.float64))[1] for *_, c in found.values()])
    segments = max(1, -(-int(quanta.sum()) * BITS_PER_ENTRY // SEGMENT_BITS))
    f = Filter(set_bits(grams, quanta, grams % np.uint64(segments), segments))
    out = []
    for n, (blocks, lens, place, h, c) in found.items():
        q = f.quanta(h)[place]
        exact = c[place] if n == 1 else None
        for block, a, m in zip(blocks, _offsets(np.array(lens)).tolist(), lens):
            out.append((block, n, shard, pack(q[a:a + m]), None if exact is None else exact[a:a + m].tobytes(),
                        *[None] * 5))
        out.append((None, n, shard, None, None, int((c > 0).sum()), int(c.sum()), int((c == 1).sum()),
                    int((c == 2).sum()), int(c[h == END].sum()) if n == 1 else 0))
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out), _ANSWERS.types)], schema=_ANSWERS)


def _totals(answers: DataFrame) -> Totals:
    seen = {r.n: r for r in answers.filter("block IS NULL").groupBy("n").agg(
        *[F.sum(x).alias(x) for x in ("k", "words", "n1", "n2", "texts")]).collect()}
    if 1 not in seen:
        return Totals(0, 0, 0, (), ())
    longer = [seen[n] for n in sorted(seen)[1:]]
    total = seen[1].words
    discount = tuple(discounted(r.n1, r.n2) for r in longer)
    return Totals(total, seen[1].k, seen[1].texts, discount, tuple(
        (r.words - r.k * d) / max(total, 1) for r, d in zip(longer, discount)))


def shards_for(blocks: int, order: int = ORDER, block_words: int = BLOCK_WORDS) -> int:
    """Shards for which none is asked about more than about ``SHARD_NGRAMS`` n-grams; 64 at least."""
    return max(64, -(-blocks * order * block_words // SHARD_NGRAMS))


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text",
          order: int = ORDER, block_words: int = BLOCK_WORDS, shards: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row.

    The model learns from the rows for which ``held_out`` is false. ``shards`` defaults to
    :func:`shards_for` the blocks.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                       F.col(f"`{text}`").alias("text"))
    blocks = stored(encode_blocks(rows, block_words).withColumn("block", F.monotonically_increasing_id()))
    shards = shards or shards_for(blocks.count(), order, block_words)
    answers = stored(_ask(blocks, order, shards).groupBy("shard").applyInArrow(_answer, ANSWERS))
    totals = _totals(answers)
    denominator = float(totals.total + totals.distinct + 1)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        is_block = table.column("tokens").is_valid()
        body = table.filter(is_block)
        row = body.to_pylist()[0]
        lens, grams, starts = _unpack_block(row, order)
        found = table.select(["n", "shard", "q", "c"]).filter(pc.invert(is_block)).sort_by(
            [("n", "ascending"), ("shard", "ascending")]).to_pylist()
        counts = []
        for n, g in enumerate(grams, 1):
            h, place = np.unique(g, return_inverse=True)
            q = np.concatenate([unpack(r["q"]) for r in found if r["n"] == n])
            if len(q) != len(h):
                raise ValueError("a block's n-grams did not all come back")
            counts.append(expected(q)[place])
            if n == 1:
                exact = np.concatenate([np.frombuffer(r["c"], "<i8") for r in found if r["n"] == 1])[place]
        p = interpolated(totals, counts, starts)
        return pa.table({
            "doc_id": pc.list_flatten(body.column("ids")),
            "held_out": pa.array(row["held_out"], pa.bool_()), "n_tokens": pa.array(lens),
            "n_known": pa.array(np.add.reduceat((exact > 0).astype(np.int64), starts)),
            "base_score": pa.array(np.add.reduceat(np.log10((exact + 1.0) / denominator), starts)),
            "score": pa.array(np.add.reduceat(p, starts))})

    both = blocks.unionByName(answers.filter("block IS NOT NULL").select("block", "n", "shard", "q", "c"),
                              allowMissingColumns=True)
    scored = both.groupBy("block").applyInArrow(run, (
        f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known",
                         F.lit(totals.total).cast("long").alias("train_tokens"), "base_score", "score")
