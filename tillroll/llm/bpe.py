"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Documents are read in blocks of whole texts. A block's texts are split into
   pre-tokens; the block keeps, by position, a number for every pre-token, and
   each distinct pre-token of the block goes once to the word bucket its hash names.
2. A bucket holds all copies of its words from all blocks and encodes every
   distinct word once.
3. The ids go back to the blocks and are put in place by position.

The position numbers and words travel packed (byte planes, zstd): a pre-token
costs one to two bytes in the shuffle instead of a row. No text is shuffled, no
word is a hot key (a block sends each word once), and a task holds one block or
one bucket. Steps 1's two outputs are computed by two passes over the same
scan, which is cheaper than storing them; a block whose ids do not fit its
positions fails.

Decoding joins the ids with the token-byte table (one row per vocabulary entry).

Ids are returned as little-endian unsigned 32-bit integers in one binary value
(``numpy.frombuffer(ids, '<u4')``).

Defined results: a null or empty text has no tokens; null ids and repeated rows
each get their row; special tokens' strings are ordinary text; an empty table
gives an empty table; other columns do not matter.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_TOKENS = 500_000
BLOCK_DOCS = 20_000
DECODE_ROWS = 256
ROWS = ("block bigint, bucket int, doc_ids array<bigint>, n_pieces array<bigint>, places binary, "
        "buckets binary, words binary")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: one base64 token and its id per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def white_space(pattern: str) -> str:
    """The pattern with ``\\s`` as the Unicode property, which is what the merges' library takes."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(
        r"\S", r"\P{White_Space}")


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    used = 4 if not len(values) else max(1, (int(values.max()).bit_length() + 7) // 8)
    return bytes([used]) + zstandard.ZstdCompressor(level=3).compress(planes[:used].tobytes())


def unpack(data: bytes) -> np.ndarray:
    """The numbers of :func:`pack`, as unsigned 32-bit integers."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    planes = raw.reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, :data[0]] = planes.T
    return out.view("<u4").ravel()


def pack_words(found: list[bytes]) -> bytes:
    """Byte strings as one compressed value."""
    lens = pack(np.array([len(w) for w in found], np.uint32))
    return len(lens).to_bytes(4, "little") + lens + zstandard.ZstdCompressor(level=3).compress(b"".join(found))


def unpack_words(data: bytes) -> list[bytes]:
    n = 4 + int.from_bytes(data[:4], "little")
    ends = np.cumsum(unpack(data[4:n]).astype(np.int64)).tolist()
    raw = zstandard.ZstdDecompressor().decompress(data[n:])
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, limit: int):
    """Yield (name, doc ids, pieces per document, place of every piece, distinct pieces) per block.

    Pieces are numbered by falling frequency. The name is a hash of ids and texts:
    blocks of one name are equal and may share their words.
    """
    import regex
    import xxhash

    split = regex.compile(white_space(pattern)).findall

    def block():
        places = np.concatenate(held) if held else np.empty(0, np.uint32)
        order = np.argsort(-np.bincount(places, minlength=len(numbers)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        pieces = list(numbers)
        return (name.intdigest() - (1 << 63), ids, n_pieces, rank[places],
                [pieces[k] for k in order.tolist()])

    numbers, held, ids, n_pieces, total = defaultdict(count().__next__), [], [], [], 0
    name = xxhash.xxh64()
    for b in batches:
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
            text = t.as_py() or ""
            name.update(f"{i} {len(text)} {text}")
            places = np.array([numbers[p] for p in split(text)], np.uint32)
            ids.append(i)
            n_pieces.append(len(places))
            held.append(places)
            total += len(places)
            if total >= limit or len(ids) >= BLOCK_DOCS:
                yield block()
                numbers, held, ids, n_pieces, total = defaultdict(count().__next__), [], [], [], 0
                name = xxhash.xxh64()
    if ids:
        yield block()


def _bucket_of(pieces: list[bytes], n: int) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(p) % n for p in pieces], np.uint32)


def encode(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id",
           text: str = "text", block_tokens: int = BLOCK_TOKENS, buckets: int | None = None,
           decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids), one row per row of ``docs``.

    With ``decoded`` also the bytes that the ids decode to, found where the ids are
    put together, which spares a pass over them (:func:`decode` is for stored ids).
    ``vocabulary`` is the path of a rank file, read on the driver; ``buckets``
    defaults to twice the shuffle partitions, which grow with the input.
    """
    spark = docs.sparkSession
    buckets = buckets or max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))
    tokens = spark.sparkContext.broadcast(_token_bytes(ranks.value)) if decoded else None
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    names = [f.split()[0] for f in ROWS.split(", ")]
    longs = pa.list_(pa.int64())
    schema = pa.schema(list(zip(names, (pa.int64(), pa.int32(), longs, longs, *[pa.binary()] * 3))))

    def split(want_words: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for name, ids, n_pieces, places, pieces in _blocks(batches, pattern, block_tokens):
                raw = [p.encode() for p in pieces]
                of = _bucket_of(raw, buckets)
                if not want_words:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, (
                        name, None, ids, n_pieces, pack(places), pack(of), None)))], schema)
                    continue
                order = np.argsort(of, kind="stable")
                cuts = np.flatnonzero(np.diff(of[order])) + 1
                out = []
                for part in np.split(order, cuts):
                    if len(part):
                        out.append(dict(zip(names, (name, int(of[part[0]]), None, None, None, None,
                                                    pack_words([raw[j] for j in part.tolist()])))))
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)
        return run

    merges = None  # made once per task

    def encode_words(table: pa.Table) -> pa.Table:
        import tiktoken

        nonlocal merges
        merges = merges or tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks.value,
                                             special_tokens={})
        known: dict[bytes, list[int]] = {}
        out = []
        for words in table.column("words"):
            found = unpack_words(words.as_py())
            for w in found:
                if w not in known:
                    known[w] = merges.encode_ordinary(w.decode())
            ids = [known[w] for w in found]
            lens = pack(np.array([len(x) for x in ids], np.uint32))
            flat = pack(np.fromiter((x for y in ids for x in y), np.uint32))
            out.append(len(lens).to_bytes(4, "little") + lens + flat)
        at = schema.get_field_index("words")
        return table.set_column(at, "words", pa.array(out, pa.binary())).cast(schema)

    def place(table: pa.Table) -> pa.Table:
        rows_ = table.to_pylist()
        blocks = [r for r in rows_ if r["bucket"] is None]  # equal but for repeated rows
        words_of = {r["bucket"]: r["words"] for r in rows_ if r["bucket"] is not None}
        if not blocks:
            raise ValueError("a block's positions are missing: the texts were read differently")
        block = blocks[0]
        places, of = unpack(block["places"]), unpack(block["buckets"])
        lens, parts, order = np.zeros(len(of), np.int64), [], []
        for bucket, data in words_of.items():
            n = 4 + int.from_bytes(data[:4], "little")
            own = np.flatnonzero(of == bucket)
            lens[own] = unpack(data[4:n])  # fails unless the words are those of the positions
            parts.append(unpack(data[n:]))
            order.append(own)
        order = np.concatenate(order) if order else np.empty(0, np.int64)
        if len(order) != len(of):
            raise ValueError("a block's words did not all come back")
        flat = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        starts = np.zeros(len(of), np.int64)
        starts[order] = np.cumsum(lens[order]) - lens[order]
        ids, n_tokens, back = [], [], []
        ends = np.cumsum(block["n_pieces"])
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            p = places[a:b]
            n = lens[p]
            upto = np.cumsum(n)
            total = int(upto[-1]) if len(p) else 0
            at = np.repeat(starts[p] - (upto - n), n) + np.arange(total)
            n_tokens.append(total)
            ids.append(flat[at].astype("<u4").tobytes())
            if decoded:
                back.append(_decode(ids[-1], tokens.value))
        more = {"decoded": pa.array(back, pa.binary())} if decoded else {}
        return pa.concat_tables([pa.table({
            "doc_id": pa.array(block["doc_ids"], pa.int64()),
            "n_tokens": pa.array(n_tokens, pa.int64()), "ids": pa.array(ids, pa.binary()), **more})] * len(blocks))

    words = rows.mapInArrow(split(True), ROWS).groupBy("bucket").applyInArrow(encode_words, ROWS)
    positions = rows.mapInArrow(split(False), ROWS)
    return words.unionByName(positions).groupBy("block").applyInArrow(
        place, "doc_id bigint, n_tokens bigint, ids binary" + ", decoded binary" * decoded)


def _token_bytes(ranks: dict[bytes, int]) -> dict[int, bytes]:
    """The token-byte table: the bytes of every id."""
    return {i: b for b, i in ranks.items()}


def _decode(ids: bytes, tokens: dict[int, bytes]) -> bytes:
    return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` (binary): the bytes of every id, found in the token-byte table."""
    spark = encoded.sparkSession
    table = spark.sparkContext.broadcast(_token_bytes(read_ranks(vocabulary)))
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = table.value
        for whole in batches:
            for at in range(0, whole.num_rows, DECODE_ROWS):
                b = whole.slice(at, DECODE_ROWS)
                out = [None if x.as_py() is None else _decode(x.as_py(), tokens) for x in b.column(ids)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())],
                                                 [*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
