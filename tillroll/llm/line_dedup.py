"""Line dedup by pairwise alignment.

1. A run is a sequence of consecutive non-blank lines that reaches
   ``min_block_words`` words and would not without its first or its last line; every
   line that lies in a block of that many words lies in a run within the block.
   Every run has a first holder: the first document, by (id, text hash), with it.
   A run that later documents share nominates the pair (later document, first
   holder). A run nominates one partner per document however frequent it is, so
   pairs stay in proportion to lines, and no passage depends on what else its
   documents share with others.
2. Each pair is aligned with a patience diff of the two sequences of line
   hashes: common heads and tails, then lines that occur once on both sides, in
   their longest increasing order, and so on between them. Where lines are left over that lie
   in runs of both documents (in another order, say), the segments around these are aligned again.
3. Aligned blocks of consecutive lines with ``min_block_words`` words or more
   are deleted from the later document. The first document with a line keeps it, so
   no line disappears from the corpus.

Lines are compared by 128-bit hashes. Texts are read twice (hashes, deletion)
and never shuffled unless the deletions are too many to broadcast.

Defined results: a null text stays null, an empty text empty; blank lines are
never compared and go only if both neighbours go in one block of one pair; null ids come
before all others; repeated rows (equal id and text) are one document and get
equal results; equal ids with different texts are different documents; other
columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import BROADCAST_ROWS, fresh, let, stored, words

MIN_BLOCK_WORDS = 10


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain of pairs, sorted by the first member, whose second members increase."""
    tops, at, back = [], [], [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back[k] = at[p - 1] if p else -1
        tops[p:p + 1], at[p:p + 1] = [j], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _anchors(a: list, b: list, alo, ahi, blo, bhi) -> list[tuple[int, int]]:
    """Pairs of equal lines that occur once on both sides; failing that, n-th with n-th occurrence."""
    ca, cb = Counter(a[alo:ahi]), Counter(b[blo:bhi])
    where = {x: j for j, x in enumerate(b[blo:bhi], blo) if cb[x] == 1}
    once = [(i, where[x]) for i, x in enumerate(a[alo:ahi], alo) if ca[x] == 1 and x in where]
    if once:
        return _increasing(once)
    seen, nth = Counter(), {}
    for j in range(blo, bhi):
        if b[j] in ca:
            nth[b[j], seen[b[j]]] = j
            seen[b[j]] += 1
    seen, pairs = Counter(), []
    for i in range(alo, ahi):
        if (j := nth.get((a[i], seen[a[i]]))) is not None:
            pairs.append((i, j))
        seen[a[i]] += 1
    return _increasing(pairs)


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned (index in a, index in b) of a patience diff, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        i0, j0 = alo, blo
        for i, j in _anchors(a, b, alo, ahi, blo, bhi):
            out.append((i, j))
            todo.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
        if (i0, j0) != (alo, blo):
            todo.append((i0, ahi, j0, bhi))
    return sorted(out)


def runs(n_words: list[int], least: int) -> list[tuple[int, int]]:
    """(start, end) of the shortest runs with ``least`` words, from every first and to every last line."""
    out, least, n = set(), max(least, 1), len(n_words)
    end = held = 0
    for start in range(n):
        while end < n and held < least:
            held += n_words[end]
            end += 1
        if held < least:
            break
        out.add((start, end))
        held -= n_words[start]
    start = held = 0
    for end in range(1, n + 1):
        held += n_words[end - 1]
        while held - n_words[start] >= least:
            held -= n_words[start]
            start += 1
        if held >= least:
            out.add((start, end))
    return sorted(out)


def _blocks(pairs: list[tuple[int, int]], n_words: list[int], least: int) -> list[tuple[int, int]]:
    """(start, end) in the first sequence of the runs of pairs that have ``least`` words."""
    out, k = [], 0
    while k < len(pairs):
        m = k + 1
        while m < len(pairs) and pairs[m] == (pairs[m - 1][0] + 1, pairs[m - 1][1] + 1):
            m += 1
        if sum(n_words[i] for i, _ in pairs[k:m]) >= least:
            out.append((pairs[k][0], pairs[m - 1][0] + 1))
        k = m
    return out


def _realigned(a: list, n_words: list[int], b: list, done: set[int], least: int) -> list[tuple[int, int]]:
    """(start, end) of blocks that hold lines of ``a`` not in ``done``.

    An alignment keeps an order, so blocks in another order, and blocks that share lines with
    those it took, are left over. Runs with such lines say where ``b`` has the like;
    runs of equal distance are one segment, and each segment is aligned by itself.
    """
    size, where, part = dict(zip(a, n_words)), {}, []
    for k, x in enumerate([*b, None]):
        if x in size:
            part.append(x)
            continue
        for i, j in runs([size[y] for y in part], least):
            where.setdefault(tuple(part[i:j]), k - len(part) + i)
        part = []
    segments: list[list[int]] = []
    for i, j in runs(n_words, least):
        there = None if all(k in done for k in range(i, j)) else where.get(tuple(a[i:j]))
        if there is None:
            continue
        if segments and segments[-1][2] == there - i and i <= segments[-1][1]:
            segments[-1][1] = max(j, segments[-1][1])
        else:
            segments.append([i, j, there - i])
    return [(i + p, i + q) for i, j, far in segments
            for p, q in _blocks(patience(a[i:j], b[i + far:j + far]), n_words[i:j], least)]


def cut_positions(later: list, n_words: list[int], first: list, min_block_words: int) -> list[int]:
    """Line positions of ``later`` that lie in aligned blocks with ``first``.

    Blank lines are None; blocks run over them. The two are aligned as wholes, then what
    that left over.
    """
    at = [i for i, x in enumerate(later) if x is not None]
    a, b, size = [later[i] for i in at], [x for x in first if x is not None], [n_words[i] for i in at]
    blocks = _blocks(patience(a, b), size, min_block_words)
    done = {k for i, j in blocks for k in range(i, j)}
    more = _realigned(a, size, b, done, min_block_words)
    out = {k for i, j in [*blocks, *more] for k in range(at[i], at[j - 1] + 1)}
    if more:
        beside = set(zip(b, b[1:]))
        for k in range(len(a) - 1):  # blank lines between neighbours of one block
            if at[k] in out and at[k + 1] in out and (a[k], a[k + 1]) in beside:
                out.update(range(at[k], at[k + 1]))
    return sorted(out)


def sequences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc`` (id, text hash), line hashes (null: blank line) and words."""
    t = F.col(f"`{text}`")
    lines = F.split(t, "\n")
    rows = docs.filter(t.isNotNull()).select(
        F.struct(F.col(f"`{doc_id}`").alias("id"), F.md5(t).alias("h")).alias("doc"),
        F.transform(lines, lambda x: F.struct(
            F.unhex(F.md5(x)).alias("h"), F.size(words(x)).alias("n"))).alias("s"))
    return rows.select(
        "doc", F.transform("s", lambda x: F.when(x["n"] > 0, x["h"])).alias("lines"),
        F.col("s.n").alias("n_words")).dropDuplicates(["doc"])


def _run_hashes(seqs: DataFrame, min_block_words: int) -> DataFrame:
    """(doc, h): the 128-bit hashes of every document's runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i in range(b.num_rows):
                n_words = b.column("n_words")[i].as_py()
                if sum(n_words) < min_block_words:
                    continue
                held = [(x, n) for x, n in zip(b.column("lines")[i].as_py(), n_words) if x is not None]
                found = {hashlib.md5(b"".join([x for x, _ in held[a:z]])).digest()
                         for a, z in runs([n for _, n in held], min_block_words)}
                at += [i] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays(
                [b.column("doc").take(pa.array(at, pa.int64())), pa.array(out, pa.binary())], ["doc", "h"])

    return seqs.mapInArrow(run, f"doc {seqs.schema['doc'].dataType.simpleString()}, h binary")


def cuts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
         min_block_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """(doc, cut): the positions of the lines to delete, for documents that have some."""
    seqs = stored(sequences(docs, doc_id, text))
    held = stored(_run_hashes(seqs, min_block_words))
    holders = held.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter(
        "first <> last").select("h", "first")
    pairs = held.join(holders, "h").filter("doc <> first").select("doc", "first").distinct()
    both = pairs.join(seqs, "doc").join(
        seqs.select(F.col("doc").alias("first"), F.col("lines").alias("others")), "first").select(
        "doc", "lines", "n_words", "others")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs_, at = b.column("doc"), []
            cols = [b.column(c) for c in ("lines", "n_words", "others")]
            pos = []
            for i in range(b.num_rows):
                found = cut_positions(*[c[i].as_py() for c in cols], min_block_words)
                if found:
                    at.append(i)
                    pos.append(found)
            yield pa.RecordBatch.from_arrays(
                [docs_.take(pa.array(at, pa.int64())), pa.array(pos, pa.list_(pa.int32()))],
                ["doc", "cut"])

    found = both.mapInArrow(align, f"doc {seqs.schema['doc'].dataType.simpleString()}, cut array<int>")
    return found.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("cut"))).alias("cut"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                min_block_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """``docs`` without the lines aligned with earlier documents, with ``n_lines`` and ``n_cut``."""
    found = stored(cuts(docs, doc_id, text, min_block_words))
    total = found.select(F.sum(F.size("cut") + 8)).first()[0] or 0
    if total <= 10 * BROADCAST_ROWS:  # 8 MB of positions and keys
        found = F.broadcast(found)
    (key,) = fresh(docs, "doc")
    t = F.col(f"d.`{text}`")
    d = docs.withColumn(key, F.struct(F.col(f"`{doc_id}`").alias("id"),
                                      F.md5(F.col(f"`{text}`")).alias("h"))).alias("d")
    lines = F.split(t, "\n")
    out = [c for c in docs.columns if c not in (text, "n_lines", "n_cut")]
    joined = d.join(found.alias("c"), F.col(f"d.{key}") == F.col("c.doc"), "left")
    return joined.select(
        *[F.col(f"d.`{c}`") for c in out],
        F.when(F.col("c.cut").isNull(), t).otherwise(_without(t, F.col("c.cut"))).alias(text),
        F.when(t.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("c.cut"), F.lit(0)).cast("long").alias("n_cut"))


def _without(text, cut):
    """The text without the lines at the given positions, in time linear in its lines."""
    return let(F.split(text, "\n"), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), cut),
        lambda i: F.get(lines, i)), "\n"))
