"""Exact substring dedup with suffix arrays: bytes that an earlier document holds in a long match go.

Every byte covered by a string of ``least`` bytes that also starts in a document with a
smaller id is removed. Strings are judged on the input and never cross documents.

1. *Per-shard suffix arrays.* Tasks pack their documents into shards of ``SHARD_BYTES``
   bytes (a longer document takes several shards that overlap by ``least - 1`` bytes).
   A shard's suffixes are sorted by Larsson-Sadakane refinement: by their first eight
   bytes, then, only where still equal, by the ranks of the suffixes 8, 16, 32... bytes
   on, until no two are equal. The common prefixes of neighbours are compared word
   by word, as far as ``least`` bytes. Neighbours that share ``least`` bytes are one string; all but the smallest id's
   are known as repeats.
2. *Strings that travel.* What is first in its shard must be compared with other shards. A string
   goes where its anchor goes: the ``ANCHOR`` bytes of least hash within it, the leftmost of
   them. Equal strings have equal anchors, and consecutive strings of a text mostly share
   theirs, so a stretch of text travels once (about four bytes a byte, before compression)
   instead of ``least`` bytes per position.
3. *Merging by binary search.* A task receives the shards' stretches of its range of
   anchors, every shard's in the order of its suffix array, and merges them pairwise: the place of
   a stretch among those of the other shards is found by binary search of its anchor's
   first eight bytes. Stretches of one anchor are then compared as wholes and,
   where they differ, string by string: grouped by hash, and equal only if all bytes are.
4. The spans to remove go back to the documents by (id, text hash).

Ids are 64-bit integers. Defined results: a null text is an empty one; a null id is smaller than any
other; repeated rows (equal id and text) get equal results; equal ids with different texts
do not repeat each other; other columns pass through; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import BROADCAST_ROWS, fresh, scratch, stored

LEAST = 50
#: A small shard's arrays stay in a core's cache: sorting 2 MB takes twice as long a byte.
SHARD_BYTES = 512 << 10
#: Bytes of stretches that a task holds before it sends a block to every range.
SEND_BYTES = 32 << 20
#: Bytes of an anchor.
ANCHOR = 12
#: Uncompressed bytes of stretches that a merging task receives, on average.
MERGE_BYTES = 24 << 20
#: Neighbours in a suffix array that are compared at once, in a core's cache.
LANES = 32768
#: Strings that are compared at once.
BLOCK_STRINGS = 1 << 20
KNOWN = 2 ** 32 - 1

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_BYTES = np.array([1 << 8 * k for k in range(8)], np.uint64)
_PIECE = np.dtype([("id", "<i8"), ("h", "<i8"), ("pos", "<i8"), ("size", "<u4"), ("at", "<u4")])


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as big-endian numbers; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    view = np.ndarray(len(text), ">u8", padded, strides=(1,)) if len(text) else np.empty(0, ">u8")
    return view.astype(np.uint64)


def suffix_array(first: np.ndarray) -> np.ndarray:
    """All suffixes of a text, given by :func:`words_at`, in order: Larsson-Sadakane refinement.

    ``start`` is the place where a group of suffixes, equal so far, begins; only groups
    of two and more are sorted again, by the ranks of the suffixes ``h`` bytes on. Group, rank
    and position of a suffix make one number if 63 bits hold them: numbers alone are sorted
    much faster than positions by their numbers.
    """
    n = len(first)
    order = np.argsort(first)
    key = first[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    # places behind the text come first, the last of them foremost: a suffix that ends
    # comes before those that go on
    behind = max(n, 8)
    rank = np.empty(n + behind, np.int32 if n < 2 ** 30 else np.int64)
    rank[n:] = np.arange(behind - 1, -1, -1)
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = start + behind
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)[:n]))
    start, h = start[open_], 8
    low, high = n.bit_length(), (n + behind).bit_length()
    packed = 2 * low + high <= 63
    while len(open_):
        at = order[open_]
        full = start << high | rank[at + h]
        if packed:
            full = np.sort(full << low | at)
            at, full = full & (1 << low) - 1, full >> low
        else:
            by = np.argsort(full)
            at, full = at[by], full[by]
        order[open_] = at
        new = np.ones(len(open_), bool)
        new[1:] = full[1:] != full[:-1]
        start = np.maximum.accumulate(np.where(new, open_, 0))
        rank[at] = start + behind
        more = ~(new & np.append(new[1:], True))
        open_, start, h = open_[more], start[more], 2 * h
    return order


def _equal_bytes(differs: np.ndarray) -> np.ndarray:
    """Equal leading bytes of words, given by their exclusive or."""
    out = np.zeros(len(differs), np.uint8)
    for least in _BYTES:
        out += differs < least
    return out


def common_prefixes(word: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that every suffix shares with the one before it in ``order``, ``most`` at most.

    Neighbours are compared word by word, ``LANES`` pairs at once; only those whose words are equal go on.
    """
    n = len(word)
    out = np.zeros(n, np.int32)
    for a in range(1, n, LANES):
        pair = order[a - 1:a + LANES]
        one, two = pair[1:], pair[:-1]
        room = np.minimum(n - np.maximum(one, two), most)
        key = word[pair]
        more = _equal_bytes(key[1:] ^ key[:-1])
        held = np.minimum(more, room)
        todo = np.flatnonzero((more == 8) & (held < room))
        while len(todo):
            more = _equal_bytes(word[one[todo] + held[todo]] ^ word[two[todo] + held[todo]])
            held[todo] = np.minimum(held[todo] + more, room[todo])
            todo = todo[(more == 8) & (held[todo] < room[todo])]
        out[a:a + LANES] = held
    return out


def repeats(order: np.ndarray, shared: np.ndarray, least: int, valid: np.ndarray,
            doc: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether the string at every position also starts in a document with a smaller id in the shard."""
    out = np.zeros(len(order), bool)
    alike = shared >= least
    # strings that no neighbour equals are not looked at again
    place = np.flatnonzero(alike | np.append(alike[1:], False)[:len(alike)])
    if len(place):
        at = order[place]
        owner = np.where(valid[at], ids[doc[at]], np.iinfo(np.int64).max)
        starts = np.flatnonzero(~alike[place])
        lowest = np.repeat(np.minimum.reduceat(owner, starts), np.diff(np.append(starts, len(place))))
        out[at] = (owner > lowest) & valid[at]
    return out


def anchors(word: np.ndarray, least: int) -> np.ndarray:
    """Position of the anchor of the string at every position.

    Hashes are ordered by their upper bits; the position in the lower ones makes the
    leftmost of equal anchors the least.
    """
    n = len(word)
    width = least - ANCHOR + 1
    # nothing starts behind the text, so no anchor does either: the last values repeat
    rest = ANCHOR - 8
    low = np.full(n, _MIX[2])
    low[:max(n - rest, 0)] += word[rest:]
    low *= _MIX[1]
    low ^= word * _MIX[0]
    low ^= low >> np.uint64(29)
    low *= _MIX[0]
    bits = np.uint64(max(n, 2).bit_length())
    low >>= bits
    low <<= bits
    low |= np.arange(n, dtype=np.uint64)
    other = np.empty_like(low)
    for step in [*(1 << k for k in range(width.bit_length() - 1)), width - (1 << width.bit_length() - 1)]:
        if 0 < step < n:
            np.minimum(low[:n - step], low[step:], out=other[:n - step])
            other[n - step:] = low[n - step:]
            low, other = other, low
    low &= (np.uint64(1) << bits) - np.uint64(1)
    return low.view(np.int64)


def spans(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def shard(text: np.ndarray, bounds: np.ndarray, ids: np.ndarray, hashes: np.ndarray,
          base: np.ndarray, least: int, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(range, pieces, their bytes) of one shard; the local repeats have the anchor offset ``KNOWN``.

    ``bounds`` cuts ``text`` into documents, ``base`` is a document's offset in the whole text.
    """
    n = len(text)
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    valid = np.ones(n, bool)
    for a, z in zip(bounds[:-1], bounds[1:]):
        valid[max(a, z - least + 1):z] = False
    word = words_at(text)
    order = suffix_array(word)
    known = repeats(order, common_prefixes(word, order, least), least, valid, doc, ids)
    rank = np.empty(n, np.int32)
    rank[order] = np.arange(n, dtype=np.int32)
    anchor = anchors(word, least)

    def pieces(start, end, at):
        d = doc[start]
        out = np.empty(len(start), _PIECE)
        out["id"], out["h"] = ids[d], hashes[d]
        out["pos"] = start - bounds[d] + base[d]
        out["size"], out["at"] = end - start, at
        return out

    def runs(of, edge):
        """Starts and ends of the stretches between edges that ``of`` holds for."""
        edge = np.flatnonzero(edge)
        chosen = of[edge]
        return edge[chosen], np.append(edge[1:], n)[chosen]

    # runs of strings that have one anchor; the last strings of a document are not valid
    open_ = valid & ~known
    cut = np.ones(n, bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (open_[1:] != open_[:-1])
    start, end = runs(open_, cut)
    where = anchor[start]
    key = word[where] * _MIX[1] ^ (word[np.minimum(where + ANCHOR - 8, n - 1)] + _MIX[0]) * _MIX[2]
    part = ((key ^ key >> np.uint64(31)) * _MIX[2] >> np.uint64(32)) % np.uint64(parts)
    by = np.argsort(part << np.uint64(32) | rank[where].astype(np.uint64), kind="stable")
    start, end, part = start[by], end[by] + least - 1, part[by]
    made = pieces(start, end, where[by] - start)
    raw = text.tobytes()
    strings = [raw[a:z] for a, z in zip(start.tolist(), end.tolist())]
    firsts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
    for a, z in zip(firsts, [*firsts[1:], len(part)]):
        yield int(part[a]), made[a:z].tobytes(), b"".join(strings[a:z])
    # what the shard itself knows passes through any merging task
    edge = np.ones(n, bool)
    edge[1:] = known[1:] != known[:-1]
    start, end = runs(known, edge)
    if len(start):
        yield int(hashes[0]) % parts, pieces(start, end, KNOWN).tobytes(), b""


def _inner(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... of every size, one after the other."""
    sizes = sizes.astype(np.int64)
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def merge_order(blocks: list[np.ndarray]) -> np.ndarray:
    """Order of the concatenated blocks, each of which is sorted: pairs are merged by binary search."""
    starts = np.cumsum([0, *[len(b) for b in blocks]])
    todo = [(b, np.arange(a, a + len(b))) for a, b in zip(starts, blocks)]
    while len(todo) > 1:
        merged = []
        for (a, i), (b, j) in zip(todo[::2], todo[1::2]):
            at = np.searchsorted(a, b, "right") + np.arange(len(b))  # places of b's members
            key, place = np.empty(len(a) + len(b), a.dtype), np.empty(len(a) + len(b), np.int64)
            rest = np.ones(len(key), bool)
            rest[at] = False
            key[at], key[rest], place[at], place[rest] = b, a, j, i
            merged.append((key, place))
        todo = merged + ([todo[-1]] if len(todo) % 2 else [])
    return todo[0][1] if todo else np.empty(0, np.int64)


def merged_repeats(pieces: np.ndarray, text: np.ndarray, blocks: list[int], least: int):
    """(piece, first string, behind the last) of the strings that a smaller id holds.

    ``blocks``: number of pieces per shard, in the order of ``pieces``.
    """
    m = len(pieces)
    size = pieces["size"].astype(np.int64)
    begin = np.cumsum(size) - size
    word = words_at(text)
    where = begin + pieces["at"]
    one, two = word[where], word[where + ANCHOR - 8]
    order = merge_order(np.split(one, np.cumsum(blocks)[:-1]))
    # equal first halves: by the second half
    same = np.concatenate([[0], np.cumsum(one[order][1:] != one[order][:-1])]) if m else one
    order = order[np.lexsort((two[order], same))]
    one, two = one[order], two[order]
    new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
    group = np.cumsum(new) - 1
    ids = pieces["id"][order]
    first = np.flatnonzero(new)
    several = np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)
    chosen = order[several[group]]
    group = group[several[group]]
    if not len(chosen):
        return
    # equal stretches: the smallest id stands for all
    whole = _hash_strings(text, begin[chosen], size[chosen]) ^ (
        pieces["at"][chosen].astype(np.uint64) * _MIX[1])
    by = np.lexsort((pieces["id"][chosen], whole, group))
    chosen, group, whole = chosen[by], group[by], whole[by]
    head = np.concatenate([[True], (group[1:] != group[:-1]) | (whole[1:] != whole[:-1])])
    lead = np.maximum.accumulate(np.where(head, np.arange(len(chosen)), 0))
    exact = _equal(text, begin[chosen], begin[chosen[lead]], size[chosen], size[chosen[lead]])
    head |= ~exact  # a collision: the stretch stands for itself
    lead = np.where(exact, lead, np.arange(len(chosen)))
    behind = pieces["id"][chosen] > pieces["id"][chosen[lead]]
    late = np.flatnonzero(behind)
    yield chosen[late], np.zeros(len(late), np.int64), size[chosen[late]] - least + 1
    # different stretches of one anchor: string by string, groups in blocks
    reps = np.flatnonzero(head)
    alone = np.bincount(group[reps])[group[reps]] == 1
    reps = reps[~alone]
    n_strings = size[chosen[reps]] - least + 1
    filled = np.cumsum(n_strings)
    a = 0
    twins = np.flatnonzero(~head & ~behind)
    while a < len(reps):
        z = int(np.searchsorted(filled, (filled[a - 1] if a else 0) + BLOCK_STRINGS, "right"))
        z = max(z, a + 1)
        while z < len(reps) and group[reps[z]] == group[reps[z - 1]]:
            z += 1
        piece = chosen[reps[a:z]]
        flag, n = _string_repeats(pieces["id"][piece], begin[piece], group[reps[a:z]],
                                  pieces["at"][piece], n_strings[a:z], text, word, least)
        owner = np.repeat(np.arange(z - a), n)
        inner = _inner(n)
        edge = np.ones(len(flag), bool)
        edge[1:] = ~(flag[1:] & flag[:-1] & (owner[1:] == owner[:-1]))
        s = np.flatnonzero(edge & flag)
        ends = np.append(np.flatnonzero(edge), len(flag))
        e = ends[np.searchsorted(ends, s, "right")]
        lo, hi = inner[s], inner[s] + (e - s)
        yield piece[owner[s]], lo, hi
        # stretches of the same id that equal a representative share its result
        mine = twins[np.isin(lead[twins], reps[a:z])]
        if len(mine) and len(s):
            r = np.searchsorted(reps[a:z], lead[mine])
            of = owner[s]
            first = np.searchsorted(of, r)
            n = np.searchsorted(of, r, "right") - first
            each = np.repeat(first, n) + _inner(n)
            yield np.repeat(chosen[mine], n), lo[each], hi[each]
        a = z


def _words_of(text: np.ndarray, start: np.ndarray, n: np.ndarray, size: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """The ``n`` words of eight bytes that cover every stretch; the last one ends where the stretch does."""
    view = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
    return view[np.repeat(start, n) + np.minimum(8 * inner, np.repeat(size - 8, n))]


def _hash_strings(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of every stretch, of eight bytes at least, from a running sum of mixed words and places."""
    place = np.arange(-(-int(size.max()) // 8) if len(size) else 0, dtype=np.uint64)
    factor = (place + _MIX[0]) * _MIX[1]
    factor = (factor ^ factor >> np.uint64(31)) * _MIX[2] | np.uint64(1)
    out = np.empty(len(start), np.uint64)
    for a in range(0, len(start), 1 << 16):
        sizes = size[a:a + (1 << 16)]
        n = -(-sizes // 8)
        inner = _inner(n)
        value = (_words_of(text, start[a:a + (1 << 16)], n, sizes, inner) + _MIX[0]) * _MIX[2]
        value = (value ^ value >> np.uint64(32)) * factor[inner]
        out[a:a + (1 << 16)] = np.add.reduceat(value ^ value >> np.uint64(29), np.cumsum(n) - n)
    return out ^ size.astype(np.uint64) * _MIX[0]


def _equal(text, start, other, size, other_size) -> np.ndarray:
    """Whether two stretches, of eight bytes at least, are equal in all bytes."""
    out = size == other_size
    for a in range(0, len(start), 1 << 16):
        sel = np.arange(a, min(a + (1 << 16), len(start)))
        sel = sel[out[sel] & (start[sel] != other[sel])]
        if not len(sel):
            continue
        n = -(-size[sel] // 8)
        inner = _inner(n)
        one, two = (_words_of(text, x[sel], n, size[sel], inner) for x in (start, other))
        out[sel] = np.add.reduceat((one != two).astype(np.int64), np.cumsum(n) - n) == 0
    return out


def _string_repeats(ids, begin, group, at, n, text, word, least):
    """For every string of the pieces, whether a smaller id has it in the same group."""
    ends = np.cumsum(n)
    total = int(ends[-1])
    flag = np.zeros(total, bool)
    p = np.arange(total) + np.repeat(begin - ends + n, n)
    # a string's place relative to the anchor is part of its identity, as the anchor is
    named = group.astype(np.uint64) * _MIX[0] + (begin + at).astype(np.uint64) * _MIX[1]
    named = np.repeat(named, n) - p.astype(np.uint64) * _MIX[1]
    # most strings differ from all others in their first or last word
    h = named
    for o in (0, least - 8):
        h = (h ^ word[p + o]) * _MIX[2]
        h ^= h >> np.uint64(32)
    bits = np.uint64(total.bit_length())
    h = np.sort(h >> bits << bits | np.arange(total, dtype=np.uint64))
    same = h[1:] >> bits == h[:-1] >> bits
    some = np.append(same, False)
    some[1:] |= same
    some = (h[some] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    if not len(some):
        return flag, n
    offsets = [*range(0, least - 7, 8)]
    if offsets[-1] + 8 < least:
        offsets.append(least - 8)
    h, q = named[some], p[some]
    for o in offsets:
        h = (h ^ word[q + o]) * _MIX[2]
        h ^= h >> np.uint64(32)
    by = np.argsort(h)
    hs = h[by]
    starts = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
    count = np.diff(np.append(starts, len(hs)))
    # strings of a hash that no other has are not looked at again
    at = some[by[np.repeat(count > 1, count)]]
    count = count[count > 1]
    if not len(at):
        return flag, n
    starts = np.cumsum(count) - count
    owner, lead = np.repeat(ids, n)[at], np.repeat(at[starts], count)
    same = np.ones(len(at), bool)
    for o in offsets:
        same &= word[p[at] + o] == word[p[lead] + o]
    flag[at] = owner > np.repeat(np.minimum.reduceat(owner, starts), count)
    odd = np.isin(lead, lead[~same]) if not same.all() else ~same
    if odd.any():  # hash collisions: the strings of these hashes are compared as bytes
        keys = [text[x:x + least].tobytes() for x in p[at[odd]]]
        best = {}
        for k, i in zip(keys, owner[odd]):
            best[k] = min(i, best.get(k, i))
        flag[at[odd]] = [i > best[k] for k, i in zip(keys, owner[odd])]
    return flag, n


def _shards(batches: Iterator[pa.RecordBatch], least: int, shard_bytes: int):
    """Documents of a task, packed into shards: (bytes, ids, text hashes, offsets)."""
    held, size = [], 0
    for b in batches:
        for i, h, t in zip(*[b.column(c) for c in ("id", "h", "t")]):
            raw = t.as_py().encode("utf-8", "surrogatepass")
            if len(raw) < least:
                continue
            for a in range(0, len(raw) - least + 1, shard_bytes):
                piece = raw[a:a + shard_bytes + least - 1]
                if size + len(piece) > shard_bytes + least and held:
                    yield held
                    held, size = [], 0
                held.append((piece, i.as_py(), h.as_py(), a))
                size += len(piece)
    if held:
        yield held


def span_lists(i: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray, least: int) -> pa.Table:
    """One row per document: the spans of bytes that the runs of strings ``start`` to ``end`` cover."""
    by = np.lexsort((start, h, i))
    i, h, start, end = i[by], h[by], start[by], end[by] + least - 1
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (h[1:] != h[:-1])
    # the end reached so far in a document; documents are kept apart by an offset
    shift = np.cumsum(new) * (end.max(initial=0) + 1)
    reach = np.maximum.accumulate(end + shift) - shift
    head = new.copy()
    head[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(head)
    tail = np.append(first, len(i))[1:] - 1
    docs = np.flatnonzero(new[first])
    offsets = np.append(docs, len(first)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (start[first], reach[tail])]
    return pa.table([pa.array(i[first][docs]), pa.array(h[first][docs]), *lists], ["id", "h", "starts", "ends"])


def found_spans(docs: DataFrame, least: int = LEAST, shard_bytes: int = SHARD_BYTES,
                merge_bytes: int = MERGE_BYTES) -> DataFrame:
    """(id, h, starts, ends): bytes of a document to remove, from frames ``id, h, t`` of documents."""
    if least < ANCHOR + 8:
        raise ValueError(f"matches have {ANCHOR + 8} bytes at least")
    total = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-5 * total // merge_bytes))  # about five bytes travel per byte

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = {}, 0
        for held in _shards(batches, least, shard_bytes):
            text = np.frombuffer(b"".join(x[0] for x in held), np.uint8)
            bounds = np.concatenate([[0], np.cumsum([len(x[0]) for x in held])])
            columns = [np.array([x[k] for x in held], np.int64) for k in (1, 2, 3)]
            for part, *block in shard(text, bounds, *columns, least, parts):
                waiting.setdefault(part, []).append(block)
                size += len(block[0]) + len(block[1])
            if size > SEND_BYTES:
                yield sent(waiting)
                waiting, size = {}, 0
        if waiting:
            yield sent(waiting)

    def sent(waiting):
        pack = zstandard.ZstdCompressor(level=3).compress
        return pa.RecordBatch.from_arrays(
            [pa.array(list(waiting), pa.int32()),
             pa.array([[len(b[0]) // _PIECE.itemsize if b[1] else 0 for b in w]
                       for w in waiting.values()], pa.list_(pa.int32())),
             *[pa.array([pack(b"".join(b[k] for b in w)) for w in waiting.values()], pa.binary())
               for k in (0, 1)]], ["part", "counts", "pieces", "bytes"])

    def merge(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        own, known, texts = [], [], []
        for counts, a, b in zip(*[table.column(c) for c in ("counts", "pieces", "bytes")]):
            rows = np.frombuffer(unpack(a.as_py()), _PIECE)
            texts.append(unpack(b.as_py()))
            own += np.split(rows[rows["at"] != KNOWN], np.cumsum([c for c in counts.as_py() if c])[:-1])
            known.append(rows[rows["at"] == KNOWN])
        own = [x for x in own if len(x)]
        out = [(k["id"], k["h"], k["pos"], k["pos"] + k["size"]) for k in known]
        if own:
            pieces = np.concatenate(own)
            text = np.frombuffer(b"".join(texts), np.uint8)
            for piece, lo, hi in merged_repeats(pieces, text, [len(x) for x in own], least):
                rows = pieces[piece]
                out.append((rows["id"], rows["h"], rows["pos"] + lo, rows["pos"] + hi))
        cols = [np.concatenate(c).astype(np.int64) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 4
        return span_lists(*cols, least)

    shards = docs.select("id", "h", "t").mapInArrow(sort, "part int, counts array<int>, pieces binary, bytes binary")
    return shards.groupBy("part").applyInArrow(
        merge, "id long, h long, starts array<long>, ends array<long>")


def dedup_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                least: int = LEAST, **sizes) -> DataFrame:
    """``docs`` without ``text``, with ``n_bytes, n_removed, n_spans`` and ``kept``, the bytes left."""
    key, h, t, cut = fresh(docs, "key", "h", "t", "cut")
    least_id = F.lit(-2 ** 63).cast("long")
    named = docs.withColumns({
        t: F.coalesce(F.col(f"`{text}`"), F.lit("")),
        key: F.coalesce(F.col(f"`{doc_id}`").cast("long"), least_id)}).withColumn(h, F.xxhash64(t))
    parts = stored(found_spans(named.select(F.col(key).alias("id"), F.col(h).alias("h"),
                                            F.col(t).alias("t")), least, **sizes),
                   scratch(docs.sparkSession))
    found = parts.groupBy("id", "h").agg(F.sort_array(F.flatten(F.collect_list(
        F.arrays_zip("starts", "ends")))).alias("s"))
    found = stored(found)
    total = found.select(F.sum(F.size("s") * 16 + 16)).first()[0] or 0
    if total <= 10 * BROADCAST_ROWS * 4:  # 8 MB of spans and keys
        found = F.broadcast(found)
    out = [c for c in docs.columns if c not in (text, "n_bytes", "n_removed", "n_spans", "kept")]
    rows = named.alias("d").join(
        found.withColumnRenamed("s", cut).alias("f"),
        (F.col(f"d.{key}") == F.col("f.id")) & (F.col(f"d.{h}") == F.col("f.h")), "left").select(
        *[F.col(f"d.`{c}`") for c in out], F.col(f"d.{t}"), F.col(f"f.{cut}"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            figures, kept = [], []
            for x, c in zip(b.column(len(out)), b.column(len(out) + 1)):
                raw, at, left, n = x.as_py().encode("utf-8", "surrogatepass"), 0, [], 0
                runs = []
                for s in c.as_py() or []:
                    if runs and s["starts"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s["ends"])
                    else:
                        runs.append([s["starts"], s["ends"]])
                for s, e in runs:
                    left.append(raw[at:s])
                    at, n = e, n + e - s
                kept.append(b"".join([*left, raw[at:]]))
                figures.append((len(raw), n, len(runs)))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(k) for k in range(len(out))],
                 *[pa.array([f[k] for f in figures], pa.int64()) for k in range(3)],
                 pa.array(kept, pa.binary())], [*out, "n_bytes", "n_removed", "n_spans", "kept"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:len(out)])
    return rows.mapInArrow(remove, f"{fields}, n_bytes long, n_removed long, n_spans long, kept binary")
