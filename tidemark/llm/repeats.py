"""Exact repeated passages: maximal repeats from enhanced suffix arrays, over any number of documents.

A suffix array of a whole corpus cannot be held, so it is built in pieces that together see every
repeat. Each window of ``min_bytes`` bytes is assigned to the k-gram in it whose hash is least. Equal
windows choose equal k-grams at equal offsets, so the windows of a document fall into short runs, each
with an anchor, and equal windows always carry the same anchor. Anchors that occur once are dropped;
for the others the bytes their windows span are brought together by anchor. A task builds suffix, LCP
and left-character arrays over the spans it holds and scans the LCP intervals with a stack: an interval
whose suffixes are preceded by different bytes (or begin a span) is a maximal repeat and is put out with
all its occurrences.

Before the shuffle equal spans of a batch are put out as repeats of the earliest, which alone travels on.
An anchor that very many different spans share is refined: its windows get anchors a little shorter than a window, and where
these are shared so too the longest there is, the window itself; they are counted like the others, and those that occur twice or more go through the same arrays.
Parts of a passage that is longer than a span are joined again by ``passages``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.llm.common import checked_broadcast, frugal, materialise, numbered, shuffle_partitions

#: Bytes of an anchor.
K = 24
#: Different spans from which on an anchor's windows get anchors of their own.
REFINE_FROM = 2000
#: The first longer anchors are so many bytes shorter than a window, the last as long as one.
NEAR = 20
#: Bytes of spans a task sorts at a time (whole anchors, so a little more).
CHUNK = 1 << 16
#: Bytes of text, spans and anchor rows that are looked at in one step.
STEP_BYTES, STEP_SPANS, STEP_ROWS = 1 << 18, 10_000, 1_000_000
#: Spans among which equal ones are looked for before the shuffle (those of whole texts, so a little more).
SETTLE_SPANS = 300_000
_ODD = 0x9E3779B97F4A7C15
_SHIFT = 7  # a span is coded as first window << _SHIFT | number of windows

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        for i, base in enumerate((_ODD, pow(_ODD, -1, 2**64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _rolling(buf: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the ``k`` bytes from each position of ``buf``."""
    n = len(buf)
    up, down = _powers_to(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return _mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_bytes: int, k: int = K):
    """Of several adjacent texts in one buffer: (text, anchor hash, first window within the text, number of windows)."""
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < min_bytes:
        return none, none, none, none
    grams = _rolling(buf, k)
    # The least hash in each window and its leftmost place, as one number.
    best = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width = min_bytes - k + 1
    step = 1
    while step * 2 <= width:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    if step < width:
        best = np.minimum(best[: len(best) - (width - step)], best[width - step :])
    text = np.repeat(np.arange(len(starts)), ends - starts)[: len(best)]
    at = np.arange(len(best))
    valid = np.flatnonzero(at + min_bytes <= ends[text])
    if not len(valid):
        return none, none, none, none
    anchor, own = (best[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64), text[valid]
    # Ties of the upper half are broken by place, which equal windows share; a run ends where its anchor or text does.
    cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1]))))
    count = np.diff(np.concatenate((cut, [len(valid)])))
    who = own[cut]
    return who, grams[anchor[cut]].view(np.int64), valid[cut] - starts[who], count


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys below 2 to the ``bits`` and the keys in it. Key and place are sorted as one number where they fit."""
    own = max(1, (len(key) - 1).bit_length())
    if bits + own > 64:
        order = np.argsort(key)
        return order, key[order]
    packed = np.sort((key << np.uint64(own)) | np.arange(len(key), dtype=np.uint64))
    return (packed & np.uint64((1 << own) - 1)).astype(np.int64), packed >> np.uint64(own)


def _rank(key: np.ndarray, bits: int) -> np.ndarray:
    order, ranked = _sorted(key, bits)
    out = np.empty(len(key), np.uint64)
    out[order] = np.cumsum(np.concatenate(([0], (ranked[1:] != ranked[:-1]).astype(np.uint64))), dtype=np.uint64)
    return out


def _shifted(rank: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(rank)
    out[:-by] = rank[by:]
    return out


def suffix_array(buf: np.ndarray, length_left: np.ndarray, first: np.ndarray, min_bytes: int):
    """Sorted suffixes among ``first`` (those with ``min_bytes`` left in their span) and the LCP of neighbours.

    Prefix doubling on ranks of 4, 8, 16, 32 and 64 bytes; spans are shorter than 192 bytes. ``buf`` ends
    with at least 192 bytes of padding.
    """
    words = np.zeros(len(buf), np.uint64)
    for i in range(4):
        words[: len(buf) - i] |= buf[i:].astype(np.uint64) << np.uint64(24 - 8 * i)
    # Bytes beyond the span read as nothing, so that a span's end cannot match what lies behind it.
    short = np.flatnonzero(length_left < 4)
    keep = length_left[short].astype(np.uint64) * np.uint64(8)
    words[short] = words[short] & ~(np.uint64(0xFFFFFFFF) >> keep)
    levels = {4: _rank(words, 32)}
    bits = len(buf).bit_length()
    size = np.uint64(bits)
    for n in (4, 8, 16, 32):
        levels[2 * n] = _rank((levels[n] << size) | _shifted(levels[n], n), 2 * bits)
    r64 = levels[64]
    r128 = _rank((r64[first] << size) | r64[first + 64], 2 * bits)
    sa = first[_sorted((r128 << size) | r64[first + 128], 2 * bits)[0]]
    a, b = sa[:-1], sa[1:]
    lcp = np.zeros(len(a), np.int64)
    for n in (64, 64, 64, 32, 16, 8, 4):
        lcp += n * (levels[n][np.minimum(a + lcp, len(buf) - 1)] == levels[n][np.minimum(b + lcp, len(buf) - 1)])
    for _ in range(4):
        x, y = np.minimum(a + lcp, len(buf) - 1), np.minimum(b + lcp, len(buf) - 1)
        lcp += (buf[x] == buf[y]) & (lcp < np.minimum(length_left[a], length_left[b]))
    lcp = np.minimum(lcp, np.minimum(length_left[a], length_left[b]))
    return sa, lcp


def maximal_repeats(sa: np.ndarray, lcp: np.ndarray, left: np.ndarray, min_bytes: int):
    """(length, low, high) of the LCP intervals of at least ``min_bytes`` whose suffixes differ to the left.

    ``left``: the byte before each sorted suffix, or below zero where its span begins. The stack holds
    (length, low, left byte or -1 if several).
    """
    near = lcp >= min_bytes
    bounds = np.flatnonzero(np.diff(np.concatenate(([0], near.astype(np.int8), [0]))))
    begin, end = bounds[::2], bounds[1::2]  # suffixes begin .. end hang together
    out = []
    if not len(begin):
        return out
    # An interval all of whose suffixes follow the same byte holds none that is left-diverse.
    changes = np.concatenate(([0], np.cumsum((left[1:] != left[:-1]) | (left[1:] < 0) | (left[:-1] < 0))))
    diverse = changes[end] > changes[begin]
    pair = diverse & (end - begin == 1)
    for lo in begin[pair].tolist():
        out.append((int(lcp[lo]), lo, lo + 1))
    for lo, hi in zip(begin[diverse & ~pair].tolist(), end[diverse & ~pair].tolist()):
        lengths, bytes_left = lcp[lo:hi].tolist(), left[lo : hi + 1].tolist()
        stack: list[list] = []
        for i, length in enumerate([*lengths, 0]):
            low, kind = lo + i, bytes_left[i]
            if kind < 0:
                kind = -1
            while stack and stack[-1][0] > length:
                size, at, seen = stack.pop()
                # The suffix lo + i is the last of the interval.
                seen = seen if seen == kind and kind >= 0 else -1
                if seen < 0:
                    out.append((size, at, lo + i))
                low, kind = at, seen
            if stack and stack[-1][0] == length:
                stack[-1][2] = kind if stack[-1][2] == kind and kind >= 0 else -1
            elif length:
                stack.append([length, low, kind])
    return out



def _scan(body: np.ndarray, size: np.ndarray, doc: np.ndarray, first: np.ndarray, min_bytes: int):
    """Maximal repeats among adjacent spans, as (repeat number, length, doc, position) columns."""
    pad = 256
    # Four zeros after a span keep what follows it from deciding its suffixes' order.
    wide = size + 4
    start = np.cumsum(wide) - wide
    span = np.repeat(np.arange(len(size)), wide)
    within = np.arange(len(span)) - start[span]
    buf = np.zeros(len(span) + pad, np.uint8)
    buf[np.flatnonzero(within < size[span])] = body
    left_over = np.concatenate((np.maximum(size[span] - within, 0), np.zeros(pad, np.int64)))
    suffixes = np.flatnonzero(left_over[: len(span)] >= min_bytes)
    if len(suffixes) < 2:
        return None
    sa, lcp = suffix_array(buf, left_over, suffixes, min_bytes)
    before = np.where(within[sa] > 0, buf[sa - 1].astype(np.int64), -1)
    found = maximal_repeats(sa, lcp, before, min_bytes)
    if not found:
        return None
    length, low, high = np.array(found, np.int64).T
    count = high - low + 1
    number = np.repeat(np.arange(len(found)), count)
    member = sa[np.arange(len(number)) - np.repeat(np.cumsum(count) - count, count) + low[number]]
    return number, length[number], doc[span[member]], first[span[member]] + within[member]


_REPEAT = "repeat_id bigint, length bigint, doc bigint, pos bigint, first_doc bigint, first_pos bigint"
_SPAN = "key bigint, body binary, doc bigint, pos bigint, late_doc bigint, late_pos bigint, length bigint"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _batch(arrays, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], _names(schema))


def _occurrences(number, length, doc, pos, base: int) -> pa.RecordBatch:
    """Rows of one batch of repeats, each with the earliest occurrence of its repeat."""
    order = np.lexsort((pos, doc, number))
    number, length, doc, pos = number[order], length[order], doc[order], pos[order]
    head = np.maximum.accumulate(np.where(np.concatenate(([True], number[1:] != number[:-1])), np.arange(len(number)), 0))
    return _batch([number + base, length, doc, pos, doc[head], pos[head]], _REPEAT)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from zero) and bytes of a binary column."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and flat values of a list column without nulls."""
    return np.diff(np.asarray(column.offsets)), column.flatten().to_numpy(zero_copy_only=False)


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of pieces of ``data``, one after the other."""
    ends = np.cumsum(size)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]


def _marks(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pieces of ``data``."""
    body = _gather(data, start, size)
    at = np.cumsum(size) - size
    up, down = _powers_to(len(body) + 1)
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[: len(body)], out=sums[1:])
    return _mix((sums[at + size] - sums[at]) * down[at])


def _parts(rows: np.ndarray):
    for i in range(0, len(rows), STEP_SPANS):
        yield rows[i : i + STEP_SPANS]


def _steps(sizes: np.ndarray, at_most: int):
    """(from, to) of runs of items whose sizes add up to ``at_most``, or of one larger item."""
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + at_most, side="right")))
        yield i, j
        i = j


def _settled(data, start, doc, at, size, key):
    """Spans (bytes of ``data`` from ``start``, at ``at`` in ``doc``) as rows of ``_SPAN``: of equal ones only the
    earliest has a body, the others are pairs with it."""
    mark = np.concatenate([_marks(data, start[i : i + STEP_SPANS], size[i : i + STEP_SPANS]) for i in range(0, len(key), STEP_SPANS)])
    order = np.lexsort((at, doc, size, mark, key))
    key, doc, at, size, start, mark = (x[order] for x in (key, doc, at, size, start, mark))
    alike = np.concatenate(([False], (key[1:] == key[:-1]) & (size[1:] == size[:-1]) & (mark[1:] == mark[:-1])))
    head = np.maximum.accumulate(np.where(alike, 0, np.arange(len(key))))
    # The bytes decide, not the hash.
    for late in _parts(np.flatnonzero(alike)):
        differs = _gather(data, start[late], size[late]) != _gather(data, start[head[late]], size[late])
        alike[late] = ~np.logical_or.reduceat(differs, np.cumsum(size[late]) - size[late])
    # In the order of the texts, in which neighbours share most of their bytes: so they take little room on disk.
    alone = np.flatnonzero(~alike)
    for lone in _parts(alone[np.lexsort((at[alone], doc[alone]))]):
        ends = pa.py_buffer(np.concatenate(([0], np.cumsum(size[lone]))).astype(np.int32))
        body = pa.Array.from_buffers(pa.binary(), len(lone), [None, ends, pa.py_buffer(_gather(data, start[lone], size[lone]))])
        nulls = pa.nulls(len(lone), pa.int64())
        yield _batch([key[lone], body, doc[lone], at[lone], nulls, nulls, size[lone]], _SPAN)
    for late in _parts(np.flatnonzero(alike)):
        first = head[late]
        yield _batch([doc[late], pa.nulls(len(late), pa.binary()), doc[first], at[first], doc[late], at[late], size[late]], _SPAN)


class RepeatFinder:
    """Repeats of at least ``min_bytes`` bytes (100 to 150) among texts known by a unique ``doc`` number.

    ``texts``: doc bigint (ascending numbers are earlier) and data binary, neither of them null. Short texts and
    empty tables have no repeats; texts of any length are read in steps.
    """

    def __init__(self, texts: DataFrame, min_bytes: int = 100):
        # A span's windows, at most min_bytes - K + 1, are counted in seven bits.
        if not K < min_bytes <= K + 127:
            raise ValueError("min_bytes must be above the anchor's length and at most 127 above it")
        self.n = shuffle_partitions(texts.sparkSession)
        self.texts, self.min_bytes = texts, min_bytes

    def _anchors(self) -> DataFrame:
        """(doc, h, code): spans whose anchor occurs more than once."""
        least, step = self.min_bytes, STEP_BYTES

        def anchors(batches):
            for batch in batches:
                offsets, data = _binary(batch.column(1))
                docs = batch.column(0).to_numpy()
                for i, j in _steps(np.diff(offsets), step):
                    # A text longer than a step is read in pieces that share the bytes of one window less one.
                    for at in range(int(offsets[i]), max(int(offsets[i]) + 1, int(offsets[j]) - least + 1), step):
                        to = min(at + step + least - 1, int(offsets[j])) if j == i + 1 else int(offsets[j])
                        piece = np.clip(offsets[i : j + 1], at, to) - at
                        who, h, first, count = spans(data[at:to], piece[:-1], piece[1:], least)
                        if len(h):
                            yield docs[i:j][who], h, ((first + (at - offsets[i])) << _SHIFT) | count
                        if j > i + 1:
                            break

        return self._repeated(self.texts, anchors)

    def _repeated(self, rows: DataFrame, anchors) -> DataFrame:
        """(doc, h, code) of what ``anchors`` finds in the rows, less the anchors that occur once."""

        @frugal
        def emit(batches):
            # A task puts out one row for each of its anchors to be compared with the other tasks'. What
            # it has seen itself more than once needs no comparison and goes on under a spread key.
            held: list = []
            n = 0
            for part in anchors(batches):
                held.append(part)
                n += len(part[0])
                if n >= STEP_ROWS:
                    yield from settle(held)
                    held, n = [], 0
            yield from settle(held)

        def settle(held):
            if not held:
                return
            doc, h, code = (np.concatenate([p[i] for p in held]) for i in range(3))
            order = np.argsort(h, kind="stable")
            doc, h, code = doc[order], h[order], code[order]
            same = h[1:] == h[:-1]
            twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
            head = twice & np.concatenate(([True], ~same))
            # kind 0: alone here; 1: a sign that a task has it twice; 2: known to be repeated.
            for rows, kind, key in ((~twice, 0, h), (head, 1, h), (twice, 2, doc)):
                picked = np.flatnonzero(rows)
                for at in range(0, len(picked), 100_000):
                    p = picked[at : at + 100_000]
                    yield _batch([key[p], doc[p], h[p], code[p] * 4 + kind], "key, doc, h, code")

        @frugal
        def repeated(batches):
            carry = None
            for batch in batches:
                cols = [c.to_numpy() for c in batch.columns]
                if carry is not None:
                    cols = [np.concatenate((a, b)) for a, b in zip(carry, cols)]
                key = cols[0]
                ends = np.flatnonzero(key[1:] != key[:-1])
                last = int(ends[-1]) + 1 if len(ends) else 0
                carry = [c[last:] for c in cols]
                if last:
                    yield from choose(*(c[:last] for c in cols))
            if carry is not None and len(carry[0]):
                yield from choose(*carry)

        def choose(key, doc, h, code):
            kind = code & 3
            known = kind == 2
            i = np.flatnonzero(~known)
            same = h[i][1:] == h[i][:-1]
            several = np.concatenate((same, [False])) | np.concatenate(([False], same))
            keep = known.copy()
            keep[i[several & (kind[i] == 0)]] = True
            keep = np.flatnonzero(keep)
            if len(keep):
                yield _batch([doc[keep], h[keep], code[keep] >> 2], "doc, h, code")

        dealt = rows.mapInArrow(emit, "key bigint, doc bigint, h bigint, code bigint").repartition(self.n, "key")
        return dealt.sortWithinPartitions("key", "h").mapInArrow(repeated, "doc bigint, h bigint, code bigint")

    def _spans(self) -> DataFrame:
        """(key, body, doc, pos) of the earliest of equal spans of a batch; the others as pairs with it."""
        least = self.min_bytes
        found = materialise(self._anchors(), "anchors", compression="zstd")
        lists = found.groupBy("doc").agg(F.collect_list(F.struct("h", "code")).alias("s")).select("doc", "s.h", "s.code")

        @frugal
        def cut(batches):
            for batch in batches:
                offsets, data = _binary(batch.column(1))
                docs = batch.column(0).to_numpy()
                sizes, keys = _lists(batch.column(2))
                codes = _lists(batch.column(3))[1]
                upto = np.concatenate(([0], np.cumsum(sizes)))
                for i, j in _steps(sizes, SETTLE_SPANS):
                    owner, code = np.repeat(np.arange(i, j), sizes[i:j]), codes[upto[i] : upto[j]]
                    at = code >> _SHIFT
                    yield from _settled(data, offsets[owner] + at, docs[owner], at, (code & ((1 << _SHIFT) - 1)) + least - 1, keys[upto[i] : upto[j]])

        return self.texts.join(lists, "doc").select("doc", "data", "h", "code").mapInArrow(cut, _SPAN)

    def _windows(self, shared: DataFrame, k: int) -> DataFrame:
        """The spans of the windows among the spans ``shared`` by anchors of ``k`` bytes that occur twice or more."""
        least = self.min_bytes

        def anchors(batches):
            for batch in batches:
                for part in (batch.slice(i, STEP_SPANS // 8) for i in range(0, len(batch), STEP_SPANS // 8)):
                    doc, pos = part.column(2).to_numpy(), part.column(3).to_numpy()
                    offsets, body = _binary(part.column(1))
                    who, h, first, count = spans(body, offsets[:-1], offsets[1:], least, k)
                    if len(h):
                        yield doc[who], h ^ np.int64(k << 48), ((pos[who] + first) << _SHIFT) | count

        found = materialise(self._repeated(shared, anchors), "windows")
        lists = found.groupBy("doc").agg(F.collect_list(F.struct("h", "code")).alias("s")).select("doc", "s.h", "s.code")

        @frugal
        def cut(batches):
            for batch in batches:
                offsets, data = _binary(batch.column(0))
                docs, first, length = (batch.column(k).to_numpy() for k in (1, 2, 3))
                sizes, keys = _lists(batch.column(4))
                codes = _lists(batch.column(5))[1]
                upto = np.concatenate(([0], np.cumsum(sizes)))
                for i, j in _steps(sizes, SETTLE_SPANS):
                    owner, code = np.repeat(np.arange(i, j), sizes[i:j]), codes[upto[i] : upto[j]]
                    at, size = code >> _SHIFT, (code & ((1 << _SHIFT) - 1)) + least - 1
                    # A document's list has the windows of all its spans.
                    own = np.flatnonzero((at >= first[owner]) & (at + size <= first[owner] + length[owner]))
                    owner, at, size, key = owner[own], at[own], size[own], keys[upto[i] : upto[j]][own]
                    if len(own):
                        yield from _settled(data, offsets[owner] + at - first[owner], docs[owner], at, size, key)

        return shared.join(lists, "doc").select("body", "doc", "pos", "length", "h", "code").mapInArrow(cut, _SPAN)

    def repeats(self) -> DataFrame:
        """(repeat_id, length, doc, pos, first_doc, first_pos): every occurrence of the maximal repeats.

        The first occurrence is the one of least (doc, pos). A repeat is maximal within the spans it was found in, so
        a passage longer than a span comes in overlapping parts (see ``passages``), and copies of a span that met in
        one batch come as repeats of two.
        """
        least = self.min_bytes

        @frugal
        def scan(batches):
            from pyspark import TaskContext

            task = TaskContext.get()
            base = (task.partitionId() if task else 0) << 40
            held, size = [], 0
            for batch in batches:
                pair = batch.column(4).is_valid()
                pairs, rows = batch.filter(pair), batch.filter(pc.invert(pair))
                if len(pairs):
                    doc, pos, late_doc, late_pos, length = (pairs.column(k).to_numpy() for k in (2, 3, 4, 5, 6))
                    n = np.arange(len(pairs))
                    yield _occurrences(np.concatenate((n, n)), np.concatenate((length, length)), np.concatenate((doc, late_doc)), np.concatenate((pos, late_pos)), base)
                    base += len(pairs)
                if not len(rows):
                    continue
                held.append((rows.column(0).to_numpy(), *(rows.column(k).to_numpy() for k in (2, 3, 6)), _binary(rows.column(1))[1]))
                size += len(held[-1][-1])
                if size >= CHUNK:
                    key, doc, pos, length, body = (np.concatenate([h[k] for h in held]) for k in range(5))
                    edge = np.flatnonzero(key[1:] != key[:-1])
                    upto = int(edge[-1]) + 1 if len(edge) else 0
                    cut = int(length[:upto].sum())
                    for a, b in _whole_keys(key[:upto], length[:upto]):
                        lo, hi = int(length[:a].sum()), int(length[:b].sum())
                        rows = settle(key[a:b], doc[a:b], pos[a:b], length[a:b], body[lo:hi], base)
                        if rows is not None:
                            yield rows
                            base += len(rows)
                    held, size = [(key[upto:], doc[upto:], pos[upto:], length[upto:], body[cut:])], len(body) - cut
            if held:
                key, doc, pos, length, body = (np.concatenate([h[k] for h in held]) for k in range(5))
                rows = settle(key, doc, pos, length, body, base)
                if rows is not None:
                    yield rows

        def settle(key, doc, pos, length, body, base):
            # A span that is alone with its anchor by now repeats nothing.
            same = key[1:] == key[:-1]
            several = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
            if not len(several):
                return None
            start = np.cumsum(length) - length
            found = _scan(_gather(body, start[several], length[several]), length[several], doc[several], pos[several], least)
            return None if found is None else _occurrences(*found, base)

        def taken(on: bool):
            @frugal
            def run(batches):
                for batch in batches:
                    flag = pc.and_(pc.fill_null(batch.column(7), False), batch.column(1).is_valid())
                    yield pa.RecordBatch.from_arrays(batch.columns[:7], batch.schema.names[:7]).filter(flag if on else pc.invert(flag))

            return run

        spans_, done = materialise(self._spans(), "spans", compression="zstd"), []
        # Longer anchors first: few of their spans occur twice, and only these are looked at window by window.
        for k in (least - NEAR, least) if least - NEAR > K else (least,):
            counts = spans_.groupBy("key").agg(F.count("body").alias("n")).where(F.col("n") > REFINE_FROM)
            shared = materialise(counts.select("key", F.lit(True).alias("shared")), "shared_anchors")
            if not shared.limit(1).count():
                break
            flagged = spans_.join(checked_broadcast(shared), "key", "left").select(*_names(_SPAN), "shared")
            refined = materialise(flagged.mapInArrow(taken(True), _SPAN), "refined")
            done.append(flagged.mapInArrow(taken(False), _SPAN))
            spans_ = self._windows(refined, k)
            if k < least:
                spans_ = materialise(spans_, "refined_spans", compression="zstd")
        for part in done:
            spans_ = part.unionByName(spans_)
        dealt = spans_.repartition(self.n, "key").sortWithinPartitions("key")
        return dealt.mapInArrow(scan, _REPEAT)

    def passages(self) -> DataFrame:
        """(doc, pos, length, first_doc, first_pos): later occurrences whose parts are joined to whole passages.

        Parts join where they overlap or touch and repeat the same place at the same distance; the bytes of a row
        equal those at its first place. All rows of one first place and length are the occurrences of one passage.
        """
        late = self.repeats().where("doc <> first_doc OR pos <> first_pos")
        late = late.withColumn("lag", F.col("pos") - F.col("first_pos")).groupBy("doc", "first_doc", "lag", "pos").agg(F.max("length").alias("length"))
        along = Window.partitionBy("doc", "first_doc", "lag").orderBy("pos")
        reach = F.max(F.col("pos") + F.col("length")).over(along.rowsBetween(Window.unboundedPreceding, -1))
        island = F.sum(F.when(reach >= F.col("pos"), 0).otherwise(1)).over(along)
        joined = late.withColumn("island", island).groupBy("doc", "first_doc", "lag", "island")
        joined = joined.agg(F.min("pos").alias("pos"), F.max(F.col("pos") + F.col("length")).alias("end"))
        return joined.select("doc", "pos", (F.col("end") - F.col("pos")).alias("length"), "first_doc", (F.col("pos") - F.col("lag")).alias("first_pos"))

    def covered(self) -> DataFrame:
        """(doc, cover): bytes of later occurrences, as sorted disjoint [from, to) pairs."""

        @frugal
        def merge(batches):
            carry = None
            for batch in batches:
                cols = [c.to_numpy() for c in batch.columns]
                if carry is not None:
                    cols = [np.concatenate((a, b)) for a, b in zip(carry, cols)]
                edge = np.flatnonzero(cols[0][1:] != cols[0][:-1])
                last = int(edge[-1]) + 1 if len(edge) else 0
                carry = [c[last:] for c in cols]
                if last:
                    yield islands(*(c[:last] for c in cols))
            if carry is not None and len(carry[0]):
                yield islands(*carry)

        def islands(doc, pos, length):
            new = np.concatenate(([True], doc[1:] != doc[:-1]))
            shift = np.cumsum(new) << 40  # texts lie one after the other
            begin, end = pos + shift, np.maximum.accumulate(pos + length + shift)
            open_ = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1])))
            close = np.concatenate((open_[1:] - 1, [len(end) - 1]))
            pairs = np.stack((begin[open_] - shift[open_], end[close] - shift[open_]), axis=1).ravel()
            firsts = np.flatnonzero(new[open_])
            offsets = np.concatenate((2 * firsts, [len(pairs)])).astype(np.int32)
            return _batch([doc[open_[firsts]], pa.ListArray.from_arrays(pa.array(offsets), pa.array(pairs))], "doc, cover")

        late = self.repeats().where("doc <> first_doc OR pos <> first_pos").groupBy("doc", "pos").agg(F.max("length").alias("length"))
        dealt = late.repartition(self.n, "doc").sortWithinPartitions("doc", "pos")
        return dealt.mapInArrow(merge, "doc bigint, cover array<bigint>")


def _whole_keys(key: np.ndarray, length: np.ndarray):
    """(from, to) of runs of whole keys of about ``CHUNK`` bytes."""
    edges = np.concatenate((np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])) if len(key) else np.zeros(0, np.int64)
    upto = np.cumsum(length)
    a = 0
    while a < len(key):
        far = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CHUNK))
        b = int(edges[min(np.searchsorted(edges, far, side="left"), len(edges) - 1)])
        b = b if b > a else int(edges[np.searchsorted(edges, a, side="right")])
        yield a, b
        a = b


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 100) -> DataFrame:
    """(row, data, cover): the columns of ``docs`` but the text, its bytes, and those to remove, as [from, to) pairs.

    A byte is covered if a string of ``min_bytes`` bytes that holds it also starts earlier: in a row of smaller id,
    or further up in the same text; rows of one id, or without one (they come first), are taken in the order of a hash
    of their texts. Null and short texts have no cover; of repeated rows all but the first are covered whole. Ids may
    be of any type that can be sorted; columns may have any name. An empty table gives an empty one.
    """
    rows = numbered(docs, id_col, text_col)
    cover = materialise(RepeatFinder(rows.select("doc", "data"), min_bytes).covered(), "cover")
    none = F.expr("array()").cast("array<bigint>")
    return rows.join(cover, "doc", "left").select("row", "data", F.coalesce("cover", none).alias("cover"))


def kept_text(covered: DataFrame, columns: list[str], text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """The rows with what is left of their texts, in the order of ``columns``. A character cut in two goes.

    ``chars_col``, a column of whole numbers, gets the length of what is left. No row is dropped.
    """
    fields = {f.name: f.dataType for f in covered.schema["row"].dataType.fields}
    others = [c for c in columns if c not in (text_col, chars_col)]

    @frugal
    def run(batches):
        for batch in batches:
            texts = []
            for body, cover in zip(batch.column(0), batch.column(1).to_pylist()):
                body = memoryview(body.as_buffer())
                edges = [0, *cover, len(body)]
                texts.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2])).decode("utf-8", "ignore"))
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*made, *batch.columns[2:]], names)

    names = [f"_{i}" for i in range(2 + len(others))]
    schema = StructType([StructField("_0", StringType()), StructField("_1", LongType())] + [StructField(f"_{i + 2}", fields[c]) for i, c in enumerate(others)])
    picked = covered.select("data", "cover", *[covered["row"][c].alias(f"_{i + 2}") for i, c in enumerate(others)])
    made = picked.mapInArrow(run, schema)
    place = {text_col: F.col("_0")} | ({chars_col: F.col("_1").cast(fields[chars_col])} if chars_col else {}) | {c: F.col(f"_{i + 2}") for i, c in enumerate(others)}
    return made.select(*[place[c].alias(c) for c in columns])


def removal_digest(covered: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of rows with data and cover."""

    @frugal
    def run(batches):
        for batch in batches:
            rows = []
            for body, cover in zip(batch.column(1), batch.column(2).to_pylist()):
                body = memoryview(body.as_buffer())
                digest, at, removed = hashlib.sha256(), 0, 0
                for a, b in zip(cover[::2], cover[1::2]):
                    digest.update(body[at:a])
                    at, removed = b, removed + b - a
                digest.update(body[at:])
                rows.append((len(body), removed, len(cover) // 2, digest.hexdigest()))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = covered.schema["row"].dataType[id_col].dataType
    fields = [StructField("id", kind), *(StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")), StructField("kept_sha256", StringType())]
    return covered.select(covered["row"][id_col].alias("id"), "data", "cover").mapInArrow(run, StructType(fields))
