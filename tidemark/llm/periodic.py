"""Periodic runs of words: every maximal stretch in which words a fixed distance apart are the same.

A batch of documents is laid out as one sequence of word numbers, each document between marks that occur once, so that
nothing matches across documents. Prefix doubling gives the suffix array and, on its way, equality classes of all
substrings of 1, 2, 4, ... words; by them the common extension of two places, ahead or backwards, takes steps of powers of two. The longest
previous factor of a place is its longer match with the two neighbours in the suffix array that start earlier; it
cuts each document into LZ blocks. A run that touches a block's border is found from there by extending both ways for each
period that two neighbouring blocks allow (Main). A run within a block has an earlier occurrence and is copied from
the buckets of runs by start.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import col, frugal

#: A run has at least so many words, and at least so many periods.
MIN_LENGTH, MIN_PERIODS = 24, 3
#: Words that share one suffix array; a longer document has one to itself.
BATCH_WORDS = 1 << 18
#: Rounds of pointer jumping before minima over powers of two take over.
JUMPS = 12

Run = tuple[int, int, int]  # start, length, period


def _heads(values: np.ndarray) -> np.ndarray:
    """Where a sorted array's value differs from the one before."""
    return np.concatenate(([True], values[1:] != values[:-1]))


def _spread(heads: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``values`` ascend; each head's value for all places up to the next head."""
    return np.maximum.accumulate(np.where(heads, values, 0))


def substring_classes(codes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(classes, suffix array). ``classes[k][i]`` is the same for two places iff their next 2^k codes are the same.

    The last code must occur once. A class is the place of its first suffix in the suffix array; only suffixes that share
    their class are sorted again.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    heads = _heads(codes[order])
    rank = np.empty(n, np.int64)
    rank[order] = _spread(heads, np.arange(n))
    classes, step = [rank], 1
    open_ = order[~(heads & np.append(heads[1:], True))]
    while len(open_):
        key = rank[open_] * n + rank[open_ + step]
        by_key = np.argsort(key, kind="stable")
        open_, heads = open_[by_key], _heads(key[by_key])
        old, place = rank[open_], np.arange(len(open_))
        place = old + place - _spread(_heads(old), place)
        rank = rank.copy()
        rank[open_] = _spread(heads, place)
        classes.append(rank)
        open_ = open_[~(heads & np.append(heads[1:], True))]
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return classes, suffixes


def common_extension(classes: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """How many codes from ``i`` and from ``j`` on are the same; with ``back`` how many up to and with ``i`` and ``j``."""
    length = np.zeros(len(i), np.int64)

    def same(k: int, pairs: np.ndarray) -> np.ndarray:
        a, b = i[pairs], j[pairs]
        if not back:
            return classes[k][a + length[pairs]] == classes[k][b + length[pairs]]
        less = length[pairs] + (1 << k) - 1
        inside = np.minimum(a, b) >= less
        return inside & (classes[k][np.maximum(a - less, 0)] == classes[k][np.maximum(b - less, 0)])

    alike, pairs = [], np.arange(len(i))
    for k in range(len(classes)):
        pairs = pairs[same(k, pairs)]
        if not len(pairs):
            break
        alike.append(pairs)
    for k in reversed(range(len(alike))):
        more = alike[k][same(k, alike[k])]
        length[more] += 1 << k
    return length


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """Of each place the nearest place before it with a smaller value, or -1. ``values`` are not negative and differ."""
    n = len(values)
    ended, near = np.append(values, -1), np.arange(-1, n - 1)
    left = np.arange(n)
    for _ in range(JUMPS):
        left = left[ended[near[left]] > values[left]]
        if not len(left):
            return near
        near[left] = near[near[left]]
    left = left[ended[near[left]] > values[left]]
    if len(left):
        lows = [values]  # lows[k][i]: the least of the 2^k values up to and with i
        while (1 << len(lows)) <= n:
            k = 1 << (len(lows) - 1)
            lows.append(np.concatenate((lows[-1][:k], np.minimum(lows[-1][k:], lows[-1][:-k]))))
        at = near[left]
        for k in reversed(range(len(lows))):
            skip = (at >= (1 << k) - 1) & (lows[k][np.maximum(at, 0)] > values[left])
            at = np.where(skip, at - (1 << k), at)
        near[left] = at
    return near


def longest_previous_factors(classes: list[np.ndarray], suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, source): of each place its longest match that starts earlier, and where that starts (-1: none)."""
    n = len(suffixes)
    length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    before = nearest_smaller(suffixes)
    after = n - 1 - nearest_smaller(suffixes[::-1])[::-1]
    for near, known in ((before, before >= 0), (after, after < n)):
        own, other = suffixes[known], suffixes[near[known]]
        shared = common_extension(classes, own, other)
        better = shared > length[own]
        length[own[better]], source[own[better]] = shared[better], other[better]
    return length, source


def _border_runs(classes: list[np.ndarray], starts: np.ndarray, lengths: np.ndarray, first: np.ndarray, last: np.ndarray, min_length: int, min_periods: int) -> np.ndarray:
    """Rows (start, end, period) of the runs that touch a block's border; ``first`` and ``last`` bound a border's document."""
    two = np.zeros(len(starts), np.int64)
    two[1:] = lengths[1:] + lengths[:-1]
    # A run that ends in a block starts less than a period before the block before it.
    most = np.maximum((two - 1) // (min_periods - 1), 0)
    least = np.maximum(min_length - two + 1, 1)
    count = np.maximum(most - least + 1, 0)
    border = np.repeat(np.arange(len(starts)), count)
    period = np.arange(len(border)) - np.repeat(np.cumsum(count) - count, count) + least[border]
    found = []
    for ahead in (True, False):
        b, p = starts[border], period
        inside = (b + p <= last[border]) if ahead else (b - p >= first[border])
        at, p, lo = b[inside], p[inside], first[border][inside]
        i = at if ahead else at - p
        forth = common_extension(classes, i, i + p)
        back = common_extension(classes, i - 1, i + p - 1, back=True)
        length = forth + back + p
        good = (length >= min_length) & (length >= min_periods * p) & (i - back >= lo)
        found.append(np.stack((i - back, i + p + forth - 1, p), 1)[good])
    return np.concatenate(found)


def _copied(runs: list[Run], blocks: list[tuple[int, int, int]]) -> list[Run]:
    """``runs`` as (start, end, period) with those that lie within a block (start, length, source) copied from its source."""
    buckets: dict[int, list[tuple[int, int]]] = {}
    for s, e, p in runs:
        buckets.setdefault(s, []).append((e, p))
    starts = sorted(buckets)
    for t, length, source in blocks:
        k, end, by = bisect_right(starts, source), source + length - 1, t - source
        while k < len(starts) and starts[k] < end:
            for e, p in buckets[starts[k]]:
                if e < end:
                    own = buckets.get(starts[k] + by)
                    if own is None:
                        insort(starts, starts[k] + by)
                        buckets[starts[k] + by] = [(e + by, p)]
                    elif (e + by, p) not in own:
                        own.append((e + by, p))
            k += 1
    return [(s, e, p) for s in starts for e, p in buckets[s]]


def runs_of(documents: list[np.ndarray], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[list[Run]]:
    """All runs (start, length, period) of each document, by start, then period. Documents are arrays of word numbers."""
    sizes = np.array([len(d) for d in documents], np.int64)
    total = int(sizes.sum()) + len(documents) + 1
    begin = np.cumsum(sizes + 1) - sizes  # a mark stands before each document and after the last
    out: list[list[Run]] = [[] for _ in documents]
    if total == len(documents) + 1:
        return out
    codes = np.empty(total, np.int64)
    mark = np.concatenate(([0], begin + sizes))
    codes[mark] = -1 - np.arange(len(mark))
    words = max((int(d.max()) + 1 for d in documents if len(d)), default=1)
    for k, (at, d) in enumerate(zip(begin, documents)):
        codes[at : at + len(d)] = d + k * words
    classes, suffixes = substring_classes(codes)
    length, source = longest_previous_factors(classes, suffixes)
    ahead, chain, at = (np.arange(total) + np.maximum(length, 1)).tolist(), [], 0
    while at < total:
        chain.append(at)
        at = ahead[at]
    starts = np.array(chain, np.int64)
    lengths = np.maximum(length[starts], 1)
    of = np.searchsorted(begin, starts, side="right") - 1  # the document that a border stands in or ends
    of = np.maximum(of, 0)
    found = _border_runs(classes, starts, lengths, begin[of], begin[of] + sizes[of], min_length, min_periods)
    if not len(found):
        return out
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    found = found[_heads(found[:, 0]) | _heads(found[:, 1])]  # multiples of the period have the same ends
    owner = np.searchsorted(begin, found[:, 0], side="right") - 1
    long_blocks = np.flatnonzero((lengths >= min_length + 2) & (source[starts] >= 0))
    block_owner = of[long_blocks]
    for k in np.unique(owner):
        own = long_blocks[np.searchsorted(block_owner, k) : np.searchsorted(block_owner, k, side="right")]
        blocks = list(zip(starts[own].tolist(), lengths[own].tolist(), source[starts[own]].tolist()))
        every = _copied([tuple(r) for r in found[owner == k].tolist()], blocks)
        out[k] = sorted(((s - int(begin[k]), e - s + 1, p) for s, e, p in every), key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Without the words that a run holds after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, n in zip(words, np.cumsum(edge[:-1]).tolist()) if not n]


def _batches(rows: Iterator[tuple[object, list[bytes]]]) -> Iterator[list[tuple[object, list[bytes]]]]:
    now, held = [], 0
    for row in rows:
        if now and held + len(row[1]) > BATCH_WORDS:
            yield now
            now, held = [], 0
        now.append(row)
        held += len(row[1])
    if now:
        yield now


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None, keep_text: bool = True) -> DataFrame:
    """One row per document: id, n_words, runs (array of start, length, period), text without the repeated periods.

    Words are what stands between ASCII white space; places count words from 0. ``rewrite`` may change a document's words
    before they are looked at. Without ``keep_text`` the texts are left out and ``collapsed_sha256`` alone is returned.
    A null or empty text has no word, no run and an empty collapsed text; ids may be null, repeated and of any type; rows that repeat
    give rows that repeat; an empty table gives an empty one; other columns are left out. A document is worked
    on in one piece, in memory of about 100 bytes a word and doubling step. No shuffle.
    """
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").cast("binary").alias("data"))
    run = "array<struct<start: bigint, length: bigint, period: bigint>>"
    fields = [f"n_words bigint, runs {run}", "collapsed string" if keep_text else "", "runs_sha256 string, collapsed_sha256 string"]
    schema = StructType([rows.schema["id"], *StructType.fromDDL(", ".join(f for f in fields if f)).fields])

    @frugal
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = None
        for batch in batches:
            if out_schema is None:
                from pyspark.sql.pandas.types import to_arrow_schema

                out_schema = to_arrow_schema(schema)
            split = ((k, (x.as_py() or b"").split()) for k, x in enumerate(batch.column("data")))
            if rewrite:
                ids = batch.column("id").to_pylist()
                split = ((k, rewrite(ids[k], words) if words else words) for k, words in split)
            for part in _batches(split):
                places, texts = [k for k, _ in part], [w for _, w in part]
                numbers = pd.factorize(np.array([x for w in texts for x in w] or [b""], dtype=object))[0]
                ends = np.cumsum([len(w) for w in texts])
                found = runs_of([numbers[e - len(w) : e] for w, e in zip(texts, ends.tolist())])
                kept = [b" ".join(collapsed(w, r) if r else w) for w, r in zip(texts, found)]
                listed = ["".join(f"{s},{n},{p}\n" for s, n, p in r) for r in found]
                columns = [
                    batch.column("id").take(pa.array(places)),
                    pa.array([len(w) for w in texts], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), x)) for x in r] for r in found], out_schema.field("runs").type),
                    *([pa.array([k.decode() for k in kept], out_schema.field("collapsed").type)] if keep_text else []),
                    *(pa.array([hashlib.sha256(x).hexdigest() for x in xs], out_schema.field("runs_sha256").type) for xs in ([x.encode() for x in listed], kept)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=out_schema)

    return rows.mapInArrow(work, schema)


def run_digest(runs: DataFrame) -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) from ``periodic_runs``."""
    # Of two runs the one with more periods: lengths and periods are whole numbers, compared by products.
    better = "CASE WHEN x.length * y.period <> y.length * x.period THEN x.length * y.period > y.length * x.period WHEN x.start <> y.start THEN x.start < y.start ELSE x.period < y.period END"
    best = F.expr(f"aggregate(runs, get(runs, 0), (x, y) -> CASE WHEN {better} THEN x ELSE y END)")
    return runs.withColumn("best", best).select(
        "id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col(f"best.{name}").alias(name) for name in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
