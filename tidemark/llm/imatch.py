"""I-Match document fingerprints over randomised lexicons.

The terms of a document whose document frequency lies in a chosen band are kept, sorted and hashed,
once for every randomised subset of the lexicon. Subsets come in ``RATES`` sizes, from a quarter of the
lexicon down, ``REPEATS`` of each, so that short and long documents both have subsets that hold a few of
their terms. Two fingerprints are as alike as the share of their informative subset hashes that agree.

Document frequencies are counted over all documents in a table of ``BUCKETS`` hashed terms, whose size
does not depend on the corpus.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, frugal, numbered, shuffle_partitions
from tidemark.llm.features import words_of

BUCKETS = 1 << 21
#: Share of the documents a kept term occurs in.
BAND = (5e-4, 3e-2)
#: Sizes of the lexicon subsets as powers of one half, and how many subsets have each size.
RATES = (2, 4, 6, 8, 10, 12)
REPEATS = 24
EMPTY = "----"
_BLOCK = 1 << 15
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_SEEDS = _mix(np.arange(1, REPEATS + 1, dtype=np.uint64) * _MIX)


def term_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's terms."""
    terms = set(words_of(text.encode())) if text else ()
    return np.sort(np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64, len(terms)))


def lexicon(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = BAND) -> np.ndarray:
    """Flags of the hashed terms whose document frequency lies in the band, from counts over all documents.

    Null and empty texts count as documents without terms; an empty table flags nothing that a document could have.
    """

    @frugal
    def count(batches):
        seen = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[np.unique(term_hashes(text) % np.uint64(BUCKETS)).astype(np.int64)] += 1
                seen[BUCKETS] += 1
        for at in range(0, BUCKETS, _BLOCK):
            part = seen[at : at + _BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at // _BLOCK]), pa.array([part.astype(np.int32).tobytes()], pa.binary())], ["block", "counts"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([seen[BUCKETS:].astype(np.int32).tobytes()], pa.binary())], ["block", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(counts, np.int32).astype(np.int64)
                total[block] = total[block] + part if block in total else part
        for block, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part.tobytes()], pa.binary())], ["block", "counts"])

    schema = "block bigint, counts binary"
    blocks = docs.select(col(text_col)).mapInArrow(count, schema)
    n = min(shuffle_partitions(docs.sparkSession), BUCKETS // _BLOCK)
    summed = {r[0]: np.frombuffer(bytes(r[1]), np.int64) for r in blocks.repartition(n, "block").mapInArrow(add, schema).collect()}
    n_docs = int(summed.pop(-1)[0]) if -1 in summed else 0
    flags = np.zeros(BUCKETS, bool)
    for block, counts in summed.items():
        flags[block * _BLOCK : block * _BLOCK + len(counts)] = (counts >= max(1, band[0] * n_docs)) & (counts <= max(1, band[1] * n_docs))
    return flags


def imatch(terms: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Subset hashes (RATES x REPEATS) of sorted term hashes; -1 where a subset holds none of them.

    A document without a term in the band uses all its terms.
    """
    kept = terms[flags[(terms % np.uint64(BUCKETS)).astype(np.int64)]]
    kept = kept if len(kept) else terms
    out = np.full((len(RATES), REPEATS), -1, np.int64)
    draws = _mix(kept[None, :] ^ _SEEDS[:, None])
    subset, term = np.nonzero(draws < np.uint64(1 << (64 - RATES[0])))
    draw = draws[subset, term]
    for i, rate in enumerate(RATES):
        inside = draw < np.uint64(1 << (64 - rate))
        subset, term, draw = subset[inside], term[inside], draw[inside]
        if not len(subset):
            break
        # The sorted terms of a subset are hashed in order: each with its rank among them.
        starts = np.flatnonzero(np.concatenate(([True], subset[1:] != subset[:-1])))
        rank = np.arange(len(subset)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(subset)]))))
        sums = np.add.reduceat(_mix(kept[term] + rank.astype(np.uint64) * _MIX), starts)
        out[i, subset[starts]] = (_mix(sums) >> np.uint64(48)).astype(np.int64)
    return out


def as_text(print_: np.ndarray) -> str:
    return "".join(EMPTY if x < 0 else f"{x:04x}" for x in print_.ravel().tolist())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal hashes among the subsets that hold a term of either text, at sizes small enough to leave some empty."""
    some = (a >= 0) | (b >= 0)
    informative = some & ~some.all(axis=1, keepdims=True)
    if not informative.any():
        informative = some
    n = int(informative.sum())
    return float(((a == b) & informative).sum() / n) if n else 1.0


def edited(text: str, following: str) -> str:
    """The last half replaced by as much of the beginning of the text that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints_with_next(docs: DataFrame, flags: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of the text edited with the next document's, and their likeness.

    Documents are taken in ascending id (null first, rows of one id by a hash of their texts), the first following the
    last. They are dealt out by ranges; the first row of a range also goes to the range before, so that no task needs
    more than its own rows and one. Null text is empty; whole texts of any length are read; equal texts have equal
    fingerprints; ids may be of any type that can be sorted; other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = numbered(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), "id", "text")
    own = rows.select("doc", rows["row"]["id"].alias("id"), F.col("data").cast("string").alias("text"))
    parts = 4 * shuffle_partitions(spark)
    cuts = [i / parts for i in range(1, parts)]
    smallest, bounds = own.agg(F.min("doc"), F.percentile_approx("doc", cuts, 20 * parts)).first()
    bounds = np.unique(np.array(bounds or [], np.int64))
    bounds = bounds[bounds > (smallest if smallest is not None else 0)]

    @frugal
    def deal(batches):
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            part = np.searchsorted(bounds, numbers, side="right")
            for guest, rows in ((False, np.arange(len(numbers))), (True, np.flatnonzero(np.isin(numbers, bounds) | (numbers == smallest)))):
                if len(rows):
                    to = part[rows] - 1 if guest else part[rows]
                    to = np.where(to < 0, len(bounds), to)
                    taken = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(np.full(len(rows), guest)), *taken.columns], ["part", "guest", "doc", "id", "text"])

    @frugal
    def run(batches):
        waiting = None  # the row whose next one is not seen yet: (part, id, text, fingerprint)
        for batch in batches:
            rows = []
            for part, guest, _, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if waiting is not None and waiting[0] != part:
                    waiting = None  # its guest has been used, or it was a guest
                if guest and waiting is None:
                    continue
                mark = imatch(term_hashes(text), flags)
                if waiting is not None:
                    _, k, t, m = waiting
                    new = edited(t, text)
                    mark_new = imatch(term_hashes(new), flags)
                    sha = hashlib.sha256(new.encode()).hexdigest()
                    rows.append((k, len(t), sha, as_text(m), as_text(mark_new), likeness(m, mark_new), likeness(m, mark)))
                waiting = None if guest else (part, key, text, mark)
            if rows:
                id_type = batch.column(3).type
                yield pa.RecordBatch.from_arrays([pa.array(c, t or id_type) for c, t in zip(zip(*rows), kinds)], names)

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    kind = docs.schema[id_col].dataType.simpleString()
    dealt = own.mapInArrow(deal, f"part bigint, guest boolean, doc bigint, id {kind}, text string")
    placed = dealt.repartition(shuffle_partitions(spark), "part").sortWithinPartitions("part", "guest", "doc")
    return placed.mapInArrow(run, f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
