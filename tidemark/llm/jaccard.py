"""Exact links of texts whose sets of word shingles have a Jaccard similarity of at least 4/5.

Candidates come from two sides. SimHash fingerprints of the texts are joined on the segment-popcount grid
(``simhash.links``), which finds the close copies. What lies beyond the grid's reach is found by the sets themselves:
two sets of that similarity share a shingle among the first ``n - ceil(4n/5) + 1`` of each in any common order, and
``k`` of them among the first ``n - ceil(4n/5) + k``. The second form, in the order of a hash, leaves out most texts
at once; the first, in the order of the number of sets that hold a shingle (rarest first), makes cells of the others.
Every link is verified on the whole sets. Each set of a cell is verified against the cell's least one; cells that
this makes one class are settled; the others are cut in blocks, and the pairs of different classes of two blocks are
verified where they meet. Only links leave a task, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import checked_broadcast, col, frugal, materialise, shuffle_partitions
from tidemark.llm.graph import connected_components

#: The least similarity, as a fraction: whole numbers keep the test exact.
NUM, DEN = 4, 5
#: Blocks that shingles are dealt to by their high bits; a block tells them apart by their low 32 bits.
BLOCK_BITS = 10
#: A text's shingles are looked at first in a prefix longer by this part of them.
EXTRA = 6
#: Sets of a cell, or partners of a set, that go to one task together.
BLOCK = 256
#: Texts whose shingles are dealt out at once.
TEXTS_AT_ONCE = 1024


def _set_of(text: bytes | None, shingle: int) -> np.ndarray:
    return np.unique(simhash._shingle_hashes(text, shingle))


def _name(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64))


def _short(hashes: np.ndarray) -> np.ndarray:
    """Low bits and block of each shingle: a coarser name, under which two may fall together."""
    return np.unique((hashes & np.uint64(0xFFFFFFFF)) << np.uint64(BLOCK_BITS) | (hashes >> np.uint64(64 - BLOCK_BITS)))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    n = len(a) + len(b)
    if min(len(a), len(b)) * DEN < max(len(a), len(b)) * NUM:
        return False
    both = np.sort(np.concatenate((a, b)), kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared * (NUM + DEN) >= NUM * n


def _needed(n: int) -> int:
    """Shingles that must be shared by two similar sets, the smaller of which has n."""
    return -(-NUM * n // DEN)


def marks(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, th, name, n, m, fp): the name of a row's shingle set, its size, that of its coarser names, its fingerprint."""

    @frugal
    def run(batches):
        for batch in batches:
            new: list[list[int]] = [[], [], [], []]
            for text in batch.column(2).to_pylist():
                hashes = simhash._shingle_hashes(text, shingle)
                own = np.unique(hashes)
                for column, value in zip(new, (_name(own), len(own), len(_short(own)), int(simhash._bits(simhash._margins(hashes))[0]))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in new)], ["id", "th", "name", "n", "m", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(col(id_col).alias("id"), simhash.text_key(text_col).alias("th"), col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, f"id {kind}, th bigint, name bigint, n bigint, m bigint, fp bigint")


def _shared_shingles(texts: DataFrame, sets_of, prefix) -> DataFrame:
    """(name, key, df): the shingles that more than one set holds, by coarser name, with the number of sets.

    ``sets_of`` reads the sets of some rows; of each the ``prefix(n, m)`` least shingles are looked at.
    """

    @frugal
    def deal(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                sets = {_name(s): s for s in sets_of(batch.column(0).slice(at, TEXTS_AT_ONCE).to_pylist())}
                shorts = [_short(s) for s in sets.values()]
                shorts = [x[: prefix(len(s), len(x))] for s, x in zip(sets.values(), shorts)]
                keys = np.concatenate(shorts)
                names = np.repeat(np.fromiter(sets, np.int64, len(sets)), [len(s) for s in shorts])
                blocks = (keys & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int32)
                order = np.argsort(blocks, kind="stable")
                blocks, low, names = blocks[order], (keys[order] >> np.uint64(BLOCK_BITS)).astype(np.uint32), names[order]
                starts = np.flatnonzero(np.concatenate(([len(keys) > 0], blocks[1:] != blocks[:-1]))[: len(keys)])
                ends = np.append(starts[1:], len(keys))
                parts = [
                    pa.array(blocks[starts], pa.int32()),
                    pa.array([low[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    pa.array([names[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(parts, ["block", "low", "names"])

    def settle(block, low, names):
        low, names = np.concatenate(low), np.concatenate(names)
        order = np.lexsort((names, low))
        low, names = low[order], names[order]
        new = np.concatenate(([True], (low[1:] != low[:-1]) | (names[1:] != names[:-1])))
        low, names = low[new], names[new]
        starts = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        sizes = np.diff(np.append(starts, len(low)))
        df = np.repeat(sizes, sizes)
        some = df > 1
        keys = (np.int64(block) << np.int64(32)) | low[some].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(keys), pa.array(df[some].astype(np.int64))], ["name", "key", "df"])

    @frugal
    def count(batches):
        now, low, names = None, [], []
        for batch in batches:
            for block, a, b in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if block != now:
                    if now is not None:
                        yield settle(now, low, names)
                    now, low, names = block, [], []
                low.append(np.frombuffer(a, np.uint32))
                names.append(np.frombuffer(b, np.int64))
        if now is not None:
            yield settle(now, low, names)

    dealt = texts.mapInArrow(deal, "block int, low binary, names binary")
    placed = dealt.repartition(shuffle_partitions(texts.sparkSession), "block").sortWithinPartitions("block")
    return placed.mapInArrow(count, "name bigint, key bigint, df bigint")


def _promising(docs: DataFrame, firsts: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(name) of the sets that share enough of a longer prefix with other sets to have a similar one."""

    def longer(n: int, m: int) -> int:
        return min(m, n - _needed(n) + max(1, n // EXTRA))

    texts = docs.select(col(text_col).cast("binary").alias("text"))
    shared = _shared_shingles(texts, lambda rows: [_set_of(t, shingle) for t in rows], longer)
    found = shared.groupBy("name").agg(F.count("*").alias("k"))
    # A similar set has at least 4/5 of the size, so that it is the smaller one's longer prefix that counts.
    least = F.expr(f"greatest(1, least((n * {NUM} + {DEN - 1}) div {DEN} div {EXTRA}, m - n + (n * {NUM} + {DEN - 1}) div {DEN}))")
    return found.join(firsts.select("name", "n", "m"), "name").where(F.col("k") >= least).select("name")


def _cells(sizes: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, name): the prefix of every set, less the shingles of one set alone; these come first in it."""
    lists = shared.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("s"))
    prefix = F.expr(f"n - (n * {NUM} + {DEN - 1}) div {DEN} + 1 - (m - size(s))").cast("int")
    sized = lists.join(sizes, "name").select("name", "s", prefix.alias("p")).where("p > 0")
    return sized.select("name", F.explode(F.slice("s", 1, F.col("p"))).alias("x")).select("x.key", "name")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(name, hashes) of the rows (id, th) in ``wanted``, one of each set."""

    @frugal
    def run(batches):
        for batch in batches:
            sets = [_set_of(t, shingle) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["name", "hashes"])

    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("binary").alias("text"), simhash.text_key(text_col).alias("th"))
    same = F.expr("d.id <=> w.id AND d.th = w.th")
    picked = rows.alias("d").join(checked_broadcast(wanted.select("id", "th")).alias("w"), same, "left_semi")
    return picked.select("text").mapInArrow(run, "name bigint, hashes array<bigint>").dropDuplicates(["name"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of similar sets. A set that stands in very many pairs is dealt out with parts of them."""
    counted = pairs.groupBy("u").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    one = sets.join(counted, sets["name"] == counted["u"]).select("u", F.col("hashes").alias("a"), "parts", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
    two = pairs.join(sets, pairs["v"] == sets["name"]).join(counted, "u").select("u", "v", F.col("hashes").alias("b"), F.pmod(F.xxhash64("v"), F.col("parts")).alias("part"))
    shared = F.size(F.array_intersect("a", "b"))
    return two.join(one, ["u", "part"]).where(shared * (NUM + DEN) >= NUM * (F.size("a") + F.size("b"))).select("u", "v")


def _rest(named: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): the similar pairs of different classes that meet in a cell. ``named``: (key, name, root).

    Cells of the same members are looked at once. A cell is cut in blocks, and each pair of blocks is one group.
    """
    marks_ = [F.bit_xor(F.xxhash64("name", F.lit(k))).alias(f"mark_{k}") for k in (1, 2)]
    open_cells = named.groupBy("key").agg((F.min("root") < F.max("root")).alias("open"), F.count("*").alias("k"), *marks_).where("open")
    open_cells = open_cells.groupBy("k", "mark_1", "mark_2").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("k") / BLOCK).alias("blocks"))
    members = named.join(open_cells, "key").withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")))
    members = members.select("key", "name", "root", "block", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other"))
    group = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    rows = members.select(group.alias("group"), "block", (F.col("block") == F.col("other")).alias("own"), "name", "root").join(sets, "name")

    def walk(rows):
        forest = simhash._Forest()
        rows = sorted(rows, key=lambda r: len(r[4]))
        for i, (block, own, u, a, x) in enumerate(rows):
            for other, _, v, b, y in rows[i + 1 :]:
                if len(x) * DEN < len(y) * NUM:
                    break
                if (own or block != other) and forest.find(a) != forest.find(b) and similar(x, y):
                    forest.link(a, b)
                    yield u, v

    @frugal
    def run(batches):
        now, rows = None, []

        def done():
            found = list(walk(rows))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            ends, flat = np.asarray(batch.column(5).offsets), batch.column(5).values.to_numpy()
            for i, (group, *row) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(5)))):
                if group != now:
                    yield done()
                    now, rows = group, []
                rows.append((*row, flat[ends[i] : ends[i + 1]].copy()))
        yield done()

    placed = rows.select("group", "block", "own", "name", "root", "hashes").repartition(shuffle_partitions(named.sparkSession), "group")
    return placed.sortWithinPartitions("group").mapInArrow(run, "u bigint, v bigint")


def links(docs: DataFrame, firsts: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(u, v) names of sets: links whose closure is that of all pairs of at least that similarity.

    ``firsts``: (name, n, m, fp, id, th), one row for each set.
    """
    # Copies that SimHash finds: sets of one fingerprint, and of fingerprints within reach.
    standing = firsts.groupBy("fp").agg(F.min("name").alias("one"))
    alike = firsts.join(standing, "fp").where("name <> one").select(F.col("one").alias("u"), F.col("name").alias("v"))
    near = simhash.links(standing.select("fp"))
    a, b = (standing.select(F.col("fp").alias(x), F.col("one").alias("name_" + x)) for x in ("u", "v"))
    near = near.join(a, "u").join(b, "v").select(F.col("name_u").alias("u"), F.col("name_v").alias("v"))
    close = materialise(alike.union(near.where("u <> v")), "close")
    # Those it does not reach.
    promising = materialise(_promising(docs, firsts, text_col, shingle), "promising")
    nodes = promising.union(close.select("u")).union(close.select("v")).distinct()
    sets = materialise(_sets(docs, firsts.join(nodes, "name"), id_col, text_col, shingle), "sets")
    own = sets.join(promising, "name", "left_semi").select("hashes")
    shared = _shared_shingles(own, lambda rows: [np.array(h, np.int64).view(np.uint64) for h in rows], lambda n, m: m)
    cells = materialise(_cells(firsts.select("name", "n", "m"), shared), "cells")
    least = cells.groupBy("key").agg(F.min("name").alias("u"), F.count("*").alias("k")).where("k > 1")
    pairs = cells.join(least, "key").where("name <> u").select("u", F.col("name").alias("v"))
    first = materialise(_verified(pairs.union(close).distinct(), sets), "verified")
    roots = connected_components(first)
    named = cells.join(roots, cells["name"] == roots["node"], "left").select("key", "name", F.coalesce("root", "name").alias("root"))
    return first.union(_rest(materialise(named, "named"), sets))
