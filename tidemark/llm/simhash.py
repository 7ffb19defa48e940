"""SimHash near-duplicate classes through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits. The vector of the segments' bit counts lies
at a Manhattan distance no greater than the Hamming distance of the fingerprints, so a range join on
the vectors loses no link. The range join runs on a grid: the segments form ``groups`` groups and, as
at most ``max_distance`` of them can differ, every pair within reach agrees on the counts of some
``groups - max_distance`` of them. Each such subset is one family of grid cells. Inside a cell pairs
are tested first by the Manhattan bound, then exactly; only a spanning forest of the links leaves a
cell, never all pairs.

The grid needs a radius well below the number of segments: two texts whose word shingles have a Jaccard similarity
of 0.8 differ in 15 % of their bits, far beyond it. ``representatives`` therefore takes the grid's links as candidates
only, verifies them on the shingle sets and finds the rest by the sets themselves (``jaccard``).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, frugal, materialise, shuffle_partitions
from tidemark.llm.graph import connected_components

HASH_SEED = 42
SEGMENT_BITS = 2
LOW_BITS = 0x5555555555555555


def _shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included."""
    words = text.lower().split() if text else []
    if not words:
        return np.array([], np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(line, HASH_SEED)], dtype=np.uint64)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.concatenate(([0], gaps[: len(words) - shingle] + 1)).tolist()
    ends = np.concatenate((gaps[shingle - 1 :], [len(line)])).tolist()
    return np.array([digest(line[a:b], HASH_SEED) for a, b in zip(starts, ends)], dtype=np.uint64)


def _margins(hashes: np.ndarray) -> np.ndarray:
    """Set minus unset hashes for each of the 64 bits."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return 2 * counts - len(hashes)


def _bits(margins: np.ndarray) -> np.ndarray:
    return np.packbits((margins > 0).astype(np.uint8), axis=-1, bitorder="little").view(np.int64)


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """Majority bits of the XXH64 values of the word shingles, as a signed 64-bit integer."""
    return int(_bits(_margins(_shingle_hashes(text, shingle)))[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, th, fp): one row per input row, th being a hash of the text. Null and wordless texts get fingerprint zero."""

    @frugal
    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            fps = pa.array([fingerprint(t, shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], ["id", "th", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(col(id_col).alias("id"), text_key(text_col).alias("th"), col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, f"id {kind}, th bigint, fp bigint")


def text_key(text_col: str):
    return F.xxhash64(F.coalesce(col(text_col), F.lit("")))


def _unary(fp):
    """The 32 bit counts, each written in unary (00, 01, 11): XOR popcount is then the Manhattan distance."""
    high = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(high).bitwiseAND(F.lit(LOW_BITS))
    both = fp.bitwiseAND(high).bitwiseAND(F.lit(LOW_BITS))
    return some.bitwiseOR(F.shiftleft(both, 1))


def grid_masks(max_distance: int, groups: int) -> list[int]:
    """The bit mask of every subset of ``groups - max_distance`` segment groups."""
    edges = [round(i * (64 // SEGMENT_BITS) / groups) * SEGMENT_BITS for i in range(groups + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    out = [sum(pick) for pick in combinations(masks, groups - max_distance)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


class _Forest:
    """Union-find over the fingerprints one task has linked."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = up.setdefault(x, x)
        while up[root] != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _unary_np(fp: np.ndarray) -> np.ndarray:
    low, one = np.uint64(LOW_BITS), np.uint64(1)
    high = fp >> one
    return ((fp | high) & low) | (((fp & high) & low) << one)


def _near(fp: np.ndarray, un: np.ndarray, other: np.ndarray, other_un: np.ndarray, d: int) -> np.ndarray:
    """Rows of (rows, words) arrays within reach: Manhattan bound first, exact Hamming distance only where it holds."""
    hits = np.flatnonzero(_popcount(un ^ other_un) <= d)
    return hits[_popcount(fp[hits] ^ (other[hits] if other.ndim == 2 else other)) <= d]


def _popcount(x: np.ndarray) -> np.ndarray:
    """Set bits of each row; adding column by column is faster than a sum over a short axis."""
    n = np.bitwise_count(x[:, 0]).astype(np.int16)
    for k in range(1, x.shape[1]):
        n += np.bitwise_count(x[:, k])
    return n


def _walk_cell(fp: np.ndarray, d: int, forest: _Forest) -> None:
    """Spanning links of one large cell: breadth first, each step one vector operation."""
    rest, rest_un = fp.copy(), _unary_np(fp)
    while len(rest):
        queue, queue_un = [rest[0]], [rest_un[0]]
        rest, rest_un = rest[1:], rest_un[1:]
        while queue and len(rest):
            a, a_un = queue.pop(), queue_un.pop()
            hits = _near(rest, rest_un, a, a_un, d)
            if len(hits):
                for b in rest[hits, 0].tolist():
                    forest.link(int(a[0]), b)
                queue.extend(rest[hits])
                queue_un.extend(rest_un[hits])
                keep = np.ones(len(rest), bool)
                keep[hits] = False
                rest, rest_un = rest[keep], rest_un[keep]


#: Cells above this many fingerprints are walked breadth first instead of by pairwise offsets.
WIDE_CELL = 48


def _link_cells(cell: np.ndarray, fp: np.ndarray, d: int, forest: _Forest) -> None:
    """Whole cells, rows of a cell adjacent: links every pair within ``d`` into the forest."""
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(cell)])))
    for s, n in zip(starts[sizes > WIDE_CELL].tolist(), sizes[sizes > WIDE_CELL].tolist()):
        _walk_cell(fp[s : s + n], d, forest)
    size_of = np.repeat(sizes, sizes)
    keep = (size_of > 1) & (size_of <= WIDE_CELL)
    cell, fp = cell[keep], fp[keep]
    un = _unary_np(fp)
    for off in range(1, WIDE_CELL):
        if off >= len(cell):
            break
        same = np.flatnonzero(cell[off:] == cell[:-off])
        if not len(same):
            break
        hits = _near(fp[same], un[same], fp[same + off], un[same + off], d)
        for i in same[hits].tolist():
            forest.link(int(fp[i, 0]), int(fp[i + off, 0]))


#: Fingerprints that the commonest cell may be expected to hold; more groups make smaller cells.
CELL = 20_000


def groups_for(n: int, max_distance: int) -> int:
    """Groups under which the commonest of the cells of ``n`` fingerprints holds about ``CELL``, in steps of two.

    A cell fixes the counts of a share of the 32 segments, the commonest count of a segment has one half of all
    fingerprints. Every choice finds every link.
    """
    groups = max_distance + 2
    while groups < 2 * max_distance + 4 and n > CELL * 2 ** ((64 // SEGMENT_BITS) * (groups - max_distance) // groups):
        groups += 2
    return groups


def links(distinct: DataFrame, max_distance: int = 4, groups: int | None = None) -> DataFrame:
    """(fp) distinct fingerprints to (u, v): links whose closure is that of all pairs within reach."""
    masks = grid_masks(max_distance, groups or groups_for(distinct.count(), max_distance))
    cells = (
        distinct.select("fp", _unary(F.col("fp")).alias("un"))
        .select("fp", F.posexplode(F.array(*[F.col("un").bitwiseAND(F.lit(m)) for m in masks])).alias("family", "counts"))
        .select(F.xxhash64("family", "counts").alias("cell"), "fp")
    )

    return _link_within(cells, 1, max_distance)


def _link_within(cells: DataFrame, words: int, d: int) -> DataFrame:
    """(cell, fp, ...) to the spanning links of every cell's pairs within ``d`` bits."""

    @frugal
    def run(batches):
        forest = _Forest()
        cell, fp = np.array([], np.int64), np.empty((0, words), np.uint64)
        for batch in batches:
            cell = np.concatenate((cell, batch.column(0).to_numpy()))
            new = np.stack([batch.column(1 + k).to_numpy().view(np.uint64) for k in range(words)], axis=1)
            fp = np.concatenate((fp, new))
            ends = np.flatnonzero(cell[1:] != cell[:-1])
            last = int(ends[-1]) + 1 if len(ends) else 0
            if last:
                _link_cells(cell[:last], fp[:last], d, forest)
                cell, fp = cell[last:], fp[last:]
        if len(cell):
            _link_cells(cell, fp, d, forest)
        nodes = list(forest.up)
        for at in range(0, len(nodes), 100_000):
            part = nodes[at : at + 100_000]
            u = np.array(part, np.uint64).view(np.int64)
            v = np.array([forest.find(x) for x in part], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    placed = cells.repartition(shuffle_partitions(cells.sparkSession), "cell").sortWithinPartitions("cell")
    return placed.mapInArrow(run, "u bigint, v bigint")


def near_duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_distance: int = 4, groups: int | None = None
) -> DataFrame:
    """(id, fp, component_id): component_id is the least id reachable over links of at most ``max_distance`` bits.

    Null and wordless texts share fingerprint zero and are linked like any other. Equal texts and
    repeated rows share a class. A null id is never the least id unless its whole class has none. Long
    texts are read whole. Extra columns are ignored; an empty table gives an empty one.
    """
    return _classes(docs, id_col, text_col, shingle, max_distance, groups).select("id", "fp", "component_id")


#: Tasks that the members of one class are dealt to when they learn its least id.
CLASS_SALTS = 16


def _classes(docs, id_col, text_col, shingle, max_distance, groups) -> DataFrame:
    marked = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    found = links(marked.select("fp").distinct(), max_distance, groups)
    return labelled(marked, "fp", found).drop("first_th")


def labelled(marked: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """``marked`` (id, th and others) with component_id and first_th: the least id of a row's class and the text hash
    that goes with it. ``found``: links (u, v) between values of ``key``."""
    counted = marked.groupBy(key).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("first"), F.count("*").alias("rows"))
    distinct = materialise(counted, "distinct")
    roots = connected_components(found)
    rooted = distinct.join(roots, distinct[key] == roots["node"], "left").select(key, "first", "rows", F.coalesce("root", key).alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("n")).where("n > 1")
    spread = least.select("root", "least", F.explode(F.expr(f"sequence(0L, {CLASS_SALTS - 1}L)")).alias("salt"))
    salted = rooted.select(key, "first", "rows", "root", _salt(key))
    best = F.coalesce("least", "first")
    classes = salted.join(spread, ["root", "salt"], "left").select(key, "rows", best["id"].alias("component_id"), best["th"].alias("first_th"))
    # Keys of more rows than a task's share are dealt out too. There are no more of them than CLASS_SALTS to a task.
    tasks = CLASS_SALTS * shuffle_partitions(marked.sparkSession)
    share = F.ceil(F.lit((distinct.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] + 1) / tasks))
    hot = F.broadcast(distinct.where(F.col("rows") > share).select(key, F.lit(True).alias("hot")))
    dealt = marked.join(hot, key, "left").withColumn("salt", F.when(F.col("hot"), _salt("id")).otherwise(F.lit(0).cast("bigint"))).drop("hot")
    salts = F.when(F.col("rows") > share, F.expr(f"sequence(0L, {CLASS_SALTS - 1}L)")).otherwise(F.expr("array(0L)"))
    classes = classes.select(key, "component_id", "first_th", F.explode(salts).alias("salt"))
    return dealt.join(classes, [key, "salt"]).drop("salt")


def _salt(name: str):
    return F.pmod(F.xxhash64(name), F.lit(CLASS_SALTS).cast("bigint")).alias("salt")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` of which each stands for its class: the one of least id. Repeated rows stay once.

    Texts are linked where the sets of their word shingles have a Jaccard similarity of at least 0.8, every such
    pair and no other; a class is what these links reach. SimHash fingerprints find the close copies, the sets
    themselves what lies beyond the fingerprints' reach (``jaccard``). Null and wordless texts are one class, a null
    id stands for a class only where the class has no other, and of rows with one id and different texts each is
    taken for itself. Columns may have any name; an empty table gives an empty one.
    """
    from tidemark.llm import jaccard

    marked = materialise(jaccard.marks(docs, id_col, text_col, shingle), "sets_of_rows")
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("one")
    firsts = marked.groupBy("name").agg(one, F.first("n").alias("n"), F.first("m").alias("m"), F.min("fp").alias("fp"))
    firsts = materialise(firsts.select("name", "n", "m", "fp", "one.id", "one.th"), "sets")
    found = materialise(jaccard.links(docs, firsts, id_col, text_col, shingle), "links")
    classes = labelled(marked.select("id", "th", "name"), "name", found)
    stays = materialise(classes.where("id <=> component_id AND th = first_th").groupBy("id", "th").agg(F.count("*").alias("n")), "stays")
    # The user's columns travel as one, so that no name of theirs meets one of ours.
    packed = docs.select(F.struct(*map(col, docs.columns)).alias("row"), col(id_col).alias("id"), text_key(text_col).alias("th"))
    kept = packed.alias("d").join(stays.alias("k"), F.expr("d.id <=> k.id AND d.th = k.th"), "left_semi")
    if stays.where("n > 1").limit(1).count():
        kept = kept.dropDuplicates(["id", "th"])
    return kept.select(*[kept["row"][c].alias(c) for c in docs.columns])
