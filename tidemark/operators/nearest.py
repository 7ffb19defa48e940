"""The nearest vectors of other groups by cosine: every query against every vector, in tiles.

Vectors and queries are dealt out in blocks, and two blocks meet in one task as matrices. The product there only tells which pairs can be among
the best; these are summed again in the order of the components, so that ties are ties. Only the best of a tile leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a tile's sides, vectors that are multiplied at once, pairs that are summed again at once.
QUERIES, VECTORS, STEP, PAIRS = 1 << 13, 1 << 15, 512, 1 << 18


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks if len(c)]
    return np.concatenate(parts).reshape(-1, dim) if parts else np.empty((0, dim), np.float64)


def _ascending(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows by id, their ids, and a number for each label (-1 for none)."""
    table = table.sort_by(table.column_names[2])
    labels = table.column(4).combine_chunks().cast(pa.int64())
    return table, table.column(2).to_numpy(), labels


def _tile(asked: pa.Table, given: pa.Table, dim: int, k: int) -> pa.Table:
    """(q, vec_id, c, y) of the best ``k`` of the vectors of a tile for each of its queries."""
    asked, qs, q_labels = _ascending(asked)
    given, ids, v_labels = _ascending(given)
    known = {x: i for i, x in enumerate(dict.fromkeys(q_labels.to_pylist() + v_labels.to_pylist()))}
    ql, vl = (np.array([known[x] for x in labels.to_pylist()], np.int64) for labels in (q_labels, v_labels))
    a, b = _matrix(asked.column(3), dim), _matrix(given.column(3), dim)
    # Of equal vectors of one label only the k with the least ids can be among the best.
    whole = np.column_stack((b.astype(np.float64), vl.astype(np.float64))) + 0.0
    _, same = np.unique(whole.view(np.dtype((np.void, whole.shape[1] * 8))).ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    starts = np.flatnonzero(np.concatenate(([len(order) > 0], same[order][1:] != same[order][:-1]))[: len(order)])
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    kept = np.sort(order[place < k])
    # Within a step vectors of one label stand together.
    a, at, lab = a.astype(np.float64), kept, vl[kept]
    b = b[kept].astype(np.float64)
    by_label = np.argsort(ql, kind="stable")
    a, qs, ql = a[by_label], qs[by_label], ql[by_label]
    first, last = np.searchsorted(ql, np.arange(len(known))), np.searchsorted(ql, np.arange(len(known)), side="right")
    norms = lambda x: np.sqrt((x * x).sum(1))
    slack = 8 * (dim + 2) * 2.0**-53 * norms(a) * norms(b).max(initial=0.0)
    best, which = np.full((len(a), k), -np.inf), np.full((len(a), k), -1, np.int64)
    a_t, b_t = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)

    def take(rows: np.ndarray, cols: np.ndarray) -> None:
        exact = np.zeros(len(rows))
        for d in range(dim):
            exact += b_t[d][cols] * a_t[d][rows]
        exact = np.clip(exact, -1.0, 1.0)
        some = np.unique(rows)
        old = np.repeat(some, k)
        r, c, w = np.concatenate((old, rows)), np.concatenate((best[some].ravel(), exact)), np.concatenate((which[some].ravel(), cols))
        r, c, w = r[c > -np.inf], c[c > -np.inf], w[c > -np.inf]
        order = np.lexsort((w, -c, r))
        r, c, w = r[order], c[order], w[order]
        begins = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        rank = np.arange(len(r)) - np.repeat(begins, np.diff(np.append(begins, len(r))))
        r, c, w, rank = (x[rank < k] for x in (r, c, w, rank))
        best[r, rank], which[r, rank] = c, w

    for s in range(0, len(b), STEP):
        step = slice(s, min(s + STEP, len(b)))
        got = a @ b[step].T
        for label in np.unique(lab[step]):
            if first[label] < last[label]:
                got[first[label] : last[label], np.flatnonzero(lab[step] == label)] = -np.inf
        least = best[:, -1]
        floor = np.where(least > -1.0, least - slack, -np.inf)
        if got.shape[1] > k:
            # Until k are known the k-th best of the step stands for the least, by the product alone.
            rows = np.flatnonzero(least == -np.inf)
            if len(rows):
                here = np.partition(got[rows], got.shape[1] - k, axis=1)[:, got.shape[1] - k]
                here = np.minimum(here, 1.0)
                floor[rows] = np.where(here > -1.0, here - 2 * slack[rows], -np.inf)
        hits = np.flatnonzero((got >= floor[:, None]) & (got > -np.inf))
        for i in range(0, len(hits), PAIRS):
            rows, cols = np.divmod(hits[i : i + PAIRS], got.shape[1])
            take(rows, cols + s)
    rows, cols = np.nonzero(which >= 0)
    chosen = at[which[rows, cols]]
    return pa.table({"q": pa.array(qs[rows], pa.int64()), "vec_id": pa.array(ids[chosen], pa.int64()), "c": pa.array(best[rows, cols], pa.float64()), "y": given.column(5).take(pa.array(chosen)).cast(pa.int64())})


def cosine() -> F.Column:
    dot = F.aggregate(F.zip_with("v", "qv", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))


def nearest_of_others(vectors: DataFrame, queries: DataFrame, k: int, most_queries: int = QUERIES, most_vectors: int = VECTORS) -> DataFrame:
    """(q, vec_id, c, y): for each query candidates that hold its ``k`` nearest vectors of another label, ties by the least id.

    ``vectors``: vec_id (whole, not null), v (array of numbers), label and y (whole numbers or null); ``queries``: q, qv, ql. c is the sum of products in
    the order of the components, cut at -1 and 1; a null label is a label. Vectors that are null, hold a null or what is no number, or are not of the
    commonest length meet all others as SQL compares them: a null sum is 1.
    """
    sizes = vectors.where("v IS NOT NULL AND size(v) > 0").groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = sizes["dim"] if sizes else 1
    plain = lambda c: F.coalesce((F.size(c) == dim) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e100)), F.lit(False))
    n, odd = vectors.agg(F.count("*"), F.count(F.when(~plain("v"), 1))).first()
    m, odd_queries = queries.agg(F.count("*"), F.count(F.when(~plain("qv"), 1))).first()
    # Tiles enough to keep tasks busy where the table is small.
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v_blocks = max(-(-n // most_vectors), min(parts, -(-n // 4096)), 1)
    q_blocks = max(-(-m // most_queries), 1)
    home = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    label = lambda c: F.col(c).cast("bigint")
    asked = queries.where(plain("qv")).select(home("q", q_blocks).alias("i"), every(v_blocks).alias("j"), F.col("q").cast("bigint"), "qv", label("ql"))
    given = vectors.where(plain("v")).select(every(q_blocks).alias("i"), home("vec_id", v_blocks).alias("j"), F.col("vec_id").cast("bigint"), "v", label("label"), label("y"))
    given = given.toDF("vi", "vj", "vec_id", "v", "label", "y")
    met = asked.groupBy("i", "j").cogroup(given.groupBy("vi", "vj")).applyInArrow(lambda a, b: _tile(a, b, dim, k), "q bigint, vec_id bigint, c double, y bigint")
    if odd or odd_queries:
        others = F.expr("NOT label <=> ql")
        columns = [F.col("q").cast("bigint"), F.col("vec_id").cast("bigint"), cosine().alias("c"), label("y")]
        met = met.union(vectors.where(~plain("v")).join(queries, others).select(*columns)).union(vectors.where(plain("v")).join(queries.where(~plain("qv")), others).select(*columns))
    return met
