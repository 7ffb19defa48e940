"""What the findings of round 4 found: each of these failed, or took far too long, before."""

import math
import random

import duckdb
import pyarrow as pa
import pytest

from tidemark.operators import frames, nearest, novelty
from tidemark.plans import catalog
from tidemark.sources import pages
from tidemark.storage import materialise


def _against_sql(spark, folder, name, tables):
    """The rows of a query on ``folder`` and those of its SQL, sorted."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, str(folder))
    theirs = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLES[name]}) x").fetchall()
    order = lambda rows: sorted((tuple(r) for r in rows), key=str)
    return order(got.collect()), order(theirs)


def test_a_cut_between_neighbouring_numbers_is_that_of_the_sql(spark, tmp_path):
    """Of 44 margins the cut lies between 0.9986 and a number two units in the last place above it."""
    values = [50.0] * 34 + [0.07, 99.93] + [150.0] * 8
    rows = spark.createDataFrame(list(enumerate(values)), "event_id bigint, value double")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    ours, theirs = _against_sql(spark, tmp_path, "gate_quantile", ["events"])
    assert ours == theirs and sum(r[2] for r in ours) == 10


def test_two_hops_take_a_nodes_own_share_from_its_nation(spark, tmp_path):
    """Suppliers alone in a nation, without a nation, without a balance, and one key in two nations."""
    rows = [(1, 1, 10.0), (2, 1, 25.5), (3, 1, None), (4, 2, 7.25), (5, None, 1.0), (7, 3, 2.0), (7, 4, 4.5), (9, 3, -3.0), (10, 4, 8.0), (12, 5, None), (13, 5, None)]
    spark.createDataFrame(rows, "s_suppkey bigint, s_nationkey bigint, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    ours, theirs = _against_sql(spark, tmp_path, "two_hop_propagation", ["supplier"])
    assert ours == theirs
    plan = catalog.QUERIES["two_hop_propagation"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "s_nationkey" in plan and "NOT (s_suppkey" not in plan  # no pair of a nation's suppliers is made


def test_time_frames_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.choice([None, *range(-60, 90)]), rng.choice([None, 0.1, 0.25, 1e12, -3.5, rng.random()])) for i in range(400)]
    rows += [(i, "nan", i, v) for i, v in enumerate([1.0, float("nan"), 2.0, float("inf"), 3.0, float("-inf")], 1000)]
    span = 17
    got = frames.time_frames(spark.createDataFrame(rows, "id int, k string, t int, v double"), "k", "t", "v", span).collect()
    assert sorted(r["id"] for r in got) == sorted(r[0] for r in rows)
    great = lambda x: (math.isnan(x), x)
    for r in got:
        seen = [v for _, k, t, v in rows if k == r["k"] and v is not None and (t is None if r["t"] is None else t is not None and r["t"] - span <= t <= r["t"] - 1)]
        assert r["n"] == len(seen)
        assert repr(r["low"]) == repr(min(seen, key=great, default=None)) and repr(r["high"]) == repr(max(seen, key=great, default=None))
        assert r["mean"] is None if not seen else r["mean"] == pytest.approx(sum(seen) / len(seen), rel=1e-12, nan_ok=True)


def test_nearest_of_others_equals_sql_on_copies_and_odd_vectors(spark, tmp_path):
    """Copies tie and the least ids win; null vectors have a cosine of 1; some labels are null."""
    rng = random.Random(9)
    some = [[rng.choice([-0.5, 0.1, 0.3, 0.7]) for _ in range(6)] for _ in range(30)]
    rows = [(i, [float(x) for x in rng.choice(some)], rng.choice([0, 1, 2, 3, None])) for i in range(400)] + [(400, None, 1), (420, [0.0] * 6, 2)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    ours, theirs = _against_sql(spark, tmp_path, "cosine_topk_softmax", ["embeddings"])
    assert ours == theirs


def test_nearest_of_others_over_many_tiles(spark):
    rng = random.Random(10)
    rows = [(i, [rng.gauss(0, 0.5) for _ in range(5)], rng.randrange(3), i % 2) for i in range(700)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, v array<double>, label int, y bigint")
    queries = vectors.where("vec_id % 7 = 0").selectExpr("vec_id AS q", "v AS qv", "label AS ql")
    got = {}
    for r in nearest.nearest_of_others(vectors, queries, 4, 30, 90).collect():
        got.setdefault(r["q"], []).append((-r["c"], r["vec_id"]))
    for q, v, label, _ in rows[::7]:
        want = sorted((-max(-1.0, min(1.0, sum(x * y for x, y in zip(w, v)))), i) for i, w, other, _ in rows if other != label)[:4]
        assert [i for _, i in sorted(got[q])[:4]] == [i for _, i in want]


def test_table_cells_leave_a_worker_in_small_batches():
    page = "<table>" + "<tr><td>a<td>b</tr>" * 100 + "</table>"
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array([page] * 199 + [None])], ["id", "html"])
    got = list(pages._cells_of(iter([batch])))
    assert max(b.num_rows for b in got) <= pages.CELLS_AT_ONCE and sum(b.num_rows for b in got) == 199 * 200
    assert {i for b in got for i in b.column(0).to_pylist()} == set(range(199))


def test_novelty_deals_out_few_blocks(spark, monkeypatch):
    """Two thousand rows of one key within one window were eight blocks and 36 pairs of them; a long row counts for more."""
    made = {}
    monkeypatch.setattr(novelty, "materialise", lambda df, label, **o: made.setdefault(label, materialise(df, label, **o)))
    rows = spark.range(2000).selectExpr("id", "'k' AS k", "id AS t", "array(CAST(id % 7 AS STRING)) AS w")
    novelty.greatest_likeness(rows, "id", "k", "t", "w", {"s": 10_000})
    assert made["pairs"].count() == 1
    long = spark.range(600).selectExpr("id", "'k' AS k", "id AS t", "transform(sequence(1, 2560), x -> CAST(x AS STRING)) AS w")
    made.clear()
    novelty.greatest_likeness(long, "id", "k", "t", "w", {"s": 10_000})
    assert made["blocks"].select("block").distinct().count() == 2


@pytest.mark.parametrize("block", [3, 4096])
def test_near_copies_equal_brute_force(spark, block):
    rng = random.Random(14)
    base = [rng.sample([f"w{i}" for i in range(60)], 12) for _ in range(8)]
    change = lambda words, n: sorted({*words[n:], *(f"x{rng.randrange(9)}" for _ in range(n))})
    rows = []
    for i in range(160):
        short = change(rng.choice(base), rng.choice([0, 0, 1]))
        rows.append((i, rng.choice("ab"), rng.randrange(60), [] if i % 40 == 0 else short, short + change(base[i % 3], 2), i % 19 == 0))
    got = novelty.near_copies(spark.createDataFrame(rows, "uid bigint, key string, t int, short array<string>, long array<string>, bare boolean").selectExpr("uid", "key", "t", "short", "array_distinct(long) AS long", "bare"), 20, 0.88, 0.72, block).collect()
    like = lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) if a and b else 0.0
    want = {}
    for u, k, t, s, w, bare in rows:
        for v, l, r, z, x, also in rows:
            if k == l and ((t, u) < (r, v)) and r - t <= 20 and like(s, z) >= 0.88 and (like(w, x) >= 0.72 or bare or also):
                want[u, v] = (like(s, z), like(w, x))
    assert len(got) == len(want) and {(r["u"], r["v"]): (r["short_j"], r["long_j"]) for r in got} == want and len(want) > 50
