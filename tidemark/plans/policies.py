"""Splits, priors, retrieval, queues, audits and gates as plans with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import graph, joins, nearest, ordered, sequential
from tidemark.plans.dialect import VIEWS, S, statement
from tidemark.session import load

DAY = 86_400_000_000
MINUTE = 60_000_000


# Checked joins.
def checked_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    region = load(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    first = joins.checked_join(load(spark, sf_dir, "customer"), nation, ["c_nationkey"], "left", "m:1")
    return joins.checked_join(first, region, ["n_regionkey"], "left", "m:1").select("c_custkey", "c_mktsegment", "n_name", "r_name")


CHECKED_LEFT_SQL = """SELECT c.c_custkey, c.c_mktsegment, n.n_name, r.r_name FROM customer c
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"""


def checked_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    return joins.checked_join(docs, load(spark, sf_dir, "labels"), ["doc_id"], "inner", "1:1").select("doc_id", "source", "quality", "toxic")


CHECKED_INNER_SQL = "SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)"


# Split manifest: orders as events, one customer's orders within seven days belong together, as do those of one price.
def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, component, block, fold): components are cut into blocks that no component crosses, blocks into five folds."""
    rows = ordered.ordered(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.expr(S.us("o_orderdate")).alias("t")), ["t", "o_orderkey"], number="place")
    rows = rows.withColumn("node", F.col("place"))
    near = F.lag(F.struct("node", "t")).over(_window("o_custkey", "t", "node"))
    by_ticker = rows.withColumn("before", near).where(f"t - before.t <= {7 * DAY}").select(F.col("before.node").alias("a"), F.col("node").alias("b"))
    groups = rows.groupBy("o_custkey", "o_totalprice").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("a", "b")
    roots = graph.components(by_ticker.union(groups))
    rows = rows.join(roots, "node", "left").withColumn("component", F.coalesce("root", "node"))
    spans = rows.groupBy("component").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("n_rows").alias("n_rows"))
    # Blocks are islands of overlapping spans along the one order of places; places are dealt out in ranges of days.
    cover = spans.where("hi > lo").select("lo", "hi")
    marks = cover.select(F.col("lo").alias("node"), F.lit(1).alias("open")).union(cover.select(F.col("hi").alias("node"), F.lit(-1).alias("open")))
    depth = ordered.ordered(marks.groupBy("node").agg(F.sum("open").alias("step"), F.max(F.when(F.col("open") == 1, 1).otherwise(0)).alias("opens")), ["node"], {"depth": "step"}, number="at")
    starts = depth.where("depth - step = 0 AND opens = 1").select("node").union(rows.join(depth.where("depth > 0 OR step < 0").select("node"), "node", "left_anti").select("node"))
    inside = ordered.ordered(
        rows.select("node", "o_orderkey", "component", "n_rows").join(depth.select("node", "step"), "node", "left").join(starts.withColumn("begin", F.lit(1)), "node", "left"),
        ["node"], {"within": F.coalesce("step", F.lit(0))}, number="again", total="all_rows",
    )
    # A node begins a block where nothing is open before it.
    inside = inside.withColumn("begins", ((F.col("within") - F.coalesce("step", F.lit(0))) == 0).cast("int"))
    blocks = ordered.ordered(inside.select("node", "o_orderkey", "component", "n_rows", "begins"), ["node"], {"block": "begins"}, number="third", total="rows_again")
    sizes = blocks.groupBy("block").agg(F.min("node").alias("first"), F.count("*").alias("size"))
    fold = F.least(F.lit(4), F.floor((F.col("first") - 1 + F.col("size") / 2) * 5 / F.col("n_rows"))).cast("bigint")
    return blocks.join(sizes, "block").select("o_orderkey", F.col("component"), F.col("first").alias("block"), fold.alias("fold"))


def _window(key: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


SPLIT_SQL = f"""
WITH RECURSIVE o AS (SELECT o_orderkey, o_custkey, o_totalprice, epoch_us(o_orderdate) AS t, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS node, count(*) OVER () AS n_rows FROM orders),
l AS (SELECT node, o_custkey, CASE WHEN t - lag(t) OVER w <= {7 * DAY} THEN 0 ELSE 1 END AS cut FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY t, node)),
r AS (SELECT node, o_custkey, sum(cut) OVER (PARTITION BY o_custkey ORDER BY node) AS run FROM l),
g AS (SELECT DISTINCT r.o_custkey, r.run, o.o_totalprice FROM r JOIN o USING (node)),
e AS (SELECT DISTINCT a.o_custkey, a.run AS x, b.run AS y FROM g a JOIN g b ON a.o_custkey = b.o_custkey AND a.o_totalprice = b.o_totalprice),
reach AS (SELECT o_custkey, x AS run, y AS other FROM e UNION SELECT reach.o_custkey, run, y FROM reach JOIN e ON e.o_custkey = reach.o_custkey AND e.x = other),
m AS (SELECT o_custkey, run, min(other) AS least FROM reach GROUP BY 1, 2),
c AS (SELECT r.node, min(r.node) OVER (PARTITION BY r.o_custkey, m.least) AS component, max(r.node) OVER (PARTITION BY r.o_custkey, m.least) AS hi FROM r JOIN m USING (o_custkey, run)),
b AS (SELECT node, component, CASE WHEN max(hi) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= node THEN 0 ELSE 1 END AS begins FROM c),
k AS (SELECT node, component, sum(begins) OVER (ORDER BY node) AS block FROM b), s AS (SELECT block, min(node) AS first, count(*) AS size FROM k GROUP BY block)
SELECT o_orderkey, component, first AS block, least(4, CAST(floor((first - 1 + size / 2) * 5 / n_rows) AS BIGINT)) AS fold FROM k JOIN s USING (block) JOIN o USING (node)"""


def cosine_topk(spark: SparkSession, sf_dir: str, k: int = 5, temperature: float = 0.1, strength: float = 2.0) -> DataFrame:
    """Of every twentieth vector the five nearest of other labels, weighted by a softmax and shrunk to the prior.

    Blocks of queries and of vectors meet in tiles, each of which keeps the best ``k`` of a query.
    """
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"), "label", (F.col("label") % 2).alias("y"))
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("v").alias("qv"), F.col("label").alias("ql"))
    pairs = nearest.nearest_of_others(vectors, queries, k)
    rank = F.row_number().over(_window("q", F.desc("c"), "vec_id"))
    best = pairs.withColumn("k", rank).where(F.col("k") <= k)
    weighed = best.withColumn("w", F.exp((F.col("c") - F.max("c").over(_all("q"))) / temperature))
    prior = vectors.agg(F.avg(F.col("label") % 2).alias("prior"))
    found = weighed.groupBy("q").agg(F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum("w").alias("w"), F.round(F.max("c"), 6).alias("top"))
    return found.crossJoin(F.broadcast(prior)).select("q", "top", F.round((F.col("wy") + strength * F.col("prior")) / (F.col("w") + strength), 6).alias("probability"))


def _all(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key)


COSINE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings), q AS (SELECT vec_id AS q, v AS qv, label AS ql FROM v WHERE vec_id % 20 = 0),
p AS (SELECT q, vec_id, greatest(-1.0, least(1.0, list_dot_product(v, qv))) AS c, label % 2 AS y FROM v JOIN q ON label IS DISTINCT FROM ql),
b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, vec_id) AS k FROM p), w AS (SELECT *, exp((c - max(c) OVER (PARTITION BY q)) / 0.1) AS w FROM b WHERE k <= 5)
SELECT q, round(max(c), 6) AS top, round((sum(w * y) + 2 * (SELECT avg(label % 2) FROM v)) / (sum(w) + 2), 6) AS probability FROM w GROUP BY q"""


def dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine of all pairs of one label's vectors, in closed form from their sum: no pair is made."""
    unit = load(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    flat = unit.withColumn("norm", norm).where("norm > 0").select("label", "norm", F.posexplode("v").alias("i", "x"))
    summed = flat.groupBy("label", "i").agg(F.sum(F.col("x") / F.col("norm")).alias("s"), F.count("*").alias("n"))
    whole = summed.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("square"), F.max("n").alias("n"))
    return whole.where("n > 1").select("label", "n", F.round(1 - (F.col("square") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("dispersion"))


DISPERSION_SQL = """
WITH v AS (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT a.label, list_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT label, (SELECT count(*) FROM v WHERE v.label = p.label) AS n, round(1 - avg(c), 6) AS dispersion FROM p GROUP BY label"""


def _orders(q) -> str:
    return f"o AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, {q.us('o_orderdate')} AS t, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, o_orderpriority AS market FROM orders)"


def prequential(q) -> str:
    """The mean of strictly earlier targets: over all rows, and shrunk to it for three keys, with log supports."""
    if q.spark:
        base = "g AS (SELECT o_orderkey, o_custkey, o_orderpriority, y, t, rn - 1 AS n, ysum - y AS s FROM orders_with_sums)"
    else:
        base = f"{_orders(q)}, g AS (SELECT o_orderkey, o_custkey, o_orderpriority, y, t, count(y) OVER w AS n, coalesce(sum(y) OVER w, 0) AS s FROM o WINDOW w AS (ORDER BY t, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
    keys = {"customer": "o_custkey", "segment": "o_custkey % 40, o_orderpriority", "pair": "o_custkey, o_orderpriority"}
    sums = ", ".join(f"count(y) OVER w_{k} AS n_{k}, coalesce(sum(y) OVER w_{k}, 0) AS s_{k}" for k in keys)
    frames = ", ".join(f"w_{k} AS (PARTITION BY {c} ORDER BY t, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)" for k, c in keys.items())
    return f"""WITH {base}, p AS (SELECT *, (s + 20 * 0.5E0) / (n + 20) AS prior FROM g), k AS (SELECT *, {sums} FROM p WINDOW {frames})
        SELECT o_orderkey, round(prior, 8) AS prior, {', '.join(f'round((s_{k} + 20 * prior) / (n_{k} + 20), 8) AS prior_{k}, round(ln(1 + n_{k}), 8) AS support_{k}' for k in keys)} FROM k"""


def orders_with_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.expr(S.us("o_orderdate")).alias("t"), F.expr("CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END").alias("y"))
    return ordered.ordered(rows, ["t", "o_orderkey"], {"ysum": "y"})


LEVELS = ("market", "market, family", "market, kind", "market, family, kind", "market, family, form", "market, family, taxonomy", "market, family, form, bucket")


def hierarchical(q) -> str:
    """Seven key levels, each a mean shrunk to the global one, weighed by reliability and depth, clipped."""
    rows = "r AS (SELECT l.doc_id, CAST(l.quality AS DOUBLE) AS y, coalesce(lang, '') AS market, source AS family, d.doc_id % 3 AS kind, d.doc_id % 4 AS form, d.doc_id % 5 AS taxonomy, d.doc_id % 2 AS bucket, 1.0E0 / (1 + d.doc_id % 2) AS w FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
    tables = ", ".join(f"t{i} AS (SELECT {k}, (sum(w * y) + 20 * max(mu)) / (sum(w) + 20) AS p, sum(w) / (sum(w) + 20) * (1 + 0.12 * {i}) AS a FROM r CROSS JOIN g GROUP BY {k})" for i, k in enumerate(LEVELS))
    joins_ = " ".join(f"JOIN t{i} ON " + " AND ".join(f"t{i}.{c} = r.{c}" for c in k.split(", ")) for i, k in enumerate(LEVELS))
    top, low = " + ".join(f"t{i}.p * t{i}.a" for i in range(7)), " + ".join(f"t{i}.a" for i in range(7))
    return f"WITH {rows}, g AS (SELECT sum(w * y) / sum(w) AS mu FROM r), {tables} SELECT r.doc_id, round(least(0.98, greatest(0.02, (0.35 * mu + {top}) / (0.35 + {low}))), 8) AS prior FROM r CROSS JOIN g {joins_}"


def decayed(q) -> str:
    """Arrivals before an event of its type, halved every 15, 60 and 240 minutes and every day; simultaneous ones do not count.

    Beyond sixty half-lives nothing is left to a double's accuracy, so that time is summed in closed form by cells:
    within a cell arrivals are scaled to its end, and whole cells decay together.
    """
    halves = {"m15": 900, "m60": 3600, "m240": 14400, "d1": 86400}
    if not q.spark:
        each = ", ".join(f"round(coalesce(sum(pow(2.0, -(a.t - b.t) / {h}.0)), 0), 6) AS {n}" for n, h in halves.items())
        return f"WITH e AS (SELECT event_id, event_type, epoch_us(ts) / 1e6 AS t FROM events) SELECT a.event_id, {each} FROM e a LEFT JOIN e b ON a.event_type = b.event_type AND b.t < a.t GROUP BY a.event_id"
    parts, out = [], []
    for n, h in halves.items():
        cell = 8 * h
        # Sums of a cell, decayed to its beginning or end; a running total over cells needs the last eight cells only.
        parts.append(f"{n}c AS (SELECT event_type, floor(t / {cell}) AS cell, sum(power(2.0D, (t - floor(t / {cell}) * {cell}) / {h}.0D - 8)) AS s FROM e GROUP BY event_type, floor(t / {cell}))")
        parts.append(f"{n}p AS (SELECT c.event_type, c.cell, sum(b.s * power(2.0D, -8.0D * (c.cell - b.cell - 1))) AS before FROM {n}c c JOIN {n}c b ON b.event_type = c.event_type AND b.cell < c.cell AND b.cell >= c.cell - 9 GROUP BY c.event_type, c.cell)")
        parts.append(f"{n}w AS (SELECT event_id, event_type, t, floor(t / {cell}) AS cell, coalesce(sum(power(2.0D, (t - floor(t / {cell}) * {cell}) / {h}.0D)) OVER (PARTITION BY event_type, floor(t / {cell}) ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 0.0000005D PRECEDING), 0) AS own FROM e)")
        parts.append(f"{n}r AS (SELECT w.event_id, round(power(2.0D, -(t - w.cell * {cell}) / {h}.0D) * (own + coalesce(before, 0)), 6) AS {n} FROM {n}w w LEFT JOIN {n}p p ON p.event_type = w.event_type AND p.cell = w.cell)")
        out.append(n)
    return f"WITH e AS (SELECT event_id, event_type, {q.us('ts')} / 1.0E6 AS t FROM events), {', '.join(parts)} SELECT m15r.event_id, {', '.join(out)} FROM m15r " + " ".join(f"JOIN {n}r ON {n}r.event_id = m15r.event_id" for n in out[1:])


def frames(q) -> str:
    """Count, mean, sample deviation and range of a user's values in the last 1, 2, 5, 10, 30 and 60 minutes before an event, and in as many hours (``n_1h`` and so on)."""
    sizes = {f"{m}{unit}": m * length for unit, length in (("", MINUTE), ("h", 60 * MINUTE)) for m in (1, 2, 5, 10, 30, 60)}
    each = lambda m: f"count(value) OVER w{m} AS n_{m}, round(avg(value) OVER w{m}, 6) AS mean_{m}, round(stddev_samp(value) OVER w{m}, 6) AS sd_{m}, round(max(value) OVER w{m} - min(value) OVER w{m}, 6) AS range_{m}"
    windows = ", ".join(f"w{m} AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN {t} PRECEDING AND 1 PRECEDING)" for m, t in sizes.items())
    return f"WITH e AS (SELECT event_id, user_id, value, {q.us('ts')} AS t FROM events) SELECT event_id, {', '.join(map(each, sizes))} FROM e WINDOW {windows}"


def gap_moves(q) -> str:
    """Moves between neighbours no more than six hours apart: largest fall and rise along the path, signed log volume, jumps."""
    return f"""WITH e AS (SELECT user_id, event_id, value, {q.us('ts')} AS t, lag(value) OVER w AS v0, lag({q.us('ts')}) OVER w AS t0, max(value) OVER w AS high, min(value) OVER w AS low FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        r AS (SELECT *, CASE WHEN t - t0 <= {360 * MINUTE} THEN value / nullif(v0, 0) - 1 END AS r FROM e)
        SELECT user_id, count(r) AS moves, round(min(value / nullif(high, 0) - 1), 6) AS drawdown, round(max(value / nullif(low, 0) - 1), 6) AS runup, round(sum(sign(r) * ln(1 + abs(value))), 6) AS signed_volume, count(CASE WHEN abs(r) > 1 THEN 1 END) AS jumps FROM r GROUP BY user_id"""


def audits(q) -> str:
    """Seven audits of a series: duplicates, order, prices at or below zero, crossed bars, negative volume, gaps, rows in hours."""
    return f"""WITH b AS (SELECT user_id, {q.us('ts')} AS t, value AS close, value * CASE WHEN event_id % 50 = 0 THEN 0.9E0 ELSE 1.1E0 END AS high, value * 0.95E0 AS low, CASE WHEN event_id % 97 = 0 THEN -1 ELSE 1 END AS volume, event_id FROM events),
        l AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS before, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS last FROM b)
        SELECT user_id, count(*) AS n, count(*) - count(DISTINCT t) AS duplicates, count(CASE WHEN t < before THEN 1 END) AS backwards, count(CASE WHEN close <= 0 THEN 1 END) AS non_positive, count(CASE WHEN high < close OR low > close THEN 1 END) AS crossed,
        count(CASE WHEN volume < 0 THEN 1 END) AS negative_volume, count(CASE WHEN t - last > {60 * MINUTE} THEN 1 END) AS gaps, max(t - last) AS longest_gap, count(CASE WHEN t % {DAY} BETWEEN {9 * 60 * MINUTE} AND {16 * 60 * MINUTE} THEN 1 END) AS in_hours FROM l GROUP BY user_id"""


def parity(q) -> str:
    """Agreement of two providers, two hash halves of the orders, and whether it passes six thresholds."""
    return f"""WITH a AS (SELECT l_orderkey, min(l_extendedprice / l_quantity) AS p1, max(l_extendedprice / l_quantity) AS p2, count(*) AS n, min(l_returnflag) AS f1, max(l_returnflag) AS f2 FROM lineitem GROUP BY l_orderkey),
        m AS (SELECT count(*) AS n, count(CASE WHEN n > 1 THEN 1 END) AS exact_n, avg(CASE WHEN n > 1 THEN CASE WHEN f1 = f2 THEN 1.0E0 ELSE 0.0E0 END END) AS agreement, {q.quantile('CASE WHEN n > 1 THEN abs(p2 / p1 - 1) END', 0.5)} AS med, {q.quantile('CASE WHEN n > 1 THEN abs(p2 / p1 - 1) END', 0.95)} AS p95, corr(CASE WHEN n > 1 THEN p1 END, CASE WHEN n > 1 THEN p2 END) AS c FROM a),
        t AS (SELECT exact_n >= 30 AS enough, agreement >= 0.5 AS labels_agree, coalesce(c >= 0.9, false) AS returns_agree, coalesce(med <= 0.5, false) AS median_close, coalesce(p95 <= 1.5, false) AS tail_close, exact_n * 1.0E0 / n >= 0.5 AS covered, m.* FROM m)
        SELECT n, exact_n, round(agreement, 8) AS agreement, round(med, 8) AS median_difference, round(p95, 8) AS p95_difference, round(c, 8) AS correlation, enough, labels_agree, returns_agree, median_close, tail_close, covered,
        CASE WHEN enough AND labels_agree AND returns_agree AND median_close AND tail_close AND covered THEN 'PASS' ELSE 'FAIL' END AS status FROM t"""


def certification(q) -> str:
    """Twelve named checks of a scored table against thresholds; a check without a value fails."""
    scored = "s AS (SELECT doc_id, y, source, lang, p FROM scored)" if q.spark else "s AS (SELECT l.doc_id, CAST(l.quality AS BIGINT) AS y, d.source, d.lang, (row_number() OVER (ORDER BY d.n_chars, l.doc_id) - 0.5E0) / (count(*) OVER ()) AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
    balanced = lambda w: f"(avg(CASE WHEN {w} AND y = 1 THEN CASE WHEN p >= 0.5 THEN 1.0E0 ELSE 0.0E0 END END) + avg(CASE WHEN {w} AND y = 0 THEN CASE WHEN p < 0.5 THEN 1.0E0 ELSE 0.0E0 END END)) / 2"
    right = "CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0E0 ELSE 0.0E0 END"
    checks = [
        ("total_events", "CAST(count(*) AS DOUBLE)", 300), ("us_events", "CAST(count(CASE WHEN lang = 'en' THEN 1 END) AS DOUBLE)", 100), ("kr_events", "CAST(count(CASE WHEN lang = 'fr' THEN 1 END) AS DOUBLE)", 60),
        ("balanced_accuracy", balanced("true"), 0.53), ("brier_skill", "1 - avg((p - y) * (p - y)) / 0.25", 0.0), ("edge_vs_naive", f"avg({right}) - greatest(avg(y), 1 - avg(y))", 0.01),
        ("highconf_coverage", "avg(CASE WHEN abs(p - 0.5) >= 0.3 THEN 1.0E0 ELSE 0.0E0 END)", 0.2), ("highconf_accuracy", f"avg(CASE WHEN abs(p - 0.5) >= 0.3 THEN {right} END)", 0.55),
        ("mean_signed_net", "avg(CASE WHEN p >= 0.5 THEN 1.0E0 ELSE -1.0E0 END * (2 * y - 1))", 0.0), ("worst_decile", f"1 - avg(CASE WHEN p >= 0.9 THEN 1 - {right} END)", 0.5),
        ("us_balanced", balanced("lang = 'en'"), 0.5), ("kr_balanced", balanced("lang = 'xx'"), 0.5),
    ]
    columns = ", ".join(f"{e} AS k{i}" for i, (_, e, _) in enumerate(checks))
    rows = " UNION ALL ".join(f"SELECT '{n}' AS name, round(k{i}, 8) AS actual, CAST({t} AS DOUBLE) AS threshold, coalesce(k{i} >= {t}, false) AS passed FROM m" for i, (n, _, t) in enumerate(checks))
    return f"WITH {scored}, m AS (SELECT {columns} FROM s) {rows}"


def dev_seal(q) -> str:
    """DEV and SEAL by market: the last 30 % of rows, or the last 210 days where these are more."""
    return f"""WITH {_orders(q)}, r AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY t, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY market) AS n, max(t) OVER (PARTITION BY market) AS last FROM o),
        c AS (SELECT market, least(min(CASE WHEN i = least(greatest(CAST(floor(n * 0.7E0) AS BIGINT), 1), n - 1) THEN t END), max(last) - {210 * DAY}) AS start FROM r GROUP BY market)
        SELECT o.o_orderkey, CASE WHEN o.t < c.start THEN 'DEV' ELSE 'SEAL' END AS part FROM o JOIN c ON c.market = o.market"""


def expanding_cv(q) -> str:
    """Four folds by quantiles of time: training rows before the cut, validation rows in the next tenth."""
    cuts = (0.45, 0.6, 0.75, 0.9)
    columns = ", ".join(f"{q.quantile('CAST(t AS DOUBLE)', c)} AS a{i}, {q.quantile('CAST(t AS DOUBLE)', min(c + 0.1, 0.995))} AS b{i}" for i, c in enumerate(cuts))
    rows = " UNION ALL ".join(f"SELECT {i} AS fold, market, count(CASE WHEN t < a{i} THEN 1 END) AS train, count(CASE WHEN t >= a{i} AND t < b{i} THEN 1 END) AS valid, min(CASE WHEN t >= a{i} AND t < b{i} THEN o_orderkey END) AS first_valid FROM j GROUP BY market" for i in range(4))
    return f"WITH {_orders(q)}, c AS (SELECT market AS m, {columns} FROM o GROUP BY market), j AS (SELECT * FROM o JOIN c ON c.m = o.market) {rows}"


def fold_invariants(q) -> str:
    """Groups that cross folds, by number of folds: none may have more than one where the fold follows the group."""
    return "WITH f AS (SELECT o_custkey, o_orderkey, o_custkey % 5 AS by_group, o_orderkey % 5 AS by_row FROM orders), g AS (SELECT o_custkey, count(DISTINCT by_group) AS a, count(DISTINCT by_row) AS b FROM f GROUP BY o_custkey) SELECT max(a) AS group_folds, count(CASE WHEN a > 1 THEN 1 END) AS crossing, max(b) AS row_folds, count(CASE WHEN b > 1 THEN 1 END) AS crossing_by_row FROM g"


def roles(q) -> str:
    """Buckets of 100 by hash: frozen roles stay, new rows get theirs, frozen rows that are gone are quarantined; validated append-only."""
    bucket = q.hash32("'seed|' || " + q.string("id")) + " % 100"
    role = f"CASE WHEN {bucket} < 10 THEN 'DEV' WHEN {bucket} < 55 THEN 'RESEARCH' ELSE 'RESERVE' END"
    return f"""WITH now AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 10 <> 3), old AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'DEV' ELSE 'RESERVE' END AS role FROM customer WHERE c_custkey % 2 = 1)
        SELECT coalesce(now.id, old.id) AS id, coalesce(old.role, {role.replace('id AS', 'now.id AS').replace('(id', '(now.id')}) AS role, CASE WHEN now.id IS NULL THEN 'QUARANTINED_NOT_IN_ACTIVE_QUEUE' ELSE 'ACTIVE' END AS status, old.id IS NOT NULL AS frozen FROM now FULL OUTER JOIN old ON now.id = old.id"""


def mod10(q) -> str:
    """The whole SHA-256 as a number modulo 10, digit by digit: 16 to any power ends in 6."""
    digits = "instr('0123456789abcdef', substr(h, CAST(i AS INT), 1)) - 1" if q.spark else "strpos('0123456789abcdef', substr(h, CAST(i AS INT), 1)) - 1"
    total = f"aggregate(transform(sequence(1, 63), i -> {digits}), 0, (s, x) -> s + x)" if q.spark else f"list_sum(list_transform(range(1, 64), lambda i: {digits}))"
    last = digits.replace("CAST(i AS INT)", "64")
    return f"WITH s AS (SELECT c_custkey, {q.sha(q.string('c_custkey'))} AS h FROM customer) SELECT c_custkey, CAST((6 * ({total}) + {last}) % 10 AS BIGINT) AS slot, (6 * ({total}) + {last}) % 10 < 3 AS sealed FROM s"


def gate(q) -> str:
    """The confidence gate of a policy: cut at a quantile of the margins, mapped to 0.86 + 0.14 m above it and 0.84 m below."""
    return f"""WITH p AS (SELECT event_id, abs(value / 100.0E0 - 0.5E0) * 2 AS margin FROM events), g AS ({'SELECT q0 AS cut, q1 AS top FROM margin_quantiles' if q.spark else f"SELECT {q.quantile('margin', 0.8)} AS cut, max(margin) AS top FROM p"})
        SELECT event_id, round(CASE WHEN margin >= cut THEN 0.86 + 0.14 * (margin - cut) / greatest(top - cut, 1e-9) ELSE 0.84 * margin / greatest(cut, 1e-9) END, 6) AS confidence, margin >= cut AS gated FROM p CROSS JOIN g"""


def polarity(q) -> str:
    """Five strengths of a feature block on the logit scale, and the accuracy of each."""
    scored = "s AS (SELECT doc_id, y, p FROM scored)" if q.spark else "s AS (SELECT l.doc_id, CAST(l.quality AS BIGINT) AS y, (row_number() OVER (ORDER BY d.n_chars, l.doc_id) - 0.5E0) / (count(*) OVER ()) AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
    z = "ln(least(greatest({0}, 1e-6), 1 - 1e-6) / (1 - least(greatest({0}, 1e-6), 1 - 1e-6)))"
    rows = " UNION ALL ".join(f"SELECT CAST({a} AS DOUBLE) AS alpha, y, 1 / (1 + exp(-(w + {a} * (f - w)))) AS p FROM z" for a in (-1, 0, 0.5, 1, 1.5))
    return f"WITH {scored}, z AS (SELECT y, {z.format('p')} AS f, {z.format('(0.8 * p + 0.1)')} AS w FROM s), r AS ({rows}) SELECT alpha, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0E0 ELSE 0.0E0 END), 8) AS accuracy, round(avg((p - y) * (p - y)), 8) AS brier FROM r GROUP BY alpha"


def scaling(q) -> str:
    """Median and interquartile range by brand, the deviation where the range is nought, one where both are; clipped at 8."""
    return f"""WITH g AS (SELECT p_brand AS b, {q.median('p_retailprice')} AS m, {q.quantile('p_retailprice', 0.75)} - {q.quantile('p_retailprice', 0.25)} AS iqr, stddev_pop(p_retailprice) AS sd FROM part GROUP BY p_brand)
        SELECT p_partkey, round(least(greatest((p_retailprice - m) / CASE WHEN iqr > 1e-12 THEN iqr WHEN sd > 1e-12 THEN sd ELSE 1 END, -8), 8), 6) + 0.0E0 AS scaled FROM part JOIN g ON p_brand = b"""


def due_tasks(q) -> str:
    """The next tasks: one broad task per market first, then issuers by attempts, four a market in all."""
    return """WITH t AS (SELECT c_custkey AS task, c_mktsegment AS market, c_custkey % 50 = 0 AS broad, c_nationkey % 4 AS attempts FROM customer WHERE c_custkey % 3 <> 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY market, broad ORDER BY attempts, task) AS k FROM t), e AS (SELECT * FROM r WHERE NOT broad OR k = 1),
        f AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY CASE WHEN broad THEN 0 ELSE 1 END, attempts, task) AS place FROM e)
        SELECT market, place, task, broad FROM f WHERE place <= 4"""


def work_queue(q) -> str:
    """A work queue from two checked joins and a summary: missing counts are nought, buckets by count, rank within a bucket."""
    return """WITH s AS (SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS top FROM orders GROUP BY o_custkey),
        q AS (SELECT c_custkey, n_name, coalesce(n_orders, 0) AS n_orders, coalesce(top, 0) AS top FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN s ON o_custkey = c_custkey),
        b AS (SELECT *, CASE WHEN n_orders = 0 THEN 'EMPTY' WHEN n_orders < 10 THEN 'FEW' ELSE 'MANY' END AS bucket FROM q)
        SELECT c_custkey, n_name, n_orders, bucket, row_number() OVER (PARTITION BY n_name, bucket ORDER BY top DESC, c_custkey) AS place FROM b"""


def crosstab(q) -> str:
    return "SELECT source, " + ", ".join(f"count(CASE WHEN lang = '{k}' THEN 1 END) AS {k}" for k in ("de", "en", "es", "fr")) + ", count(CASE WHEN lang IS NULL THEN 1 END) AS missing FROM documents GROUP BY source"


def liquidity(q) -> str:
    """Four bins of ranks within a brand: most, more, less and least liquid."""
    return "WITH r AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) * 1.0E0 / count(*) OVER (PARTITION BY p_brand) AS x FROM part) SELECT p_partkey, CASE WHEN x <= 0.25 THEN 'LEAST' WHEN x <= 0.5 THEN 'LESS' WHEN x <= 0.75 THEN 'MORE' ELSE 'MOST' END AS bin FROM r"


def two_hop(q) -> str:
    """Values carried over two hops of a typed graph: weighted mean per type, mean over types, blended with the node's own."""
    hop = lambda v, name: f"{name}t AS (SELECT e.node, e.kind, sum(e.w * {v}.x) / sum(e.w) AS x FROM e JOIN {v} ON {v}.node = e.other GROUP BY e.node, e.kind), {name} AS (SELECT a.node, 0.5 * a.x + 0.5 * coalesce(m.x, a.x) AS x FROM v a LEFT JOIN (SELECT node, avg(x) AS x FROM {name}t GROUP BY node) m ON m.node = a.node)"
    if q.spark:
        # Suppliers of one nation are all neighbours: a node's own share is taken from the nation's totals, and no pair is made.
        odd = {"up": "x = double('Infinity')", "down": "x = double('-Infinity')", "nan": "isnan(x)"}
        of = "sum(CASE WHEN abs(x) < double('Infinity') THEN x END) AS x, count(*) AS w, count(x) AS known, " + ", ".join(f"count(CASE WHEN {c} THEN 1 END) AS n_{k}" for k, c in odd.items())
        names = ["x", "w", "known", *[f"n_{k}" for k in odd]]
        rest = ", ".join(f"sum(p.n * (coalesce(t.{c}, 0) - coalesce(p.{c}, 0))) AS {c}" for c in names)
        mean = "CASE WHEN known = 0 THEN NULL WHEN n_nan > 0 OR n_up > 0 AND n_down > 0 THEN double('NaN') WHEN n_up > 0 THEN double('Infinity') WHEN n_down > 0 THEN double('-Infinity') ELSE x / w END"
        linked = lambda v: f"""{v}g AS (SELECT node, {of} FROM {v} GROUP BY node), {v}p AS (SELECT m.nation, m.node, m.n, {', '.join(f'm.n * g.{c} AS {c}' for c in names)} FROM m JOIN {v}g g ON g.node = m.node),
            {v}s AS (SELECT nation, {', '.join(f'sum({c}) AS {c}' for c in names)} FROM {v}p GROUP BY nation)"""  # noqa: E731
        hop = lambda v, name: f"""{linked(v)}, {name}r AS (SELECT p.node, {rest} FROM {v}p p JOIN {v}s t ON t.nation = p.nation GROUP BY p.node), {name}t AS (SELECT node, {mean} AS x FROM {name}r WHERE w > 0
            UNION ALL SELECT e.node, sum(e.w * {v}.x) / sum(e.w) AS x FROM e JOIN {v} ON {v}.node = e.other GROUP BY e.node),
            {name} AS (SELECT a.node, 0.5 * a.x + 0.5 * coalesce(m.x, a.x) AS x FROM v a LEFT JOIN (SELECT node, avg(x) AS x FROM {name}t GROUP BY node) m ON m.node = a.node)"""  # noqa: E731
        return f"""WITH v AS (SELECT s_suppkey AS node, s_acctbal AS x FROM supplier), m AS (SELECT s_nationkey AS nation, s_suppkey AS node, count(*) AS n FROM supplier WHERE s_nationkey IS NOT NULL AND s_suppkey IS NOT NULL GROUP BY s_nationkey, s_suppkey),
            e AS (SELECT s_suppkey AS node, s_suppkey + 1 AS other, 2.0E0 AS w FROM supplier UNION ALL SELECT s_suppkey + 1, s_suppkey, 1.0E0 FROM supplier),
            {hop('v', 'h')}, {hop('h', 'k')} SELECT node, round(x, 6) AS carried FROM k"""
    return f"""WITH v AS (SELECT s_suppkey AS node, s_acctbal AS x FROM supplier),
        e AS (SELECT a.s_suppkey AS node, b.s_suppkey AS other, 'nation' AS kind, 1.0E0 AS w FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey
            UNION ALL SELECT s_suppkey, s_suppkey + 1, 'next', 2.0E0 FROM supplier UNION ALL SELECT s_suppkey + 1, s_suppkey, 'next', 1.0E0 FROM supplier),
        {hop('v', 'h')}, {hop('h', 'k')} SELECT node, round(x, 6) AS carried FROM k"""


def _headlines(q) -> str:
    return f"""SELECT doc_id, source, substr(trim({q.sub("lower(coalesce(text, ''))", '[^a-z0-9가-힣]+', ' ')}), 1, 120) AS head, {q.hash32(q.string('doc_id'))} % 7200 * 1000000 AS t FROM documents"""


HEADLINES = statement(_headlines)


def suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (source, first 120 characters of the normalised headline) the rows, and those kept: each ten minutes or more after the last one kept."""
    rows = HEADLINES[0](spark, sf_dir).withColumn("source", F.coalesce("source", F.lit(""))).withColumn("head", F.sha2("head", 256))
    kept = sequential.greedy_spacing(rows, ["source", "head"], "t", "doc_id", 600 * 1_000_000, strict=False)
    marks = rows.join(kept.select("doc_id", F.lit(1).alias("kept")), "doc_id", "left")
    return marks.groupBy("source", "head").agg(F.count("*").alias("n"), F.count("kept").alias("kept"), F.min(F.when(F.col("kept") == 1, F.col("doc_id"))).alias("least_kept"))


SUPPRESSED_SQL = f"""WITH RECURSIVE a AS (SELECT doc_id, coalesce(source, '') AS source, sha256(head) AS head, t, row_number() OVER (PARTITION BY coalesce(source, ''), head ORDER BY t, doc_id) AS k FROM ({HEADLINES[1]}) h),
r AS (SELECT source, head, k, doc_id, t AS last, true AS kept FROM a WHERE k = 1 UNION ALL SELECT a.source, a.head, a.k, a.doc_id, CASE WHEN a.t - r.last >= 600000000 THEN a.t ELSE r.last END, a.t - r.last >= 600000000 FROM r JOIN a ON a.source = r.source AND a.head = r.head AND a.k = r.k + 1)
SELECT source, head, count(*) AS n, count(*) FILTER (kept) AS kept, min(doc_id) FILTER (kept) AS least_kept FROM r GROUP BY source, head"""


PLANS = {
    "prequential_prior_keys": prequential, "hierarchical_prior_levels": hierarchical, "decayed_intensity_types": decayed, "time_frames_six": frames, "gap_guarded_moves": gap_moves, "series_audits": audits,
    "provider_parity_gate": parity, "certification_twelve": certification, "dev_seal_split": dev_seal, "expanding_cv": expanding_cv, "fold_invariants": fold_invariants, "append_only_roles": roles,
    "hash_mod10_split": mod10, "gate_quantile": gate, "polarity_grid": polarity, "robust_scale_groups": scaling, "due_tasks": due_tasks, "work_queue": work_queue, "crosstab": crosstab,
    "liquidity_bins": liquidity, "two_hop_propagation": two_hop,
}
STATEMENTS = {name: statement(build, VIEWS | {"orders_with_sums": orders_with_sums}) for name, build in PLANS.items()}
BUILT = {
    "checked_left_join": (checked_left_join, CHECKED_LEFT_SQL), "checked_inner_join": (checked_inner_join, CHECKED_INNER_SQL), "split_manifest_components": (split_manifest, SPLIT_SQL),
    "cosine_topk_softmax": (cosine_topk, COSINE_SQL), "pairwise_dispersion": (dispersion, DISPERSION_SQL), "headline_suppression_keys": (suppressed, SUPPRESSED_SQL),
}
QUERIES = {name: pair[0] for name, pair in (STATEMENTS | BUILT).items()}
ORACLES = {name: pair[1] for name, pair in (STATEMENTS | BUILT).items()}
