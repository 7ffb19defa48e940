"""Aggregations, windows, splits and priors as SQL plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import frames
from tidemark.plans.dialect import S, statement
from tidemark.session import load

DAY = 86_400_000_000


def _scored(q) -> str:
    """Labelled documents with a score in (0, 1) from the rank of their length."""
    if q.spark:
        return "s AS (SELECT * FROM scored)"
    return (
        "s AS (SELECT l.doc_id, CAST(l.quality AS BIGINT) AS y, d.source, d.lang, "
        "(row_number() OVER (ORDER BY d.n_chars, l.doc_id) - 0.5E0) / (count(*) OVER ()) AS p, CAST(d.n_chars AS DOUBLE) AS x, "
        "row_number() OVER (ORDER BY d.n_chars, l.doc_id) AS rn, count(*) OVER () AS n_rows "
        "FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
    )


PLANS = {
    "masked_scan": lambda q: f"""
        SELECT doc_id, source, CASE WHEN {q.hash32(q.string('doc_id'))} % 10 < 3 THEN NULL ELSE n_chars END AS n_chars_open FROM documents""",
    "projection_pushdown": lambda q: "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01 00:00:00' AND l_returnflag = 'R'",
    "semi_join": lambda q: "SELECT d.doc_id, d.source FROM documents d LEFT SEMI JOIN labels l ON d.doc_id = l.doc_id" if q.spark else "SELECT d.doc_id, d.source FROM documents d SEMI JOIN labels l ON d.doc_id = l.doc_id",
    "anti_join": lambda q: "SELECT d.doc_id, d.source FROM documents d LEFT ANTI JOIN labels l ON d.doc_id = l.doc_id" if q.spark else "SELECT d.doc_id, d.source FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id",
    "group_aggregate": lambda q: """
        SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price,
        min(l_discount) AS min_discount, max(l_tax) AS max_tax, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "vwap_fallback": lambda q: """
        SELECT l_suppkey, round(coalesce(sum(l_extendedprice * l_quantity) / nullif(sum(l_quantity), 0), avg(l_extendedprice)), 4) AS vwap, count(*) AS n
        FROM lineitem GROUP BY l_suppkey""",
    "weighted_mean_accuracy": lambda q: f"""
        WITH {_scored(q)}, c AS (SELECT y, x, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS hat FROM s)
        SELECT round(sum(x * CASE WHEN y = hat THEN 1 ELSE 0 END) / sum(x), 8) AS weighted_accuracy, round(sum(x * hat) / sum(x), 8) AS weighted_mean FROM c""",
    "balanced_accuracy": lambda q: f"""
        WITH {_scored(q)}, c AS (SELECT y, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0E0 ELSE 0.0E0 END) AS recall FROM s GROUP BY y)
        SELECT round(avg(recall), 8) AS balanced_accuracy FROM c""",
    "brier_logloss": lambda q: f"""
        WITH {_scored(q)}, c AS (SELECT y, least(greatest(CAST(p AS DOUBLE), 1e-6), 1 - 1e-6) AS p FROM s)
        SELECT round(avg((p - y) * (p - y)), 8) AS brier, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 8) AS logloss FROM c""",
    "reliability_bins": lambda q: f"""
        WITH {_scored(q)}, b AS (SELECT p, y, """ + ("greatest(1, (rn - 1) * 5 div (n_rows - 1) + CAST((rn - 1) * 5 % (n_rows - 1) > 0 AS BIGINT))" if q.spark else "CASE WHEN rn <= 1 + (n_rows - 1) * 0.2 THEN 1 WHEN rn <= 1 + (n_rows - 1) * 0.4 THEN 2 WHEN rn <= 1 + (n_rows - 1) * 0.6 THEN 3 WHEN rn <= 1 + (n_rows - 1) * 0.8 THEN 4 ELSE 5 END") + """ AS bin FROM s),
        g AS (SELECT bin, count(*) AS n, round(avg(p), 8) AS confidence, round(avg(y), 8) AS accuracy FROM b GROUP BY bin)
        SELECT *, coalesce(accuracy >= lag(accuracy) OVER (ORDER BY bin), true) AS not_falling FROM g""",
    "winsorized_top_removed": lambda q: f"""
        WITH e AS ({'SELECT q0 AS lo, q4 AS hi FROM price_quantiles' if q.spark else f"SELECT {q.quantile('l_extendedprice', 0.05)} AS lo, {q.quantile('l_extendedprice', 0.95)} AS hi FROM lineitem"}),
        w AS (SELECT avg(least(greatest(l_extendedprice, lo), hi)) AS m FROM lineitem CROSS JOIN e),
        h AS (SELECT sum(p) AS s, count(*) AS n FROM (SELECT l_extendedprice AS p FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 5) x),
        t AS (SELECT (sum(l_extendedprice) - max(h.s)) / (count(*) - max(h.n)) AS m FROM lineitem CROSS JOIN h)
        SELECT round(w.m, 4) AS winsorized, round(t.m, 4) AS without_top5 FROM w CROSS JOIN t""",
    "exact_quantiles": lambda q: f"""
        SELECT p_brand, {', '.join(f'round({q.quantile("p_retailprice", p)}, 6) AS q{int(100 * p)}' for p in (0.1, 0.25, 0.5, 0.75, 0.9))} FROM part GROUP BY p_brand""",
    "standardised_moments": lambda q: """
        WITH m AS (SELECT user_id, avg(value) AS mu, stddev_pop(value) AS sd FROM events GROUP BY user_id HAVING count(*) >= 5)
        SELECT e.user_id, round(avg(power((value - mu) / nullif(sd, 0), 3)), 6) AS skew, round(avg(power((value - mu) / nullif(sd, 0), 4)), 6) AS kurt
        FROM events e JOIN m ON e.user_id = m.user_id GROUP BY e.user_id""",
    "trend_slope": lambda q: f"""
        SELECT user_id, round(regr_slope(ln(value + 1), {q.us('ts')} / 6.0E7), 12) AS slope, count(*) AS n FROM events WHERE value >= 0 GROUP BY user_id HAVING count(*) >= 5""",
    "autocorr_lag1": lambda q: """
        WITH l AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
        SELECT user_id, round(corr(value, before), 6) AS autocorr FROM l WHERE before IS NOT NULL GROUP BY user_id HAVING count(*) >= 3""",
    "realised_volatility": lambda q: """
        WITH r AS (SELECT user_id, ln((value + 1) / (lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 1)) AS r FROM events WHERE value >= 0)
        SELECT user_id, round(sqrt(sum(r * r)), 6) AS vol, round(max(abs(r)), 6) AS largest, sum(CASE WHEN abs(r) > 1 THEN 1 ELSE 0 END) AS jumps FROM r WHERE r IS NOT NULL GROUP BY user_id""",
    "category_entropy": lambda q: """
        WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type), t AS (SELECT user_id, n * 1.0E0 / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
        SELECT user_id, round(-sum(p * ln(p)), 8) AS entropy FROM t GROUP BY user_id""",
    "mode_with_tiebreak": lambda q: """
        WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k FROM c)
        SELECT source, lang AS top_lang, n FROM r WHERE k = 1""",
    "pivot_wide": lambda q: "SELECT user_id, " + ", ".join(f"sum(CASE WHEN event_type = '{t}' THEN value END) IS NULL AS no_{t}, round(avg(CASE WHEN event_type = '{t}' THEN value END), 6) AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id",
    "status_histogram": lambda q: "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority",
    "source_and_total_sets": lambda q: f"""
        WITH {_scored(q)} SELECT coalesce(source, 'ALL') AS source, count(*) AS n, round(avg(y), 8) AS rate FROM s GROUP BY GROUPING SETS ((source), ())""",
    "shrunk_group_mean": lambda q: f"""
        WITH {_scored(q)}, g AS (SELECT avg(y) AS mu FROM s)
        SELECT source, count(*) AS n, round((sum(y) + 20 * max(mu)) / (count(*) + 20), 8) AS prior FROM s CROSS JOIN g GROUP BY source""",
    "hierarchical_prior": lambda q: f"""
        WITH {_scored(q)}, g AS (SELECT avg(y) AS mu FROM s), a AS (SELECT source, sum(y) AS y, count(*) AS n FROM s GROUP BY source),
        b AS (SELECT source, lang, sum(y) AS y, count(*) AS n FROM s GROUP BY source, lang),
        w AS (SELECT b.source, b.lang, mu, a.y * 1.0E0 / a.n AS ma, b.y * 1.0E0 / b.n AS mb, a.n / (a.n + 20.0E0) * 1.12 AS wa, b.n / (b.n + 20.0E0) * 1.24 AS wb
              FROM b JOIN a ON a.source = b.source CROSS JOIN g)
        SELECT source, lang, round((mu + wa * ma + wb * mb) / (1 + wa + wb), 8) AS prior FROM w""",
    "prequential_prior": lambda q: f"""
        WITH o AS (SELECT o_orderkey, o_custkey, {q.us('o_orderdate')} AS t, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders)
        SELECT o_orderkey, count(y) OVER w AS support, round((coalesce(sum(y) OVER w, 0) + 20 * 0.5E0) / (count(y) OVER w + 20), 8) AS prior
        FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY t, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "embargoed_history_rate": lambda q: f"""
        WITH e AS (SELECT event_id, event_type, {q.us('ts')} AS t, CASE WHEN value > 50 THEN 1 ELSE 0 END AS y FROM events)
        SELECT event_id, count(y) OVER w AS support, round(avg(y) OVER w, 8) AS rate
        FROM e WINDOW w AS (PARTITION BY event_type ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND {2_100_000_001} PRECEDING)""",
    "count_tail_frame": lambda q: """
        SELECT event_id, round(avg(value) OVER w, 6) AS mean20, round(max(value) OVER w - min(value) OVER w, 6) AS range20
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
    "time_frame_stats": lambda q: f"""
        WITH e AS (SELECT event_id, event_type, value, {q.us('ts')} AS t FROM events)
        SELECT event_id, count(value) OVER w AS n, round(avg(value) OVER w, 6) AS mean, round(min(value) OVER w, 6) AS low, round(max(value) OVER w, 6) AS high
        FROM e WINDOW w AS (PARTITION BY event_type ORDER BY t RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING)""",
    "reference_cdf_rank": lambda q: "SELECT p_partkey, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_retailprice), 8) AS cdf FROM part",
    "midrank": lambda q: "SELECT p_partkey, round((2 * (upto - same) + same + 1) / (2.0E0 * n_rows), 8) AS midrank FROM part p JOIN size_ranks r ON p.p_size = r.p_size" if q.spark else """
        WITH c AS (SELECT p_partkey, rank() OVER (ORDER BY p_size) AS r, count(*) OVER (PARTITION BY p_size) AS same, count(*) OVER () AS n FROM part)
        SELECT p_partkey, round((2 * (r - 1) + same + 1) / (2.0E0 * n), 8) AS midrank FROM c""",
    "group_pct_rank": lambda q: """
        WITH c AS (SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS r, count(*) OVER (PARTITION BY c_nationkey, c_acctbal) AS same, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
        SELECT c_custkey, round((r + (same - 1) / 2.0E0) / n, 8) AS pct FROM c""",
    "group_z_singleton": lambda q: f"""
        WITH g AS (SELECT s_nationkey, avg(s_acctbal) AS m, stddev_samp(s_acctbal) AS sd, {q.quantile('s_acctbal', 0.5)} AS med, count(*) AS n FROM supplier GROUP BY s_nationkey)
        SELECT s_suppkey, round(CASE WHEN n = 1 OR sd = 0 THEN 0 ELSE (s_acctbal - m) / sd END, 8) AS z, round(CASE WHEN n = 1 THEN 0 ELSE s_acctbal - med END, 6) AS off_median, 1.0E0 / n AS weight
        FROM supplier s JOIN g ON s.s_nationkey = g.s_nationkey""",
    "first_per_key": lambda q: "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS k FROM orders) x WHERE k = 1",
    "time_quantile_folds": lambda q: f"""
        WITH o AS (SELECT o_orderkey, {q.us('o_orderdate')} AS t FROM orders), c AS ({'SELECT q0 AS c45, q1 AS c60, q2 AS c75, q3 AS c90 FROM order_time_quantiles' if q.spark else 'SELECT ' + ', '.join(f'{q.quantile("CAST(t AS DOUBLE)", p)} AS c{int(p * 100)}' for p in (0.45, 0.6, 0.75, 0.9)) + ' FROM o'})
        SELECT o_orderkey, CASE WHEN t <= c45 THEN 0 WHEN t <= c60 THEN 1 WHEN t <= c75 THEN 2 WHEN t <= c90 THEN 3 ELSE 4 END AS fold FROM o CROSS JOIN c""",
    "ntile_embargo_folds": lambda q: f"""
        WITH o AS (SELECT o_orderkey, {q.us('o_orderdate')} AS t, {'fifth' if q.spark else 'ntile(5) OVER (ORDER BY o_orderdate, o_orderkey)'} AS fold FROM {'orders_in_time' if q.spark else 'orders'}),
        b AS (SELECT fold, min(t) AS lo FROM o GROUP BY fold)
        SELECT o.o_orderkey, o.fold, b.lo IS NOT NULL AND b.lo - o.t <= 2100000000 AS embargoed FROM o LEFT JOIN b ON b.fold = o.fold + 1""",
    "group_split_70": lambda q: "SELECT o_custkey, CASE WHEN upto <= 0.7E0 * upto_all THEN 'train' ELSE 'valid' END AS part FROM customers_in_time" if q.spark else """
        WITH g AS (SELECT o_custkey, min(o_orderdate) AS first, count(*) AS n FROM orders GROUP BY o_custkey),
        c AS (SELECT o_custkey, sum(n) OVER (ORDER BY first, o_custkey) AS upto, sum(n) OVER () AS total FROM g)
        SELECT o_custkey, CASE WHEN upto <= 0.7E0 * total THEN 'train' ELSE 'valid' END AS part FROM c""",
    "ticker_embargo_purge": lambda q: f"""
        WITH o AS (SELECT o_orderkey, o_custkey, {q.us('o_orderdate')} AS t, {'tenth' if q.spark else 'ntile(10) OVER (ORDER BY o_orderdate, o_orderkey)'} AS k FROM {'orders_in_time' if q.spark else 'orders'}),
        v AS (SELECT o_custkey, min(t) AS first FROM o WHERE k > 7 GROUP BY o_custkey)
        SELECT o.o_orderkey FROM o LEFT JOIN v ON o.o_custkey = v.o_custkey WHERE k <= 7 AND (v.first IS NULL OR o.t < v.first - {7 * DAY})""",
    "hash_role_100": lambda q: f"SELECT c_custkey, {q.hash32(q.string('c_custkey'))} % 100 AS slot, CASE WHEN {q.hash32(q.string('c_custkey'))} % 100 < 60 THEN 'dev' WHEN {q.hash32(q.string('c_custkey'))} % 100 < 80 THEN 'seal' ELSE 'quarantine' END AS role FROM customer",
    # The five least hashes of a part of a source first, so that no task sees a whole source.
    "hash_sample_k": lambda q: f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h) AS k FROM (SELECT *, row_number() OVER (PARTITION BY source, part ORDER BY h) AS j FROM (SELECT doc_id, source, {q.sha(q.string('doc_id'))} AS h, doc_id % 64 AS part FROM documents) a) b WHERE j <= 5) c WHERE k <= 5" if q.spark else f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {q.sha(q.string('doc_id'))}) AS k FROM documents) x WHERE k <= 5",
    "round_robin_strata": lambda q: "SELECT doc_id, lang, k, place FROM round_robin" if q.spark else f"""
        WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {q.sha(q.string('doc_id'))}) AS k FROM documents)
        SELECT doc_id, lang, k, row_number() OVER (ORDER BY k, lang) AS place FROM r""",
    "cut_day_bootstrap": lambda q: f"""
        WITH d AS (SELECT CAST(floor({q.us('o_orderdate')} / {DAY}.0E0) AS BIGINT) AS day, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1),
        k AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS m FROM d), r AS (SELECT {q.sequence(1, 600)} AS rep),
        draw AS (SELECT rep, {q.hash32(f"{q.string('rep')} || '-' || {q.string('i')}")} % m AS pick FROM r CROSS JOIN k),
        b AS (SELECT rep, sum(s) / sum(n) AS mean FROM draw JOIN k ON k.i = draw.pick GROUP BY rep)
        SELECT round({q.quantile('mean', 0.025)}, 4) AS lower95, round({q.quantile('mean', 0.975)}, 4) AS upper95, round(avg(mean), 4) AS centre FROM b""",
    "threshold_grid_best": lambda q: f"""
        WITH {_scored(q)}, g AS (SELECT {q.sequence(30, 70)} AS pct), m AS (SELECT pct, avg(CASE WHEN (p >= pct / 100.0E0) = (y = 1) THEN 1.0E0 ELSE 0.0E0 END) AS acc FROM s CROSS JOIN g GROUP BY pct)
        SELECT pct, round(acc, 8) AS accuracy FROM (SELECT *, row_number() OVER (ORDER BY round(acc, 10) DESC, abs(pct - 50), pct) AS k FROM m) x WHERE k = 1""",
    "rank_policy": lambda q: "SELECT p_partkey, round(direction, 8) AS direction, round(confidence, 8) AS confidence, confidence >= 0.86E0 AS high FROM policy_ranks" if q.spark else """
        WITH r AS (SELECT p_partkey, cume_dist() OVER (ORDER BY p_retailprice) AS a, cume_dist() OVER (ORDER BY p_size) AS b FROM part),
        d AS (SELECT p_partkey, 0.6E0 * a + 0.4E0 * b AS direction FROM r), c AS (SELECT *, cume_dist() OVER (ORDER BY round(abs(direction - 0.5E0), 10)) AS confidence FROM d)
        SELECT p_partkey, round(direction, 8) AS direction, round(confidence, 8) AS confidence, confidence >= 0.86E0 AS high FROM c""",
    "mean_reversion_score": lambda q: f"""
        WITH l AS (SELECT event_id, user_id, ln((value + 1) / (lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 1)) AS r FROM events WHERE value >= 0),
        s AS ({'SELECT q0 AS scale FROM move_quantiles' if q.spark else f"SELECT {q.quantile('abs(r)', 0.9)} AS scale FROM l"})
        SELECT event_id, round(1 / (1 + exp(r / scale)), 6) AS probability FROM l CROSS JOIN s WHERE r IS NOT NULL""",
    "robust_scale": lambda q: f"""
        WITH g AS ({'SELECT q2 AS m, q3 - q1 AS iqr FROM price_quantiles' if q.spark else f"SELECT {q.quantile('l_extendedprice', 0.5)} AS m, {q.quantile('l_extendedprice', 0.75)} - {q.quantile('l_extendedprice', 0.25)} AS iqr FROM lineitem"})
        SELECT l_orderkey, l_linenumber, round(least(greatest((l_extendedprice - m) / nullif(iqr, 0), -8), 8), 6) AS scaled FROM lineitem CROSS JOIN g""",
    "probability_blend": lambda q: f"""
        WITH {_scored(q)} SELECT doc_id, round(1 / (1 + exp(-(ln(p / (1 - p)) + 0.25E0))), 8) AS shifted, round(0.7E0 * p + 0.3E0 * 0.5E0, 8) AS blended FROM s""",
    "ohlc_quality": lambda q: f"""
        WITH m AS (SELECT event_type, CAST(floor({q.us('ts')} / 3600000000.0E0) AS BIGINT) AS bar, min(value) AS low, max(value) AS high, count(*) AS n FROM events GROUP BY 1, 2),
        l AS (SELECT *, bar - lag(bar) OVER (PARTITION BY event_type ORDER BY bar) AS gap FROM m)
        SELECT event_type, count(*) AS bars, sum(CASE WHEN gap > 1 THEN 1 ELSE 0 END) AS gaps, sum(CASE WHEN low <= 0 THEN 1 ELSE 0 END) AS non_positive, sum(CASE WHEN high < low THEN 1 ELSE 0 END) AS crossed, max(gap) AS longest_gap FROM l GROUP BY event_type""",
    "provider_overlap": lambda q: f"""
        WITH h AS (SELECT CAST(floor({q.us('ts')} / 3600000000.0E0) AS BIGINT) AS bar, event_id % 2 AS side FROM events),
        a AS (SELECT DISTINCT bar FROM h WHERE side = 0), b AS (SELECT DISTINCT bar FROM h WHERE side = 1),
        j AS (SELECT a.bar AS x, b.bar AS y FROM a FULL OUTER JOIN b ON a.bar = b.bar)
        SELECT count(x) AS left_bars, count(y) AS right_bars, count(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 1 END) AS shared, round(count(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 1 END) * 1.0E0 / count(*), 8) AS coverage FROM j""",
    "certification_checks": lambda q: f"""
        WITH {_scored(q)}, m AS (SELECT avg(y) AS rate, avg((p - y) * (p - y)) AS brier, count(*) AS n FROM s)
        SELECT 'base_rate' AS name, round(rate, 8) AS value, rate >= 0.5 AS passed FROM m UNION ALL SELECT 'brier', round(brier, 8), brier <= 0.25 FROM m UNION ALL SELECT 'rows', CAST(n AS DOUBLE), n >= 100 FROM m""",
    "consensus_ladder": lambda q: f"""
        WITH g AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS kinds, count(*) AS n, max({q.us('l_shipdate')}) - min({q.us('l_shipdate')}) AS spread, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey)
        SELECT l_orderkey, CASE WHEN n < 2 THEN 'TOO_FEW' WHEN kinds > 1 THEN 'CONFLICT' WHEN spread > {60 * DAY} THEN 'TOO_SPREAD' ELSE 'OK' END AS status, CASE WHEN n >= 2 AND kinds = 1 AND spread <= {60 * DAY} THEN flag END AS consensus FROM g""",
    "ambiguity_quarantine": lambda q: f"""
        WITH g AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS k FROM lineitem GROUP BY l_partkey), r AS (SELECT l.*, k, row_number() OVER (PARTITION BY l.l_partkey ORDER BY {q.sha(f"{q.string('l.l_orderkey')} || '-' || {q.string('l.l_linenumber')}")}) AS o FROM lineitem l JOIN g ON l.l_partkey = g.l_partkey)
        SELECT l_partkey, k AS n_suppliers, CASE WHEN k > 3 THEN 'QUARANTINE' ELSE 'KEPT' END AS status, CASE WHEN k > 3 THEN NULL ELSE l_orderkey END AS kept_order FROM r WHERE o = 1""",
    "provider_priority": lambda q: """
        WITH u AS (SELECT o_custkey AS k, 1 AS priority, max(o_totalprice) AS v FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY o_custkey UNION ALL SELECT o_custkey, 2, max(o_totalprice) FROM orders GROUP BY o_custkey UNION ALL SELECT c_custkey, 3, c_acctbal FROM customer)
        SELECT k, priority, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY priority) AS o FROM u) x WHERE o = 1""",
    "quota_shortfall": lambda q: "SELECT c_mktsegment, count(*) AS have, greatest(0, 350 - count(*)) AS shortfall FROM customer GROUP BY c_mktsegment",
    "pending_groups": lambda q: "SELECT o_custkey, bool_or(o_orderstatus = 'P') AS any_pending, " + q.every("o_orderstatus = 'F'") + " AS settled, count(*) AS n FROM orders GROUP BY o_custkey",
    "union_distinct_latest": lambda q: """
        WITH u AS (SELECT n_nationkey AS k, n_name AS name, 0 AS age FROM nation UNION ALL SELECT r_regionkey, r_name, 1 FROM region)
        SELECT k, name FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY age DESC) AS o FROM u) x WHERE o = 1""",
    "intersect_except": lambda q: "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT r_regionkey FROM region",
    "global_rank": lambda q: "SELECT o_orderkey, rn AS place FROM orders_by_priority" if q.spark else "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders",
    "decayed_intensity": lambda q: f"""
        WITH e AS (SELECT event_id, user_id, {q.us('ts')} / 1.0E6 AS t FROM events)
        SELECT a.event_id, round(coalesce(sum(power(2.0E0, -(a.t - b.t) / 3600)), 0), 6) AS h1, round(coalesce(sum(power(2.0E0, -(a.t - b.t) / 86400)), 0), 6) AS d1
        FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.t < a.t GROUP BY a.event_id""",
    "block_state_20": lambda q: """
        WITH n AS (SELECT user_id, value, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 20.0E0) AS BIGINT) AS block FROM events),
        b AS (SELECT user_id, block, count(*) AS n, avg(CASE WHEN value > 50 THEN 1.0E0 ELSE 0.0E0 END) AS hit FROM n GROUP BY user_id, block)
        SELECT user_id, block, n, round(hit, 8) AS hit, coalesce(lag(hit) OVER (PARTITION BY user_id ORDER BY block) < 0.5, false) AS reversed FROM b""",
    "decision_cutoff": lambda q: f"""
        WITH c AS (SELECT event_id, {q.us('ts')} AS t, {q.us('ts')} + ({q.hash32(q.string('event_id'))} % 300) * 1000000 AS seen FROM events)
        SELECT event_id, seen <= t + 120000000 AS usable, seen > t + 120000000 AS late FROM c""",
    "conversation_prefix": lambda q: """
        SELECT conv_id, turn, role, coalesce(sum(length(text)) OVER w, 0) AS chars_before, count(*) OVER w AS turns_before
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "exact_duplicates": lambda q: f"SELECT {q.sha('text')} AS content_sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1",
}



def time_frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the events of its type in the hour before it say about each event."""
    events = load(spark, sf_dir, "events").select("event_id", "event_type", "value", F.expr(S.us("ts")).alias("t"))
    got = frames.time_frames(events, "event_type", "t", "value", 3_600_000_000)
    return got.select("event_id", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


STATEMENTS = {name: statement(build) for name, build in PLANS.items()}
QUERIES = {name: pair[0] for name, pair in STATEMENTS.items()} | {"time_frame_stats": time_frame_stats}
ORACLES = {name: pair[1] for name, pair in STATEMENTS.items()}
