"""Event timing, sequence, metric, graph and text queries built from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import articles
from tidemark.functions import text as tx
from tidemark.operators import asof, containment, graph, metrics, sequential
from tidemark.session import load

MINUTE = 60_000_000
_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({} AS TIMESTAMP_NTZ))"


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Error events as the news, all others as one series of bars."""
    rows = load(spark, sf_dir, "events").select("event_id", "event_type", "value", F.expr(_US.format("ts")).alias("t"))
    return rows.where("event_type = 'error'").select("event_id", "t"), rows.where("event_type <> 'error'").select("t", "value")


def asof_entry_exit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry two minutes after the event, exit thirty minutes after the actual entry, each within 300 s; the status ladder of both."""
    news, bars = _events(spark, sf_dir)
    lookup = dict(right_time="t", value="value", tolerance=300 * 1_000_000, bucket=1440 * MINUTE)
    placed = asof.asof_join(news.withColumn("entry_target", F.col("t") + 2 * MINUTE), bars, "entry_target", prefix="entry", **lookup)
    placed = placed.withColumn("exit_target", F.col("entry_time") + 30 * MINUTE)
    found = placed.where("entry_time IS NOT NULL")
    found = asof.asof_join(found, bars, "exit_target", prefix="exit", **lookup)
    missed = placed.where("entry_time IS NULL")
    rows = found.unionByName(missed, allowMissingColumns=True)
    status = F.when(F.col("entry_time").isNull(), "ENTRY_TIMING_MISS").when(F.col("exit_time").isNull(), "EXIT_TIMING_MISS").otherwise("OK")
    return rows.select(
        "event_id",
        status.alias("status"),
        ((F.col("entry_time") - F.col("entry_target")) / 1e6).alias("entry_slip_s"),
        F.round(F.when(F.col("entry_value") > 0, F.col("exit_value") / F.col("entry_value") - 1), 8).alias("fwd_ret"),
    )


ENTRY_EXIT_SQL = f"""
WITH e AS (SELECT event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'error'),
b AS (SELECT epoch_us(ts) AS bt, max(value) AS v FROM events WHERE event_type <> 'error' GROUP BY 1),
n AS (SELECT e.event_id, e.t + {2 * MINUTE} AS target, b.bt, b.v FROM (SELECT *, t + {2 * MINUTE} AS x FROM e) e ASOF LEFT JOIN b ON e.x <= b.bt),
n2 AS (SELECT event_id, target, CASE WHEN bt - target <= 300000000 THEN bt END AS bt, CASE WHEN bt - target <= 300000000 THEN v END AS v FROM n),
x AS (SELECT n3.*, b.bt AS xt, b.v AS xv FROM (SELECT *, coalesce(bt, 9000000000000000) + {30 * MINUTE} AS xtarget FROM n2) n3 ASOF LEFT JOIN b ON n3.xtarget <= b.bt)
SELECT event_id, CASE WHEN bt IS NULL THEN 'ENTRY_TIMING_MISS' WHEN xt IS NULL OR xt - xtarget > 300000000 THEN 'EXIT_TIMING_MISS' ELSE 'OK' END AS status,
(bt - target) / 1e6 AS entry_slip_s, round(CASE WHEN v > 0 AND bt IS NOT NULL AND xt - xtarget <= 300000000 THEN xv / v - 1 END, 8) AS fwd_ret FROM x"""


def asof_status_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``asof_entry_exit_status``, with all five statuses: no bar at all and an entry or exit on another day than the event too."""
    news, bars = _events(spark, sf_dir)
    lookup = dict(right_time="t", value="value", tolerance=300 * 1_000_000, bucket=1440 * MINUTE)
    placed = asof.asof_join(news.withColumn("entry_target", F.col("t") + 2 * MINUTE), bars, "entry_target", prefix="entry", **lookup)
    placed = placed.withColumn("exit_target", F.col("entry_time") + 30 * MINUTE)
    found = asof.asof_join(placed.where("entry_time IS NOT NULL"), bars, "exit_target", prefix="exit", **lookup)
    rows = found.unionByName(placed.where("entry_time IS NULL"), allowMissingColumns=True)
    # What the tolerance hides: a bar at or after the target exists where the series ends no earlier.
    rows = rows.crossJoin(F.broadcast(bars.agg(F.max("t").alias("last_bar"))))
    missing = lambda target: F.col("last_bar").isNull() | (F.col(target) > F.col("last_bar"))
    day = lambda c: F.floor(F.col(c) / (1440 * MINUTE))
    status = (
        F.when(missing("entry_target"), "BAR_MISSING")
        .when(F.col("entry_time").isNull(), "ENTRY_TIMING_MISS")
        .when(missing("exit_target"), "BAR_MISSING")
        .when(F.col("exit_time").isNull(), "EXIT_TIMING_MISS")
        .when((day("entry_time") != day("t")) | (day("exit_time") != day("t")), "CROSSES_SESSION")
        .otherwise("OK")
    )
    price = F.when(F.col("status").isin("OK", "CROSSES_SESSION") & (F.col("entry_value") > 0), F.col("exit_value") / F.col("entry_value") - 1)
    rows = rows.withColumn("status", status)
    return rows.select("event_id", "status", ((F.col("entry_time") - F.col("entry_target")) / 1e6).alias("entry_slip_s"), F.round(price, 8).alias("fwd_ret"))


STATUS_LADDER_SQL = f"""
WITH e AS (SELECT event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'error'),
b AS (SELECT epoch_us(ts) AS bt, max(value) AS v FROM events WHERE event_type <> 'error' GROUP BY 1),
n AS (SELECT e.event_id, e.t, e.x AS target, b.bt, b.v FROM (SELECT *, t + {2 * MINUTE} AS x FROM e) e ASOF LEFT JOIN b ON e.x <= b.bt),
x AS (SELECT n3.*, b.bt AS xt, b.v AS xv FROM (SELECT *, bt + {30 * MINUTE} AS xtarget FROM n) n3 ASOF LEFT JOIN b ON n3.xtarget <= b.bt),
s AS (SELECT *, CASE WHEN bt IS NULL THEN 'BAR_MISSING' WHEN bt - target > 300000000 THEN 'ENTRY_TIMING_MISS' WHEN xt IS NULL THEN 'BAR_MISSING' WHEN xt - xtarget > 300000000 THEN 'EXIT_TIMING_MISS'
WHEN bt // {1440 * MINUTE} <> t // {1440 * MINUTE} OR xt // {1440 * MINUTE} <> t // {1440 * MINUTE} THEN 'CROSSES_SESSION' ELSE 'OK' END AS status FROM x)
SELECT event_id, status, CASE WHEN bt - target <= 300000000 THEN (bt - target) / 1e6 END AS entry_slip_s,
round(CASE WHEN status IN ('OK', 'CROSSES_SESSION') AND v > 0 THEN xv / v - 1 END, 8) AS fwd_ret FROM s"""


def asof_backward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns from 5, 15, 30 and 60 minutes before an event to its last bar, each lookup at most 600 s stale."""
    news, bars = _events(spark, sf_dir)
    spread = news.withColumn("minutes", F.explode(F.array(*[F.lit(m) for m in (0, 5, 15, 30, 60)]))).withColumn("at", F.col("t") - F.col("minutes").cast("bigint") * MINUTE)
    seen = asof.asof_join(spread, bars, "at", "t", "value", direction="backward", tolerance=600_000_000, bucket=1440 * MINUTE)
    wide = seen.groupBy("event_id").pivot("minutes", [0, 5, 15, 30, 60]).agg(F.max("asof_value"))
    ret = lambda m: F.round(F.when(F.col(str(m)) > 0, F.col("0") / F.col(str(m)) - 1), 8).alias(f"ret_{m}")
    return wide.select("event_id", *[ret(m) for m in (5, 15, 30, 60)])


_BACK = """{m} AS (SELECT event_id, CASE WHEN x - bt <= 600000000 THEN v END AS v FROM (SELECT e.event_id, e.t - {u} AS x FROM e) q ASOF LEFT JOIN b ON q.x >= b.bt)"""
BACKWARD_SQL = (
    "WITH e AS (SELECT event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'error'), b AS (SELECT epoch_us(ts) AS bt, max(value) AS v FROM events WHERE event_type <> 'error' GROUP BY 1), "
    + ", ".join(_BACK.format(m=f"m{m}", u=m * MINUTE) for m in (0, 5, 15, 30, 60))
    + " SELECT m0.event_id, " + ", ".join(f"round(CASE WHEN m{m}.v > 0 THEN m0.v / m{m}.v - 1 END, 8) AS ret_{m}" for m in (5, 15, 30, 60))
    + " FROM m0 " + " ".join(f"JOIN m{m} USING (event_id)" for m in (5, 15, 30, 60))
)


def _spacing(spark, sf_dir, gap, strict):
    rows = load(spark, sf_dir, "events").select("event_id", "user_id", F.expr(_US.format("ts")).alias("t"))
    return sequential.greedy_spacing(rows, ["user_id"], "t", "event_id", gap, strict).select("user_id", "event_id")


def greedy_spacing_35m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spacing(spark, sf_dir, 35 * MINUTE, True)


def greedy_spacing_10h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spacing(spark, sf_dir, 600 * MINUTE, False)


def _spacing_sql(test: str) -> str:
    return f"""WITH RECURSIVE n AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, t AS last, true AS kept FROM n WHERE k = 1 UNION ALL
SELECT n.user_id, n.event_id, n.k, CASE WHEN n.t - r.last {test} THEN n.t ELSE r.last END, n.t - r.last {test} FROM r JOIN n ON n.user_id = r.user_id AND n.k = r.k + 1)
SELECT user_id, event_id FROM r WHERE kept"""


def nearest_embargo_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-priority orders of customers without an order of low priority within 30 days either way."""
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.expr(_US.format("o_orderdate")).alias("t"))
    left, right = rows.where("o_orderpriority LIKE '1%'"), rows.where("o_orderpriority LIKE '5%'")
    return asof.embargo_anti(left, right, "t", ["o_custkey"], 30 * 1440 * MINUTE).select("o_orderkey")


EMBARGO_SQL = f"""SELECT o_orderkey FROM orders a WHERE o_orderpriority LIKE '1%' AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_orderpriority LIKE '5%'
AND b.o_custkey = a.o_custkey AND abs(epoch_us(b.o_orderdate) - epoch_us(a.o_orderdate)) <= {30 * 1440 * MINUTE})"""


def interval_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("user_id", F.expr(_US.format("ts")).alias("lo")).withColumn("hi", F.col("lo") + 360 * MINUTE)
    return sequential.merge_intervals(rows, ["user_id"], "lo", "hi")


ISLANDS_SQL = f"""WITH e AS (SELECT user_id, epoch_us(ts) AS lo, epoch_us(ts) + {360 * MINUTE} AS hi FROM events),
m AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, CAST(island AS BIGINT) AS island, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM i GROUP BY user_id, island"""


def quarter_hour_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The :01, :16, :31 and :46 marks from 15 minutes before an error event to 90 after."""
    news, _ = _events(spark, sf_dir)
    first = F.ceil((F.col("t") - 15 * MINUTE - MINUTE) / (15 * MINUTE)) * (15 * MINUTE) + MINUTE
    return news.select("event_id", F.explode(F.sequence(first, F.col("t") + 90 * MINUTE, F.lit(15 * MINUTE))).alias("bucket_us"))


QUARTER_SQL = f"""SELECT event_id, unnest(generate_series(CAST(ceil((epoch_us(ts) - {16 * MINUTE}) / {15 * MINUTE}.0) AS BIGINT) * {15 * MINUTE} + {MINUTE}, epoch_us(ts) + {90 * MINUTE}, {15 * MINUTE})) AS bucket_us
FROM events WHERE event_type = 'error'"""


def _scored(spark, sf_dir):
    joined = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "n_chars", "source"), "doc_id")
    return joined.select("doc_id", "source", F.col("quality").cast("double").alias("y"), "n_chars", (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("p"))


_SCORED_SQL = "s AS (SELECT l.doc_id, d.source, CAST(l.quality AS DOUBLE) AS y, d.n_chars, d.n_chars / (d.n_chars + 1000.0) AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def exact_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.roc_auc(_scored(spark, sf_dir), "p", "y", keys=["source"])
    return out.select("source", F.round("auc", 8).alias("auc"))


AUC_SQL = f"""WITH {_SCORED_SQL} SELECT a.source, round(CASE WHEN max(t.np) * max(t.nn) > 0 THEN sum(CASE WHEN a.y = 1 AND b.y = 0 THEN CASE WHEN a.n_chars > b.n_chars THEN 1.0 WHEN a.n_chars = b.n_chars THEN 0.5 ELSE 0.0 END ELSE 0.0 END) / (max(t.np) * max(t.nn)) END, 8) AS auc
FROM s a JOIN s b ON a.source = b.source JOIN (SELECT source, sum(y) AS np, sum(1 - y) AS nn FROM s GROUP BY source) t ON t.source = a.source GROUP BY a.source"""


def ece_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.expected_calibration_error(_scored(spark, sf_dir), "p", "y").select(F.round("ece", 8).alias("ece"))


ECE_SQL = f"WITH {_SCORED_SQL}, b AS (SELECT least(floor(p * 10), 9) AS k, count(*) AS n, avg(p) AS p, avg(y) AS y FROM s GROUP BY 1) SELECT round(sum(n * abs(p - y)) / sum(n), 8) AS ece FROM b"


def risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumn("right", ((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double")).withColumn("c", F.abs(F.col("p") - 0.5))
    return metrics.risk_coverage(rows, "c", "right", "doc_id", [0.1, 0.2, 0.5, 1.0]).select("coverage", "n", F.round("accuracy", 8).alias("accuracy"))


COVERAGE_SQL = f"""WITH {_SCORED_SQL}, r AS (SELECT CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END AS ok, row_number() OVER (ORDER BY abs(p - 0.5) DESC, doc_id) AS k, count(*) OVER () AS m FROM s),
c AS (SELECT unnest([0.1::DOUBLE, 0.2, 0.5, 1.0]) AS coverage) SELECT coverage, count(*) AS n, round(avg(ok), 8) AS accuracy FROM r CROSS JOIN c WHERE k <= ceil(m * coverage) GROUP BY coverage"""


KEYWORDS = ["idiot", "stupid", "the", "license", "token"]


def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", tx.count_keywords(F.col("text"), KEYWORDS).alias("n_keywords"))


KEYWORDS_SQL = "SELECT doc_id, " + " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in KEYWORDS) + " AS n_keywords FROM documents"


def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("canonical"))


URL_SQL = r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', '') AS host,
rtrim(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g'), '/') AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages),
k AS (SELECT *, [x for x in string_split(q, '&') if x <> '' AND NOT starts_with(lower(x), 'utm_') AND lower(string_split(x, '=')[1]) NOT IN ('ref', 'source', 'output')] AS kept FROM p),
t AS (SELECT *, array_to_string(list_sort([CASE WHEN contains(x, '=') THEN x ELSE x || '=' END for x in kept]), '&') AS tail FROM k)
SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN tail <> '' THEN '?' || tail ELSE '' END AS canonical FROM t"""


def url_canonical_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", tx.canonical_url(F.col("url"), ordered=True).alias("canonical"))


URL_ORDERED_SQL = r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '\.$', '') AS host,
rtrim(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g'), '/') AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages),
k AS (SELECT *, array_to_string([CASE WHEN contains(x, '=') THEN x ELSE x || '=' END for x in string_split(q, '&') if x <> '' AND NOT starts_with(lower(x), 'utm_')
AND lower(string_split(x, '=')[1]) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'oc', 'ref', 'ref_src', 'source')], '&') AS tail FROM p)
SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN tail <> '' THEN '?' || tail ELSE '' END AS canonical FROM k"""


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", tx.html_text(F.col("html")).alias("text"))


# The tables hold these references only; the operator decodes all there are.
HTML_SQL = (
    "WITH r AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?>.*?</script>|<style.*?>.*?</style>', ' ', 'g'), "
    r"'(?is)<br\s*/?>|</p\s*>', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g') AS t FROM pages), "
    "d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&nbsp;', chr(160)), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&') AS t FROM r) "
    r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r\f\x0B]+', ' ', 'g'), '\n\s*\n+', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM d"
)


def public_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of the pages and of literal addresses, with whether they may be fetched."""
    odd = ["http://10.1.2.3/a", "https://8.8.8.8/x", "http://172.20.0.1", "ftp://example.com", "http://user@example.com", "https://LOCALHOST:8080/", "http://printer.local/", "http://192.168.1.1:80/", "https://203.0.114.1/"]
    pages = load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    literal = spark.range(1).select(F.posexplode(F.array(*map(F.lit, odd))).alias("id", "url")).select((-1 - F.col("id")).cast("bigint").alias("id"), "url")
    return pages.union(literal).select("id", articles.safe_public_url(F.col("url")).alias("safe"))


PUBLIC_SQL = """SELECT page_id AS id, regexp_matches(url, '^https?://[^/?#@]+([/?#]|$)') AS safe FROM pages
UNION ALL SELECT * FROM (VALUES (-1, false), (-2, true), (-3, false), (-4, false), (-5, false), (-6, false), (-7, false), (-8, false), (-9, true)) t(id, safe)"""


def title_and_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return load(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract(h, "(?is)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract(h, '(?i)<html lang="([^"]*)"', 1).alias("lang"), F.size(F.regexp_extract_all(h, F.lit('(?i)<a href="([^"]*)"'), F.lit(1))).alias("n_links")
    )


TITLE_SQL = """SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?i)<html lang="([^"]*)"', 1) AS lang, CAST(len(regexp_extract_all(html, '(?i)<a href="([^"]*)"', 1)) AS INT) AS n_links FROM pages"""


def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of an item's distinct words that a document has, where it is half or more; short items too."""
    return _contained(spark, sf_dir, "words")


def _contained(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    docs, items = load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark").select("item_id", "text")
    hits = containment.contained(docs, items, "doc_id", "item_id", "text", kind, 0.5)
    return hits.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "shared", F.round(F.col("shared") / F.col("size"), 8).alias("containment"))


_TOKENS_SQL = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9가-힣]+', ' ', 'g')), ' '), lambda x: length(x) > 1))"
CONTAINMENT_SQL = f"""WITH d AS (SELECT doc_id, unnest({_TOKENS_SQL}) AS tok FROM documents), i AS (SELECT item_id, len(toks) AS m, unnest(toks) AS tok FROM (SELECT item_id, {_TOKENS_SQL} AS toks FROM benchmark) x)
SELECT doc_id, item_id, count(*) AS shared, round(count(*) / max(m), 8) AS containment FROM d JOIN i USING (tok) GROUP BY doc_id, item_id HAVING count(*) * 2 >= max(m)"""


def doc_char5_containment_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of an item's distinct character 5-grams that a document has, where it is half or more; short items too."""
    return _contained(spark, sf_dir, "char5")


_CHAR5_SQL = """list_distinct(list_filter([substr(t, i, 5) FOR i IN generate_series(1, greatest(length(t) - 4, 1))], lambda g: g <> ''))"""
_PLAIN_SQL = "replace(trim(regexp_replace(lower(text), '[^a-z0-9가-힣]+', ' ', 'g')), ' ', '')"
CHAR5_SQL = f"""WITH d AS (SELECT doc_id, unnest({_CHAR5_SQL}) AS gram FROM (SELECT doc_id, {_PLAIN_SQL} AS t FROM documents) x),
i AS (SELECT item_id, len(grams) AS m, unnest(grams) AS gram FROM (SELECT item_id, {_CHAR5_SQL} AS grams FROM (SELECT item_id, {_PLAIN_SQL} AS t FROM benchmark) x) y)
SELECT doc_id, item_id, count(*) AS shared, round(count(*) / max(m), 8) AS containment FROM d JOIN i USING (gram) GROUP BY doc_id, item_id HAVING count(*) * 2 >= max(m)"""


def mean_vector_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The renormalised mean embedding of each label, one row per component."""
    parts = load(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = parts.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return parts.join(norm, "label").select("label", F.col("i").cast("bigint").alias("i"), F.round(F.col("m") / F.col("norm"), 6).alias("x"))


MEAN_SQL = """WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS x, CAST(unnest(generate_series(0, len(embedding) - 1)) AS BIGINT) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM p GROUP BY label, i), n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM m GROUP BY label)
SELECT m.label, m.i, round(m / norm, 6) AS x FROM m JOIN n ON m.label = n.label"""

_PAIRS = {
    "asof_entry_exit_status": (asof_entry_exit_status, ENTRY_EXIT_SQL),
    "asof_status_ladder": (asof_status_ladder, STATUS_LADDER_SQL),
    "asof_backward_returns": (asof_backward_returns, BACKWARD_SQL),
    "greedy_spacing_35m": (greedy_spacing_35m, _spacing_sql(f"> {35 * MINUTE}")),
    "greedy_spacing_10h": (greedy_spacing_10h, _spacing_sql(f">= {600 * MINUTE}")),
    "nearest_embargo_anti": (nearest_embargo_anti, EMBARGO_SQL),
    "interval_islands": (interval_islands, ISLANDS_SQL),
    "quarter_hour_buckets": (quarter_hour_buckets, QUARTER_SQL),
    "exact_auc": (exact_auc, AUC_SQL),
    "ece_10": (ece_10, ECE_SQL),
    "risk_coverage": (risk_coverage, COVERAGE_SQL),
    "keyword_counts": (keyword_counts, KEYWORDS_SQL),
    "url_canonical": (url_canonical, URL_SQL),
    "url_canonical_ordered": (url_canonical_ordered, URL_ORDERED_SQL),
    "public_urls": (public_urls, PUBLIC_SQL),
    "html_to_text": (html_to_text, HTML_SQL),
    "title_and_meta": (title_and_meta, TITLE_SQL),
    "benchmark_containment": (benchmark_containment, CONTAINMENT_SQL),
    "doc_char5_containment_benchmark": (doc_char5_containment_benchmark, CHAR5_SQL),
    "mean_vector_by_label": (mean_vector_by_label, MEAN_SQL),
}
QUERIES = {k: v[0] for k, v in _PAIRS.items()}
ORACLES = {k: v[1] for k, v in _PAIRS.items()}
