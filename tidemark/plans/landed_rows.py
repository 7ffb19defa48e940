"""Sources, sinks and capture rules as queries: rows of the tables are put in the landed form and read back from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import articles
from tidemark.functions import text as tx
from tidemark.session import load
from tidemark.sources import landed, sinks
from tidemark.storage import scratch
from tidemark.streaming import capture


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "csv")
    load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").write.option("header", True).option("compression", "gzip").csv(path)
    return landed.csv_table(spark, path, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double", ["o_orderkey", "o_totalprice"])


CSV_SQL = "SELECT o_orderkey, o_totalprice FROM orders"


def json_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good lines and quarantined ones of a ledger in which every tenth line is cut off."""
    path = scratch(spark, "ledger")
    docs = load(spark, sf_dir, "documents")
    line = F.to_json(F.struct("doc_id", "source", "lang"), {"ignoreNullFields": "false"})
    docs.select(F.when(F.col("doc_id") % 10 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.option("compression", "gzip").text(path)
    good, bad = landed.audited_json_lines(spark, path, "doc_id bigint, source string, lang string")
    return good.select("doc_id", "source", F.lit("READ").alias("status")).union(bad.groupBy("line").count().selectExpr("NULL", "line", "'MALFORMED'"))


JSON_SQL = """SELECT doc_id, source, 'READ' AS status FROM documents WHERE doc_id % 10 <> 0
UNION ALL SELECT DISTINCT CAST(NULL AS BIGINT), substr('{"doc_id":' || doc_id || ',', 1, 12), 'MALFORMED' FROM documents WHERE doc_id % 10 = 0"""


def keyed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "keyed")
    docs = load(spark, sf_dir, "documents").where("source IS NOT NULL")
    lists = docs.groupBy("source").agg(F.collect_list(F.struct("doc_id", "n_chars")).alias("rows"))
    whole = lists.agg(F.map_from_entries(F.collect_list(F.struct("source", "rows"))).alias("m"))  # one file, as it lands
    whole.select(F.to_json("m").alias("value")).coalesce(1).write.text(path)
    return landed.keyed_json(spark, path, "doc_id: bigint, n_chars: bigint", "source")


def bucket_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a JSON-lines bucket with an http(s) url and a title."""
    path = scratch(spark, "bucket")
    title = F.when(F.col("page_id") % 4 != 1, F.concat(F.lit("t"), F.col("page_id")))
    load(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("ftp:"), "url")).otherwise(F.col("url")).alias("url"), title.alias("title")).write.json(path)
    return landed.news_bucket(spark, path, "page_id bigint, url string, title string")


BUCKET_SQL = "SELECT page_id, url, 't' || page_id AS title FROM pages WHERE page_id % 5 <> 0 AND page_id % 4 <> 1"


def feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of feeds, and what goes to the quarantine: items without a source or time, payloads that are no feed."""
    docs = load(spark, sf_dir, "documents").select("doc_id")
    k = F.col("doc_id").cast("string")
    date = F.when(F.col("doc_id") % 7 == 0, "soon").otherwise("Mon, 05 Jan 2026 07:08:09 GMT")
    item = F.concat(F.lit("<item><title> T"), k, F.lit(" </title><link>http://a/"), k, F.lit("</link><pubDate>"), date, F.lit("</pubDate><source>"), F.when(F.col("doc_id") % 5 == 0, "").otherwise("S"), F.lit("</source></item>"))
    payload = F.when(F.col("doc_id") % 11 == 0, "<rss><chan").otherwise(F.concat(F.lit("<rss><channel>"), item, F.lit("</channel></rss>")))
    items, quarantine = landed.feed_items(docs.withColumn("payload", payload))
    good = items.select("doc_id", "headline", "guid", F.unix_seconds("published_at").alias("published"), F.lit("READ").alias("status"))
    return good.union(quarantine.selectExpr("doc_id", "NULL", "NULL", "NULL", "reason"))


FEED_SQL = """SELECT doc_id, CASE WHEN ok THEN 'T' || doc_id END AS headline, CASE WHEN ok THEN 'http://a/' || doc_id END AS guid, CAST(CASE WHEN ok THEN 1767596889 END AS BIGINT) AS published,
CASE WHEN ok THEN 'READ' WHEN doc_id % 11 = 0 THEN 'INVALID_FEED' ELSE 'INVALID_ITEM' END AS status FROM (SELECT doc_id, doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND doc_id % 5 <> 0 AS ok FROM documents) x"""


def filing_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").groupBy("source").agg(F.sort_array(F.collect_list(F.struct("doc_id", "lang"))).alias("x"))
    return landed.columnar_filings(docs.select("source", "x.doc_id", "x.lang"), ["doc_id", "lang"], F.expr("lang IN ('en', 'de')"))


def index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "orders").select(
        F.concat_ws(
            "|", F.concat(F.lit("00"), F.col("o_custkey").cast("string")), F.concat(F.lit(" Name "), F.col("o_custkey").cast("string")), F.when(F.col("o_orderkey") % 3 == 0, "8-K").otherwise("4"),
            F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("edgar/data/"), F.col("o_orderkey").cast("string"), F.lit(".txt")), F.when(F.col("o_orderkey") % 13 == 0, "more"),
        ).alias("value")
    )
    return landed.master_index(lines, ["8-K", "10-Q"])


INDEX_SQL = """SELECT CAST(o_custkey AS VARCHAR) AS cik, 'Name ' || o_custkey AS company, '8-K' AS form, strftime(o_orderdate, '%Y-%m-%d') AS filed, 'edgar/data/' || o_orderkey || '.txt' AS filename, CAST(o_orderkey AS VARCHAR) AS accession
FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 13 <> 0"""


def listed_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part").select((F.col("p_partkey") % 700).alias("ticker"), F.col("p_brand").alias("exchange"), F.col("p_type").alias("name"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice") + F.col("p_partkey") / 1e6).alias("market_cap"))
    return landed.universe(part, "(?i)A", 7).select("ticker", "exchange", "name", "market_cap")


UNIVERSE_SQL = """WITH p AS (SELECT p_partkey % 700 AS ticker, p_brand AS exchange, p_type AS name, CASE WHEN p_partkey % 9 <> 0 THEN p_retailprice + p_partkey / 1e6 END AS market_cap FROM part WHERE regexp_matches(p_type, '(?i)A')),
o AS (SELECT * FROM p WHERE market_cap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY market_cap DESC, exchange) = 1)
SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY exchange ORDER BY market_cap DESC, ticker) <= 7"""


def normal_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars under other column names, in New York's wall clock, with repeated times and missing closes."""
    events = load(spark, sf_dir, "events").where("event_type = 'view'")
    raw = events.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:00").alias("T"), F.col("value").cast("string").alias("Open"), F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("c"), F.lit("x").alias("vol"))
    bars = landed.bars(raw.withColumn("vol", F.lit(None).cast("string")), "America/New_York", ("user_id",))
    return bars.select("user_id", F.unix_seconds("datetime").alias("at"), "open", "close")


BARS_SQL = """SELECT user_id, CAST(epoch((date_trunc('minute', ts) AT TIME ZONE 'America/New_York')) AS BIGINT) AS at, max(value) AS open, max(value) AS close
FROM events WHERE event_type = 'view' AND event_id % 6 <> 0 GROUP BY 1, 2""".replace(" AS at,", " AS \"at\",")


def fallback_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return landed.first_source([orders.where(f"o_orderstatus = '{s}'") for s in ("P", "F", "O")], "o_custkey")


FALLBACK_SQL = """WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS k FROM orders)
SELECT o_custkey, o_orderkey, o_orderstatus FROM r WHERE k IS NOT NULL QUALIFY k = min(k) OVER (PARTITION BY o_custkey)"""


def alias_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("ID"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("Publisher"), F.col("lang").alias("feed"))
    return landed.aliased(raw, {"doc_id": ["id"], "publisher": ["publisher", "source", "feed"], "author": ["by"]}, required=("doc_id",))


ALIAS_SQL = "SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN source END, lang) AS publisher, CAST(NULL AS VARCHAR) AS author FROM documents"


_TIMES = [
    ("2026-01-05T07:08:09Z", 1767596889, "EXACT_SECOND", "HIGH", False), ("Mon, 05 Jan 2026 07:08:09 EST", 1767614889, "EXACT_SECOND", "HIGH", False), ("2026-01-05 07:08", 1767596880, "EXACT_MINUTE", "LOW", True),
    ("2026-01-05", 1767571200, "DATE_ONLY", "LOW", True), ("2026-01-05 16:08:09+09:00", 1767596889, "EXACT_SECOND", "HIGH", False), ("yesterday", None, "UNKNOWN", "UNKNOWN", False),
]


def published_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(t[0]) for t in _TIMES]), (F.col("doc_id") % len(_TIMES) + 1).cast("int"))
    rows = load(spark, sf_dir, "documents").select("doc_id", articles.published(raw).alias("p"))
    return rows.select("doc_id", F.unix_seconds("p.at").alias("published"), "p.precision", "p.confidence", "p.zone_inferred")


PUBLISHED_SQL = "SELECT doc_id, published, precision, confidence, zone_inferred FROM documents JOIN (VALUES " + ", ".join(
    f"({i}, {'CAST(NULL AS BIGINT)' if at is None else at}, '{p}', '{c}', {str(z).lower()})" for i, (_, at, p, c, z) in enumerate(_TIMES)
) + f") t(k, published, precision, confidence, zone_inferred) ON k = doc_id % {len(_TIMES)}"


def tickers_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = load(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "KR").otherwise("US").alias("market"))
    raw = F.when(F.col("market") == "KR", F.concat(F.lit(" A"), F.col("c_custkey").cast("string"), F.lit("k"))).otherwise(F.concat(F.lit("ab."), F.col("c_custkey").cast("string"), F.lit(" ")))
    ticker = tx.norm_ticker(raw, F.col("market"))
    return customers.select("c_custkey", ticker.alias("ticker"), tx.stable_id("ev_", F.col("market"), ticker).alias("id"), articles.shift_probability((F.col("c_custkey") % 100) / 100, 0.5).cast("decimal(18,8)").cast("double").alias("shifted"))


TICKERS_SQL = """WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'KR' ELSE 'US' END AS market, CASE WHEN c_custkey % 2 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') ELSE 'AB-' || c_custkey END AS ticker, least(greatest(c_custkey % 100 / 100.0, 1e-6), 1 - 1e-6) AS p FROM customer)
SELECT c_custkey, ticker, 'ev_' || substr(sha256(market || chr(31) || ticker), 1, 24) AS id, CAST(CAST(1 / (1 + exp(-(ln(p / (1 - p)) + 0.5))) AS DECIMAL(18, 8)) AS DOUBLE) AS shifted FROM t"""


def seen_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first capture of each user's kind of event, and whether it was in time."""
    rows = load(spark, sf_dir, "events").select(F.concat_ws("-", "user_id", "event_type").alias("key"), "event_id", F.col("ts").alias("captured_at"), (F.col("ts") - F.expr("make_dt_interval(0, 0, CAST(event_id % 4 AS INT))")).alias("published_at"))
    return capture.flag_usable(capture.first_seen(rows, "key")).select("key", "event_id", "usable")


SEEN_SQL = "SELECT user_id || '-' || event_type AS key, event_id, event_id % 4 <= 2 AS usable FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, user_id || '-' || event_type, event_id) = 1"


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after two upserts: the later order date of each customer wins, new rows win ties."""
    path = scratch(spark, "upserted")
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    first = orders.where("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.max("o_orderdate").alias("o_orderdate"))
    second = orders.where("o_orderkey % 2 = 1").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.max("o_orderdate").alias("o_orderdate"))
    for part in (first, second):
        sinks.upsert(spark, path, part, ["o_custkey"], "o_orderdate")
    return sinks.latest(spark, path).select("o_custkey", "o_orderkey")


UPSERT_SQL = "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey % 2 DESC, o_orderkey DESC) = 1"


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger after overlapping appends: each key once."""
    path = scratch(spark, "appended")
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    for condition in ("doc_id % 3 < 2", "doc_id % 3 > 0", "doc_id % 3 = 1"):
        sinks.append_ledger(spark, path, docs.where(condition), "doc_id")
    return spark.read.schema("doc_id bigint, source string").json(path).select("doc_id", "source")


def sessions_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("event_id", F.expr("CAST(CAST(ts AS STRING) AS TIMESTAMP)").alias("at"), F.when(F.col("user_id") % 2 == 0, "US").otherwise("KR").alias("market"))
    b = articles.session_bounds(F.col("at"), F.col("market"))
    return rows.select("event_id", b.alias("b")).select("event_id", F.date_format("b.local", "yyyy-MM-dd HH:mm:ss").alias("local"), F.date_format("b.open", "yyyy-MM-dd HH:mm").alias("open"), F.date_format("b.close", "yyyy-MM-dd HH:mm").alias("close"))


SESSION_SQL = """WITH e AS (SELECT event_id, user_id % 2 = 0 AS us, CASE WHEN user_id % 2 = 0 THEN (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' ELSE (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Seoul' END AS l FROM events)
SELECT event_id, strftime(l, '%Y-%m-%d %H:%M:%S') AS local, strftime(l, '%Y-%m-%d ') || CASE WHEN us THEN '09:30' ELSE '09:00' END AS open, strftime(l, '%Y-%m-%d ') || CASE WHEN us THEN '16:00' ELSE '15:30' END AS close FROM e"""


def retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retry schedule of each user's events: error events fail, the others succeed."""
    events = load(spark, sf_dir, "events").where("event_type IN ('error', 'signup')")
    rows = events.select(F.col("user_id").cast("string").alias("query_id"), F.expr("CAST(CAST(ts AS STRING) AS TIMESTAMP)").alias("attempt_at"), F.expr("CASE WHEN event_type = 'error' THEN 'E' || CAST(event_id % 2 AS STRING) END").alias("error"), F.lit(False).alias("deterministic"), F.lit(600).alias("cadence_s"))
    done = capture.retry_schedule(rows)
    return done.groupBy("query_id", "status").agg(F.count("*").alias("n"), F.max("failures").cast("bigint").alias("most"), F.max(F.unix_seconds("next_due") - F.unix_seconds("attempt_at")).alias("longest"))


RETRY_SQL = """WITH e AS (SELECT user_id, ts, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events WHERE event_type IN ('error', 'signup')),
g AS (SELECT *, coalesce(max(CASE WHEN NOT bad THEN k END) OVER (PARTITION BY user_id ORDER BY k), 0) AS good FROM e),
f AS (SELECT CAST(user_id AS VARCHAR) AS query_id, bad, k - good AS failures FROM g)
SELECT query_id, CASE WHEN bad THEN 'BACKOFF' ELSE 'READY' END AS status, count(*) AS n, max(failures) AS most, max(CASE WHEN bad THEN 60 * least(480, 5 * pow(2, least(failures - 1, 7))) ELSE 600 END)::BIGINT AS longest FROM f GROUP BY 1, 2"""


PAIRS = {
    "landed_csv": (csv_rows, CSV_SQL), "json_ledger_audit": (json_ledger, JSON_SQL), "keyed_json_rows": (keyed_rows, "SELECT source, doc_id, n_chars FROM documents WHERE source IS NOT NULL"), "news_bucket": (bucket_rows, BUCKET_SQL),
    "feed_items": (feed_rows, FEED_SQL), "columnar_filings": (filing_arrays, "SELECT source, doc_id, lang FROM documents WHERE lang IN ('en', 'de')"), "master_index": (index_lines, INDEX_SQL), "listed_universe": (listed_universe, UNIVERSE_SQL),
    "normal_bars": (normal_bars, BARS_SQL), "fallback_sources": (fallback_sources, FALLBACK_SQL), "alias_columns": (alias_columns, ALIAS_SQL), "published_times": (published_times, PUBLISHED_SQL), "tickers_and_ids": (tickers_and_ids, TICKERS_SQL),
    "first_seen": (seen_first, SEEN_SQL), "upsert_latest": (upserted, UPSERT_SQL), "append_ledger": (ledger_rows, "SELECT doc_id, source FROM documents"), "session_bounds": (sessions_of_events, SESSION_SQL), "retry_schedule": (retries, RETRY_SQL),
}
QUERIES = {name: pair[0] for name, pair in PAIRS.items()}
ORACLES = {name: pair[1] for name, pair in PAIRS.items()}
