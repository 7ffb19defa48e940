"""Articles and table rows read from markup: the given pages with heads of several kinds, and a day's orders as a disclosure table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.dialect import statement
from tidemark.sources import pages

#: A page's own title goes into the head in one of four forms, or stays where it is.
_HEADED = statement(
    lambda q: f"""SELECT page_id, url, CASE page_id % 4
        WHEN 0 THEN '<script type="application/ld+json">{{"@graph": [{{"@type": "WebSite", "publisher": {{"name": "Paper ' || {q.string('page_id')} || '"}}}}, {{"headline": "LD ' || {q.string('page_id')} || '", "datePublished": "2026-01-0' || {q.string('page_id % 9 + 1')} || 'T10:00:00Z", "articleBody": "Body ' || {q.string('page_id')} || '"}}]}}</script>'
        WHEN 1 THEN '<meta property="og:title" content="OG ' || {q.string('page_id')} || '"><meta name="pubdate" content="2026-02-0' || {q.string('page_id % 9 + 1')} || '"><meta property="og:url" content="/c/' || {q.string('page_id')} || '">'
        WHEN 2 THEN '<time datetime="2026-03-0' || {q.string('page_id % 9 + 1')} || 'T09:30+02:00">x</time>' ELSE '' END || coalesce(html, '') AS html FROM pages"""
)


def article_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pages.articles_of(_HEADED[0](spark, sf_dir), "page_id", "url", "html")
    names = ["headline", "headline_from", "publisher", "publisher_from", "published_raw", "published_from", "precision", "confidence", "body_from"]
    return got.select(F.col("id").alias("page_id"), *names, F.unix_seconds("published_at").alias("published"))


_TITLE = r"trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '[\s ]+', ' ', 'g'))"
CHAIN_SQL = f"""
WITH p AS (SELECT page_id, page_id % 4 AS k, CAST(page_id AS VARCHAR) AS id, page_id % 9 + 1 AS day, {_TITLE} AS title, coalesce(html, '') AS html FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'LD ' || id WHEN 1 THEN 'OG ' || id ELSE title END AS headline, CASE k WHEN 0 THEN 'JSON_LD' WHEN 1 THEN 'META:og:title' ELSE CASE WHEN title = '' THEN 'UNKNOWN' ELSE 'TITLE' END END AS headline_from,
CASE k WHEN 0 THEN 'Paper ' || id ELSE '' END AS publisher, CASE k WHEN 0 THEN 'JSON_LD' ELSE 'UNKNOWN' END AS publisher_from,
CASE k WHEN 0 THEN '2026-01-0' || day || 'T10:00:00Z' WHEN 1 THEN '2026-02-0' || day WHEN 2 THEN '2026-03-0' || day || 'T09:30+02:00' ELSE '' END AS published_raw,
CASE k WHEN 0 THEN 'JSON_LD_DATE_PUBLISHED' WHEN 1 THEN 'HTML_META:pubdate' WHEN 2 THEN 'HTML_TIME_DATETIME' ELSE 'UNKNOWN' END AS published_from,
CASE k WHEN 0 THEN 'EXACT_SECOND' WHEN 1 THEN 'DATE_ONLY' WHEN 2 THEN 'EXACT_MINUTE' ELSE 'UNKNOWN' END AS precision, CASE k WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' WHEN 2 THEN 'HIGH' ELSE 'UNKNOWN' END AS confidence,
CASE WHEN k = 0 THEN 'JSON_LD' WHEN regexp_matches(html, '(?i)<p[ >]') THEN 'PARAGRAPHS' ELSE 'UNKNOWN' END AS body_from,
epoch(CASE k WHEN 0 THEN make_timestamp(2026, 1, day, 10, 0, 0.0) WHEN 1 THEN make_timestamp(2026, 2, day, 0, 0, 0.0) WHEN 2 THEN make_timestamp(2026, 3, day, 7, 30, 0.0) END)::BIGINT AS published FROM p"""

#: A customer's orders as a page with one table; two neighbouring orders share a time cell.
_LISTED = """
SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders"""


def _tables(q) -> str:
    clock = f"lpad({q.string('o_custkey % 24')}, 2, '0') || ':' || lpad({q.string('CAST(floor((k - 1) / 2) AS BIGINT) % 60')}, 2, '0')"
    first = f"CASE WHEN k % 2 = 0 THEN '' WHEN k < n THEN '<td rowspan=\"2\">' || {clock} || '</td>' ELSE '<td>' || {clock} END"
    # The words of a script hold quotes of both kinds.
    call = lambda f, x: f"'<a onclick=\"{f}(''' || {x} || ''')\"'"
    row = f"'<tr>' || {first} || '<td>' || {call('companysummary_open', 'lpad(' + q.string('o_custkey') + ', 5, ' + chr(39) + '0' + chr(39) + ')')} || '>Customer&nbsp;' || {q.string('o_custkey')} || '</a><td>' || {call('openDisclsViewer', q.string('o_orderkey'))} || ' title=\" ' || o_orderpriority || ' \">short</a><td>x</td></tr>'"
    joined = f"array_join(transform(array_sort(collect_list(struct(k, {row} AS r))), x -> x.r), '')" if q.spark else f"string_agg({row}, '' ORDER BY k)"
    return f"""SELECT o_custkey, '2026-01-05' AS day, '<table><tr><td>other</table><table class="list type-00 mt10"><thead><tr><th>Time</th></tr></thead><tbody>' || {joined} || '</tbody></table>' AS html FROM ({_LISTED}) o GROUP BY o_custkey"""


_TABLES = statement(_tables)


def disclosure_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pages.disclosures(_TABLES[0](spark, sf_dir), "o_custkey", "day", "html")
    return got.select(F.col("id").alias("o_custkey"), "event_id", "ticker", "company", F.unix_seconds("event_time").alias("event_time"), "headline", "accession", "url")


DISCLOSURE_SQL = f"""
SELECT o_custkey, 'KIND:' || o_orderkey AS event_id, lpad(CAST(o_custkey AS VARCHAR), 5, '0') || '0' AS ticker, 'Customer ' || o_custkey AS company,
CAST(epoch(TIMESTAMP '2026-01-05 00:00:00') AS BIGINT) + (o_custkey % 24 - 9) * 3600 + CAST(floor((k - 1) / 2) AS BIGINT) % 60 * 60 AS event_time, o_orderpriority AS headline, CAST(o_orderkey AS VARCHAR) AS accession,
'https://kind.krx.co.kr/common/disclsviewer.do?method=search&acptno=' || o_orderkey || '&docno=&viewerhost=&viewerport=' AS url FROM ({_LISTED}) o"""

QUERIES = {"article_chain": article_chain, "disclosure_table_rows": disclosure_table_rows}
ORACLES = {"article_chain": CHAIN_SQL, "disclosure_table_rows": DISCLOSURE_SQL}
