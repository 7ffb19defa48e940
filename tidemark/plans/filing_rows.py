"""The structure of filings: whole documents as bodies, three in four with a filing's items, exhibit, figures and closing around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import filings
from tidemark.functions.filings import TAXONOMY
from tidemark.plans.dialect import statement


def _bodies(q) -> str:
    n = "chr(10)"
    half = "CAST(floor(length(text) / 2) AS INT)"
    return f"""SELECT doc_id, source AS headline, CASE WHEN doc_id % 4 = 0 THEN text ELSE 'Cover' || {n} || 'Item 2.02 ' || substr(text, 1, {half}) || ' raised $12.5 million. The offering price is $' || {q.string('doc_id % 9 + 1')} || '.50 a share, USD 3 bn in all. '
        || CASE WHEN doc_id % 6 <> 1 THEN 'item 9.01 Exhibits' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN {n} || ' EX-99.1 ' || {n} ELSE ' ' END || substr(text, {half} + 1) || ' Enrolled 120 of n = 90, p < 0.0' || {q.string('doc_id % 8 + 1')} || ', hazard ratio of 0.7. FDA has approved. Phase III warrants.'
        || CASE WHEN doc_id % 5 = 0 THEN {n} || 'SIGNATURES' || {n} || 'phase 2' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN ' Forward-looking statements: crl' ELSE '' END END AS body FROM documents"""


BODIES = statement(_bodies)


def filing_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = BODIES[0](spark, sf_dir).withColumn("log_price", F.ln(F.lit(4.0)))
    return filings.structure(rows, "headline", "body", "log_price").drop("headline", "body", "log_price")


def _sql() -> str:
    text = lambda p: p.replace("'", "''")
    hit = lambda part, p: f"regexp_matches({part}, '(?is){text(p)}')::INT::VARCHAR"
    count = lambda p: f"len(regexp_extract_all(t, '(?is){text(p)}'))"
    tax = ", ".join(f"CASE WHEN {count(p)} > 0 THEN '{k}:' || least({count(p)}, 10) || ':' || {hit('prim', p)} || ':' || {hit('ex', p)} END" for k, p in sorted(TAXONOMY.items()))
    numbers = lambda p: f"list_filter(list_transform(regexp_extract_all(t, '{p}', 1), lambda x: x::DOUBLE), lambda x: x > 0)"
    mark, item = r"(?im)^\s*EX(?:HIBIT)?[-_ ]?99(?:\.[0-9]+)?\s*$", r"(?i)\bitem\s+(?:1\.01|2\.02|2\.03|3\.02|5\.02|7\.01|8\.01|9\.01)\b"
    return rf"""WITH b AS ({BODIES[1]}), c AS (SELECT doc_id, coalesce(headline, '') AS head, coalesce(body, '') AS body FROM b),
        r AS (SELECT *, string_split_regex(regexp_replace(body, '(?is)(?:forward[- ]looking statements?|safe harbor).*$', ' '), '(?im)^\s*SIGNATURES?\s*$')[1] AS rd FROM c),
        e AS (SELECT *, regexp_extract(rd, '{mark}') AS mark, regexp_extract(rd, '{item}') AS first FROM r),
        f AS (SELECT *, CASE WHEN mark <> '' THEN substr(rd, length(string_split_regex(rd, '{mark}')[1]) + length(mark) + 1) ELSE '' END AS ex, CASE WHEN first = '' THEN rd ELSE substr(regexp_replace(substr(rd, strpos(rd, first)), '({item})', ' \1', 'g'), 2) END AS whole FROM e),
        g AS (SELECT *, CASE WHEN mark = '' THEN whole ELSE substr(whole, 1, greatest(strpos(whole, mark) - 1, 0)) END AS prim FROM f),
        h AS (SELECT *, head || ' ' || prim || ' ' || ex AS t, list_sort(list_distinct(regexp_extract_all(body, '(?i)\bitem\s+(1\.01|2\.02|2\.03|3\.02|5\.02|7\.01|8\.01|9\.01)\b', 1))) AS items FROM g),
        a AS (SELECT *, '(?i)(?:\$|usd\s*)([0-9]+(?:\.[0-9]+)?)\s*(million|billion|m|bn)?' AS pattern, regexp_extract(t, '(?is)(?:offering|purchase) price.{{0,80}}?\$\s*([0-9]+(?:\.[0-9]+)?)', 1) AS offer FROM h),
        m AS (SELECT *, list_transform(regexp_extract_all(t, pattern), lambda x: regexp_extract(x, pattern, 1)::DOUBLE * CASE WHEN lower(regexp_extract(x, pattern, 2)) IN ('million', 'm') THEN 1e6 WHEN lower(regexp_extract(x, pattern, 2)) IN ('billion', 'bn') THEN 1e9 ELSE 1 END) AS amounts FROM a)
        SELECT doc_id, array_to_string(items, ',') AS items, CASE WHEN len(items) > 1 THEN array_to_string(list_transform(range(1, len(items)), lambda i: items[i] || '|' || items[i + 1]), ',') ELSE '' END AS item_pairs, trim(body, ' ') <> '' AS body_present, ex <> '' AS exhibit_present,
        regexp_matches(body, '(?im)^\s*SIGNATURES?\s*$') AS signature_present, regexp_matches(body, '(?i)forward[- ]looking statements?|safe harbor') AS disclaimer_present, round(ln(1 + length(body)), 6) AS log_body_len, round(ln(1 + length(prim)), 6) AS log_primary_len,
        round(ln(1 + length(ex)), 6) AS log_exhibit_len, concat_ws(',', {tax}) AS taxonomy, round(coalesce(ln(1 + list_max(list_filter(amounts, lambda x: x > 0 AND x < 1e13))), 0), 6) AS max_amount_log, CASE WHEN offer <> '' THEN round(least(greatest(offer::DOUBLE / 4 - 1, -2), 2), 6) END AS offer_vs_entry,
        round(coalesce(ln(1 + list_max({numbers(r'(?i)\b(?:n\s*=|enroll(?:ed|ment of))\s*([0-9]{1,5})\b')})), 0), 6) AS max_subjects_log, round(coalesce(-log10(list_min({numbers(r'(?i)\bp\s*[=<]\s*(0?\.[0-9]+)')})), 0), 6) AS least_p_neglog,
        round(coalesce(ln({numbers(r'(?is)hazard ratio.{0,30}?(0?\.[0-9]+)')}[1]), 0), 6) AS hazard_ratio_log FROM m"""


QUERIES = {"filing_structure": filing_structure}
ORACLES = {"filing_structure": _sql()}
