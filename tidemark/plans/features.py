"""Event features over the given tables: events are the market's events, documents the articles linked to them.

A document belongs to the event whose id is a third of its own, and is published some hours before or minutes after it. What the tables do
not hold (tiers, classes, types, precision) comes from a hash of the id. Their SQL is written from the rule, not from the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.operators import event_features as ef
from tidemark.plans.dialect import statement

_TOPICS = ["FDA_APPROVAL", "TRIAL_NEGATIVE", "OFFERING", "", "RECALL", "TRIAL_POSITIVE", "OTHER"]
_TYPES = ["news rss", "SEC filing", "kind disclosure", "issuer feed", "", "news rss", "news api"]
_TIERS = ["A", "B_FULL", "B_HEADLINE", "C", "A", "B_FULL"]


def _events(q) -> str:
    return f"""SELECT {q.string('event_id')} AS canonical_event_id, 'g-' || {q.string('user_id')} AS event_group_id, CASE WHEN user_id % 3 = 0 THEN 'KR' ELSE 'US' END AS market,
        {q.string('user_id')} AS ticker, {q.us('ts')} AS event_time, {q.us('ts')} + 120000000 AS decision_cutoff FROM events"""


def _articles(q) -> str:
    return f"""SELECT a.*, e.ticker, CASE WHEN h % 23 = 0 THEN NULL ELSE event_time + (h % 7 - 5) * 3600000000 * (h % 11) END AS published_at FROM (
        SELECT {q.string('doc_id')} AS article_uid, CASE WHEN doc_id % 29 = 0 THEN NULL ELSE {q.string('CAST(floor(doc_id / 3) AS BIGINT)')} END AS canonical_event_id, {q.hash32(q.string('doc_id'))} AS h,
            'r-' || {q.string('CAST(floor(doc_id / 2) AS BIGINT)')} AS syndication_root_id, doc_id % 7 <> 6 AS causal_t2_eligible, {q.at(_TIERS, 'doc_id % 6')} AS quality_tier,
            CASE WHEN doc_id % 31 = 0 THEN NULL ELSE source END AS origin_publisher, {q.at([*rules.PUBLISHER_CLASSES, ""], 'doc_id % 10')} AS publisher_class, source AS publisher_canonical,
            CASE WHEN doc_id % 37 = 0 THEN 'https://www.sec.gov/x' ELSE 'https://example.com/' || {q.string('doc_id')} END AS canonical_url, {q.at(_TYPES, 'doc_id % 7')} AS source_type, 'feed' AS source_provider,
            {q.at(_TOPICS, 'doc_id % 7')} AS primary_topic, text AS normalized_text, substr(coalesce(text, ''), 1, 80) AS headline, CASE WHEN doc_id % 5 = 0 THEN '' ELSE substr(coalesce(text, ''), 81) END AS body,
            embedding, CASE WHEN embedding IS NULL THEN '' ELSE 'rev  1' END AS embedding_model_revision, {q.at(["EXACT_SECOND", "DATE_ONLY", "EXACT_MINUTE", "ODD"], 'doc_id % 4')} AS published_at_precision,
            {q.at(["HIGH", "LOW", "MEDIUM", "UNKNOWN", ""], 'doc_id % 5')} AS published_at_confidence, doc_id % 4 = 1 AS first_seen_observed
        FROM documents LEFT JOIN embeddings ON vec_id = doc_id) a JOIN ({_events(q)}) e ON e.canonical_event_id = {q.string('CAST(floor(CAST(article_uid AS BIGINT) / 3) AS BIGINT)')}"""


EVENTS, ARTICLES = statement(_events), statement(_articles)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 8).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def event_feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ef.event_features(EVENTS[0](spark, sf_dir), ARTICLES[0](spark, sf_dir)))


def event_article_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ef.event_clusters(EVENTS[0](spark, sf_dir), ARTICLES[0](spark, sf_dir))


_WORDS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9가-힣]+', ' ', 'g')), ' '), lambda w: length(w) > 1))"
_CLEAN = "trim(regexp_replace(coalesce({}, ''), '\\s+', ' ', 'g'))"
_LIKE = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END"
_case = lambda c, order: "CASE " + " ".join(f"WHEN {c} = '{k}' THEN {v}" for k, v in order.items()) + " ELSE 0 END"
_in = lambda names: ", ".join(f"'{n}'" for n in names)
_json = lambda c: f"CAST(to_json(list_sort(coalesce(list(DISTINCT {c}) FILTER ({c} <> ''), []))) AS VARCHAR)"

FEATURE_SQL = f"""
WITH e AS ({EVENTS[1]}), a AS ({ARTICLES[1]}),
r0 AS (SELECT a.*, row_number() OVER (PARTITION BY canonical_event_id, syndication_root_id ORDER BY published_at NULLS LAST, article_uid) AS k FROM a WHERE causal_t2_eligible AND canonical_event_id IS NOT NULL),
hay AS (SELECT article_uid, concat_ws(' ', lower({_CLEAN.format('source_type')}), lower({_CLEAN.format('source_provider')}), lower({_CLEAN.format('publisher_class')}), lower({_CLEAN.format('publisher_canonical')}), lower({_CLEAN.format('canonical_url')})) AS t FROM a),
r AS (SELECT r0.* EXCLUDE (k), canonical_event_id AS ev, {_WORDS.format('normalized_text')} AS w, {_WORDS.format('headline')} AS hw, {_WORDS.format('body')} AS bw, {_CLEAN.format('origin_publisher')} AS pub,
    CASE WHEN contains(t, 'sec.gov') OR regexp_matches(t, '\\b(sec|edgar)\\b') THEN 'SEC' WHEN contains(t, 'kind.krx') OR contains(t, 'dart.fss') OR regexp_matches(t, '\\bkind\\b') THEN 'KIND' WHEN contains(t, 'issuer') OR contains(t, 'official') THEN 'ISSUER_PR' ELSE '' END AS kind
    FROM r0 JOIN hay USING (article_uid) WHERE k = 1),
tiers AS (SELECT canonical_event_id AS ev, count(*) FILTER (causal_t2_eligible AND quality_tier = 'A') AS ta, count(*) FILTER (causal_t2_eligible AND quality_tier = 'B_FULL') AS tb, count(*) FILTER (quality_tier = 'B_HEADLINE') AS th FROM a GROUP BY 1),
vec AS (SELECT ev, count(embedding) >= 2 AS by_vector FROM r GROUP BY 1),
p AS (SELECT l.ev, CASE WHEN by_vector THEN CASE WHEN l.embedding IS NOT NULL AND m.embedding IS NOT NULL THEN greatest(-1, least(1, list_dot_product(l.embedding::DOUBLE[], m.embedding::DOUBLE[]))) END ELSE {_LIKE.format('l.w', 'm.w')} END AS s,
    CASE WHEN (l.kind = '') <> (m.kind = '') THEN {_LIKE.format('l.w', 'm.w')} END AS c FROM r l JOIN r m ON l.ev = m.ev AND l.article_uid < m.article_uid JOIN vec ON vec.ev = l.ev),
ps AS (SELECT ev, max(c) AS c, avg(s) AS mean_, median(s) AS median_, min(s) AS min_ FROM p GROUP BY 1),
pub AS (SELECT ev, -sum(n / total * ln(n / total)) AS entropy FROM (SELECT ev, pub, count(*) AS n, sum(count(*)) OVER (PARTITION BY ev) AS total FROM r GROUP BY 1, 2) x GROUP BY 1),
cls AS (SELECT ev, '{{' || string_agg('"' || publisher_class || '":' || n, ',' ORDER BY publisher_class) || '}}' AS j FROM (SELECT ev, publisher_class, count(*) AS n FROM r GROUP BY 1, 2) x GROUP BY 1),
top AS (SELECT ev, max(n) AS most FROM (SELECT ev, primary_topic, count(*) AS n FROM r GROUP BY 1, 2) x GROUP BY 1),
st AS (SELECT r.ev, count(*) AS n, count(DISTINCT origin_publisher) AS up, count(DISTINCT pub) AS uop, count(DISTINCT publisher_class) FILTER (publisher_class <> '') AS uc, count(DISTINCT source_type) FILTER (source_type <> '') AS ut,
    count(*) FILTER (kind <> '') AS nk, coalesce(bool_or(kind = 'ISSUER_PR'), false) AS ki, bool_or(kind = 'SEC') AS ks, bool_or(kind = 'KIND') AS kk, count(embedding) AS ne, arg_min(trim(regexp_replace(embedding_model_revision, '\\s+', ' ', 'g')), (published_at IS NULL, coalesce(published_at, 0), article_uid)) AS rev,
    arg_min(r.ticker, (published_at IS NULL, coalesce(published_at, 0), article_uid)) AS tick,
    {', '.join(f"bool_or(publisher_class = '{c}') AS has_{c}, count(*) FILTER (publisher_class = '{c}') AS n_{c}" for c in rules.PUBLISHER_CLASSES)},
    least(count(*) FILTER (primary_topic IN ({_in(rules.POSITIVE_TOPICS)})), count(*) FILTER (primary_topic IN ({_in(rules.NEGATIVE_TOPICS)}))) AS conflict,
    {_json('primary_topic')} AS jt, {_json('pub')} AS jp, {_json('source_type')} AS js, avg({_case('published_at_precision', rules.PRECISION_ORDER)}) AS prec, avg({_case('published_at_confidence', rules.CONFIDENCE_ORDER)}) AS conf,
    min((published_at - event_time) / 60e6) AS m0, max((published_at - event_time) / 60e6) AS m1, count(*) FILTER (published_at <= event_time) AS pre, count(*) FILTER (published_at > event_time) AS post, count(*) FILTER (first_seen_observed) AS seen,
    avg(length(headline)) AS hl, avg(length(body)) AS bl, avg(CASE WHEN body <> '' THEN 1 ELSE 0 END) AS ba, avg({_LIKE.format('hw', 'bw')}) AS hb FROM r JOIN e ON e.canonical_event_id = r.ev GROUP BY 1),
old AS (SELECT ticker, canonical_event_id AS ev, published_at AS t, {_WORDS.format('normalized_text')} AS w FROM a WHERE published_at IS NOT NULL),
nv AS (SELECT r.ev, {', '.join(f"max({_LIKE.format('r.w', 'old.w')}) FILTER (old.t >= event_time - {span}) AS s{name}" for name, span in ef.WINDOWS.items())}
    FROM r JOIN st ON st.ev = r.ev JOIN e ON e.canonical_event_id = r.ev JOIN old ON old.ticker = st.tick AND coalesce(old.ev, '') <> r.ev AND old.t < event_time AND old.t >= event_time - {30 * ef.DAY} GROUP BY 1)
SELECT e.canonical_event_id, event_group_id, market, ticker, event_time, decision_cutoff, coalesce(ta, 0) AS "tierA_article_count_t2", coalesce(tb, 0) AS "tierB_article_count_t2", coalesce(tb, 0) AS "tierBFull_article_count_t2", coalesce(th, 0) AS "tierBHeadline_article_count_t2",
    coalesce(n, 0) AS independent_source_count_t2, coalesce(up, 0) AS unique_publisher_count_t2, coalesce(n, 0) AS syndication_root_count_t2, coalesce(cls.j, '{{}}') AS publisher_class_counts_t2, coalesce(nk, 0) AS structured_confirmation_count_t2, coalesce(nk, 0) AS official_source_count_t2,
    coalesce(ki, false) AS issuer_pr_present_t2, coalesce(ks, false) AS "SEC_present_t2", coalesce(kk, false) AS "KIND_present_t2", round(c, 8) AS structured_text_similarity, coalesce(uop, 0) AS unique_origin_publisher_count, coalesce(uc, 0) AS unique_publisher_class_count,
    round(coalesce(entropy, 0), 8) + 0 AS publisher_entropy, coalesce(ut, 0) AS source_type_diversity, coalesce(has_WIRE, false) AS wire_present, coalesce(has_MAJOR_FINANCIAL, false) AS major_financial_present, coalesce(has_BIOTECH_SPECIALIST, false) AS biotech_specialist_present, coalesce(has_ISSUER_OFFICIAL, false) AS issuer_official_present,
    round(mean_, 8) AS mean_pairwise_similarity, round(median_, 8) AS median_similarity, round(min_, 8) AS minimum_similarity, round(1 - mean_, 8) AS semantic_dispersion, mean_ IS NOT NULL AS semantic_consensus_available, CASE WHEN ne >= 2 THEN 'MULTILINGUAL_E5_COSINE' ELSE 'TOKEN_JACCARD_FALLBACK' END AS semantic_similarity_method,
    coalesce(ne, 0) AS embedding_article_count_t2, round(ne / n, 8) AS embedding_coverage_t2, coalesce(rev, '') AS embedding_model_revision, round(most / st.n, 8) AS topic_agreement_rate, coalesce(conflict, 0) AS topic_conflict_count, round(coalesce(conflict / n, 0), 8) AS semantic_contradiction_proxy,
    coalesce(jt, '[]') AS primary_topics_t2, coalesce(jp, '[]') AS origin_publishers_t2, coalesce(js, '[]') AS source_types_t2, round(prec, 8) AS published_time_precision_mean, round(conf, 8) AS published_time_confidence_mean, round(m0, 8) AS minutes_from_event_to_publish_min, round(m1, 8) AS minutes_from_event_to_publish_max,
    coalesce(pre, 0) AS published_pre_event_count, coalesce(post, 0) AS published_post_event_count, coalesce(seen, 0) AS first_seen_known_count, round(hl, 8) AS headline_length_mean, round(bl, 8) AS body_length_mean, round(ba, 8) AS body_available_rate, round(hb, 8) AS headline_body_similarity_mean,
    e.canonical_event_id AS market_context_join_key, e.canonical_event_id AS model_agreement_join_key, {', '.join(f'round(s{w}, 8) AS similarity_to_prior_{w}' for w in ef.WINDOWS)}, coalesce(s30d >= 0.85, false) AS near_duplicate_prior_news,
    CASE WHEN n IS NULL THEN 'NO_CAUSAL_ARTICLE' WHEN s30d >= 0.85 THEN 'NEAR_DUPLICATE_PRIOR_NEWS' WHEN s30d >= 0.55 THEN 'MINOR_UPDATE_OR_REPUBLICATION' ELSE 'NOVEL_STORY' END AS news_recycling_class,
    {', '.join(f'coalesce(n_{c}, 0) AS publisher_class_{c.lower()}_count_t2' for c in rules.PUBLISHER_CLASSES)}
FROM e LEFT JOIN tiers ON tiers.ev = e.canonical_event_id LEFT JOIN st ON st.ev = e.canonical_event_id LEFT JOIN ps ON ps.ev = e.canonical_event_id LEFT JOIN pub ON pub.ev = e.canonical_event_id LEFT JOIN cls ON cls.ev = e.canonical_event_id
LEFT JOIN top ON top.ev = e.canonical_event_id LEFT JOIN nv ON nv.ev = e.canonical_event_id"""

CLUSTER_SQL = f"""
WITH e AS ({EVENTS[1]}), a AS ({ARTICLES[1]}),
l AS (SELECT canonical_event_id, count(*) AS n, count(*) FILTER (causal_t2_eligible) AS c, {', '.join(f'CAST(to_json(list_sort(list(DISTINCT {x}))) AS VARCHAR) AS {y}' for x, y in (('syndication_root_id', 'r'), ('article_uid', 'u'), ('primary_topic', 't')))} FROM a GROUP BY 1)
SELECT canonical_event_id, event_group_id, coalesce(n, 0) AS article_count_all_windows, coalesce(c, 0) AS causal_article_count_t2, coalesce(r, '[]') AS syndication_root_ids, coalesce(u, '[]') AS article_uids, coalesce(t, '[]') AS topics FROM e LEFT JOIN l USING (canonical_event_id)"""

QUERIES = {"event_feature_rows": event_feature_rows, "event_article_clusters": event_article_clusters}
ORACLES = {"event_feature_rows": FEATURE_SQL, "event_article_clusters": CLUSTER_SQL}
