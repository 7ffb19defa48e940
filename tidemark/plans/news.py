"""News rules as SQL plans over the documents: event types, topics, publishers, quality tiers, pairs, novelty, links.

A document stands for an article: its source for the ticker, its first 80 characters for the headline, and a hash of
its id for what the table does not hold (times, precision, confidence).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.operators import containment, graph, roots
from tidemark.operators.novelty import greatest_likeness, near_copies
from tidemark.plans.dialect import statement

HOUR, DAY = 3600, 86_400


def _normal(q, x: str) -> str:
    """Lower-cased text whose runs of anything but letters and digits are one space."""
    return f"trim({q.sub(f'lower({x})', '[^a-z0-9가-힣]+', ' ')})"


def _words(q, x: str) -> str:
    """Distinct words of two letters or more."""
    return q.distinct(q.filter(q.split(_normal(q, x)), "w", "length(w) > 1"))


def _jaccard(q, a: str, b: str) -> str:
    return f"CASE WHEN {q.len(a)} = 0 OR {q.len(b)} = 0 THEN 0.0E0 ELSE {q.len(q.both(a, b))} * 1.0E0 / {q.len(q.either(a, b))} END"


def _articles(q, days: int = 60) -> str:
    """a(uid, ticker, headline, body, t, h): times in seconds spread over some days, h a hash."""
    return (
        f"a AS (SELECT doc_id AS uid, source AS ticker, lang, coalesce(substr(text, 1, 80), '') AS headline, coalesce(substr(text, 81), '') AS body, "
        f"{q.hash32(q.string('doc_id'))} % {days * DAY} AS t, {q.hash32("'p-' || " + q.string('doc_id'))} AS h FROM documents)"
    )


def _any(x: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in phrases) + ")"


#: Phrases put before a text by the hash of its id, so that every rule is met by some documents.
_SEEDS = ["", "FDA approves drug", "Trial failed, study discontinued", "Public offering and warrant", "Merger agreement", "phase III topline data", "quarterly results", "임상 3상 성공", "product recall", "by Reuters", "license agreement", "clinical hold"]
_FORMS = ["", "S-3", "8-K", "10-Q", "424B5", "10-K/A"]


def _typed(q) -> str:
    return f"{_articles(q)}, x AS (SELECT uid, {q.at(_FORMS, 'h % 6')} AS form, lower({q.at(_SEEDS, 'h % 12')} || ' ' || headline || ' ' || body) AS t FROM a)"


def event_type(q) -> str:
    count = lambda words: q.len(q.filter(q.arr([w.lower() for w in words]), "w", "contains(t, w)"))
    names = [n for n, _ in rules.EVENT_TYPES]
    extra = {"FINANCING": f" + CASE WHEN upper(form) IN ({', '.join(repr(f) for f in rules.FINANCING_FORMS)}) THEN 3 ELSE 0 END",
             "EARNINGS": " + CASE WHEN upper(form) LIKE '10-Q%' OR upper(form) LIKE '10-K%' THEN 1 ELSE 0 END"}
    cols = ", ".join(f"{count(w)}{extra.get(n, '')} AS k{i}" for i, (n, w) in enumerate(rules.EVENT_TYPES))
    best = "greatest(" + ", ".join(f"k{i}" for i in range(len(names))) + ")"
    cases = " ".join(f"WHEN k{i} = {best} THEN '{n}'" for i, n in enumerate(names))
    material = f"(upper(form) IN ({', '.join(repr(f) for f in rules.FINANCING_FORMS)}) OR {count(rules.POSITIVE)} + {count(rules.NEGATIVE)} + {count(rules.FINANCING)} + {count(rules.TRIAL)} + {count(rules.REGULATORY)} + {count(rules.DEALS)} + {count(rules.EARNINGS)} > 0)"
    return f"""WITH {_typed(q)}, k AS (SELECT uid, form, {cols}, {material} AS material FROM x)
        SELECT uid, CASE WHEN {best} = 0 THEN CASE WHEN form <> '' THEN 'SEC_' || upper(form) ELSE 'OTHER' END {cases} END AS event_type, {best} AS score, material FROM k"""


def keyword_features(q) -> str:
    count = lambda words: q.len(q.filter(q.arr([w.lower() for w in words]), "w", "contains(t, w)"))
    lists = dict(positive=rules.POSITIVE, negative=rules.NEGATIVE, financing=rules.FINANCING, trial=rules.TRIAL, regulatory=rules.REGULATORY, deals=rules.DEALS, earnings=rules.EARNINGS)
    return f"""WITH {_typed(q)}, k AS (SELECT uid, {', '.join(f'{count(w)} AS {n}_kw' for n, w in lists.items())} FROM x)
        SELECT *, positive_kw - negative_kw - financing_kw AS kw_sentiment FROM k"""


def topics(q) -> str:
    hit = [(n, _any("t", p)) for n, p in rules.TOPICS]
    return f"""WITH {_articles(q)}, x AS (SELECT uid, ' ' || {_normal(q, q.at(_SEEDS, 'h % 12') + " || ' ' || headline")} || ' ' || {_normal(q, 'body')} || ' ' AS t FROM a),
        m AS (SELECT uid, CASE {' '.join(f"WHEN {c} THEN '{n}'" for n, c in hit)} ELSE 'OTHER' END AS primary_topic, concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in hit)}) AS found FROM x)
        SELECT uid, primary_topic, CASE WHEN found = '' THEN 'OTHER' ELSE found END AS topics FROM m"""


_RAW = ["Reuters", "AP News", "The Bloomberg desk", "", "SEC EDGAR filings", "PR Newswire", "Small  Paper", "MSN", "Acme Bio", "", "Naver News", "StatNews"]
_TYPES = ["wire", "rss", "issuer feed", "official press", ""]


def publishers(q) -> str:
    named = [(n, _any("hay", p), c) for n, p, c in rules.PUBLISHERS]
    issuer = _any("kind", rules.ISSUER_WORDS)
    return f"""WITH p AS (SELECT page_id, {q.at(_RAW, 'page_id % 12')} AS raw, {q.at(_TYPES, 'page_id % 5')} AS source_type,
            CASE WHEN page_id % 7 = 0 THEN '' ELSE lower(regexp_extract(url, '://([^/?#]*)', 1)) END AS host FROM pages),
        n AS (SELECT *, trim({q.sub('raw', ' +', ' ')}) AS clean, {_normal(q, 'source_type')} AS kind, ' ' || {_normal(q, 'raw')} || ' ' || host || ' ' || {_normal(q, 'source_type')} || ' ' AS hay FROM p)
        SELECT page_id, CASE {' '.join(f"WHEN {c} THEN '{n}'" for n, c, _ in named)} WHEN {issuer} THEN CASE WHEN clean = '' THEN 'Issuer official' ELSE clean END
            WHEN clean <> '' THEN clean WHEN host <> '' THEN host ELSE 'UNKNOWN' END AS publisher,
        CASE {' '.join(f"WHEN {c} THEN '{k}'" for _, c, k in named)} WHEN {issuer} THEN 'ISSUER_OFFICIAL' ELSE 'OTHER' END AS publisher_class, host FROM n"""


def origins(q) -> str:
    return f"""WITH {_articles(q)}, x AS (SELECT uid, CASE WHEN h % 9 = 0 THEN 'Own desk' ELSE '' END AS explicit, CASE WHEN h % 2 = 0 THEN 'Daily' ELSE '' END AS canonical, 'Raw feed' AS raw,
            ' ' || {_normal(q, q.at(_SEEDS, 'h % 12') + " || ' ' || headline")} || ' ' || {_normal(q, 'body')} || ' ' AS t FROM a)
        SELECT uid, CASE WHEN explicit <> '' THEN explicit {' '.join(f"WHEN {_any('t', n)} THEN '{p}'" for p, n in rules.ATTRIBUTIONS)} WHEN canonical <> '' THEN canonical ELSE raw END AS origin FROM x"""


def quality_tiers(q) -> str:
    clean = lambda c: f"trim({q.sub(f'coalesce({c}, {chr(39)}{chr(39)})', '[ ' + chr(10) + chr(9) + chr(13) + ']+', ' ')})"
    reasons = [  # in alphabetical order
        ("BODY_NOT_SUBSTANTIVE", "NOT body_ok"),
        ("CURRENT_CRAWL_MISUSED_AS_HISTORICAL_FIRST_SEEN", "misused"),
        ("EVENT_RELATIONSHIP_NOT_HIGH_CONFIDENCE", "NOT matched"),
        ("FIRST_SEEN_AFTER_EVENT_T2", "observed AND NOT seen_before"),
        ("FIRST_SEEN_PROVENANCE_UNVERIFIED", "tier = 'C' AND seen_before AND NOT provenance"),
        ("FIRST_SEEN_UNOBSERVED", "NOT observed"),
        ("HEADLINE_NOT_SUBSTANTIVE", "NOT headline_ok"),
        ("HEADLINE_ONLY_AUX", "tier = 'B_HEADLINE'"),
        ("NOT_PROVEN_PUBLISHED_BY_EVENT_T2", "NOT in_time"),
        ("PUBLICATION_TIMESTAMP_NOT_PRECISE_HIGH_CONFIDENCE", "NOT precise"),
        ("PUBLISHER_UNKNOWN", "NOT known"),
        ("RETROSPECTIVE_AUX_ONLY", "tier = 'C'"),
    ]
    return f"""WITH {_articles(q)}, r AS (SELECT uid, {q.at(["Reuters", " unknown", "N/A", "Small Paper", "", "Daily", "Wire", "Biz"], 'h % 8')} AS publisher,
            {q.at(["EXACT_SECOND", "exact_minute", "EXACT_MINUTE", "DATE_ONLY", "EXACT_SECOND"], 'h % 5')} AS precision_, {q.at(["HIGH", "high ", "HIGH", "MEDIUM"], 'h % 4')} AS confidence,
            {q.at(["HIGH", "HIGH", "LOW", "high"], 'floor(h / 16) % 4')} AS match_, CASE WHEN h % 17 = 0 THEN 'Short' ELSE headline END AS headline, CASE WHEN h % 3 = 0 THEN substr(body, 1, 40) ELSE body END AS body,
            CASE WHEN h % 19 = 0 THEN NULL ELSE t END AS published, t + (floor(h / 7) % 6 - 1) * 60 AS cutoff, CASE WHEN floor(h / 3) % 4 = 0 THEN NULL ELSE t + floor(h / 5) % 8 * 60 END AS seen,
            floor(h / 2) % 3 <> 0 AS flagged, t + CASE WHEN floor(h / 11) % 5 = 0 THEN 7200 ELSE floor(h / 5) % 8 * 60 + 4 END AS captured, floor(h / 13) % 2 = 0 AS provenance FROM a),
        s AS (SELECT *, CASE WHEN floor(captured - coalesce(published, captured)) > 3600 THEN captured - 3 ELSE seen END AS first_seen FROM r),
        f AS (SELECT uid, provenance, lower({clean('publisher')}) NOT IN ({', '.join(repr(u) for u in rules.UNKNOWN_PUBLISHERS)}) AS known,
            upper({clean('precision_')}) IN ({', '.join(repr(p) for p in rules.PRECISE)}) AND upper({clean('confidence')}) = 'HIGH' AS precise, upper({clean('match_')}) = 'HIGH' AS matched,
            length({clean('headline')}) >= {rules.LEAST_HEADLINE} AS headline_ok, length({clean('body')}) >= {rules.LEAST_BODY} AS body_ok, coalesce(published <= cutoff, false) AS in_time,
            flagged AND first_seen IS NOT NULL AS observed, flagged AND coalesce(first_seen <= cutoff, false) AS seen_before,
            flagged AND coalesce(abs(first_seen - captured) <= {rules.CRAWL_SECONDS} AND captured - published > {rules.CRAWL_LAG_SECONDS}, false) AS misused FROM s),
        g AS (SELECT *, CASE WHEN NOT (known AND precise AND matched AND headline_ok AND in_time) THEN 'C' WHEN body_ok AND seen_before AND NOT misused AND provenance THEN 'A'
            WHEN body_ok AND NOT observed THEN 'B_FULL' WHEN NOT body_ok AND (NOT observed OR seen_before AND NOT misused) THEN 'B_HEADLINE' ELSE 'C' END AS tier FROM f)
        SELECT uid, tier, tier IN ('A', 'B_FULL') AS causal, tier = 'B_HEADLINE' AS headline_only, concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in reasons)}) AS reasons FROM g"""


def source_family(q) -> str:
    return f"""WITH e AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'US' WHEN lang = 'fr' THEN 'KR' ELSE 'XX' END AS market, CASE WHEN doc_id % 3 = 0 THEN 'Sec feed' WHEN doc_id % 3 = 1 THEN 'kind' ELSE source END AS source,
            CASE WHEN doc_id % 5 = 0 THEN 'SEC:' ELSE 'n-' END || {q.string('doc_id')} AS event_id, CASE WHEN doc_id % 4 = 0 THEN 'nan' WHEN doc_id % 4 = 1 THEN ' ' ELSE 'ac-' || {q.string('doc_id % 50')} END AS accession FROM documents)
        SELECT doc_id, CASE market WHEN 'US' THEN CASE WHEN contains(upper(source), 'SEC') OR upper(event_id) LIKE 'SEC:%' THEN 'US_SEC' ELSE 'US_NEWS' END
            WHEN 'KR' THEN CASE WHEN contains(upper(source), 'KIND') OR upper(event_id) LIKE 'KIND:%' THEN 'KR_KIND' ELSE 'KR_NEWS' END ELSE 'UNKNOWN' END AS family,
        {q.sha("market || '|' || source || '|' || CASE WHEN trim(accession) NOT IN ('', 'nan') THEN 'accession_number|' || trim(accession) ELSE 'event_id|' || event_id END")} AS event_group FROM e"""


def near_duplicates(q) -> str:
    """Pairs of one language (for the ticker) within 48 hours whose headlines and bodies are nearly the same."""
    base = f"{_articles(q, 5)}, w AS (SELECT uid, coalesce(lang, '') AS ticker, t, body, {_words(q, 'headline')} AS hw, {_words(q, 'headline || body')} AS bw FROM a)"
    if q.spark:
        # Two headlines of that similarity share one of the first words of both, the rarest first.
        cells = (
            "e AS (SELECT uid, explode(hw) AS word FROM w), n AS (SELECT word, count(*) AS n FROM e GROUP BY word), o AS (SELECT uid, array_sort(collect_list(struct(n, e.word))) AS o FROM e JOIN n ON n.word = e.word GROUP BY uid), "
            f"p AS (SELECT w.uid, ticker, t, hw, body = '' AS bare, cell, x.word AS word FROM w JOIN o ON o.uid = w.uid LATERAL VIEW explode(slice(o, 1, CAST(size(o) - ceil(0.88 * size(o)) + 1 AS INT))) z AS x "
            f"LATERAL VIEW explode(array(floor(t / {48 * HOUR}), floor(t / {48 * HOUR}) + 1)) y AS cell), "
            f"c AS (SELECT DISTINCT l.uid AS u, r.uid AS v, {_jaccard(q, 'l.hw', 'r.hw')} AS headline_j, l.bare OR r.bare AS no_body FROM p l JOIN p r ON l.ticker = r.ticker AND l.cell = r.cell AND l.word = r.word "
            f"AND (l.t < r.t OR l.t = r.t AND l.uid < r.uid) AND r.t - l.t <= {48 * HOUR} AND {_jaccard(q, 'l.hw', 'r.hw')} >= 0.88)"
        )
        likeness = "j AS (SELECT u, v, l.bw AS lw, r.bw AS rw, headline_j, no_body FROM c JOIN w l ON l.uid = u JOIN w r ON r.uid = v)"
    else:
        cells = f"c AS (SELECT l.uid AS u, r.uid AS v FROM w l JOIN w r ON l.ticker = r.ticker WHERE (l.t < r.t OR l.t = r.t AND l.uid < r.uid) AND r.t - l.t <= {48 * HOUR})"
        likeness = f"j AS (SELECT u, v, l.bw AS lw, r.bw AS rw, {_jaccard(q, 'l.hw', 'r.hw')} AS headline_j, l.body = '' OR r.body = '' AS no_body FROM c JOIN w l ON l.uid = u JOIN w r ON r.uid = v)"
    return f"""WITH {base}, {cells}, {likeness},
        k AS (SELECT u, v, headline_j, no_body, {_jaccard(q, 'lw', 'rw')} AS body_j FROM j WHERE headline_j >= 0.88)
        SELECT u, v, round(headline_j, 8) AS headline_j, round(body_j, 8) AS body_j FROM k WHERE body_j >= 0.72 OR no_body"""


def novelty(q) -> str:
    """The likeness of each article to earlier ones of its ticker in three windows, and what it says."""
    best = lambda days: f"max(CASE WHEN p.t >= c.t - {days * DAY} THEN {_jaccard(q, 'c.w', 'p.w')} END)"
    cells = f"JOIN (SELECT x.*, {'explode(array(0, 1))' if q.spark else 'unnest([0, 1])'} AS later FROM x) p ON p.ticker = c.ticker AND floor(p.t / {30 * DAY}) + p.later = floor(c.t / {30 * DAY})"
    return f"""WITH {_articles(q)}, x AS (SELECT uid, ticker, t, {_words(q, 'headline || body')} AS w FROM a), c AS (SELECT * FROM x),
        s AS (SELECT c.uid, {best(1)} AS d1, {best(7)} AS d7, {best(30)} AS d30 FROM c {cells} WHERE p.t < c.t AND p.t >= c.t - {30 * DAY} GROUP BY c.uid)
        SELECT c.uid, round(d1, 8) AS like_24h, round(d7, 8) AS like_7d, round(d30, 8) AS like_30d, coalesce(d30 >= 0.85, false) AS duplicate,
        CASE WHEN d30 >= 0.85 THEN 'NEAR_DUPLICATE_PRIOR_NEWS' WHEN d30 >= 0.55 THEN 'MINOR_UPDATE_OR_REPUBLICATION' ELSE 'NOVEL_STORY' END AS recycling FROM c LEFT JOIN s ON s.uid = c.uid"""


NEAR_WORDS = statement(
    lambda q: f"WITH {_articles(q, 5)} SELECT uid, coalesce(lang, '') AS key, t, body = '' AS bare, {_words(q, 'headline')} AS short, {_words(q, 'headline || body')} AS long FROM a"
)


def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one language (for the ticker) within 48 hours whose headlines and bodies are nearly the same."""
    got = near_copies(NEAR_WORDS[0](spark, sf_dir), 48 * HOUR, 0.88, 0.72)
    return got.select("u", "v", F.round("short_j", 8).alias("headline_j"), F.round("long_j", 8).alias("body_j"))


NOVELTY_WORDS = statement(lambda q: f"WITH {_articles(q)} SELECT uid, ticker, t, {_words(q, 'headline || body')} AS w FROM a")


def novelty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeness of each article to earlier ones of its ticker in three windows, and what it says."""
    rows = NOVELTY_WORDS[0](spark, sf_dir)
    best = greatest_likeness(rows, "uid", "ticker", "t", "w", {"like_24h": DAY, "like_7d": 7 * DAY, "like_30d": 30 * DAY})
    told = rows.select("uid").join(best, "uid", "left")
    like = F.col("like_30d")
    recycling = F.when(like >= 0.85, "NEAR_DUPLICATE_PRIOR_NEWS").when(like >= 0.55, "MINOR_UPDATE_OR_REPUBLICATION").otherwise("NOVEL_STORY")
    return told.select("uid", *[F.round(c, 8).alias(c) for c in ("like_24h", "like_7d", "like_30d")], F.coalesce(like >= 0.85, F.lit(False)).alias("duplicate"), recycling.alias("recycling"))


def event_links(q) -> str:
    """Orders as events, documents as articles: explicit id, id and time where ids collide, time of the source, nearest within a day."""
    return f"""WITH e AS (SELECT o_orderkey AS id, o_orderkey % 400 AS raw, o_custkey % 20 AS ticker, {q.us('o_orderdate')} / 1000000 + o_orderkey % 86400 AS t FROM orders),
        d AS (SELECT doc_id AS uid, CASE WHEN doc_id % 5 = 0 THEN doc_id % 400 WHEN doc_id % 5 = 1 THEN doc_id % 40 END AS explicit, doc_id % 20 AS ticker,
            CASE WHEN doc_id % 4 <> 3 THEN (SELECT min(t) FROM e) + floor({q.hash32(q.string('doc_id'))} / 64) % ((SELECT max(t) - min(t) FROM e)) END AS published,
            CASE WHEN doc_id % 3 = 0 THEN doc_id * 37 % 15000 END AS ref FROM documents),
        s AS (SELECT d.*, e.t + doc_id_slip AS source_time FROM (SELECT d.*, uid % 3 - 1 AS doc_id_slip FROM d) d LEFT JOIN (SELECT id, min(t) AS t FROM e GROUP BY id) e ON e.id = d.ref),
        f AS (SELECT e.*, {q.sequence(-1, 1)} AS later FROM e), c AS (SELECT f.*, floor(t / {DAY}) + later AS cell FROM f),
        r AS (SELECT s.uid, count(e.id) AS n, min(e.id) AS one, count(CASE WHEN e.ticker = s.ticker AND abs(e.t - s.source_time) <= 1 THEN 1 END) AS n_exact,
            min(CASE WHEN e.ticker = s.ticker AND abs(e.t - s.source_time) <= 1 THEN e.id END) AS exact FROM s JOIN e ON e.raw = s.explicit GROUP BY s.uid),
        x AS (SELECT s.uid, count(e.id) AS n, min(e.id) AS one FROM s JOIN c e ON e.ticker = s.ticker AND e.cell = floor(s.source_time / {DAY}) AND abs(e.t - s.source_time) <= 1 GROUP BY s.uid),
        w AS (SELECT s.uid, count(e.id) AS n, min(e.id) AS one FROM s JOIN c e ON e.ticker = s.ticker AND e.cell = floor(s.published / {DAY}) AND abs(e.t - s.published) <= {DAY} GROUP BY s.uid)
        SELECT s.uid, CASE WHEN r.n = 1 THEN r.one WHEN r.n > 1 THEN CASE WHEN n_exact = 1 THEN exact END WHEN x.n = 1 THEN x.one WHEN x.n > 1 THEN NULL WHEN w.n = 1 AND published IS NOT NULL THEN w.one END AS event_id,
        CASE WHEN r.n = 1 THEN 'EXPLICIT' WHEN r.n > 1 AND n_exact = 1 THEN 'COLLISION_RESOLVED' WHEN r.n > 1 THEN 'AMBIGUOUS_ID' WHEN x.n = 1 THEN 'SOURCE_TIME' WHEN x.n > 1 THEN 'AMBIGUOUS_TIME'
            WHEN published IS NULL THEN 'UNLINKED' WHEN w.n IS NULL THEN 'OUTSIDE_24H' WHEN w.n = 1 THEN 'NEAREST_24H' ELSE 'AMBIGUOUS_24H' END AS method
        FROM s LEFT JOIN r ON r.uid = s.uid LEFT JOIN x ON x.uid = s.uid LEFT JOIN w ON w.uid = s.uid"""


def id_map(q) -> str:
    """Raw ids that several events share: the one eligible candidate wins, several or none are quarantined."""
    return """WITH e AS (SELECT o_orderkey AS id, o_custkey AS raw, o_orderstatus = 'F' AS eligible FROM orders),
        g AS (SELECT raw, count(*) AS n, count(CASE WHEN eligible THEN 1 END) AS ok, min(CASE WHEN eligible THEN id END) AS winner, min(id) AS single FROM e GROUP BY raw)
        SELECT raw, n, CASE WHEN n = 1 THEN single WHEN ok = 1 THEN winner END AS id, CASE WHEN n = 1 THEN 'UNIQUE' WHEN ok = 1 THEN 'RESOLVED' WHEN ok = 0 THEN 'NONE_ELIGIBLE' ELSE 'SEVERAL_ELIGIBLE' END AS status FROM g"""


def token_overlap(q) -> str:
    """Salient words of a headline (no stop words, Korean particles cut) and the codes in it: words with a digit, hyphens removed."""
    stop = ["the", "of", "and", "to", "in", "is", "for", "der", "die", "und", "le", "la", "de", "que", "en"]
    salient = lambda c: q.filter(q.map(q.split(_normal(q, c)), "w", q.sub("w", "(은|는|이|가|을|를|의|에)$", "")), "w", f"length(w) > 1 AND NOT {'array_contains' if q.spark else 'list_contains'}({q.arr(stop)}, w)")
    codes = q.distinct(q.filter(q.split(q.sub(q.sub("lower(headline || body)", "-", ""), "[^a-z0-9]+", " ")), "w", f"length(w) >= 4 AND {q.sub('w', '[0-9]', '')} <> w AND {q.sub('w', '[a-z]', '')} <> w"))
    return f"""WITH {_articles(q)}, s AS (SELECT uid, {q.distinct(salient('headline'))} AS hw, {q.distinct(salient('body'))} AS bw, {codes} AS codes FROM a)
        SELECT uid, {q.len('hw')} AS n_words, {q.len(q.both('hw', 'bw'))} AS shared, CASE WHEN {q.len('hw')} = 0 THEN 0.0E0 ELSE round({q.len(q.both('hw', 'bw'))} * 1.0E0 / {q.len('hw')}, 8) END AS coverage, {q.joined('codes')} AS codes FROM s"""


def _informative(q, x: str) -> str:
    """Words of three letters or more (one hyphen allowed) that tell something and are no number, in order."""
    found = f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+(-[a-z0-9]+)?', 0)"
    has = "array_contains" if q.spark else "list_contains"
    return q.filter(found, "w", f"length(w) >= 3 AND NOT {has}({q.arr(rules.UNINFORMATIVE)}, w) AND {q.sub('w', '[0-9]', '')} <> ''")


DOC_TOKENS = statement(lambda q: f"SELECT doc_id, length(text) AS n_chars, {_informative(q, 'text')} AS tokens FROM documents")
ITEM_TOKENS = statement(lambda q: f"SELECT item_id, {q.distinct(_informative(q, 'text'))} AS tokens FROM benchmark")


def window_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that a window of 160 of a document's words matches: the window that shares most, its coverage and likeness.

    A window covers 60 % of the item's words, so the document has as many: such pairs alone are looked at window by window.
    """
    docs, items = DOC_TOKENS[0](spark, sf_dir), ITEM_TOKENS[0](spark, sf_dir).withColumnRenamed("tokens", "item_tokens")
    joined = lambda df, c: df.withColumn("text", F.array_join(c, " "))
    pairs = containment.contained(joined(docs, "tokens"), joined(items, "item_tokens"), "doc_id", "item_id", "text", "tokens", 0.6)
    near = pairs.where("shared >= 4").join(docs, pairs["doc"] == docs["doc_id"]).join(items, pairs["item"] == items["item_id"])
    cut = f"slice(tokens, s + 1, {rules.MATCH_WINDOW})"
    both = f"size(array_intersect(item_tokens, {cut}))"
    best = F.expr(f"array_max(transform(sequence(0, greatest(size(tokens) - 1, 0), {rules.MATCH_STRIDE}), s -> named_struct('n', {both}, 'j', {both} / size(array_union(item_tokens, {cut})))))")
    rows = near.select("doc_id", "item_id", "n_chars", F.size("item_tokens").alias("m"), best.alias("b"))
    high = "n_chars >= 80 AND b.j >= 0.04 AND (m <= 6 AND b.n >= 4 AND b.n >= 0.8 * m OR b.n >= 5 AND b.n >= 0.6 * m)"
    return rows.where(high).select("doc_id", "item_id", F.col("b.n").cast("bigint").alias("found"), F.round(F.col("b.n") / F.col("m"), 8).alias("coverage"), F.round("b.j", 8).alias("likeness"))


WINDOW_SQL = f"""WITH d AS ({DOC_TOKENS[1]}), i AS ({ITEM_TOKENS[1]}),
w AS (SELECT doc_id, n_chars, list_distinct(list_slice(tokens, s + 1, s + {rules.MATCH_WINDOW})) AS win FROM (SELECT *, unnest(range(0, greatest(len(tokens), 1), {rules.MATCH_STRIDE})) AS s FROM d) x),
m AS (SELECT doc_id, item_id, n_chars, len(i.tokens) AS m, len(list_intersect(i.tokens, win)) AS n, len(list_distinct(list_concat(i.tokens, win))) AS u FROM w CROSS JOIN i),
b AS (SELECT doc_id, item_id, n_chars, m, n, n / u AS j, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, n / u DESC) AS k FROM m WHERE n >= 4)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS found, round(n / m, 8) AS coverage, round(j, 8) AS likeness FROM b WHERE k = 1 AND n_chars >= 80 AND j >= 0.04 AND (m <= 6 AND n >= 0.8 * m OR n >= 5 AND n >= 0.6 * m)"""


def filing_features(q) -> str:
    """Item numbers, neighbouring pairs, capped taxonomy counts, largest amount, subjects, least p-value and hazard ratio of a filing text."""
    text = "'Item 1.01 and Item 5.02. Total $' || CAST(doc_id % 90 AS VARCHAR(9)) || '.5 million and $2 billion, n = ' || CAST(doc_id % 400 AS VARCHAR(9)) || ', p = 0.0' || CAST(doc_id % 9 + 1 AS VARCHAR(9)) || ', hazard ratio 0.' || CAST(doc_id % 80 + 10 AS VARCHAR(9)) || CASE WHEN doc_id % 3 = 0 THEN ' Item 9.01 phase 3 phase 3 fda' ELSE ' dilution' END"
    every = lambda p, g: f"regexp_extract_all(t, '{p}', {g})"
    number = lambda x: f"CAST({x} AS DOUBLE)"
    count = lambda w: f"least(10, (length(lower(t)) - length(replace(lower(t), '{w}', ''))) / {len(w)})"
    top, low = ("array_max", "array_min") if q.spark else ("list_max", "list_min")
    concat = (lambda *a: "concat(" + ", ".join(a) + ")") if q.spark else (lambda *a: "list_concat(" + ", ".join(a) + ")")
    return f"""WITH f AS (SELECT doc_id, {text} AS t FROM documents), i AS (SELECT doc_id, t, {every('Item ([0-9]+[.][0-9]+)', 1)} AS items FROM f)
        SELECT doc_id, {q.joined(q.distinct('items'))} AS items, {q.len('items')} AS n_items, CASE WHEN {q.len('items')} > 1 THEN {'items[0]' if q.spark else 'items[1]'} || '>' || {'items[1]' if q.spark else 'items[2]'} END AS first_pair,
        CAST({count('phase 3')} AS BIGINT) AS trial, CAST({count('fda')} AS BIGINT) AS regulatory, CAST({count('dilution')} AS BIGINT) AS financing,
        {top}({concat(q.map(every('[$]([0-9.]+) million', 1), 'x', number('x') + ' * 1E6'), q.map(every('[$]([0-9.]+) billion', 1), 'x', number('x') + ' * 1E9'))}) AS largest_amount,
        {top}({q.map(every('n = ([0-9]+)', 1), 'x', number('x'))}) AS subjects, {low}({q.map(every('p = ([0-9.]*[0-9])', 1), 'x', number('x'))}) AS least_p, {low}({q.map(every('hazard ratio ([0-9.]*[0-9])', 1), 'x', number('x'))}) AS hazard_ratio FROM i"""


def alias_tickers(q) -> str:
    """Tickers whose name (of five letters or more) or $ticker occurs in a text: one, several or none."""
    return f"""WITH al AS (SELECT n_nationkey AS ticker, lower(n_name) AS alias, '$' || {q.string('n_nationkey')} || ' ' AS cash FROM nation WHERE length(n_name) >= 5),
        {_articles(q)}, x AS (SELECT uid, lower(CASE WHEN h % 5 = 0 THEN 'Plant in Germany ' WHEN h % 5 = 1 THEN 'From $7 to Brazil ' WHEN h % 5 = 2 THEN 'The $12 case ' ELSE '' END || headline) AS t FROM a),
        m AS (SELECT x.uid, count(DISTINCT al.ticker) AS n, min(al.ticker) AS ticker FROM x JOIN al ON contains(t, alias) OR contains(t, cash) GROUP BY x.uid)
        SELECT x.uid, CASE WHEN m.n IS NULL THEN 'NONE' WHEN m.n = 1 THEN 'UNIQUE' ELSE 'AMBIGUOUS' END AS status, CASE WHEN m.n = 1 THEN m.ticker END AS ticker FROM x LEFT JOIN m ON m.uid = x.uid"""


def event_text(q) -> str:
    """Turns of a conversation as one text, in order, with a mark between them, and the role that speaks most."""
    text = "array_join(transform(array_sort(collect_list(struct(turn, role, text))), x -> x.text), ' [SEP] ')" if q.spark else "string_agg(text, ' [SEP] ' ORDER BY turn, role, text)"
    return f"""WITH j AS (SELECT conv_id, {text} AS joined, count(*) AS n FROM conversations GROUP BY conv_id),
        r AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, role) AS k FROM conversations GROUP BY conv_id, role)
        SELECT j.conv_id, {q.sha('joined')} AS text_sha, CAST(length(joined) AS BIGINT) AS n_chars, n, role AS main_role FROM j JOIN r ON r.conv_id = j.conv_id WHERE k = 1"""


def set_aggregates(q) -> str:
    """Sorted sets as JSON text."""
    return f"""SELECT source, '["' || {q.joined(q.distinct(q.items('lang')), '","')} || '"]' AS langs, count(*) AS n, count(DISTINCT lang) AS n_langs FROM documents WHERE lang IS NOT NULL GROUP BY source"""


STORIES = statement(
    lambda q: f"""SELECT uid, headline, headline || body AS body, t, event, row_number() OVER (PARTITION BY event ORDER BY uid) AS k FROM (SELECT *, {q.sha("source_ || substr(" + _normal(q, 'headline') + ", 1, 24)")} AS event FROM (SELECT a.*, coalesce(lang, '') AS source_ FROM ({_articles(q, 5).removeprefix('a AS (').removesuffix(')')}) a) b) c"""
)


def information_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that share the root of the first article that begins like them in their language, and why."""
    rows = STORIES[0](spark, sf_dir)
    first = rows.groupBy("event").agg(F.min("uid").alias("uid"), F.count("*").alias("n")).where("n > 1").select("event", "uid")
    bases = rows.join(first, ["event", "uid"]).select("event", "uid", "headline", "body", "t")
    got = roots.root_sharing(bases, rows.select("event", "uid", "headline", "body", "t"))
    return got.select("base", "candidate", "reason")


def syndication_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles linked by an equal text or as near copies within 48 hours; the root is the earliest, ties by id."""
    rows = STORIES[0](spark, sf_dir).select("uid", "t", F.sha2("body", 256).alias("k"))
    same = rows.join(rows.groupBy("k").agg(F.min("uid").alias("b")), "k").select(F.col("uid").alias("a"), "b")
    near = near_pairs(spark, sf_dir).select(F.col("u").alias("a"), F.col("v").alias("b"))
    groups = graph.components(same.union(near))
    placed = rows.join(groups, F.col("uid") == F.col("node"), "left").withColumn("grp", F.coalesce("root", "uid"))
    first = placed.groupBy("grp").agg(F.min(F.struct("t", "uid")).alias("first"))
    return placed.join(first, "grp").select(F.col("uid").alias("doc_id"), F.col("first.uid").alias("root"))


PLANS = {
    "event_type_argmax": event_type, "keyword_features": keyword_features, "topic_multilabel": topics, "publisher_resolution": publishers, "origin_inference": origins,
    "quality_tier_case": quality_tiers, "source_family_groups": source_family, "doc_jaccard_pairs": near_duplicates, "doc_novelty_max": novelty, "event_link_ladder": event_links,
    "collision_id_map": id_map, "salient_overlap_codes": token_overlap, "filing_features": filing_features, "alias_tickers": alias_tickers,
    "event_text_view": event_text, "set_aggregates": set_aggregates, 
}
STATEMENTS = {name: statement(build) for name, build in PLANS.items()}
SYNDICATION_SQL = f"""WITH RECURSIVE s AS ({STORIES[1]}), p AS ({STATEMENTS['doc_jaccard_pairs'][1]}), k AS (SELECT uid, min(uid) OVER (PARTITION BY body) AS first FROM s),
e AS (SELECT uid AS a, first AS b FROM k UNION SELECT first, uid FROM k UNION SELECT u, v FROM p UNION SELECT v, u FROM p),
r AS (SELECT uid, uid AS at FROM s UNION SELECT r.uid, e.b FROM r JOIN e ON e.a = r.at)
SELECT uid AS doc_id, root FROM (SELECT r.uid, s.uid AS root, row_number() OVER (PARTITION BY r.uid ORDER BY s.t, s.uid) AS k FROM r JOIN s ON s.uid = r.at) x WHERE k = 1"""

BUILT = {"doc_novelty_max": (novelty_rows, STATEMENTS["doc_novelty_max"][1]), "doc_jaccard_pairs": (near_pairs, STATEMENTS["doc_jaccard_pairs"][1]), "token_window_match": (window_match, WINDOW_SQL), "syndication_roots": (syndication_roots, SYNDICATION_SQL)}
QUERIES = {name: pair[0] for name, pair in (STATEMENTS | BUILT).items()} | {"information_roots": information_roots}
ORACLES = {name: pair[1] for name, pair in (STATEMENTS | BUILT).items()}
