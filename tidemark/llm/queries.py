"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, filter_audit, html_extract, imatch, language_id, packing, periodic, quality, repeats, simhash, toxicity, url_filter, warc
from tidemark.llm.common import read_table
from tidemark.storage import scratch


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return imatch.fingerprints_with_next(docs, imatch.lexicon(docs)).withColumnRenamed("id", "doc_id")


def op2_byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    return language_id.predict(docs.select("doc_id", "text"), model).withColumnRenamed("id", "doc_id")


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read_table(spark, sf_dir, "documents"))


#: Loss-bearing tokens of a sequence; at least 256 of a full one are prompt.
MAX_LOSS = 3840


def packed(docs: DataFrame) -> DataFrame:
    """Packs documents as instruction data: the first line is the prompt, the rest bears loss."""
    docs = docs.select("doc_id", "text", packing.first_line(F.col("text")).alias("prompt"))
    return packing.pack_documents(docs, tokenizer_path(), prompt_col="prompt", max_loss=MAX_LOSS).withColumnRenamed("id", "doc_id")


#: The rules of the URL query.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op4_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def graded(labels: DataFrame) -> DataFrame:
    """Grades from the two labels: 0 poor, 1 good but toxic, 2 good and clean."""
    return labels.select("doc_id", F.expr("CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 1 ELSE 2 END WHEN quality = 0 THEN 0 END").alias("grade"))


def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, graded(read_table(spark, sf_dir, "labels")), 3)
    return quality.score(docs, model).select(
        F.col("id").alias("doc_id"),
        (F.col("bucket") == 0).alias("held_out"),
        "expected_grade",
        F.col("tail_1").alias("p_good"),
        F.col("tail_2").alias("p_best"),
        F.expr("CAST(tail_1 >= 0.5D AS INT) + CAST(tail_2 >= 0.5D AS INT)").alias("grade"),
        F.expr("tail_1 >= 0.5D").alias("selected"),
    )


def op6_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicate_classes(docs).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op7_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.removal_digest(repeats.remove_repeats(docs)).withColumnRenamed("id", "doc_id")


def op8_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"))


def op9_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        F.col("id").alias("doc_id"), (F.col("bucket") == 0).alias("held_out"), "score", F.expr("CAST(score >= 0.5D AS INT)").alias("predicted")
    )


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def with_periods(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """About one document in ten gets a periodic tail, its place and period told by the id."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * ((n - a) // p + 1))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.run_digest(periodic.periodic_runs(docs, rewrite=with_periods, keep_text=False)).withColumnRenamed("id", "doc_id")


def op12_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    warc.write_archive(read_table(spark, sf_dir, "pages"), folder)
    return warc.read_archive(spark, folder).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit.audit(docs, read_table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_imatch": op1_imatch,
    "op2_byte_gru_language": op2_byte_gru_language,
    "op3_vector_packing": op3_vector_packing,
    "op4_url_trees": op4_url_trees,
    "op5_ordinal_quality": op5_ordinal_quality,
    "op6_simhash_classes": op6_simhash_classes,
    "op7_repeat_removal": op7_repeat_removal,
    "op8_positional_decontamination": op8_positional_decontamination,
    "op9_pu_toxicity": op9_pu_toxicity,
    "op10_html_text": op10_html_text,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_warc_archive": op12_warc_archive,
    "op13_filter_audit": op13_filter_audit,
}

#: Windows of ten words (or a whole shorter item) of both tables meet as text; positions and items are then counted.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS t FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM b WHERE len(w) > 0) x),
k AS (SELECT DISTINCT n FROM i),
o AS (SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d CROSS JOIN k WHERE len(w) >= n) x),
h AS (SELECT doc_id, s, o.n, item FROM o JOIN i ON i.t = o.t AND i.n = o.n),
p AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM h) x GROUP BY doc_id),
m AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)"""

OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT page_id, body, octet_length(encode(body)) AS n, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest, CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to FROM f"""

#: Every combination of part and failed filters is counted, and meets every order and step directly.
OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, part, len(w) < 200 AS A, 100 * len(list_distinct(w)) < 50 * len(w) AS B, 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) AS C,
    regexp_matches(text, '[#$%&*|]') AS D, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS E FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
c AS (SELECT part, concat(CASE WHEN A THEN 'A' ELSE '' END, CASE WHEN B THEN 'B' ELSE '' END, CASE WHEN C THEN 'C' ELSE '' END, CASE WHEN D THEN 'D' ELSE '' END, CASE WHEN E THEN 'E' ELSE '' END) AS fails,
    count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad FROM x LEFT JOIN l USING (doc_id) GROUP BY ALL),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM k a JOIN k b ON b.k <> a.k JOIN k c ON c.k NOT IN (a.k, b.k) JOIN k d ON d.k NOT IN (a.k, b.k, c.k) JOIN k e ON e.k NOT IN (a.k, b.k, c.k, d.k)),
s AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INT) AS step FROM o),
h AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, part, fails, n, good, bad, contains(fails, substr(filter_order, step, 1)) AS own,
    coalesce(list_bool_or(list_transform(range(1, step), lambda i: contains(fails, substr(filter_order, CAST(i AS INT), 1)))), false) AS gone FROM s CROSS JOIN c),
r AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT gone THEN bad ELSE 0 END) AS toxic_lost FROM h GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r"""

ORACLES: dict[str, str] = {"op8_positional_decontamination": OP8_SQL, "op12_warc_archive": OP12_SQL, "op13_filter_audit": OP13_SQL}
