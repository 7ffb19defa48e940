"""One statement for two engines: the few functions that Spark and DuckDB spell differently."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.session import load

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def quoted(word: str | None) -> str:
    return "CAST(NULL AS VARCHAR(99))" if word is None else "'" + word.replace("'", "''") + "'"


class SparkSQL:
    spark = True

    def us(self, c):
        return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({c} AS TIMESTAMP_NTZ))"

    def quantile(self, x, p):
        return f"percentile({x}, {p}D)"

    def sha(self, x):
        return f"sha2({x}, 256)"

    def hash32(self, x):
        return f"CAST(conv(substr(sha2({x}, 256), 1, 8), 16, 10) AS BIGINT)"

    def sequence(self, a, b):
        return f"explode(sequence({a}, {b}))"

    def string(self, x):
        return f"CAST({x} AS STRING)"

    def every(self, x):
        return f"every({x})"

    def sub(self, x, pattern, to):
        return f"regexp_replace({x}, '{pattern}', '{to}')"

    def arr(self, words):
        return "array(" + ", ".join(quoted(w) for w in words) + ")"

    def at(self, words, i):
        return f"element_at({self.arr(words)}, CAST({i} AS INT) + 1)"

    def filter(self, a, v, cond):
        return f"filter({a}, {v} -> {cond})"

    def map(self, a, v, expr):
        return f"transform({a}, {v} -> {expr})"

    def len(self, a):
        return f"CAST(size({a}) AS BIGINT)"

    def distinct(self, a):
        return f"array_distinct({a})"

    def both(self, a, b):
        return f"array_intersect({a}, {b})"

    def either(self, a, b):
        return f"array_union({a}, {b})"

    def joined(self, a, sep=","):
        return f"array_join(array_sort({a}), '{sep}')"

    def split(self, x, sep=" "):
        return f"split({x}, '{sep}')"

    def slice(self, a, start, n):
        return f"slice({a}, {start}, {n})"

    def items(self, x):
        return f"collect_list({x})"

    def median(self, x):
        return self.quantile(x, 0.5)

    def local(self, ts, zone):
        return f"CAST(from_utc_timestamp(CAST(CAST({ts} AS STRING) AS TIMESTAMP), '{zone}') AS TIMESTAMP_NTZ)"

    def at_most(self, x, by):
        return f"max_by({x}, {by})"

    def at_least(self, x, by):
        return f"min_by({x}, {by})"

    def seconds(self, c):
        return f"(hour({c}) * 3600 + minute({c}) * 60 + second({c}))"

    def day(self, c):
        return f"datediff(CAST({c} AS DATE), DATE '1970-01-01')"

    def back(self, us):
        return f"timestampadd(MICROSECOND, {us}, TIMESTAMP_NTZ '1970-01-01 00:00:00')"


class DuckSQL:
    spark = False

    def us(self, c):
        return f"epoch_us({c})"

    def quantile(self, x, p):
        return f"quantile_cont({x}, {p})"

    def sha(self, x):
        return f"sha256({x})"

    def hash32(self, x):
        return f"CAST(('0x' || substr(sha256({x}), 1, 8)) AS BIGINT)"

    def sequence(self, a, b):
        return f"unnest(generate_series({a}, {b}))"

    def string(self, x):
        return f"CAST({x} AS VARCHAR)"

    def every(self, x):
        return f"bool_and({x})"

    def sub(self, x, pattern, to):
        return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"

    def arr(self, words):
        return "[" + ", ".join(quoted(w) for w in words) + "]"

    def at(self, words, i):
        return f"{self.arr(words)}[CAST({i} AS INT) + 1]"

    def filter(self, a, v, cond):
        return f"list_filter({a}, lambda {v}: {cond})"

    def map(self, a, v, expr):
        return f"list_transform({a}, lambda {v}: {expr})"

    def len(self, a):
        return f"len({a})"

    def distinct(self, a):
        return f"list_distinct({a})"

    def both(self, a, b):
        return f"list_intersect({a}, {b})"

    def either(self, a, b):
        return f"list_distinct(list_concat({a}, {b}))"

    def joined(self, a, sep=","):
        return f"array_to_string(list_sort({a}), '{sep}')"

    def split(self, x, sep=" "):
        return f"string_split({x}, '{sep}')"

    def slice(self, a, start, n):
        return f"list_slice({a}, {start}, {start} + {n} - 1)"

    def items(self, x):
        return f"list({x})"

    def median(self, x):
        return self.quantile(x, 0.5)

    def local(self, ts, zone):
        return f"(({ts} AT TIME ZONE 'UTC') AT TIME ZONE '{zone}')"

    def at_most(self, x, by):
        return f"arg_max({x}, {by})"

    def at_least(self, x, by):
        return f"arg_min({x}, {by})"

    def seconds(self, c):
        return f"(hour({c}) * 3600 + minute({c}) * 60 + second({c}))"

    def day(self, c):
        return f"date_diff('day', DATE '1970-01-01', CAST({c} AS DATE))"

    def back(self, us):
        return f"make_timestamp(CAST({us} AS BIGINT))"


S, D = SparkSQL(), DuckSQL()


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score in (0, 1) from the rank of their length."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    rows = load(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("bigint").alias("y")).join(docs, "doc_id")
    ranked = ordered.ordered(rows, ["n_chars", "doc_id"])
    p = ((F.col("rn") - F.lit(0.5)) / F.col("n_rows")).alias("p")
    return ranked.select("doc_id", "y", "source", "lang", p, F.col("n_chars").cast("double").alias("x"), "rn", "n_rows")


def orders_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    ranked = ordered.ordered(rows, ["o_orderdate", "o_orderkey"])
    return ranked.select("*", ordered.equal_parts(5).alias("fifth"), ordered.equal_parts(10).alias("tenth"))


def customers_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"), F.count("*").alias("n"))
    return ordered.ordered(groups, ["first", "o_custkey"], {"upto": "n"})


def price_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.value_ranks(load(spark, sf_dir, "part"), "p_retailprice")


def size_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.value_ranks(load(spark, sf_dir, "part"), "p_size")


def orders_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ordered.ordered(rows, ["o_orderpriority", F.desc("o_totalprice"), "o_orderkey"])


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their place ``k`` within their language by a hash, and the place of (k, lang) among all."""
    rows = load(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    ranked = ordered.ordered(rows, ["lang", "h"])
    first = ranked.groupBy("lang").agg(F.min("rn").alias("first"))
    within = ranked.join(F.broadcast(first), "lang").select("doc_id", "lang", (F.col("rn") - F.col("first") + 1).alias("k"))
    return ordered.ordered(within, ["k", "lang"]).select("doc_id", "lang", "k", F.col("rn").alias("place"))


def policy_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a direction from two ranks and the rank of its distance from one half."""
    part = load(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    share = lambda name: (F.col("upto") / F.col("n_rows")).alias(name)
    price = ordered.value_ranks(part, "p_retailprice").select("p_retailprice", share("a"))
    size = ordered.value_ranks(part, "p_size").select("p_size", share("b"))
    directed = part.join(price, "p_retailprice").join(size, "p_size").withColumn("direction", F.col("a") * 0.6 + F.col("b") * 0.4)
    directed = directed.withColumn("margin", F.round(F.abs(F.col("direction") - 0.5), 10))
    return directed.join(ordered.value_ranks(directed, "margin").select("margin", share("confidence")), "margin").select("p_partkey", "direction", "confidence")


def _quantile_row(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row with the exact quantiles q0, q1, ... of ``value``, found by ranks over ranges."""
    found = ordered.exact_quantiles(df, value, shares)
    return found.agg(*[F.max(F.when(F.col("share") == share, F.col("quantile"))).alias(f"q{i}") for i, share in enumerate(shares)])


def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quantile_row(load(spark, sf_dir, "lineitem"), "l_extendedprice", [0.05, 0.25, 0.5, 0.75, 0.95])


def order_time_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select(F.expr(S.us("o_orderdate")).cast("double").alias("t"))
    return _quantile_row(rows, "t", [0.45, 0.6, 0.75, 0.9])


def margin_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select(F.expr("abs(value / 100.0E0 - 0.5E0) * 2").alias("margin"))
    return _quantile_row(rows, "margin", [0.8, 1.0])


def move_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ninth decile of the moves between a user's neighbouring events."""
    moves = load(spark, sf_dir, "events").where("value >= 0").selectExpr("abs(ln((value + 1) / (lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 1))) AS r")
    return _quantile_row(moves, "r", [0.9])


#: Tables that put rows in a global order; Spark plans name them, the SQL of the other engine has a window.
VIEWS = {f.__name__: f for f in (scored, orders_in_time, customers_in_time, price_ranks, size_ranks, orders_by_priority, round_robin, policy_ranks, price_quantiles, order_time_quantiles, margin_quantiles, move_quantiles)}


def statement(build: Callable[[object], str], views: dict[str, Callable] = VIEWS) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """(Spark query, DuckDB text) of a statement builder; driver tables and ``views`` follow FROM or JOIN by name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text, sources = build(S), TABLES + list(views)
        used = [t for t in sources if re.search(rf"\b(FROM|JOIN)\s+{t}\b", text)]
        text = text.replace("{", "{{").replace("}", "}}")
        for t in used:
            text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", text)
        return spark.sql(text, **{t: views[t](spark, sf_dir) if t in views else load(spark, sf_dir, t) for t in used})

    return run, build(D)
