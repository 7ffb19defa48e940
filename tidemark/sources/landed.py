"""Readers of landed files: every source is a lazy DataFrame, so column and row pruning reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def csv_table(spark: SparkSession, path: str | list[str], schema: str, columns: list[str] | None = None) -> DataFrame:
    """Plain or gzipped CSV with a declared schema (no inference pass); only ``columns`` are parsed."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.select(*columns) if columns else rows


def audited_json_lines(spark: SparkSession, path: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of a JSON-lines ledger, gzipped or plain: lines that do not parse come whole as ``line``."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("_r"))
    good = parsed.where("_r IS NOT NULL AND _r._bad IS NULL").select("_r.*").drop("_bad")
    return good, parsed.where("_r IS NULL OR _r._bad IS NOT NULL").select(F.col("value").alias("line"))


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """The rows of a JSON-lines ledger; see ``audited_json_lines`` for the lines that do not parse."""
    return audited_json_lines(spark, path, schema)[0]


def news_bucket(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Rows of a JSON-lines bucket with an http(s) ``url`` and a ``title``."""
    return json_lines(spark, path, schema).where(F.col("url").rlike("^https?://") & (F.coalesce("title", F.lit("")) != ""))


def keyed_json(spark: SparkSession, path: str | list[str], row: str, key: str = "key") -> DataFrame:
    """JSON files that map a key to a list of records: one row per record, with its key."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", f"map<string,array<struct<{row}>>>")).alias(key, "_rows"))
    return pairs.select(key, F.explode("_rows").alias("_r")).select(key, "_r.*")


def aliased(df: DataFrame, aliases: dict[str, list[str]], required: tuple[str, ...] = ()) -> DataFrame:
    """Output columns from the first non-null of their aliases, whatever the letter case; absent ones are null.

    A required column none of whose aliases exists raises ValueError.
    """
    have: dict[str, list[str]] = {}
    for c in df.columns:
        have.setdefault(c.lower(), []).append(c)
    out = []
    for name, options in aliases.items():
        found = [c for o in options for c in have.get(o.lower(), [])]
        if not found and name in required:
            raise ValueError(f"no column for {name}: expected one of {options}")
        out.append((F.coalesce(*[F.col(f"`{c}`") for c in found]) if found else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def to_utc(text: Column, zone: Column | str) -> Column:
    """A time literal as an instant: its own offset where it has one, else read in ``zone``. Needs a UTC session."""
    offset = text.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})\s*$")
    stamp = F.try_to_timestamp(text)
    return F.when(offset, stamp).otherwise(F.to_utc_timestamp(stamp, zone))


#: The column names under which bar files carry each field.
BAR_ALIASES = {
    "datetime": ["datetime", "timestamp", "time", "date", "t"],
    "open": ["open", "o"],
    "high": ["high", "h"],
    "low": ["low", "l"],
    "close": ["close", "c"],
    "volume": ["volume", "vol", "v"],
}


def bars(df: DataFrame, zone: str = "UTC", keys: tuple[str, ...] = ()) -> DataFrame:
    """Normalised bars: UTC times, numeric fields, rows without time or close dropped, one row per key and time."""
    named = aliased(df, {k: [k] for k in keys} | BAR_ALIASES, required=("datetime", "close"))
    cast = named.select(*keys, to_utc(F.col("datetime").cast("string"), zone).alias("datetime"), *[F.col(c).cast("double").alias(c) for c in list(BAR_ALIASES)[1:]])
    values = F.struct("close", "open", "high", "low", "volume")
    one = cast.where("datetime IS NOT NULL AND close IS NOT NULL").groupBy(*keys, "datetime").agg(F.max(values).alias("_b"))
    return one.select(*keys, "datetime", *[F.col(f"_b.{c}").alias(c) for c in list(BAR_ALIASES)[1:]])


def first_source(sources: list[DataFrame], key: str) -> DataFrame:
    """All rows of each key from the first source in the list that has the key."""
    ranked = [s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    best = rows.groupBy(key).agg(F.min("_rank").alias("_rank"))
    return rows.join(best, [key, "_rank"], "left_semi").drop("_rank")


FEED_SCHEMA = "channel struct<item: array<struct<title: string, link: string, guid: string, pubDate: string, description: string, source: string>>>, _bad string"


def feed_items(payloads: DataFrame, xml: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(items, quarantine) of RSS payloads.

    An item needs a title, a link, a source and an exact publication time; the others, and payloads that are not
    XML or have no items, go to the quarantine with a ``reason``. Other columns of ``payloads`` come along.
    """
    rest = [F.col(f"`{c}`") for c in payloads.columns if c != xml]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "attributePrefix": "_"}
    parsed = payloads.select(*rest, F.from_xml(F.col(xml), FEED_SCHEMA, options).alias("_f"))
    broken = F.col("_f").isNull() | F.col("_f._bad").isNotNull() | F.col("_f.channel.item").isNull()
    rows = parsed.where(~broken).select(*rest, F.posexplode("_f.channel.item").alias("position", "_i"))
    text = lambda name: F.trim(F.coalesce(F.col(f"_i.{name}"), F.lit("")))
    stamp = F.regexp_replace(F.regexp_replace(text("pubDate"), r"^[A-Za-z]{3},\s*", ""), r"(GMT|UTC|UT|Z)$", "+0000")
    rows = rows.select(
        *rest,
        "position",
        text("title").alias("headline"),
        text("link").alias("url"),
        F.coalesce(F.nullif(text("guid"), F.lit("")), text("link")).alias("guid"),
        text("source").alias("publisher"),
        text("description").alias("description"),
        F.try_to_timestamp(stamp, F.lit("d MMM yyyy HH:mm:ss Z")).alias("published_at"),
    )
    sound = (F.col("headline") != "") & (F.col("url") != "") & (F.col("publisher") != "") & F.col("published_at").isNotNull()
    bad_items = rows.where(~sound).select(*rest, "position", F.lit("INVALID_ITEM").alias("reason"))
    bad_files = parsed.where(broken).select(*rest, F.lit(None).cast("int").alias("position"), F.lit("INVALID_FEED").alias("reason"))
    return rows.where(sound), bad_items.unionByName(bad_files)


def columnar_filings(payloads: DataFrame, arrays: list[str], keep: Column) -> DataFrame:
    """Records that arrive as parallel arrays, zipped to rows and filtered."""
    rest = [F.col(f"`{c}`") for c in payloads.columns if c not in arrays]
    rows = payloads.select(*rest, F.explode(F.arrays_zip(*arrays)).alias("_z"))
    return rows.select(*rest, *[F.col(f"_z.{a}").alias(a) for a in arrays]).where(keep)


def master_index(lines: DataFrame, forms: list[str], text: str = "value") -> DataFrame:
    """Five-field index lines of the wanted forms; the accession is the file's stem. One row per (cik, accession)."""
    part = F.split(F.col(text), r"\|")
    rows = lines.select(part.alias("p")).where(F.size("p") == 5)
    cik, company, form, filed, filename = [F.trim(F.col("p")[i]) for i in range(5)]
    named = rows.select(cik.alias("cik"), company.alias("company"), form.alias("form"), filed.alias("filed"), filename.alias("filename"))
    named = named.where(F.col("cik").rlike("^[0-9]+$") & F.col("form").isin(*forms))
    stem = F.regexp_replace(F.regexp_extract("filename", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    named = named.withColumn("cik", F.col("cik").cast("decimal(38,0)").cast("string")).withColumn("accession", stem)
    first = named.groupBy("cik", "accession").agg(F.min(F.struct("filed", "company", "form", "filename")).alias("r"))
    return first.select("cik", "r.company", "r.form", "r.filed", "r.filename", "accession")


def universe(listings: DataFrame, pattern: str, top: int, by: str = "market_cap", group: str = "exchange", key: str = "ticker", name: str = "name") -> DataFrame:
    """The ``top`` listings of each group by size among those whose name matches; one row per key, the largest."""
    fit = listings.where(F.col(name).rlike(pattern) & F.col(by).isNotNull())
    one = fit.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by), group))).where("_k = 1")
    ranked = one.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(by), key)))
    return ranked.where(F.col("_r") <= top).drop("_k", "_r")
