"""Landed sources and sinks on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import landed, sinks


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_csv_and_json_sources(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("ticker,price,note\nA,1.5,x\nB,,y\n")
    assert _rows(landed.csv_table(spark, str(tmp_path / "a.csv.gz"), "ticker string, price double, note string", ["ticker", "price"])) == [("A", 1.5), ("B", None)]
    with gzip.open(tmp_path / "n.json.gz", "wt") as f:
        f.write('{"url":"https://a/1","title":"t"}\n{"url":"ftp://a","title":"t"}\n{broken\n{"url":"http://b","title":""}\n')
    assert _rows(landed.news_bucket(spark, str(tmp_path / "n.json.gz"), "url string, title string")) == [("https://a/1", "t")]
    (tmp_path / "k.json").write_text(json.dumps({"A": [{"t": 1}, {"t": 2}], "B": []}))
    assert _rows(landed.keyed_json(spark, str(tmp_path / "k.json"), "t: int")) == [("A", 1), ("A", 2)]


def test_bars_pick_aliases_and_drop_bad_rows(spark):
    raw = spark.createDataFrame([("2026-01-05 09:30:00", "1", "2"), ("2026-01-05T14:31:00Z", "3", "4"), (None, "5", "6"), ("bad", "7", "8"), ("2026-01-05 09:30:00", "1", "2")], "Timestamp string, C string, vol string")
    out = landed.bars(raw, "America/New_York").select(F.date_format("datetime", "HH:mm").alias("t"), "close", "volume", "open")
    assert _rows(out) == [("14:30", 1.0, 2.0, None), ("14:31", 3.0, 4.0, None)]
    with pytest.raises(ValueError):
        landed.bars(raw.drop("C"))


def test_first_source_and_universe(spark):
    a = spark.createDataFrame([("A", 1)], "k string, v int")
    b = spark.createDataFrame([("A", 2), ("B", 3), ("B", 4)], "k string, v int")
    assert _rows(landed.first_source([a, b], "k")) == [("A", 1), ("B", 3), ("B", 4)]
    cols = "ticker string, name string, exchange string, market_cap double"
    listed = spark.createDataFrame([("A", "Bio A", "X", 3.0), ("B", "Bio B", "X", 2.0), ("C", "Bio C", "X", 1.0), ("A", "Bio A", "Y", 9.0), ("D", "Coal", "Y", 99.0)], cols)
    assert _rows(landed.universe(listed, "Bio", 1).select("ticker", "exchange")) == [("A", "Y"), ("B", "X")]


FEED = """<rss><channel><title>c</title>
<item><title> One </title><link>http://a/1</link><guid>g1</guid><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate><source url="http://p">P</source></item>
<item><title>Two</title><link>http://a/2</link><pubDate>yesterday</pubDate><source url="http://p">P</source></item></channel></rss>"""


def test_feed_items_and_quarantine(spark):
    pays = spark.createDataFrame([("c1", FEED), ("c2", "<rss><chan"), ("c3", None), ("c4", "<rss><channel></channel></rss>")], "capture_id string, payload string")
    items, bad = landed.feed_items(pays)
    got = items.select("capture_id", "position", "headline", "guid", "publisher", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss")).collect()
    assert [tuple(r) for r in got] == [("c1", 0, "One", "g1", "P", "2026-01-05 10:00:00")]
    assert sorted((r.capture_id, r.reason) for r in bad.collect()) == [("c1", "INVALID_ITEM"), ("c2", "INVALID_FEED"), ("c3", "INVALID_FEED"), ("c4", "INVALID_FEED")]


def test_filings_and_master_index(spark):
    pays = spark.createDataFrame([("1", ["8-K", "4"], ["d1", "d2"])], "cik string, form array<string>, filed array<string>")
    assert _rows(landed.columnar_filings(pays, ["form", "filed"], F.col("form") == "8-K")) == [("1", "8-K", "d1")]
    lines = spark.createDataFrame([("0012|Acme|8-K|2026-01-05|edgar/0001-2.txt",), ("0012|Acme|8-K|2026-01-05|edgar/0001-2.txt",), ("x|y|8-K|z|w",), ("12|B|4|d|f.txt",), ("head",)], "value string")
    assert _rows(landed.master_index(lines, ["8-K"]).select("cik", "form", "accession")) == [("12", "8-K", "0001-2")]


def test_write_once_upsert_ledger_manifest(spark, tmp_path):
    one = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    path = str(tmp_path / "once")
    assert sinks.write_once(one, path) and not sinks.write_once(one.orderBy(F.desc("k")), path)
    with pytest.raises(ValueError):
        sinks.write_once(one.withColumn("v", F.lit("b")), path)
    store = str(tmp_path / "up")
    sinks.upsert(spark, store, spark.createDataFrame([("A", 1, "x"), ("B", 5, "y")], "k string, t int, v string"), ["k"], "t")
    sinks.upsert(spark, store, spark.createDataFrame([("A", 1, "z"), ("B", 4, "w"), ("C", None, "n")], "k string, t int, v string"), ["k"], "t")
    assert {(r.k, r.v) for r in sinks.latest(spark, store).collect()} == {("A", "z"), ("B", "y"), ("C", "n")}
    ledger = str(tmp_path / "led")
    for _ in range(2):
        sinks.append_ledger(spark, ledger, one, "k")
    assert spark.read.schema(one.schema).json(ledger).count() == 2
    files = sinks.file_manifest(spark, ledger).where("file LIKE 'part=%/part-%'").collect()
    assert files and all(len(r.sha256) == 64 for r in files)
