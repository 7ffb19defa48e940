"""Edges of the core operators."""

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import asof, graph, metrics, sequential


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_asof_includes_equal_times_and_respects_tolerance(spark):
    left = spark.createDataFrame([(1, 100), (2, 160), (3, 161), (4, None)], "id int, t bigint")
    right = spark.createDataFrame([(100, 1.0), (100, 2.0), (220, 3.0)], "t bigint, v double")
    for bucket in (None, 1000):
        ahead = asof.asof_join(left, right, "t", "t", "v", tolerance=60, bucket=bucket).select("id", "asof_time", "asof_value")
        assert _rows(ahead) == [(1, 100, 2.0), (2, 220, 3.0), (3, 220, 3.0), (4, None, None)]
        back = asof.asof_join(left, right, "t", "t", "v", direction="backward", tolerance=60, bucket=bucket).select("id", "asof_time")
        assert _rows(back.where("id < 4")) == [(1, 100), (2, 100), (3, None)]


def test_asof_across_bucket_borders(spark):
    left = spark.createDataFrame([(i, i * 7) for i in range(200)], "id int, t bigint")
    right = spark.createDataFrame([(i * 13, float(i)) for i in range(110)], "t bigint, v double")
    for direction in ("forward", "backward"):
        plain = asof.asof_join(left, right, "t", "t", "v", direction=direction, tolerance=9)
        cut = asof.asof_join(left, right, "t", "t", "v", direction=direction, tolerance=9, bucket=10)
        assert _rows(plain) == _rows(cut)


def test_embargo_is_closed_at_its_border(spark):
    left = spark.createDataFrame([("a", 100), ("a", 200), ("b", 100)], "k string, t bigint")
    right = spark.createDataFrame([("a", 135)], "k string, t bigint")
    assert _rows(asof.embargo_anti(left, right, "t", ["k"], 35)) == [("a", 200), ("b", 100)]


def test_greedy_spacing_anchors_on_the_last_kept_row(spark):
    rows = spark.createDataFrame([("k", 0, 0), ("k", 6, 1), ("k", 12, 2), ("k", 12, 3), ("k", 30, 4)], "k string, t bigint, id int")
    kept = sequential.greedy_spacing(rows, ["k"], "t", "id", 10, strict=False)
    assert _rows(kept.select("id")) == [(0,), (2,), (4,)]


def test_auc_ties_and_single_class(spark):
    rows = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 0), ("b", 0.1, 1)], "k string, p double, y int")
    assert _rows(metrics.roc_auc(rows, "p", "y", keys=["k"])) == [("a", 0.5), ("b", None)]


def test_components_of_a_long_chain_and_of_nothing(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a int, b int")
    roots = dict(_rows(graph.components(links)))
    assert {roots[i] for i in range(1, 41)} == {0} and roots[101] == 100
    assert graph.components(links.limit(0)).count() == 0


def test_text_expressions(spark):
    row = spark.createDataFrame([("BRK.b", "12-34", "2024-01-02 10:11", "ab cd", "ab  CD!", "https://www.A.com//x/?utm_a=1&b=2&a=1#f")], "us string, kr string, t string, a string, b string, u string")
    got = row.select(
        tx.norm_ticker(F.col("us"), F.lit("US")),
        tx.norm_ticker(F.col("kr"), F.lit("KR")),
        tx.time_precision(F.col("t")),
        tx.jaccard(tx.tokens(F.col("a")), tx.tokens(F.col("b"))),
        tx.canonical_url(F.col("u")),
        F.size(tx.char_ngrams(F.lit("abc"))),
        F.length(tx.stable_id("E", F.col("us"))),
    ).first()
    assert tuple(got) == ("BRK-B", "001234", "EXACT_MINUTE", 1.0, "https://a.com/x?a=1&b=2", 1, 25)


def test_islands_touching_intervals_merge(spark):
    rows = spark.createDataFrame([("k", 0, 5), ("k", 5, 9), ("k", 20, 21)], "k string, lo int, hi int")
    assert _rows(sequential.merge_intervals(rows, ["k"], "lo", "hi").select("lo", "hi", "n")) == [(0, 9, 2), (20, 21, 1)]


def test_global_order_numbers_sums_and_bins(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import ordered

    rows = [(i * 7 % 50, i) for i in range(203)]
    df = spark.createDataFrame(rows, "v int, id int")
    got = ordered.ordered(df, [F.desc("v"), "id"], {"upto": "id"}).withColumn("part", ordered.equal_parts(5)).withColumn("bin", ordered.quantile_bins(5)).orderBy("rn").collect()
    want, total = sorted(rows, key=lambda r: (-r[0], r[1])), 0
    import numpy as np
    import pandas as pd

    parts = np.concatenate([np.full(len(p), k + 1) for k, p in enumerate(np.array_split(np.arange(203), 5))])
    bins = pd.qcut(pd.Series(np.arange(1, 204)), 5, labels=False) + 1
    for k, (r, (v, i)) in enumerate(zip(got, want)):
        total += i
        assert (r["v"], r["id"], r["rn"], r["n_rows"], r["upto"], r["part"], r["bin"]) == (v, i, k + 1, 203, total, parts[k], bins[k])
        assert r["upto_all"] == sum(range(203))
    assert ordered.ordered(df.limit(0), ["v", "id"]).count() == 0
    ranks = {r["v"]: (r["same"], r["upto"]) for r in ordered.value_ranks(df, "v").collect()}
    assert all(ranks[v] == (sum(x == v for x, _ in rows), sum(x <= v for x, _ in rows)) for v in range(50))


def test_checked_join_raises(spark):
    import pytest

    from tidemark.operators import joins

    left = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, x string")
    right = spark.createDataFrame([(1, "u"), (2, "v")], "k int, y string")
    assert joins.checked_join(left, right, ["k"], "left", "m:1").count() == 3
    with pytest.raises(ValueError, match="left side"):
        joins.checked_join(left, right, ["k"], "inner", "1:1")
    with pytest.raises(ValueError, match="right side"):
        joins.checked_join(right, left, ["k"], "inner", "1:1")


def test_safe_public_url_and_text_rules(spark):
    from pyspark.sql import functions as F

    from tidemark.functions import articles
    from tidemark.functions import text as tx

    urls = {
        "http://example.com/a": True, "https://1.1.1.1": True, "http://172.32.0.1/": True, "http://172.31.255.255/": False, "http://127.0.0.1:80/": False, "http://0.0.0.0": False,
        "http://[::1]/": False, "http://[fd00::1]:8080/": False, "http://[2606:4700::1]/": True, "ftp://a.b": False, "http://u:p@a.b": False, "http://localhost.": False, "http://x.local": False,
        "": False, "http:///x": False, "http://999.1.1.1/": True, "http://224.0.0.1/": False,
    }
    df = spark.createDataFrame(list(urls.items()) + [(None, False)], "u string, want boolean")
    assert df.where(articles.safe_public_url(F.col("u")) != F.col("want")).collect() == []
    times = {"2026-01-02": "DATE_ONLY", "2026-01-02T03:04:05Z": "EXACT_SECOND", "2026-01-02 3:04 PM": "EXACT_MINUTE", "2026-01-02T14Z": "HOUR_ONLY", "soon": "UNKNOWN", "Mon, 05 Jan 2026 07:08:09 +0900": "EXACT_SECOND"}
    got = spark.createDataFrame(list(times.items()), "t string, want string").withColumn("got", tx.time_precision(F.col("t"))).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    pages = {"<p>a&nbsp;b &eacute;<br/>c</p> <script>x</script> <b>d</b>": "a b é\nc\n d", "": "", "a<br>\n\n<br />b": "a\nb"}
    got = spark.createDataFrame(list(pages.items()), "h string, want string").withColumn("got", tx.html_text(F.col("h"))).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    links = {"HTTP://WWW.A.com//x//?b=2&utm_x=1&a=1&Ref=q": "http://a.com/x?a=1&b=2", "https://a.com": "https://a.com/", "https://a.com/?k": "https://a.com/?k="}
    got = spark.createDataFrame(list(links.items()), "u string, want string").withColumn("got", tx.canonical_url(F.col("u"))).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
