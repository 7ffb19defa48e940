"""Articles and table rows of hand-made pages."""

from datetime import datetime

from tidemark.sources import pages


def article(spark, html, url="https://x.com/a/b?q=1"):
    return pages.articles_of(spark.createDataFrame([(1, url, html)], "id int, url string, html string"), "id", "url", "html").first()


def test_open_graph_then_linked_data_then_title(spark):
    ld = '<script type="application/LD+JSON">{"@graph": [{"@type": "WebSite", "publisher": {"name": " The  Paper "}}, [{"headline": "From data", "datePublished": "2026-01-05T10:30:00Z", "articleBody": "The whole\\n body"}]], "headline": "outer"}</script>'
    row = article(spark, f'<title>T &amp; u</title><meta property="OG:Title" content=" Open  graph "><meta name="date" content="2020-01-01">{ld}<article><p>no</p></article>')
    assert (row["headline"], row["headline_from"]) == ("Open graph", "META:og:title")
    assert (row["publisher"], row["publisher_from"]) == ("The Paper", "JSON_LD") and (row["body"], row["body_from"]) == ("The whole body", "JSON_LD")
    assert (row["published_raw"], row["published_from"], row["precision"], row["confidence"]) == ("2026-01-05T10:30:00Z", "JSON_LD_DATE_PUBLISHED", "EXACT_SECOND", "HIGH")
    assert article(spark, f"<title>T</title>{ld}")["headline"] == "outer"
    assert (lambda r: (r["headline"], r["headline_from"]))(article(spark, "<title> T &amp;\n u</title><script type='application/ld+json'>{broken</script>")) == ("T & u", "TITLE")


def test_times_by_meta_in_their_order_then_time_element(spark):
    row = article(spark, '<meta name="pubdate" content="2026-02-03"><meta name="DatePublished" content="2026-02-04T01:02Z"><time>x</time><time datetime="2026-02-05">')
    assert (row["published_raw"], row["published_from"], row["precision"]) == ("2026-02-04T01:02Z", "HTML_META:datePublished", "EXACT_MINUTE")
    row = article(spark, '<time>x</time><time datetime="2026-02-05">y</time><time datetime="2026-03-05">')
    assert (row["published_raw"], row["published_from"], row["precision"], row["confidence"]) == ("2026-02-05", "HTML_TIME_DATETIME", "DATE_ONLY", "LOW")
    row = article(spark, None)
    assert (row["published_from"], row["headline_from"], row["body_from"], row["publisher_from"], row["body"]) == ("UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN", "")


def test_paragraphs_of_the_first_article(spark):
    html = "<body><p>menu</p><main><p>intro</p><article><p>one <b>bold</b>&nbsp;x<p>two<br>lines<div><p> </p><script>var p = '<p>no</p>';</script></div></article><article><p>second</p></article><p>after</main></body>"
    assert article(spark, html)["body"] == "one bold x twolines"
    assert article(spark, "<body><p>menu</p><main><p>intro</p></main><p>after</body>")["body"] == "intro"
    assert article(spark, "<body><p>a<p>b")["body"] == "a b"


def test_canonical_urls(spark):
    made = {"/c": "https://x.com/c", "//y.com/d": "https://y.com/d", "e": "https://x.com/a/e", "http://z.com/f": "http://z.com/f"}
    for given, want in made.items():
        assert article(spark, f'<meta property="og:url" content="{given}">')["canonical_url"] == want
    assert article(spark, "<p>x", "https://x.com")["canonical_url"].startswith("https://x.com")


def cells(spark, html):
    return [(r["table"], r["row"], r["col"], r["text"], r["spanned"]) for r in sorted(pages.table_cells(spark.createDataFrame([(1, html)], "id int, html string"), "id", "html").collect(), key=lambda r: (r["table"], r["row"], r["col"]))]


def test_grid_of_spans(spark):
    html = "<table><tr><td rowspan=2>a<td colspan=2>b<td rowspan='3'>c</tr><tr><td>d<td>e<tr><td>f<td>g<td>h</table>"
    assert cells(spark, html) == [
        (0, 0, 0, "a", False), (0, 0, 1, "b", False), (0, 0, 2, "b", True), (0, 0, 3, "c", False),
        (0, 1, 0, "a", True), (0, 1, 1, "d", False), (0, 1, 2, "e", False), (0, 1, 3, "c", True),
        (0, 2, 0, "f", False), (0, 2, 1, "g", False), (0, 2, 2, "h", False), (0, 2, 3, "c", True),
    ]
    nested = "<table><tr><td>x<table><tr><td>in</td></tr></table>y</td><td>z"
    assert cells(spark, nested) == [(0, 0, 0, "xy", False), (0, 0, 1, "z", False), (1, 0, 0, "in", False)]
    assert cells(spark, None) == [] and cells(spark, "<td>stray") == [] and cells(spark, "<table><td rowspan=x colspan=0>1") == [(0, 0, 0, "1", False)]


def test_disclosures(spark):
    row = lambda t, code, acc, title: f"<tr>{t}<td><a onclick=\"companysummary_open('{code}')\">Co {code}</a></td><td><a title=\" {title} \" onclick=\"openDisclsViewer('{acc}','')\">cut...</a></td><td>x</td></tr>"
    html = (
        "<table><tbody><tr><td>other</td></tr></tbody></table><table class='list type-00 mt10'><thead><tr><th>Time</th></tr></thead><tbody>"
        + row("<td rowspan=2>09:05</td>", "00593", "2026", "Approval") + row("", "abc123", "", "Recall") + row("<td>25:99</td>", "00001", "7", "bad") + "<tr><td>10:00</td><td>no key</td><td>x</td><td>y</td></tr><tr><td>10:00</td><td>few</td></tr></tbody></table>"
    )
    df = spark.createDataFrame([(1, "2026-01-05", html), (2, "2026-01-05", None)], "id int, day string, html string")
    got = [tuple(r) for r in pages.disclosures(df, "id", "day", "html").orderBy("row").drop("url", "row").collect()]
    at = datetime(2026, 1, 5, 0, 5)
    assert got == [(1, "KIND:2026", "005930", "Co 00593", at, "Approval", "2026"), (1, "KIND:ABC123:2026-01-05T00:05:00Z", "ABC123", "Co abc123", at, "Recall", "")]
