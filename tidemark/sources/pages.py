"""Web pages to rows: the article of a page with where each field came from, and the cells of its tables.

A page is read once, as events of the standard library's parser, in Arrow batches; everything after the raw fields (choosing, times, URLs, keys,
typed rows) is DataFrame expressions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import articles, text

#: Names of meta elements, in the order in which they are asked for.
HEADLINE_NAMES = ["og:title", "twitter:title"]
PUBLISHER_NAMES = ["og:site_name", "application-name"]
TIME_NAMES = ["article:published_time", "datePublished", "date", "pubdate", "publish-date"]
#: Elements without an end, and elements at whose begin or end a paragraph ends.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "article", "main", "section", "ul", "ol", "li", "table", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "header", "footer", "aside", "nav", "form", "body", "html"}
MOST_SPAN = 1000


def linked_data(value) -> Iterator[dict]:
    """Every object of a JSON-LD value in order, those of a graph after the object that holds it; depth is not limited."""
    stack = [value]
    while stack:
        now = stack.pop()
        if isinstance(now, dict):
            yield now
            if now.get("@graph") is not None:
                stack.append(now["@graph"])
        elif isinstance(now, list):
            stack.extend(reversed(now))


class _Article(HTMLParser):
    """Gathers title, metas, JSON-LD texts, the first dated <time> and paragraphs by the first <article>, <main> and <body>."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.when, self.metas, self.scripts = None, None, {}, []
        self.scopes = {"article": None, "main": None, "body": None}  # depth at which the first one opened; -1: closed
        self.paragraphs = {"article": [], "main": [], "body": []}
        self._open: list[str] = []
        self._into, self._words = None, []

    def _end_paragraph(self):
        if self._into == "p":
            told = " ".join("".join(self._words).split())
            for scope, depth in self.scopes.items():
                if told and (depth is not None and depth >= 0):
                    self.paragraphs[scope].append(told)
            self._into = None

    def handle_starttag(self, tag, attrs):
        own = {k: v or "" for k, v in reversed(attrs)}
        if tag in BLOCKS:
            self._end_paragraph()
        if tag in self.scopes and self.scopes[tag] is None:
            self.scopes[tag] = len(self._open)
        if tag == "meta" and own.get("content"):
            self.metas.setdefault((own.get("property") or own.get("name") or "").casefold(), own["content"].strip())
        elif tag == "time" and self.when is None and "datetime" in own:
            self.when = own["datetime"]
        elif tag == "p":
            self._into, self._words = "p", []
        elif tag == "title" and self.title is None and self._into is None:
            self._into, self._words = "title", []
        elif tag == "script":
            self._into, self._words = ("ld" if "ld+json" in own.get("type", "").lower() else "code"), []
        if tag not in VOID:
            self._open.append(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._end_paragraph()
        if tag == "title" and self._into == "title":
            self.title, self._into = "".join(self._words), None
        elif tag == "script" and self._into in ("ld", "code"):
            if self._into == "ld":
                self.scripts.append("".join(self._words))
            self._into = None
        if tag in self._open:
            while self._open.pop() != tag:
                pass
            for scope, depth in self.scopes.items():
                if depth is not None and depth >= len(self._open):
                    self.scopes[scope] = -1

    def handle_data(self, data):
        if self._into:
            self._words.append(data)

    def finish(self) -> dict:
        self.close()
        self._end_paragraph()
        ld = {}
        for script in self.scripts:
            try:
                value = json.loads(script)
            except ValueError:
                continue
            for item in linked_data(value):
                publisher = item.get("publisher")
                found = {"headline": item.get("headline"), "published": item.get("datePublished"), "body": item.get("articleBody"), "publisher": publisher.get("name") if isinstance(publisher, dict) else None}
                for k, v in found.items():
                    if v and k not in ld:
                        ld[k] = str(v)
        within = next((s for s in self.scopes if self.scopes[s] is not None), None)
        return {"ld": ld, "metas": self.metas, "title": self.title, "when": self.when, "paragraphs": self.paragraphs[within] if within else [], "within": within}


RAW = "struct<ld: map<string, string>, metas: map<string, string>, title: string, when: string, paragraphs: array<string>, within: string>"


def _raw_article(pages: pd.Series) -> pd.DataFrame:
    out = []
    for page in pages:
        parser = _Article()
        parser.feed(page or "")
        out.append(parser.finish())
    return pd.DataFrame(out)


def _first(*chain: tuple[Column, str]) -> tuple[Column, Column]:
    """The first value that is not empty, and its name."""
    value, name = F.lit(""), F.lit("UNKNOWN")
    for c, label in reversed(chain):
        there = F.coalesce(c, F.lit("")) != ""
        value, name = F.when(there, c).otherwise(value), F.when(there, F.lit(label)).otherwise(name)
    return value, name


def articles_of(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """One row per page: headline, body, publisher, publication time and canonical URL, each (but the URL) with where it came from.

    Headline: Open Graph, JSON-LD, title. Publisher: Open Graph, JSON-LD. Time: JSON-LD, meta elements by name, <time>. Body: JSON-LD, else the
    paragraphs of the first article, main or body. JSON-LD that does not parse is passed over. An unclosed paragraph ends where another
    block begins. A null page has empty fields.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.pandas_udf(_raw_article, RAW)(F.col(html_col)).alias("r")).select("id", "url", "r.*")
    meta = lambda name: F.try_element_at("metas", F.lit(name.casefold()))
    ld = lambda name: F.try_element_at("ld", F.lit(name))
    headline, headline_from = _first(*[(meta(n), f"META:{n}") for n in HEADLINE_NAMES], (ld("headline"), "JSON_LD"), (F.col("title"), "TITLE"))
    publisher, publisher_from = _first(*[(meta(n), f"META:{n}") for n in PUBLISHER_NAMES], (ld("publisher"), "JSON_LD"))
    published, published_from = _first((ld("published"), "JSON_LD_DATE_PUBLISHED"), *[(meta(n), f"HTML_META:{n}") for n in TIME_NAMES], (F.col("when"), "HTML_TIME_DATETIME"))
    body, body_from = _first((ld("body"), "JSON_LD"), (F.array_join("paragraphs", "\n"), "PARAGRAPHS"))
    given = F.coalesce(meta("og:url"), F.lit(""))
    base = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*:)//[^/?#]*", 0)
    absolute = (
        F.when(given == "", F.col("url"))
        .when(given.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), given)
        .when(F.startswith(given, F.lit("//")), F.concat(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1), given))
        .when(F.startswith(given, F.lit("/")), F.concat(base, given))
        .otherwise(F.concat(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), r"(?<![:/])/[^/]*$", ""), F.lit("/"), given))
    )
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    out = rows.select("id", tidy(headline).alias("headline"), headline_from.alias("headline_from"), tidy(body).alias("body"), body_from.alias("body_from"), tidy(publisher).alias("publisher"), publisher_from.alias("publisher_from"), F.trim(published).alias("published_raw"), published_from.alias("published_from"), text.canonical_url(absolute).alias("canonical_url"))
    return out.withColumn("p", articles.published(F.col("published_raw"))).select("*", F.col("p.at").alias("published_at"), F.col("p.precision").alias("precision"), F.col("p.confidence").alias("confidence"), F.col("p.zone_inferred").alias("zone_inferred")).drop("p")


class _Tables(HTMLParser):
    """Cells of all tables with their place in the grid; a nested table's cells stand in a table of their own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells: list[dict] = []
        self._tables: list[dict] = []
        self._count = 0

    def _close_cell(self):
        t = self._tables[-1]
        if t["cell"] is not None:
            t["cell"]["text"] = " ".join("".join(t["cell"]["text"]).split())
            t["cell"] = None

    def handle_starttag(self, tag, attrs):
        own = {k: v or "" for k, v in reversed(attrs)}
        if tag == "table":
            self._tables.append({"number": self._count, "class": own.get("class", ""), "row": -1, "col": 0, "cell": None, "down": {}, "part": ""})
            self._count += 1
            return
        if not self._tables:
            return
        t = self._tables[-1]
        if tag in ("thead", "tbody", "tfoot"):
            self._close_cell()
            t["part"], t["down"] = tag, {}
        elif tag == "tr":
            self._close_cell()
            t["row"], t["col"] = t["row"] + 1, 0
            t["down"] = {c: (n - 1, cell) for c, (n, cell) in t["down"].items() if n > 0}
            self._carry(t)
        elif tag in ("td", "th"):
            self._close_cell()
            if t["row"] < 0:
                t["row"] = 0
            span = lambda k: min(max(int(own[k]), 1), MOST_SPAN) if own.get(k, "").strip().isdigit() else 1
            cell = {"table": t["number"], "table_class": t["class"], "part": t["part"], "row": t["row"], "col": t["col"], "head": tag == "th", "spanned": False, "text": [], "onclick": "", "title": "", "href": ""}
            self.cells.append(cell)
            t["cell"] = cell
            wide, deep = span("colspan"), span("rowspan")
            for c in range(t["col"], t["col"] + wide):
                if c > t["col"]:
                    self.cells.append({"copy": cell, "row": t["row"], "col": c})
                if deep > 1:
                    t["down"][c] = (deep, cell)
            t["col"] += wide
            self._carry(t)
        elif tag == "a" and t["cell"] is not None and not t["cell"].get("linked"):
            t["cell"] |= {"onclick": own.get("onclick", ""), "title": own.get("title", ""), "href": own.get("href", ""), "linked": True}
        if tag == "br" and t["cell"] is not None:
            t["cell"]["text"].append(" ")

    def _carry(self, t):
        """Cells of rows above that reach down into this place."""
        while t["col"] in t["down"] and t["down"][t["col"]][1]["row"] < t["row"] and t["down"][t["col"]][0] > 0:
            self.cells.append({"copy": t["down"][t["col"]][1], "row": t["row"], "col": t["col"]})
            t["col"] += 1

    def handle_endtag(self, tag):
        if not self._tables:
            return
        if tag in ("td", "th", "tr", "thead", "tbody", "tfoot"):
            self._close_cell()
        elif tag == "table":
            self._close_cell()
            self._tables.pop()

    def handle_data(self, data):
        if self._tables and self._tables[-1]["cell"] is not None:
            self._tables[-1]["cell"]["text"].append(data)

    def finish(self) -> Iterator[dict]:
        self.close()
        while self._tables:
            self._close_cell()
            self._tables.pop()
        keys = ("table", "table_class", "part", "row", "col", "head", "spanned", "text", "onclick", "title", "href")
        for c in self.cells:
            c = c["copy"] | {"row": c["row"], "col": c["col"], "spanned": True} if "copy" in c else c
            yield {k: c[k] for k in keys}


CELLS = "table int, table_class string, part string, row int, col int, head boolean, spanned boolean, text string, onclick string, title string, href string"
#: Pages that are read, and cells that are sent on, at once: what a worker holds does not grow with its table.
PAGES_AT_ONCE, CELLS_AT_ONCE = 64, 4096


def _cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (id, html) to batches of cells with their page's id."""
    plain = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), *[pa.string()] * 4]
    names = [field.split()[0] for field in CELLS.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES_AT_ONCE):
            part = batch.slice(at, PAGES_AT_ONCE)
            owners, cells = [], []

            def made(owners, cells):
                return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owners, pa.int32())), *[pa.array([c[k] for c in cells], t) for k, t in zip(names, plain)]], ["id", *names])

            for i, page in enumerate(part.column(1).to_pylist()):
                parser = _Tables()
                parser.feed(page or "")
                for cell in parser.finish():
                    owners.append(i)
                    cells.append(cell)
                    if len(cells) == CELLS_AT_ONCE:
                        yield made(owners, cells)
                        owners, cells = [], []
            if cells:
                yield made(owners, cells)


def table_cells(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, table, table_class, part, row, col, head, spanned, text, onclick, title, href) of every place in the grid of every table.

    A cell that spans rows or columns stands in each of its places, ``spanned`` in all but its own; a span reaches no further than
    its table's section and never over ``MOST_SPAN``. Link fields are those of the first link in the cell. Unclosed rows and cells end
    where the next begins. Pages without a table, and null pages, have no row.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_cells_of, f"id {rows.schema['id'].dataType.simpleString()}, {CELLS}")


def disclosures(pages: DataFrame, id_col: str, day_col: str, html_col: str, zone: str = "Asia/Seoul", table_class: str = "list type-00 mt10") -> DataFrame:
    """Typed rows of a day's disclosure table: id, event_id, ticker, company, event_time (UTC), headline, accession, url.

    The table is that of the given class, else the page's first; rows are those of its body with four cells or more whose second
    holds a company key. A key of five characters is an issue prefix and gets the issue digit 0; all-digit keys are filled to six. Rows
    whose time does not parse are left out.
    """
    cells = table_cells(pages, id_col, html_col)
    body = (F.col("part") == "tbody") & ~F.col("head")
    at = lambda c, field: F.max(F.when(body & (F.col("col") == c), F.col(field)))
    rows = cells.groupBy("id", "table", "row").agg(
        F.max(F.col("table_class") == table_class).alias("named"),
        F.count(F.when(body, 1)).alias("n"), at(0, "text").alias("time"), at(1, "text").alias("company"), at(1, "onclick").alias("company_key"), at(2, "text").alias("shown"), at(2, "title").alias("title"), at(2, "onclick").alias("view"),
    )
    # Pages are read once: the table is chosen from the rows.
    page = Window.partitionBy("id")
    chosen = F.coalesce(F.min(F.when(F.col("named"), F.col("table"))).over(page), F.min("table").over(page))
    rows = rows.withColumn("chosen", chosen).where("table = chosen AND n >= 4")
    rows = rows.withColumn("code", F.regexp_extract("company_key", r"companysummary_open\('([0-9A-Za-z]+)'", 1)).where("code <> ''")
    rows = rows.withColumn("accession", F.regexp_extract("view", r"openDisclsViewer\('([0-9]+)'", 1))
    ticker = F.when(F.length("code") == 5, F.concat("code", F.lit("0"))).when(F.col("code").rlike("^[0-9]+$"), F.lpad("code", 6, "0")).otherwise(F.upper("code"))
    days = pages.select(F.col(id_col).alias("id"), F.col(day_col).cast("date").alias("day"))
    local = F.try_to_timestamp(F.concat_ws(" ", F.col("day").cast("string"), F.col("time")), F.lit("yyyy-MM-dd HH:mm[:ss]"))
    out = rows.join(days, "id").withColumn("event_time", F.to_utc_timestamp(local, zone)).where("event_time IS NOT NULL").withColumn("ticker", ticker)
    url = F.concat(F.lit("https://kind.krx.co.kr/common/disclsviewer.do?method=search&acptno="), "accession", F.lit("&docno=&viewerhost=&viewerport="))
    key = F.when(F.col("accession") != "", F.col("accession")).otherwise(F.concat("ticker", F.lit(":"), F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ssXXX")))
    return out.select("id", "row", F.concat(F.lit("KIND:"), key).alias("event_id"), "ticker", "company", "event_time", F.when(F.col("title") != "", F.trim("title")).otherwise(F.col("shown")).alias("headline"), "accession", F.when(F.col("accession") != "", url).otherwise("").alias("url"))
