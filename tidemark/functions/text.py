"""Text, URL and HTML expressions: built-in functions, so that they stay inside generated code, but for one decoder."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def clean(text: Column) -> Column:
    """White space collapsed and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def normalise(text: Column) -> Column:
    """Lower case, everything but Latin letters, digits and Hangul syllables to single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9가-힣]+", " "))


def tokens(text: Column) -> Column:
    """Distinct normalised tokens of two characters or more."""
    return F.array_distinct(F.filter(F.split(normalise(text), " "), lambda t: F.length(t) > 1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def char_ngrams(text: Column, n: int = 5) -> Column:
    """Distinct character n-grams of the text without spaces; a shorter text is itself."""
    body = F.regexp_replace(normalise(text), " ", "")
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.length(body) - (n - 1), F.lit(1))), lambda i: F.substring(body, i, n))
    return F.array_distinct(many)


def count_keywords(text: Column, words: list[str]) -> Column:
    """How many list entries occur as substrings, case-folded."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words[1:]), F.contains(low, F.lit(words[0].lower())).cast("int"))


def norm_ticker(ticker: Column, market: Column) -> Column:
    """US: upper case with dots as dashes. KR: digits only, padded to six."""
    digits = F.regexp_replace(F.coalesce(ticker, F.lit("")), "[^0-9]", "")
    padded = F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)
    return F.when(market == "KR", padded).otherwise(F.replace(F.upper(F.trim(ticker)), F.lit("."), F.lit("-")))


# Query parameters that only track where a reader came from, in the two forms of canonical URLs.
TRACKING_SORTED = ("ref", "source", "output")
TRACKING_ORDERED = ("fbclid", "gclid", "mc_cid", "mc_eid", "oc", "ref", "ref_src", "source")


def canonical_url(url: Column, ordered: bool = False) -> Column:
    """A URL without tracking parameters (nor ``utm_``), doubled or closing slashes; a bare host has the path ``/``.

    By default the host loses ``www.`` and parameters are sorted; with ``ordered`` the host stays as it is but for its
    case, a closing dot and the scheme's own port, parameters keep their order, and what is not http(s) stays as it is.
    Parameters are compared as they are written; a parameter without a value gets an empty one.
    """
    raw = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(raw, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(raw, r"^[^:/?#]+://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(raw, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), "/{2,}", "/")
    path = F.regexp_replace(path, "/+$", "")
    query = F.regexp_extract(raw, r"^[^?#]*\?([^#]*)", 1)
    dropped = TRACKING_ORDERED if ordered else TRACKING_SORTED
    name = lambda p: F.lower(F.split(p, "=")[0])
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.startswith(name(p), F.lit("utm_")) & ~name(p).isin(*dropped))
    kept = F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    if ordered:
        host = F.regexp_replace(F.regexp_replace(host, F.when(scheme == "http", ":80$").otherwise(":443$"), ""), r"\.$", "")
    else:
        host, kept = F.regexp_replace(host, r"^www\.", ""), F.array_sort(kept)
    tail = F.array_join(kept, "&")
    made = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(""))
    whole = scheme.isin("http", "https") & (host != "") if ordered else host != ""
    return F.when(whole, made).otherwise(raw)


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Every character reference of the standard decoded."""
    return text.map(html.unescape, na_action="ignore")


def html_text(markup: Column) -> Column:
    """Scripts and styles removed, breaks and paragraph ends to lines, tags to spaces, references decoded.

    Runs of blanks become one space, runs of empty lines one line break. The decoder alone runs in Python, on batches.
    """
    out = F.regexp_replace(F.coalesce(markup, F.lit("")), r"(?is)<(script|style).*?>.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?is)<br\s*/?>|</p\s*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    out = F.regexp_replace(unescape(out), r"[ \t\r\f\x0B]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r"\n\s*\n+", "\n"), r"^\s+|\s+$", "")


def time_precision(text: Column) -> Column:
    """How precise a time is by the shape of its literal: the parts of its clock, else a bare day or hour."""
    clock = F.regexp_extract(text, r"(^|(?<=[T ]))[0-9]{1,2}(:[0-9]{2}){1,2}", 0)
    parts = F.length(clock) - F.length(F.replace(clock, F.lit(":"), F.lit("")))
    day = F.regexp_extract(text, r"^ *([0-9]{4}-[0-9]{2}-[0-9]{2}) *(.*)$", 1)
    rest = F.regexp_extract(text, r"[T ]([0-9]{1,2})(Z|[+-][0-9]{2}:?[0-9]{2})?$", 1)
    return F.when(parts == 2, "EXACT_SECOND").when(parts == 1, "EXACT_MINUTE").when((day != "") & (F.length(F.trim(text)) == 10), "DATE_ONLY").when(rest != "", "HOUR_ONLY").otherwise("UNKNOWN")


def stable_id(prefix: str, *parts: Column) -> Column:
    """Content-addressed id: the prefix and 24 hex digits of the SHA-256 of the joined parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\u001f", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 24))
