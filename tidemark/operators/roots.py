"""Whether two articles go back to one piece of information: near copies of the body, or an excerpt too short to prove otherwise."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The likenesses from which bodies are near copies, and what makes a short excerpt suspicious.
SEQUENCE, JACCARD, CONTAINMENT = 0.82, 0.70, 0.55
EXCERPT_BELOW, ARTICLE_FROM, HEADLINE_RATIO, WITHIN_SECONDS = 300, 500, 0.70, 300
NEAR_COPY, SHORT_EXCERPT = "BASE_CONTENT_NEAR_DUPLICATE", "BASE_SHORT_EXCERPT_NEAR_SIMULTANEOUS_INDEPENDENCE_UNPROVEN"


def _plain(text: str | None) -> str:
    return re.sub("[^0-9a-z가-힣]+", " ", (text or "").casefold()).strip()


def _grams(text: str) -> set[str]:
    packed = text.replace(" ", "")
    return {packed[i : i + 5] for i in range(max(len(packed) - 4, 1))} if packed else set()


def longest_common_subsequence(a: str, b: str) -> int:
    """Its length, a column of the table at once in the bits of one number."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    whole = open_ = (1 << len(a)) - 1
    for c in b:
        hit = open_ & where.get(c, 0)
        open_ = (open_ + hit | open_ - hit) & whole
    return len(a) - open_.bit_count()


def _alike(a: str, b: str, least: float) -> bool:
    """Whether the ratio of matching blocks reaches ``least``.

    Matching blocks are a common subsequence, so that its length bounds them; texts that pass this bound are near copies.
    """
    if not a or not b:
        return False
    match = SequenceMatcher(None, a, b, autojunk=False)
    if match.real_quick_ratio() < least or match.quick_ratio() < least:
        return False
    return 2 * longest_common_subsequence(a, b) >= least * (len(a) + len(b)) and match.ratio() >= least


def shared_root(base: str | None, other: str | None, base_headline: str | None, headline: str | None, seconds: float | None) -> str:
    """Why the two share a root, or an empty string. Grams are compared first: where they decide, no blocks are matched."""
    a, b = _plain(base), _plain(other)
    if a and b:
        ga, gb = _grams(a), _grams(b)
        both = len(ga & gb)
        if both >= CONTAINMENT * min(len(ga), len(gb)) or both >= JACCARD * len(ga | gb) or _alike(a, b, SEQUENCE):
            return NEAR_COPY
    suspicious = 0 < len(a) < EXCERPT_BELOW and len(b) >= ARTICLE_FROM and seconds is not None and abs(seconds) <= WITHIN_SECONDS
    return SHORT_EXCERPT if suspicious and _alike(_plain(base_headline), _plain(headline), HEADLINE_RATIO) else ""


def root_sharing(bases: DataFrame, candidates: DataFrame, key: str = "event") -> DataFrame:
    """(event, base, candidate, reason) of every candidate that shares the root of a base article of its event.

    Both tables: ``key``, uid, headline, body, t (seconds). Every base of an event is compared with every candidate of it, and with
    nothing else; events have few base articles. Copies in one batch are compared once. Null keys match nothing; a null
    body is empty; a null time proves nothing.
    """
    side = lambda df, p: df.where(F.col(key).isNotNull()).select(F.col(key).alias("event"), *[F.col(c).alias(f"{p}_{c}") for c in ("uid", "headline", "body", "t")])
    base, other = side(bases, "base"), side(candidates, "other")
    pairs = base.join(other, "event").where("base_uid <> other_uid").withColumn("near", F.coalesce(F.abs(F.col("base_t") - F.col("other_t")) <= WITHIN_SECONDS, F.lit(False)))

    def decide(base_body, other_body, base_headline, headline, near):
        known, out = {}, []  # copies in a batch are asked once
        for row in zip(base_body, other_body, base_headline, headline, near):
            if row not in known:
                known[row] = shared_root(*row[:4], 0 if row[4] else None)
            out.append(known[row])
        return pd.Series(out, dtype=object)

    told = pairs.withColumn("reason", F.pandas_udf(decide, "string")("base_body", "other_body", "base_headline", "other_headline", "near")).where("reason <> ''")
    return told.select("event", F.col("base_uid").alias("base"), F.col("other_uid").alias("candidate"), "reason")
