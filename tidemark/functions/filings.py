"""Structure of a filing's text: its items, exhibit, signature and disclaimer, what it speaks of, and its figures.

Segments are whole: no part is cut at a number of characters or items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns that decide what is counted.
ITEM = r"(?i)\bitem\s+(1\.01|2\.02|2\.03|3\.02|5\.02|7\.01|8\.01|9\.01)\b"
EXHIBIT = r"^\s*EX(?:HIBIT)?[-_ ]?99(?:\.[0-9]+)?\s*$"
SIGNATURE = r"^\s*SIGNATURES?\s*$"
DISCLAIMER = r"(?is)(?:forward[- ]looking statements?|safe harbor).{0,5000}$"
AMOUNT = r"(?i)(?:\$|usd\s*)([0-9]+(?:\.[0-9]+)?)\s*(million|billion|m|bn)?"
OFFER_PRICE = r"(?is)(?:offering|purchase) price.{0,80}?\$\s*([0-9]+(?:\.[0-9]+)?)"
SUBJECTS = r"(?i)\b(?:n\s*=|enroll(?:ed|ment of))\s*([0-9]{1,5})\b"
P_VALUE = r"(?i)\bp\s*[=<]\s*(0?\.[0-9]+)"
HAZARD = r"(?is)hazard ratio.{0,30}?(0?\.[0-9]+)"
TAXONOMY = {
    "fda_approval": r"\bfda\b.{0,60}\bapprov(?:al|ed)\b|\bapproval\b.{0,60}\bfda\b",
    "crl": r"complete response letter|\bcrl\b|refusal to file",
    "clinical_hold_imposed": r"clinical hold.{0,80}(?:impos|placed|initiated)|(?:impos|placed).{0,80}clinical hold",
    "clinical_hold_lifted": r"clinical hold.{0,80}(?:lift|remov)|(?:lift|remov).{0,80}clinical hold",
    "phase_1": r"\bphase\s*(?:1|i)\b",
    "phase_2": r"\bphase\s*(?:2|ii)\b",
    "phase_3": r"\bphase\s*(?:3|iii)\b",
    "endpoint_met": r"(?:met|achieved)\s+(?:the\s+)?(?:primary|secondary)?\s*endpoint",
    "endpoint_missed": r"(?:missed|did not meet|failed to meet)\s+(?:the\s+)?(?:primary|secondary)?\s*endpoint",
    "trial_positive": r"positive (?:topline|top-line|clinical|trial) results?|statistically significant",
    "trial_negative": r"negative (?:topline|top-line|clinical|trial) results?|not statistically significant",
    "public_offering": r"public offering",
    "registered_direct": r"registered direct",
    "atm": r"at-the-market|\batm (?:program|facility|offering)",
    "convertible": r"convertible (?:note|debt|security)",
    "warrant": r"\bwarrants?\b",
    "offering_priced": r"offering.{0,100}\bpriced\b|priced.{0,100}offering",
    "offering_closed": r"offering.{0,100}\bclos(?:e|ed|ing)\b|clos(?:e|ed|ing).{0,100}offering",
    "license": r"licens(?:e|ing|ed) agreement",
    "partnership": r"partnership|collaboration agreement",
    "upfront": r"upfront payment",
    "milestone": r"milestone payment",
    "ma_definitive": r"definitive (?:merger|acquisition) agreement|agreement and plan of merger",
    "ma_terminated": r"terminat(?:e|ed|ion).{0,100}(?:merger|acquisition) agreement",
    "earnings": r"earnings|results of operations|quarterly results",
    "guidance": r"financial guidance|revis(?:e|ed) guidance",
    "management_appointment": r"appoint(?:ed|ment).{0,100}(?:chief|director|officer|president)",
    "management_resignation": r"resign(?:ed|ation).{0,100}(?:chief|director|officer|president)",
    "safety": r"serious adverse event|safety signal",
    "recall": r"product recall|voluntary recall",
    "manufacturing": r"manufacturing (?:issue|deficien|facility)|cGMP deficien",
}
#: Lines end at a line feed alone.
_LINES = "(?imd)"


def _rounded(x: Column) -> Column:
    return F.round(F.coalesce(x, F.lit(0.0)), 6)


def structure(filings: DataFrame, headline: str, body: str, log_price: str) -> DataFrame:
    """``filings`` with the structure of each. Null texts are empty; figures that a text does not hold are 0, the offer's is null.

    ``taxonomy`` lists, in name order, ``name:count:primary:exhibit`` of what occurs: at most ten occurrences are counted, then
    whether the primary part and the exhibit hold it. The primary part runs from the first item on, or is the whole body, up to the exhibit.
    """
    whole = F.coalesce(F.col(body), F.lit(""))
    rows = filings.withColumn("_body", whole).withColumn("_read", F.split(F.regexp_replace(whole, DISCLAIMER, " "), _LINES + SIGNATURE, 2)[0])
    rows = rows.withColumn("_mark", F.regexp_substr("_read", F.lit(_LINES + EXHIBIT))).withColumn("_exhibit", F.coalesce(F.get(F.split("_read", _LINES + EXHIBIT, 2), F.lit(1)), F.lit("")))
    first = F.regexp_substr("_read", F.lit(ITEM))
    spaced = F.expr("substring(_spaced, 2)")
    rows = rows.withColumn("_from", F.when(first.isNotNull(), F.substring(F.col("_read"), F.instr(F.col("_read"), first), F.length("_read"))))
    rows = rows.withColumn("_spaced", F.regexp_replace("_from", ITEM, " $0")).withColumn("_primary", F.coalesce(spaced, F.col("_read")))
    cut = F.greatest(F.instr(F.col("_primary"), F.col("_mark")) - 1, F.lit(0))
    rows = rows.withColumn("_primary", F.when(F.col("_mark").isNull(), F.col("_primary")).otherwise(F.substring(F.col("_primary"), F.lit(1), cut)))
    rows = rows.withColumn("_text", F.concat_ws(" ", F.coalesce(headline, F.lit("")), "_primary", "_exhibit"))
    items = F.array_sort(F.array_distinct(F.regexp_extract_all("_body", F.lit(ITEM), F.lit(1))))
    found = []
    for name, pattern in sorted(TAXONOMY.items()):
        p = "(?is)" + pattern
        n = F.least(F.regexp_count("_text", F.lit(p)), F.lit(10))
        flag = lambda part: F.col(part).rlike(p).cast("int").cast("string")  # noqa: B023, E731
        found.append(F.when(n > 0, F.concat_ws(":", F.lit(name), n.cast("string"), flag("_primary"), flag("_exhibit"))))
    numbers = lambda p: F.filter(F.transform(F.regexp_extract_all("_text", F.lit(p), F.lit(1)), lambda x: x.cast("double")), lambda x: x > 0)
    scale = lambda s: F.when(F.lower(s).isin("million", "m"), 1e6).when(F.lower(s).isin("billion", "bn"), 1e9).otherwise(1.0)
    amounts = F.zip_with(F.regexp_extract_all("_text", F.lit(AMOUNT), F.lit(1)), F.regexp_extract_all("_text", F.lit(AMOUNT), F.lit(2)), lambda x, s: x.cast("double") * scale(s))
    offer = F.regexp_substr("_text", F.lit(OFFER_PRICE)).isNotNull()
    price = F.regexp_extract("_text", OFFER_PRICE, 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("_items") - 1), lambda i: F.concat_ws("|", F.element_at("_items", i), F.element_at("_items", i + 1)))
    rows = rows.withColumn("_items", items)
    out = {
        "items": F.array_join("_items", ","), "item_pairs": F.when(F.size("_items") > 1, F.array_join(pairs, ",")).otherwise(""), "body_present": F.trim("_body") != "", "exhibit_present": F.col("_exhibit") != "",
        "signature_present": F.col("_body").rlike(_LINES + SIGNATURE), "disclaimer_present": F.col("_body").rlike(DISCLAIMER),
        "log_body_len": _rounded(F.log1p(F.length("_body"))), "log_primary_len": _rounded(F.log1p(F.length("_primary"))), "log_exhibit_len": _rounded(F.log1p(F.length("_exhibit"))),
        "taxonomy": F.concat_ws(",", *found), "max_amount_log": _rounded(F.log1p(F.array_max(F.filter(amounts, lambda x: (x > 0) & (x < 1e13))))),
        "offer_vs_entry": F.when(offer, F.round(F.least(F.greatest(price.try_cast("double") / F.exp(log_price) - 1, F.lit(-2.0)), F.lit(2.0)), 6)),
        "max_subjects_log": _rounded(F.log1p(F.array_max(numbers(SUBJECTS)))), "least_p_neglog": _rounded(-F.log10(F.array_min(numbers(P_VALUE)))), "hazard_ratio_log": _rounded(F.log(F.get(numbers(HAZARD), F.lit(0)))),
    }
    return rows.select(*filings.columns, *[c.alias(n) for n, c in out.items()])
