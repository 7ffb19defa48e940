"""URL filtering: host and path rules, and gradient-boosted trees on lexical features for the rest.

DataFrame operations only. The URLs a rule decides are the labelled ones. The trees see length, depth,
digit share, character entropy, parameter and hyphen counts, and the block rate and frequency of the
host's suffix among the labelled URLs. Features are coarse, so the labelled rows are counted per
distinct feature vector before the fit and every one of them takes part, both verdicts with the same total weight. Suffix statistics are kept per
hashed suffix; that table has ``SUFFIX_BUCKETS`` rows at any size of input and may be broadcast.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import col, materialise

SUFFIX_BUCKETS = 1024
FEATURES = ["n_length", "n_depth", "digit_share", "entropy", "n_params", "n_hyphens", "n_labels", "suffix_rate", "suffix_log"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next of ``/ ? #``, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def match_rules(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict``: of the rules (verdict, host/path) that fit, the longest; ties by text.

    A rule fits its host and every subdomain where the path starts with the rule's.
    """
    out: Column = F.lit(None).cast("string")
    verdict: Column = F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is tested first
        host, _, rest = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit("/" + rest))
        out, verdict = F.when(fits, F.lit(rule)).otherwise(out), F.when(fits, F.lit(kind)).otherwise(verdict)
    return df.withColumn("rule", out).withColumn("rule_verdict", verdict)


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds the lexical features of ``url`` and ``bucket``, the hashed last two labels of the host."""
    text = F.coalesce(F.col(url), F.lit(""))
    n = F.length(text)
    df = df.withColumn("_u", text).withColumn("_n", F.greatest(n, F.lit(1)))
    counts = F.expr("transform(array_distinct(split(_u, '')), c -> (length(_u) - length(replace(_u, c, ''))) / CAST(_n AS DOUBLE))")
    entropy = F.aggregate(counts, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log(p)).otherwise(0.0))
    count = lambda chars: n - F.length(F.translate("_u", chars, ""))
    return df.select(
        "*",
        F.least(F.floor(n / 4), F.lit(255)).cast("double").alias("n_length"),
        F.least(F.length("path") - F.length(F.translate("path", "/", "")), F.lit(31)).cast("double").alias("n_depth"),
        F.round(count("0123456789") / F.col("_n"), 2).alias("digit_share"),
        F.round(entropy, 1).alias("entropy"),
        F.least(count("=&"), F.lit(31)).cast("double").alias("n_params"),
        F.least(count("-_"), F.lit(31)).cast("double").alias("n_hyphens"),
        F.least(F.length("host") - F.length(F.translate("host", ".", "")), F.lit(15)).cast("double").alias("n_labels"),
        F.pmod(F.xxhash64(F.substring_index("host", ".", -2)), F.lit(SUFFIX_BUCKETS)).alias("bucket"),
    ).drop("_u", "_n")


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", trees: int = 10, depth: int = 3) -> DataFrame:
    """All columns of ``pages`` with host, path, rule, score (block probability) and verdict.

    Where the labelled URLs show one verdict only, or there are none, that verdict (or allow) is every
    page's. Null and malformed URLs have empty host and path and are judged by the trees. Repeated rows
    are judged alike; columns of the input that clash with a result's name are replaced. Very long URLs are read
    whole; an empty table gives an empty one.

    Both verdicts weigh the same in the fit, whatever their numbers among the labelled URLs, so that a score of one
    half means that the features speak for neither.
    """
    taken = {"host", "path", "rule", "rule_verdict", "bucket", "score", "verdict", *FEATURES}
    own = [c for c in pages.columns if c not in taken]
    parts = pages.select(*map(col, own)).withColumn("host", host_of(col(url))).withColumn("path", path_of(col(url)))
    marked = lexical(match_rules(parts, rules), url)
    labelled = marked.where("rule_verdict is not null").withColumn("label", (F.col("rule_verdict") == "block").cast("double"))
    by_vector = materialise(labelled.groupBy(*FEATURES[:7], "bucket", "label").agg(F.count("*").cast("double").alias("n")), "labelled_urls")
    totals = {r["label"]: r["n"] for r in by_vector.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if len(totals) < 2:
        only = "block" if totals and next(iter(totals)) == 1.0 else "allow"
        scored = marked.withColumn("score", F.lit(1.0 if only == "block" else 0.0))
    else:
        # A verdict's URLs have one half of the weight together.
        half = (totals[0.0] + totals[1.0]) / 2
        each = F.when(F.col("label") == 1.0, half / totals[1.0]).otherwise(half / totals[0.0])
        by_vector = by_vector.withColumn("weight", F.col("n") * each)
        suffixes = by_vector.groupBy("bucket").agg(
            F.round((F.sum(F.col("weight") * F.col("label")) + 20 * 0.5) / (F.sum("weight") + 20), 2).alias("suffix_rate"),
            F.round(F.log1p(F.sum("n")), 1).alias("suffix_log"),
        )

        def with_suffix(df):
            return df.join(F.broadcast(suffixes), "bucket", "left").fillna({"suffix_rate": 0.5, "suffix_log": 0.0})

        assemble = VectorAssembler(inputCols=FEATURES, outputCol="_features")
        booster = GBTClassifier(featuresCol="_features", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=17)
        model = booster.fit(assemble.transform(with_suffix(by_vector)))
        model = model.setRawPredictionCol("").setPredictionCol("").setProbabilityCol("_probability")
        scored = model.transform(assemble.transform(with_suffix(marked))).withColumn("score", vector_to_array("_probability")[1])
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.withColumn("verdict", verdict).select(*map(col, own), "host", "path", "rule", "score", "verdict")
