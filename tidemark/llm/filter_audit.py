"""Audit of how filters overlap: what each of them removes at each place of every order.

Documents are counted once per combination of part and failed filters. A cube over part and flags then holds, for every set of
filters, the row in which exactly these flags are given and all are false: what survives the set. The step of an order
joins the survivors of the filters before it with those after it.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, col, materialise

#: Tasks that the rows of one text are dealt to when they meet its first document.
SALTS = 32
WORDS = r"[^\x20\x09-\x0D]+"


def text_conditions(text: Column) -> dict[str, Column]:
    """Failure conditions of a whole text, as arguments for ``flagged``: few words, repetitive, many capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, conditions, repeated: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, one boolean per filter): ``conditions(text)`` and, named ``repeated``, whether a smaller id has the same text.

    Null texts are empty, null parts the empty string. A null id is neither smaller than another nor has one smaller; rows of one id
    and text are judged alike. Texts are the same if their SHA-256 is. Texts leave the plan at the scan.
    """
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    own = docs.select(col(id_col).alias("id"), F.coalesce(col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    flags = conditions(F.col("text"))
    cols = ["id", "part", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()]]
    if not repeated:
        return own.select(*cols)
    rows = materialise(own.select(*cols, F.unhex(F.sha2("text", 256)).alias("digest")), "flags")
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("last > first").drop("last")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS).cast("bigint")))
    spread = first.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    return dealt.join(spread, ["digest", "salt"], "left").select("id", "part", *flags, F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias(repeated))


def survivors(flags: DataFrame, filters: list[str], measures: list[str]) -> DataFrame:
    """(part, mask, one sum per measure) of the rows that fail none of the filters in ``mask``, zeros included.

    Bit i of ``mask`` is filter i. ``flags`` has a column ``part`` and a boolean one per filter, none of them null.
    """
    counted = flags.groupBy("part", *filters).agg(*[F.sum(m).alias(m) for m in measures])
    cube = counted.cube("part", *filters).agg(F.grouping("part").alias("any_part"), *[F.grouping(f).alias(f"any_{f}") for f in filters], *[F.sum(m).alias(m) for m in measures])
    mask = sum((F.when(F.col(f"any_{f}") == 0, F.lit(1 << i)).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    passed = [F.col(f"any_{f}").eqNullSafe(1) | (F.col(f) == F.lit(False)) for f in filters]
    chosen = cube.where(F.col("any_part") == 0)
    for p in passed:
        chosen = chosen.where(p)
    found = materialise(chosen.select("part", mask.alias("mask"), *measures), "survivors")
    every = found.where("mask = 0").select("part", F.explode(F.expr(f"sequence(0, {(1 << len(filters)) - 1})")).alias("mask"))
    return every.join(found, ["part", "mask"], "left").fillna(0, measures)


def interactions(flags: DataFrame, filters: list[str], losses: dict[str, str]) -> DataFrame:
    """One row per part, order of all ``filters`` (at most six) and step.

    ``losses`` names columns of ``flags`` with 0 or 1 and the columns that count them among the removed. Columns: part,
    filter_order, step, kept, removed, redundant, unique_fails, the losses, shapley (removed by the step's filter, summed over all
    orders). No rows, no parts.
    """
    k = len(filters)
    if not 1 <= k <= 6:
        raise ValueError("between one and six filters, or the orders are too many")
    spark, whole = flags.sparkSession, (1 << k) - 1
    steps = [
        ("".join(filters[i] for i in order), n + 1, order[n], sum(1 << i for i in order[:n]), sum(1 << i for i in order[: n + 1]))
        for order in permutations(range(k))
        for n in range(k)
    ]
    assert len(steps) <= BROADCAST_ROWS
    plan = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter int, before int, after int"))
    left = survivors(flags.withColumn("n", F.lit(1).cast("bigint")), filters, ["n", *losses])
    held = lambda mask: F.sum(F.when(F.col("mask") == mask, F.col("n")).otherwise(0))
    weight = [factorial(t) * factorial(k - 1 - t) for t in range(k)]
    own = []
    for i in range(k):
        share = sum((F.when(F.col("mask") == m, F.lit(-weight[m.bit_count() - 1] if m >> i & 1 else weight[m.bit_count()])).otherwise(0) for m in range(whole + 1)), F.lit(0))
        own.append(F.struct(F.lit(i).alias("filter"), (held(0) - held(1 << i)).alias("fails"), (held(whole & ~(1 << i)) - held(whole)).alias("unique_fails"), F.sum(share * F.col("n")).alias("shapley")))
    each = left.groupBy("part").agg(F.array(*own).alias("own")).select("part", F.inline("own"))
    before = left.select("part", F.col("mask").alias("before"), *[F.col(m).alias(f"{m}_before") for m in ("n", *losses)])
    after = left.select("part", F.col("mask").alias("after"), *["n", *losses])
    pairs = before.join(plan, "before").join(after, ["part", "after"]).join(each, ["part", "filter"])
    removed = F.col("n_before") - F.col("n")
    return pairs.select(
        "part",
        "filter_order",
        "step",
        F.col("n").alias("kept"),
        removed.alias("removed"),
        (F.col("fails") - removed).alias("redundant"),
        "unique_fails",
        *[(F.col(f"{m}_before") - F.col(m)).alias(name) for m, name in losses.items()],
        "shapley",
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "source") -> DataFrame:
    """``interactions`` of the conditions A to E over whole texts; good and toxic documents are told by ``labels``.

    A document is good (toxic) if any of its labels has quality (toxic) 1; without a label or an id it is neither.
    """
    flags = flagged(docs, text_conditions, "E", id_col, part_col=part_col)
    known = labels.select(col(id_col).alias("id"), "quality", "toxic").where("id IS NOT NULL").groupBy("id")
    known = known.agg(F.max(F.when(F.col("quality") == 1, 1)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1)).alias("bad"))
    told = flags.join(known, "id", "left").fillna(0, ["good", "bad"])
    return interactions(told, list("ABCDE"), {"good": "good_lost", "bad": "toxic_lost"})
