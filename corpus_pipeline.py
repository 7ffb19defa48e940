"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, repeats, simhash, toxicity
from tidemark.llm.common import is_integral, materialise, read_table
from tidemark.llm.queries import packed

#: SQL can express neither the classifier nor the tokenizer; tests compare the stages with plain versions.
ORACLE_SQL = None
#: Documents in a batch that goes to Python at the packing stage.
BATCH_ROWS = 1024


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.clean_rows(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of least id stays."""
    return simhash.representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also start earlier are cut out of the texts; every document stays."""
    return repeats.kept_text(repeats.remove_repeats(docs), docs.columns, chars_col="n_chars" if "n_chars" in docs.columns and is_integral(docs, "n_chars") else None)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    return decontaminate.clean_rows(docs, read_table(spark, sf_dir, "benchmark"))


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Rows go to Python in batches of at most ``rows``; afterwards the session's setting is what it was."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows if int(before) <= 0 else min(rows, int(before)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, 64 pieces and 3840 loss-bearing tokens; of a text the first line is the prompt.

    The executors' heaps have grown by now. Batches of 10,000 whole documents would need some 100 MB a task outside them.
    """
    with small_batches(spark):
        return materialise(packed(docs), "packed")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
