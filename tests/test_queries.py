"""Every core query against its SQL on DuckDB."""

from numbers import Number

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.plans import catalog
from tidemark.plans.dialect import TABLES


def _plain(frame):
    def text(v):
        if pd.isna(v):
            return "None"
        return f"{float(v):.6f}" if isinstance(v, Number) and not isinstance(v, (bool, np.bool_)) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(text(v) for v in row) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, sf_dir, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _plain(ours) == _plain(theirs)


def test_status_ladder_has_the_surveys_five_statuses(spark):
    """SURVEY 7.4's own counts at sf0.01 and 300 s."""
    got = catalog.QUERIES["asof_status_ladder"](spark, "/root/testdata/sf0.01").groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in got} == {"OK": 714, "ENTRY_TIMING_MISS": 786, "EXIT_TIMING_MISS": 497, "CROSSES_SESSION": 16, "BAR_MISSING": 1}


def test_char5_containment_reports_short_items(spark, tmp_path):
    spark.createDataFrame([(1, "so a short item, here"), (2, "other")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", "A short item"), ("b", "so"), ("c", "nothing alike")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = catalog.QUERIES["doc_char5_containment_benchmark"](spark, str(tmp_path)).collect()
    assert [(r["doc_id"], r["item_id"], r["shared"], r["containment"]) for r in got] == [(1, "a", 6, 1.0)]
