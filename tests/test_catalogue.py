"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from evidra.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    out = [tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for r in frame.itertuples(index=False)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE) - {"law_search", "law_search_hybrid"}))
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_plans_stay_in_the_jvm(spark):
    for name in ("bm25_topk", "text_quality", "word_windows", "dense_topk_batch", "eval_metrics"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name


def test_scans_are_pruned(spark):
    plan = catalogue.QUERIES["filter_isin_combo"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "In(lang" in plan and "doc_id" not in plan.split("ReadSchema")[-1]
