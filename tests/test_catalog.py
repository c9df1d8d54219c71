"""Every registered query against its SQL on the smallest tables."""

import os

import numpy as np
import pandas as pd
import pytest
from stratalog.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    number = isinstance(v, int | float | np.integer | np.floating) and not isinstance(v, bool)
    return repr(round(float(v), 9)) if number else str(v.item() if hasattr(v, "item") else v)


def table(df, columns):
    return sorted((tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as from '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got, sorted(got.columns)) == table(want, sorted(got.columns))


def test_base_tables_hold_what_queries_need(spark):
    for name in ("scan_rules_and_sweep", "redact_and_sweep", "extract_code_blocks", "code_outline", "profile_summary"):
        assert catalog.queries()[name](spark, SF).columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_over_all_files(spark):
    q = catalog.queries()
    texts = spark.read.parquet(f"{SF}/documents.parquet")
    assert q["gather_receipts"](spark, SF).count() == texts.count()
    assert {r.repo for r in q["snapshot_diff"](spark, SF).select("repo").distinct().collect()} == {"repo0", "repo1", "repo2"}
    assert q["trace_origin"](spark, SF).select("path").distinct().count() > 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_over_whole_texts(spark):
    q = catalog.queries()
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    blocks = q["extract_code_blocks"](spark, SF).select("content").collect()
    assert sum(len(r.content) for r in blocks) >= 0.99 * sum(map(len, texts))
    rows = q["code_outline"](spark, SF).collect()
    assert all(r.parsed for r in rows) and sum(r.kind == "function" for r in rows) == sum(t.count("\n") + 1 for t in texts)
    blamed = q["markers_with_blame"](spark, SF).collect()
    assert len(blamed) == q["markers"](spark, SF).count() and {r.author is None for r in blamed} == {True, False}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_numbering_is_that_of_the_whole_order(spark):
    from pyspark.sql import Window, functions as F
    from stratalog.plans import views

    for name, by in (("commits", ["author_time", "sha"]), ("file_events", ["date", "sha"])):
        v = views.view(spark, SF, name).withColumn("sha", F.col("sha").cast("long"))
        w = Window.partitionBy("repo").orderBy(*[F.desc(c) for c in by])
        assert v.withColumn("want", F.row_number().over(w) - 1).filter("want <> seq").count() == 0
