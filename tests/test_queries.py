"""A few registered queries against their SQL; tools/check_oracle.py runs all of them."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
import check_oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in check_oracle.TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["recon_mixed_modes", "crosswalk_triage", "template_projection", "annot_quantities", "alias_upsert"])
def test_same_rows_as_sql(spark, con, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    res = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(columns)
    assert check_oracle.bag(df.columns, df.collect()) == check_oracle.bag(columns, res.fetchall())


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_lines_are_not_shuffled_by_their_project(spark, sf_dir):
    import re

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as over tables whose sizes are estimated too large
    try:
        plan = entry.queries()["prior_unnamed_in_place"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "__first" in plan and not re.search(r"SortMergeJoin \[project_id#\d+\], \[project_id#\d+\]", plan)
