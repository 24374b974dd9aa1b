"""Every registered query with a SQL counterpart, against DuckDB on the smallest given tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from tallyspark import oracle, queries
from tools.check import GIVEN, compare, compare_types

from conftest import SMALL

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in GIVEN:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, db, name):
    frame = QUERIES[name](spark, SMALL)
    rows = [tuple(r) for r in frame.collect()]
    db.sql(f"CREATE OR REPLACE VIEW counterpart AS {ORACLES[name]}")  # some statements are no views
    result = db.sql("SELECT * FROM counterpart")
    kinds = compare_types(frame.dtypes, result)
    assert (compare(frame.columns, rows, result.columns, result.fetchall()) or kinds) == ""


def test_every_counterpart_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    # Fitted numbers; what is fixed about them is checked by model_test_users, score_coverage and
    # snapshot_json_values.
    fitted = {
        "churn_random_forest", "churn_gbt", "train_compare", "feature_importance", "score_users",
        "top_risk_users", "model_roc", "model_confusion", "model_report",
    }
    assert set(queries.QUERIES) - set(oracle.ORACLES) == fitted | {"snapshot_json"}


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert [r["stage_no"] for r in rows] == [1, 2, 3, 4]


def test_matrices_have_every_cell(spark, db):
    months = db.sql(f"WITH {oracle.ORDERS} SELECT count(DISTINCT event_month) FROM ev WHERE event_type = 'purchase'").fetchall()[0][0]
    wide, cells = (QUERIES[name](spark, SMALL) for name in ("segment_matrix", "segment_matrix_all"))
    assert months > 3 and {len(r["cells"].split(",")) for r in wide.collect()} == {months}
    assert cells.count() == months * wide.count()
    last = max(r["month_number"] for r in QUERIES["cohort_matrix"](spark, SMALL).collect())
    wide, cells = (QUERIES[name](spark, SMALL) for name in ("cohort_matrix_wide", "cohort_matrix_all"))
    assert last > 6 and {len(r["cells"].split(",")) for r in wide.collect()} == {last + 1}
    assert cells.count() == (last + 1) * wide.count()
