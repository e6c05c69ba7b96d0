import os

import duckdb
import pandas as pd
import pytest

from chronoweave import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    return con


def rows(df):
    def cell(x):
        return "null" if pd.isna(x) else str(round(float(x), 6)) if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "if" else str(x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got, want = catalogue.queries()[name](spark, DIR).toPandas(), duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["apply_states_to_test", "entity_ratio_split"])
def test_split_of_ninety_entities_matches_sql(spark, tmp_path, name):
    """0.7 * 90 is less than 63 as a double; the SQL's decimal is exact."""
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_days(CAST(i % 7 AS INTEGER)) AS ts, i % 90 AS user_id, ['click', 'view'][1 + i % 2] AS event_type, CAST(i * 37 % 101 AS DOUBLE) AS value, '' AS props FROM range(2000) t(i)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got, want = catalogue.queries()[name](spark, str(tmp_path)).toPandas(), con.execute(catalogue.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


def test_applied_states_of_odd_events_match_sql(spark, tmp_path):
    """Null values, null types, types that only test entities have, types without a number, and one without any value in the training part."""
    con = duckdb.connect()
    kind = "CASE WHEN i % 20 >= 16 AND i % 3 = 0 THEN 'signup' WHEN i % 11 = 0 THEN 'other' WHEN i % 13 = 0 THEN NULL WHEN i % 7 = 0 THEN 'error' ELSE ['click', 'view'][1 + i % 2] END"
    value = "CASE WHEN i % 5 = 0 OR i % 7 = 0 AND i % 20 < 14 THEN NULL ELSE CAST(i * 37 % 101 AS DOUBLE) END"
    con.execute(f"CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_days(CAST(i // 20 % 30 AS INTEGER)) AS ts, i % 20 AS user_id, {kind} AS event_type, {value} AS value, '' AS props FROM range(600) t(i)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    sql = catalogue.oracle_sql()["apply_states_to_test"]
    got, want = catalogue.queries()["apply_states_to_test"](spark, str(tmp_path)).toPandas(), con.execute(sql).df()
    assert len(want) and want["state"].isna().any()
    assert rows(got) == rows(want)
