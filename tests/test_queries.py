"""Registered queries against their SQL twins on the smallest data set."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
CHECKED = ("simple_moving_averages", "macd_lines", "technical_factor", "fundamental_factor_scores", "insider_scores", "stability_ranking",
           "technical_scorecard", "portfolio_grid", "flow_alert_report", "regime_names", "covariance_matrices", "tail_risk_report",
           "ledger_positions_in_blocks", "daily_portfolio_value", "combined_views", "historical_batch_scores")


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("driver tables are not here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(rows):
    def key(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.5f}"
        return str(v)
    return sorted(tuple(key(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = canon([tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()])
    assert canon([tuple(r) for r in df.select(*cols).collect()]) == want


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
