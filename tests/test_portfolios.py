"""Allocation, backtests and selection: independent small cases and invariants."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorspark.operators import allocation as al
from factorspark.operators import backtest as bt
from factorspark.operators import regimes as rg
from factorspark.operators import selection as sel
from factorspark.operators.cleaning import fill_forward


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(11)
    n, names = 420, ["A", "B", "C", "D"]
    r = rng.normal(0, [0.01, 0.02, 0.03, 0.01], (n, 4))
    r[:, 3] += 0.8 * r[:, 0]
    px = 100 * np.exp(np.cumsum(r, axis=0))
    rows = [("p", 60, dt.date(2023, 1, 2) + dt.timedelta(days=i), i, s, float(px[i, k])) for i in range(n) for k, s in enumerate(names)]
    return spark.createDataFrame(rows, "portfolio string, lookback int, d date, i int, symbol string, px double").persist(), px


def test_two_assets_hrp_is_inverse_variance():
    rng = np.random.default_rng(1)
    x = rng.normal(0, [0.01, 0.03], (500, 2))
    cov = al.shrunk_cov(x)
    w = al.solve_weights(x, "hrp")
    inv = 1 / np.diag(cov)
    np.testing.assert_allclose(w, inv / inv.sum(), rtol=1e-9)


def test_ward_merges_closest_pair_first():
    c = np.eye(4)
    c[0, 3] = c[3, 0] = 0.9
    c[1, 2] = c[2, 1] = 0.5
    assert al.ward_tree(c) == [(0, 3), (1, 2), (4, 5)]
    assert al.leaf_order(al.ward_tree(c)) == [0, 3, 1, 2]


@pytest.mark.parametrize("method", ["hrp", "mhrp", "mhrp_vol", "nco"])
def test_weights_sum_to_one_and_skip_constants(method):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.02, (120, 6))
    x[:, 2] = 0.0
    w = al.solve_weights(x, method)
    assert w.sum() == pytest.approx(1) and (w >= -1e-12).all() and w[2] == 0


def test_min_variance_beats_random_long_only():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(200, 5))
    cov = np.cov(a, rowvar=False)
    w = al.long_only_min_variance(cov)
    assert all(w @ cov @ w <= v @ cov @ v + 1e-9 for v in rng.dirichlet(np.ones(5), 200))


def test_distributed_weights_equal_direct_solve(market):
    panel, px = market
    got = al.weights_at(panel, al.trailing_solves(panel, F.col("i") % 50 == 0)).orderBy("d", "symbol").toPandas()
    for i in range(50, 420, 50):
        win = px[max(i - 60, 0):i]
        want = al.solve_weights(win[1:] / win[:-1] - 1, "mhrp")
        have = got[got["d"] == dt.date(2023, 1, 2) + dt.timedelta(days=i)]["w"].to_numpy()
        np.testing.assert_allclose(have, want, rtol=1e-9)


def test_backtest_equals_plain_loop(market):
    panel, px = market
    w = bt.drift_weights(panel, 100)
    got = bt.backtest(panel, w, 100, fee=0.001).orderBy("i").toPandas()
    ret = px[1:] / px[:-1] - 1
    cur = al.solve_weights(px[1:60] / px[:59] - 1, "mhrp")
    want = [0.0]
    for i in range(101, 420):
        k, fee = i - 100, 0.0
        if k % 21 == 0 and k > 21:
            win = px[i - 60:i]
            new = al.solve_weights(win[1:] / win[:-1] - 1, "mhrp")
            if np.abs(new - cur).max() > 0.05:
                # weights set on a day earn that day's return
                cur, fee = new, 0.001
        want.append(cur @ ret[i - 1] - fee)
    np.testing.assert_allclose(got["ret"], want, atol=1e-12)
    np.testing.assert_allclose(got["value"], np.cumprod(1 + np.array(want)), rtol=1e-9)


def test_average_correlation_across_blocks(market):
    panel, px = market
    r = bt.asset_returns(panel).where("i > 0").select("portfolio", "d", "symbol", "ret")
    got = al.average_correlation(r).orderBy("d").toPandas()
    ret = px[1:] / px[:-1] - 1
    want = []
    for e in range(60, 420):
        c = np.corrcoef(ret[e - 60:e], rowvar=False)
        want.append(c[np.triu_indices(4, 1)].mean())
    np.testing.assert_allclose(got["avg_corr"], want, rtol=1e-9)


@pytest.mark.parametrize("names,n", [(1, 40), (4, 600)])
def test_covariance_in_blocks_equals_numpy(spark, days, names, n):
    """Several blocks of dates, tied and constant columns, and a portfolio of one name."""
    rnd = np.random.default_rng(3)
    x = np.round(rnd.normal(0, 0.02, (n, names)), 3)
    if names > 1:
        x[:, 1] = 0.01
    df = spark.createDataFrame([("P", days(i), f"S{k}", float(x[i, k])) for i in range(n) for k in range(names)],
                               "portfolio string, d date, symbol string, ret double")
    got = {(r["a"], r["b"]): r for r in al.covariance_long(df).collect()}
    assert len(got) == names * (names + 1) // 2
    cov, sh = np.atleast_2d(np.cov(x, rowvar=False)), al.shrunk_cov(x)
    pear, spear = al.correlation(x, False), al.correlation(x, True)
    for i in range(names):
        for j in range(i, names):
            r = got[f"S{i}", f"S{j}"]
            np.testing.assert_allclose([r["cov"], r["shrunk"], r["corr"], r["spearman"]],
                                       [cov[i, j], sh[i, j], pear[i, j], spear[i, j]], rtol=1e-7, atol=1e-9)


def test_regime_dates_are_those_of_the_portfolio(spark, days):
    """One short and one long series share the dates of the regime; a portfolio with too few keeps all rows."""
    rows = [("P", "A", days(i), 0.1) for i in range(100)] + [("P", "B", days(i), 0.1) for i in range(50)] + [("Q", "A", days(i), 0.1) for i in range(30, 100)]
    df = spark.createDataFrame(rows, "portfolio string, symbol string, d date, ret double")
    p = spark.createDataFrame([("Bear", days(0), days(69), 1)], "regime_name string, start_date date, end_date date, period_seq int")
    got = rg.restrict_to_regime(df, p, "Bear").groupBy("portfolio", "symbol").count().collect()
    assert {(r["portfolio"], r["symbol"]): r["count"] for r in got} == {("P", "A"): 70, ("P", "B"): 50, ("Q", "A"): 70}


def test_greedy_walk(spark):
    rnd = np.random.default_rng(8)
    rows = [("k", i + 1, f"S{i:03d}", f"sec{rnd.integers(5)}") for i in range(80)]
    got = [r["symbol"] for r in sel.capped_greedy(spark.createDataFrame(rows, "k string, rank int, symbol string, sector string"),
                                                  ["k"], "sector", 3, 12).orderBy("pick").collect()]
    want, used = [], {}
    for _, _, s, g in rows:
        if len(want) < 12 and used.get(g, 0) < 3:
            want.append(s)
            used[g] = used.get(g, 0) + 1
    assert got == want


def test_range_ranks_equal_window_ranks(spark):
    rows = [("hot" if i % 4 else f"k{i % 8}", f"S{i:04d}", float((i * 37) % 11)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, symbol string, score double")
    a = {(r["k"], r["symbol"]): r["rank"] for r in sel.full_rank(df, ["k"], "score", ranges=1).collect()}
    b = {(r["k"], r["symbol"]): r["rank"] for r in sel.full_rank(df, ["k"], "score", ranges=8).collect()}
    assert a == b


def test_fill_forward_limit(spark, days):
    rows = [("A", days(0), 1.0), ("A", days(4), 2.0)] + [("B", days(i), 9.0) for i in range(7)]
    out = fill_forward(spark.createDataFrame(rows, "symbol string, d date, close double"))
    got = [(r["d"], r["close"]) for r in out.where("symbol = 'A'").orderBy("d").collect()]
    assert got == [(days(0), 1.0), (days(1), 1.0), (days(2), 1.0), (days(4), 2.0), (days(5), 2.0), (days(6), 2.0)]


def test_monthly_and_volatility_weights(market):
    panel, px = market
    monthly = bt.monthly_weights(panel, 100).select("d").distinct().toPandas()["d"].tolist()
    want = []
    for i in range(100, 420):
        d = dt.date(2023, 1, 2) + dt.timedelta(days=i)
        nxt = d + dt.timedelta(days=1)
        while nxt.month == d.month and nxt.weekday() > 4:
            nxt += dt.timedelta(days=1)
        if d.weekday() < 5 and nxt.month != d.month:
            want.append(d)
    assert sorted(monthly) == want
    r = (px[101:] / px[100:-1] - 1).mean(axis=1)
    vol = [None if j < 20 else r[j - 20:j + 1].std(ddof=1) for j in range(len(r))]
    hits = [101 + j for j in range(22, len(r)) if abs(vol[j] - vol[j - 1]) / vol[j - 1] > 0.03]
    got = bt.volatility_weights(panel, 100, threshold=0.03).select("d").distinct().toPandas()["d"].tolist()
    assert sorted(got) == [dt.date(2023, 1, 2) + dt.timedelta(days=i) for i in [100, *hits]]


def test_walk_forward_folds(market):
    panel, px = market
    got = bt.walk_forward(panel, 100).toPandas()
    ret = px[1:] / px[:-1] - 1
    for f in (100, 190, 280):
        w = al.solve_weights(ret[f - 60:f - 1], "mhrp")
        rows = got[got["fold"] == dt.date(2023, 1, 2) + dt.timedelta(days=f)].sort_values("d")
        np.testing.assert_allclose(rows[rows["sample"] == "in"]["ret"], ret[f - 60:f - 1] @ w, atol=1e-12)
        np.testing.assert_allclose(rows[rows["sample"] == "out"]["ret"], ret[f:f + 89] @ w, atol=1e-12)


def test_posterior_covariance_is_the_closed_form():
    rng = np.random.default_rng(6)
    cov = np.cov(rng.normal(size=(100, 4)), rowvar=False)
    viewed, tau = [1, 3], 0.05
    p = np.eye(4)[viewed]
    omega = np.diag(np.diag(p @ (tau * cov) @ p.T))
    want = cov + np.linalg.inv(np.linalg.inv(tau * cov) + p.T @ np.linalg.inv(omega) @ p)
    np.testing.assert_allclose(al.posterior_cov(cov, viewed, tau), want, rtol=1e-9)


def test_spectrum_sums_to_the_number_of_names(market):
    panel, _ = market
    r = bt.asset_returns(panel).where("i > 0").select("portfolio", "d", "symbol", "ret")
    out = al.correlation_spectrum(r).toPandas()
    assert out["eigenvalue"].sum() == pytest.approx(4) and out["explained"].sum() == pytest.approx(1)
    assert (out.sort_values("component")["eigenvalue"].diff().dropna() <= 0).all()
