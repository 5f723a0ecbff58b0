"""Forward filter by blocks, mixtures and classifiers on planted data, the spectrum of a wide universe, factor regressions."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorspark.functions.windows import decayed_mean
from factorspark.operators import allocation as al
from factorspark.operators import grid_backtest as gb
from factorspark.operators import regimes as rg
from factorspark.operators import reversion as rv
from factorspark.operators import risk as rk

DAY = dt.date(2020, 1, 1)


def fold(p, a):
    k = len(a)
    q = p[0] / p[0].sum() if p[0].sum() > 0 else np.full(k, 1 / k)
    out = [q]
    for day in p[1:]:
        q = (q @ a) * day
        q = q / q.sum() if q.sum() > 0 else np.full(k, 1 / k)
        out.append(q)
    return np.array(out)


def sparse_days(rng, n, zeros):
    """Days and transitions with many zeros, so that the filter runs dry on some days and for some states only."""
    p = rng.random((n, 3)) * (rng.random((n, 3)) > zeros)
    a = rng.random((3, 3)) * (rng.random((3, 3)) > zeros / 2) + np.eye(3) * 0.05
    return p, a / a.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("seed", range(8))
def test_filter_maps_equal_walks(seed):
    rng = np.random.default_rng(seed)
    p, a = sparse_days(rng, 60, 0.15 * (seed % 5))
    m = rg.FilterMap.of(p, a)
    for start in (*np.eye(3), np.array([0.5, 0.5, 0]), np.array([0, 0.2, 0.8]), np.full(3, 1 / 3)):
        np.testing.assert_allclose(m(start), rg.filter_walk(start, p, a)[-1], rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_filter_over_blocks_equals_the_fold(spark, block):
    rng = np.random.default_rng(3)
    rows, matrices, want = [], [], {}
    for s, n, zeros in (("A", 45, 0.0), ("B", 30, 0.4), ("C", 1, 0.0)):
        p, a = sparse_days(rng, n, zeros)
        rows += [(s, DAY + dt.timedelta(days=t), *map(float, x)) for t, x in enumerate(p)]
        matrices.append((s, *map(float, a.ravel())))
        want[s] = fold(p, a)
    probs = spark.createDataFrame([*rows, ("none", DAY, 0.1, 0.2, 0.7)], "symbol string, d date, p_0 double, p_1 double, p_2 double")
    matrix = spark.createDataFrame(matrices, "symbol string, " + ", ".join(f"a_{i}{j} double" for i in range(3) for j in range(3)))
    got = rg.filter_labels(probs, matrix, block=block).toPandas().sort_values(["symbol", "d"])
    assert set(got["symbol"]) == set(want)
    for s, part in got.groupby("symbol"):
        q = part[["q_0", "q_1", "q_2"]].to_numpy()
        np.testing.assert_allclose(q, want[s], rtol=1e-9, atol=1e-12)
        assert (part["regime"].to_numpy() == q.argmax(axis=1)).all()


def test_mixture_finds_planted_states_and_survives_saving(spark, tmp_path):
    rng = np.random.default_rng(5)
    state = rng.integers(0, 3, 600)
    x = np.array([[-4.0, 0.0], [0.0, 4.0], [4.0, -4.0]])[state] + rng.normal(0, 0.5, (600, 2))
    f = spark.createDataFrame([("A", DAY + dt.timedelta(days=int(t)), float(u), float(v)) for t, (u, v) in enumerate(x)], "symbol string, d date, u double, v double")
    model = rg.fit_mixture(f, ["u", "v"], seeds=(1, 2))
    got = rg.label_days(model, f).orderBy("d").toPandas()
    pairs = pd.crosstab(got["regime"], state)
    assert (pairs.max(axis=1) / pairs.sum(axis=1)).min() > 0.98 and len(pairs) == 3
    rg.save_model(model, str(tmp_path / "m"))
    again = rg.label_days(rg.load_model(str(tmp_path / "m")), f).orderBy("d").toPandas()
    pd.testing.assert_frame_equal(got, again)


def test_classifier_learns_a_planted_rule(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(900):
        x = rng.normal(size=len(rv.FEATURES))
        rows.append((f"S{k % 9}", DAY + dt.timedelta(days=k // 9), *map(float, x), int(x[0] + 0.5 * x[3] > 0)))
    data = spark.createDataFrame(rows, "symbol string, d date, " + ", ".join(f"{c} double" for c in rv.FEATURES) + ", reverted int")
    model, accuracy = rv.fit_reversion(data, trees=10, folds=2)
    assert accuracy > 0.85
    weights = rv.feature_importances(model)
    assert max(weights, key=weights.get) == rv.FEATURES[0]


def test_training_table_has_partitions_by_its_rows(spark):
    rows = spark.range(0, 1000, 1, 16).select(F.format_string("S%d", F.col("id") % 7).alias("symbol"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("d"), "id")
    few, more = rv.by_size(rows), rv.by_size(rows, rows_each=300)
    assert few.rdd.getNumPartitions() == 1 and more.rdd.getNumPartitions() == 4
    assert sorted(r.id for r in few.collect()) == sorted(r.id for r in more.collect()) == list(range(1000))


def returns_frame(spark, x, names):
    t, n = x.shape
    pdf = pd.DataFrame({"portfolio": "p", "d": np.repeat([DAY + dt.timedelta(days=k) for k in range(t)], n), "symbol": np.tile(names, t), "ret": x.ravel()})
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("n,tile", [(2000, 512), (12, 5)])
def test_spectrum_equals_numpy(spark, n, tile):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(70, n)) + rng.normal(size=(70, 3)) @ rng.normal(size=(3, n))
    x[:, 4] = 0.01                                  # a constant name
    got = al.correlation_spectrum(returns_frame(spark, x, [f"N{k:04d}" for k in range(n)]), 60, tile).orderBy("component").toPandas()
    last = np.delete(x[-60:], 4, axis=1)
    z = (last - last.mean(axis=0)) / last.std(axis=0) / np.sqrt(60)
    want = np.sort(np.concatenate([np.linalg.svd(z, compute_uv=False) ** 2, [1.0]]))[::-1]
    assert len(got) == n and got["eigenvalue"].sum() == pytest.approx(n)
    np.testing.assert_allclose(got["eigenvalue"][:10], want[:10], rtol=1e-6)
    if n == 12:
        np.testing.assert_allclose(got["eigenvalue"], np.sort(np.linalg.eigvalsh(al.correlation(x[-60:], False)))[::-1], atol=1e-9)


def test_attribution_equals_least_squares(spark):
    rng = np.random.default_rng(9)
    f = rng.normal(0, 0.01, (300, 4))
    f[:, 3] = f[:, 0] - 2 * f[:, 1]                 # adds nothing to the earlier ones
    ys = {"a": f @ [0.5, -0.2, 0.1, 0] + 0.001 + rng.normal(0, 0.002, 300), "b": rng.normal(0, 0.01, 300), "few": None}
    days = [DAY + dt.timedelta(days=k) for k in range(300)]
    series = spark.createDataFrame([(p, d, float(v)) for p, y in ys.items() if y is not None for d, v in zip(days, y)] + [("few", DAY - dt.timedelta(days=9), 1.0)],
                                   "portfolio string, d date, ret double")
    wide = spark.createDataFrame([(d, *map(float, x)) for d, x in zip(days, f)] + [(DAY - dt.timedelta(days=1), None, 1.0, 1.0, 1.0)], "d date, x0 double, x1 double, x2 double, x3 double")
    got = rk.factor_attribution(series, wide, ["x0", "x1", "x2", "x3"], ["portfolio"]).toPandas()
    assert set(got["portfolio"]) == {"a", "b"}
    for p, part in got.groupby("portfolio"):
        part = part.set_index("factor")
        design = np.column_stack([np.ones(300), f[:, :3]])
        b = np.linalg.lstsq(design, ys[p], rcond=None)[0]
        np.testing.assert_allclose(part["exposure"].loc[["x0", "x1", "x2"]], b[1:], rtol=1e-6, atol=1e-9)
        assert part["exposure"]["x3"] == 0
        assert part["alpha"].iloc[0] == pytest.approx(b[0] * 252)
        assert part["r2"].iloc[0] == pytest.approx(1 - ((ys[p] - design @ b) ** 2).sum() / ((ys[p] - ys[p].mean()) ** 2).sum())


def test_decayed_mean_equals_pandas(spark):
    rng = np.random.default_rng(10)
    x = np.where(rng.random(700) < 0.3, np.nan, rng.normal(size=700))
    x[100:420] = np.nan                              # more sessions without a value than a block holds
    x[0] = np.nan
    rows = [("A", int(t), None if np.isnan(v) else float(v)) for t, v in enumerate(x)] + [("B", 5, None)]
    df = spark.createDataFrame(rows, "symbol string, no int, x double")
    for span in (3, 20):
        got = decayed_mean(df, "x", "no", 2 / (span + 1), "m").orderBy("symbol", "no").toPandas()
        want = pd.Series(x).ewm(span=span).mean()
        np.testing.assert_allclose(got["m"][:700].to_numpy(float), want, rtol=1e-12)
        assert np.isnan(got["m"].iloc[700])


def brute_grid(prices, names, start, every, lookback, threshold=0.05, fee=0.001):
    """One basket at a time with the plain solver."""
    px = prices[names].to_numpy()
    ret = np.vstack([np.zeros(len(names)), px[1:] / px[:-1] - 1])
    current, out = np.full(len(names), 1 / len(names)), []
    first = True
    for t in range(start, len(px)):
        new = None
        if t == start or (t >= start + 2 * every and (t - start) % every == 0):
            w = al.solve_weights(ret[t - lookback + 1:t], "mhrp")
            if first or np.abs(w - current).max() > threshold:
                new, first = w, False
        if new is not None:
            current = new
        out.append(0.0 if t == start else float(current @ ret[t]) - (fee if new is not None else 0))
    return np.array(out)


def test_grid_backtest_equals_baskets_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(gb, "PART", 2)
    rng = np.random.default_rng(11)
    names = [f"N{k}" for k in range(10)]
    px = pd.DataFrame(100 * np.exp(np.cumsum(rng.normal(0, 0.02, (260, 10)) * rng.uniform(0.5, 3, 10) * np.where(np.arange(260) % 90 < 45, 1, 2)[:, None], axis=0)), columns=names)
    closes = spark.createDataFrame([(s, DAY + dt.timedelta(days=t), float(px[s][t])) for t in range(260) for s in names], "symbol string, d date, close double")
    baskets = {"one": names[:5], "same": names[:5], "two": names[3:9], "three": names[::2], "pair": names[8:]}
    members = spark.createDataFrame([(p, s) for p, listed in baskets.items() for s in listed], "portfolio string, symbol string")
    plan = gb.Schedule(start=100, every=10, lookbacks=(40, 80), chunk=50)
    daily, portfolios = gb.grid_backtest(closes, members, ["portfolio"], plan, width=4)
    ids = {r["portfolio"]: r["basket"] for r in portfolios.collect()}
    assert ids["one"] == ids["same"] and len(set(ids.values())) == 4
    got = daily.toPandas()
    for p, listed in baskets.items():
        for n in plan.lookbacks:
            mine = got[(got["basket"] == ids[p]) & (got["lookback"] == n)].sort_values("i")
            np.testing.assert_allclose(mine["ret"], brute_grid(px, sorted(listed), 100, 10, n), atol=1e-10)
            assert mine["rebalanced"].sum() >= 1
