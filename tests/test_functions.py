"""Column builders and windows against values worked out by hand or in plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorspark.functions import exprs as ex
from factorspark.functions import scores as sc
from factorspark.functions.regime_tables import with_thresholds
from factorspark.functions.windows import by_symbol, ema, sma, span_alpha
from factorspark.operators import indicators as ind


def one(spark, values, col, schema="x double"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(col).collect()]


def test_clip_keeps_null(spark):
    assert one(spark, [None, -1.0, 0.5, 9.0], ex.clip(F.col("x"), 0, 1)) == [None, 0.0, 0.5, 1.0]


def test_ramp_directions_and_missing(spark):
    up = ex.ramp(F.col("x"), 0.2, 0.6, True)       # 0 at 0.1, 1 at 0.6
    assert one(spark, [0.05, 0.35, 0.7, None, float("nan"), float("inf")], up) == [0.0, pytest.approx(0.5), 1.0, None, None, None]
    down = ex.ramp(F.col("x"), 20, 10, False)      # 0 at 30, 1 at 10
    assert one(spark, [35.0, 20.0, 5.0], down) == [0.0, pytest.approx(0.5), 1.0]
    assert one(spark, [1.0], ex.ramp(F.col("x"), F.lit(None).cast("double"), 1.0, True)) == [None]


@pytest.mark.parametrize("x,want", [(-0.6, 0.1), (-0.5, 0.1), (-0.2, 0.3), (0.0, 0.5), (0.15, 0.6), (0.3, 0.7), (1.0, 0.9),
                                    (1.5, 0.95), (2.0, 1.0), (3.0, 1.0), (None, 0.5)])
def test_price_momentum_curve(spark, x, want):
    assert one(spark, [x], sc.price_momentum_score(F.col("x")))[0] == pytest.approx(want)


def test_weighted_mean_renormalises(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 0.0), (None, None)], "a double, b double")
    out = [r[0] for r in ex.add_weighted_means(df, {"m": [(F.col("a"), 0.25), (F.col("b"), 0.75)]}).select("m").collect()]
    assert out == [1.0, 0.25, 0.0]


def test_unknown_regime_uses_default(spark):
    df = spark.createDataFrame([("Odd",), (None,), ("Crisis_Bear",)], "regime string")
    out = sorted((r["regime"] or "", r["t_pe"]) for r in with_thresholds(df).collect())
    assert out == [("", 22.0), ("Crisis_Bear", 15.0), ("Odd", 22.0)]


def series(spark, days, values, symbol="A"):
    return spark.createDataFrame([(symbol, days(i), v) for i, v in enumerate(values)], "symbol string, d date, close double")


def test_sma_needs_a_full_window(spark, days):
    df = series(spark, days, [1.0, 2.0, 3.0, 4.0])
    out = [r[0] for r in df.select("d", sma(F.col("close"), 3, by_symbol()).alias("m")).orderBy("d").select("m").collect()]
    assert out == [None, None, 2.0, 3.0]


@pytest.mark.parametrize("n", [1, 5, 700, 2000])
def test_ema_equals_the_recursion(spark, days, n):
    rng = np.random.default_rng(n)
    x = rng.normal(50, 20, n)
    spans = {"fast": 3, "slow": 26}
    got = ema(series(spark, days, x.tolist()), {k: ("close", span_alpha(v)) for k, v in spans.items()}).orderBy("d").toPandas()
    for name, span in spans.items():
        a, want = span_alpha(span), [x[0]]
        for v in x[1:]:
            want.append(a * v + (1 - a) * want[-1])
        np.testing.assert_allclose(got[name], want, rtol=1e-11)


def test_ema_with_very_different_alphas(spark, days):
    x = np.linspace(1, 9, 1500)
    got = ema(series(spark, days, x.tolist()), {"quick": ("close", 0.95), "slow": ("close", 0.01)}).orderBy("d").toPandas()
    for name, a in (("quick", 0.95), ("slow", 0.01)):
        want = [x[0]]
        for v in x[1:]:
            want.append(a * v + (1 - a) * want[-1])
        np.testing.assert_allclose(got[name], want, rtol=1e-11)


def test_constant_series(spark, days):
    df = series(spark, days, [5.0] * 30)
    assert ind.rsi(df).where("rsi is not null").count() == 0
    assert ind.bollinger(df).where("percent_b is not null").count() == 0
    assert ind.drawdowns(df).agg(F.min("max_drawdown")).first()[0] == 0.0


def test_recovery_matches_a_plain_scan(spark, days):
    rng = np.random.default_rng(3)
    x = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, 300)))
    got = {r["d"]: (r["bars_to_recover"], r["counted"]) for r in ind.recovery_times(series(spark, days, x.tolist())).collect()}
    peak = np.maximum.accumulate(x)
    want = {}
    for i in range(300):
        if 1 - x[i] / peak[i] > 0.05:
            later = [j for j in range(i + 1, 300) if x[j] >= 0.99 * peak[i]]
            want[days(i)] = (later[0] - i if later else None, i <= 300 - 20)
    assert got == want


def test_labels_match_rules(spark):
    rows = [("Crisis/Bear", "Bear market", True), ("Strong Bull", "Strong Bull run", True), ("Steady Growth", "Normal", True),
            ("Steady Growth", "Crisis/Bear", False), ("Strong Bull", "Unknown", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in df.select(sc.labels_match(F.col("a"), F.col("b")), "want").collect())


def test_property_words(spark):
    df = spark.createDataFrame([("Real Estate", "x", True), ("Tech", "REIT - Office", True), ("Tech", "Software", False),
                                (None, "REIT", False)], "s string, i string, want boolean")
    assert all(r[0] == r[1] for r in df.select(sc.property_related(F.col("s"), F.col("i")), "want").collect())


def test_trailing_frames_equal_numpy_with_few_sliding_frames(spark):
    rng = np.random.default_rng(4)
    x = [None if k == 5 else float(v) for k, v in enumerate(rng.normal(1e6, 1, 60))]
    rows = [(s, k, 7.1 if s == "C" else v) for s in "ABC" for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, d int, close double")
    both = ind.trailing_zscore(ind.moving_averages(df, sizes=(1, 5, 13)), n=13)
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    # a sliding frame goes over all its rows at each row: none for the z-score, the mean alone in the others
    assert "stddev" not in plan and plan.count("count(") == 1
    got = {(r["symbol"], r["d"]): r for r in both.collect()}
    assert len(got) == len(rows)
    for k in range(60):
        for n in (1, 5, 13):
            part = x[max(k - n + 1, 0):k + 1]
            want = np.mean(part) if len(part) == n and None not in part else None
            assert got["B", k][f"sma_{n}"] == (want if want is None else pytest.approx(want, rel=1e-12))
        part = x[max(k - 12, 0):k + 1]
        want = (part[-1] - np.mean(part)) / np.std(part, ddof=1) if len(part) == 13 and None not in part else None
        assert got["A", k]["zscore"] == (want if want is None else pytest.approx(want, rel=1e-6))
        assert got["C", k]["zscore"] is None            # no spread: exactly 0
