"""Fixed regime tables: thresholds, factor weights, metric weights.

All numbers below are fixed values that results depend on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_REGIME = "Steady_Growth"
REGIMES = ("Strong_Bull", "Steady_Growth", "Crisis_Bear")

# Thresholds per regime, in the order of REGIMES (None = metric not used).
THRESHOLDS: dict[str, tuple] = {
    "pe": (30, 22, 15),
    "pb": (4.0, 3.0, 2.0),
    "ev_to_ebitda": (18, 14, 10),
    "fcf_yield": (0.02, 0.025, 0.04),
    "ev_to_sales": (3.5, 2.5, 1.5),
    "roe": (0.10, 0.12, 0.15),
    "roic": (0.08, 0.10, 0.12),
    "gross_margin": (0.20, 0.25, 0.30),
    "operating_margin": (0.08, 0.10, 0.12),
    "fcf_margin": (0.06, 0.08, 0.10),
    "asset_turnover": (None, None, None),
    "de_ratio": (80, 60, 40),
    "current_ratio": (1.2, 1.5, 2.0),
    "interest_coverage": (2.5, 3.0, 5.0),
    "cash_debt_ratio": (0.2, 0.3, 0.5),
    "rev_growth": (0.08, 0.06, 0.03),
    "growth_est": (0.15, 0.12, 0.08),
    "peg_ratio": (2.0, 1.8, 1.2),
    "price": (2, 2, 2),
    "div_yield_min": (0.01, 0.015, 0.02),
    "payout_ratio_max": (0.80, 0.70, 0.60),
}

# Factor weights per regime, in the order of REGIMES.
FACTOR_WEIGHTS: dict[str, tuple] = {
    "value": (-18.9, -11.6, -15.6),
    "quality": (37.1, 23.9, 26.1),
    "financial_health": (16.4, 23.9, 5.6),
    "stability": (-1.7, -6.1, 1.0),
    "liquidity": (47.8, 35.5, 28.9),
    "size": (0.5, 2.5, -0.7),
    "growth": (19.4, 17.2, 12.5),
    "carry": (-11.7, -10.7, -7.3),
    "momentum": (26.0, 27.4, 30.9),
    "technical": (-6.9, -2.0, 18.6),
    "options_flow": (0.0, 0.0, 0.0),
    "insider": (0.0, 0.0, 0.0),
}

# A second named set of factor weights (percent), in the order of REGIMES. It has names of its own: ``volatility_penalty``
# is what a stability score lacks to 1, for ``credit`` there is no data, so it is neutral.
PRESETS: dict[str, dict[str, tuple]] = {
    "second": {
        "momentum": (60.0, 45.0, 10.0),
        "growth": (15.0, 10.0, 0.0),
        "technical": (15.0, 10.0, 0.0),
        "quality": (10.0, 20.0, 30.0),
        "credit": (5.0, 10.0, 20.0),
        "financial_health": (5.0, 10.0, 25.0),
        "value": (-5.0, 5.0, 15.0),
        "size": (-5.0, -5.0, -5.0),
        "volatility_penalty": (-3.0, -5.0, -15.0),
        "carry": (-2.0, 0.0, 5.0),
        "liquidity": (5.0, 3.0, 10.0),
        "insider": (0.0, -3.0, 5.0),
    },
}

# Metric weights inside the value and quality scores.
VALUE_WEIGHTS = {"earnings_yield": 0.25, "fcf_yield": 0.25, "ev_to_ebitda": 0.20, "pb": 0.15,
                 "ev_to_sales": 0.15}
QUALITY_WEIGHTS = {"roe": 0.20, "roic": 0.20, "gross_margin": 0.15, "fcf_margin": 0.15,
                   "asset_turnover": 0.10, "operating_margin": 0.10, "revenue_stability": 0.10}


def known_regime(name: Column) -> Column:
    """The regime itself, or the default one for an unknown or missing name."""
    return F.when(name.isin(*REGIMES), name).otherwise(F.lit(DEFAULT_REGIME))


def with_regime_values(df: DataFrame, values: dict[str, tuple], prefix: str, regime: str = "regime") -> DataFrame:
    """Add ``<prefix><name>`` columns holding each row's regime's value; unknown regimes use the default.

    Three regimes make a small CASE per column, so no join is needed.
    """
    keyed = df.withColumn("_rk", known_regime(F.col(regime)))
    rk = F.col("_rk")

    def pick(v: tuple) -> Column:
        a, b, c = (F.lit(None if x is None else float(x)).cast("double") for x in v)
        return F.when(rk == REGIMES[0], a).when(rk == REGIMES[1], b).otherwise(c)
    return keyed.withColumns({f"{prefix}{k}": pick(v) for k, v in values.items()}).drop("_rk")


def with_thresholds(df: DataFrame, regime: str = "regime") -> DataFrame:
    return with_regime_values(df, THRESHOLDS, "t_", regime)


def with_factor_weights(df: DataFrame, weights: dict[str, tuple] | None = None, regime: str = "regime") -> DataFrame:
    """Factor weights as ``w_<factor>`` columns; pass ``weights`` to use another set."""
    return with_regime_values(df, weights or FACTOR_WEIGHTS, "w_", regime)
