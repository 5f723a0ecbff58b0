"""Row-wise factor scores as Column builders over the fundamentals schema."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorspark.functions.exprs import (clip, guarded_ratio, piecewise_linear, positive, ramp,
                                         step_score)
from factorspark.functions.regime_tables import QUALITY_WEIGHTS, VALUE_WEIGHTS


def c(name: str) -> Column:
    return F.col(name)


def ratios() -> dict[str, Column]:
    """Guarded ratios; null unless the denominator is positive and the numerator present."""
    capital = F.coalesce(c("total_assets"), F.lit(0.0)) - F.coalesce(c("total_current_liabilities"), F.lit(0.0))
    return {
        "earnings_yield": F.when(c("trailing_pe") > 0, 1 / c("trailing_pe")),
        "fcf_yield": F.when((c("free_cashflow") != 0) & (c("market_cap") != 0),
                            F.try_divide(c("free_cashflow"), c("market_cap"))),
        "interest_coverage": guarded_ratio(c("ebit"), c("interest_expense")),
        "cash_debt_ratio": guarded_ratio(c("total_cash"), c("total_debt")),
        "asset_turnover": guarded_ratio(c("total_revenue"), c("total_assets")),
        "roic": guarded_ratio(c("ebit"), capital),
        "fcf_margin": guarded_ratio(c("free_cashflow"), c("total_revenue")),
    }


def with_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({f"_r_{k}": v for k, v in ratios().items()})


def value_parts() -> list[tuple[Column, float]]:
    """Scores of the value metrics with their weights, over ``with_ratios`` columns."""
    m = {
        "earnings_yield": ramp(c("_r_earnings_yield"), 0.05, 0.10, True),
        "fcf_yield": ramp(positive(c("_r_fcf_yield")), c("t_fcf_yield"), 0.10, True),
        "ev_to_ebitda": ramp(positive(c("ev_to_ebitda")), c("t_ev_to_ebitda"), 6, False),
        "pb": ramp(positive(c("price_to_book")), c("t_pb"), 1, False),
        "ev_to_sales": ramp(positive(c("ev_to_revenue")), c("t_ev_to_sales"), 1, False),
    }
    return [(m[k], w) for k, w in VALUE_WEIGHTS.items()]


def quality_parts() -> list[tuple[Column, float]]:
    gross = ramp(c("gross_margins"), c("t_gross_margin"), 0.6, True)
    m = {
        "roe": ramp(c("return_on_equity"), c("t_roe"), 0.25, True),
        "roic": ramp(c("_r_roic"), c("t_roic"), 0.20, True),
        "gross_margin": gross,
        "fcf_margin": ramp(c("_r_fcf_margin"), c("t_fcf_margin"), 0.15, True),
        "asset_turnover": ramp(positive(c("_r_asset_turnover")), c("t_asset_turnover"), 1.0, True),
        "operating_margin": ramp(c("operating_margins"), c("t_operating_margin"), 0.2, True),
        "revenue_stability": 0.8 * F.coalesce(gross, F.lit(0.0)),
    }
    return [(m[k], w) for k, w in QUALITY_WEIGHTS.items()]


def health_parts() -> list[tuple[Column, float]]:
    """Four equally weighted financial-health metrics."""
    debt = F.when(c("debt_to_equity") >= 0, c("debt_to_equity"))
    return [
        (ramp(positive(c("_r_cash_debt_ratio")), c("t_cash_debt_ratio"), 0.6, True), 1.0),
        (ramp(positive(c("current_ratio")), c("t_current_ratio"), 2.5, True), 1.0),
        (ramp(debt, c("t_de_ratio"), 50, False), 1.0),
        (ramp(positive(c("_r_interest_coverage")), c("t_interest_coverage"), 10, True), 1.0)]


def growth_parts() -> list[tuple[Column, float]]:
    """Forward-looking growth; needs the pivoted estimate columns of ``pivot_estimates``.

    A missing revenue growth counts as zero, so that term is always in the mean.
    """
    g = F.coalesce(c("revenue_growth"), F.lit(0.0))
    peg = positive(c("peg_ratio"))
    e30 = F.coalesce(c("q0_d30"), c("q0_avg"))
    e60 = F.coalesce(c("q0_d60"), e30)
    e90 = F.coalesce(c("q0_d90"), e60)
    rev3 = F.try_divide(c("q0_avg") - e90, e90)
    rev1 = F.when(e30 > 0, F.try_divide(c("q0_avg") - e30, e30)).otherwise(F.lit(0.0))
    revision = F.when(e90 > 0, (clip((rev3 + rev1) / 0.1, -1, 1) + 1) / 2)
    fwd = F.when(c("y0_avg") > 0, F.try_divide(c("y1_avg") - c("y0_avg"), c("y0_avg")))
    up = F.when(c("price") > 0, c("target_mean_price") / c("price") - 1)
    om, pm = c("operating_margins"), c("profit_margins")
    lever = F.when((om > 0) & (pm > 0), F.try_divide(om - pm, pm))
    return [
        (clip((g - c("t_rev_growth")) / 0.25, 0, 1), 0.8),
        (clip((c("t_peg_ratio") - peg) / (c("t_peg_ratio") - 1.0), 0, 1), 0.9),
        (revision, 1.0),
        (clip((fwd - 0.05) / 0.25, 0, 1), 0.9),
        (clip((c("q0_rev_growth") - 0.05) / 0.25, 0, 1), 0.8),
        (clip((up - 0.1) / 0.4, 0, 1), 0.7),
        (clip((lever + 0.1) / 0.2, 0, 1), 0.6)]


SMALL_CAP, MEGA_CAP = 300_000_000.0, 500_000_000_000.0  # fixed values of the size scale


def size_score(cap: Column, price: Column) -> Column:
    lo, hi = math.log10(SMALL_CAP), math.log10(MEGA_CAP)
    cap_part = clip((hi - F.log10(F.when(cap > 0, cap))) / (hi - lo), 0, 1)
    price_part = (F.when(price.isNull(), 0.0).when(price < 2, price / 2).when(price <= 50, 1.0)
                  .otherwise(F.greatest(1 - (price - 50) / 150, F.lit(0.0))))
    return F.when(cap > 0, 0.8 * cap_part + 0.2 * price_part).otherwise(0.0)


def liquidity_score() -> Column:
    zero = F.lit(0.0)
    vol = F.coalesce(c("avg_volume_10d"), zero)
    shares = F.coalesce(c("shares_outstanding"), F.lit(1.0))
    price = F.coalesce(c("price"), zero)
    turn = F.when(shares > 0, F.least(F.try_divide(vol, shares) * 100, F.lit(1.0))).otherwise(zero)
    step = F.when(price < 1, price).when(price < 5, 0.8 + (price - 1) / 20).otherwise(1.0)
    return (0.30 * F.least(vol / 1e7, F.lit(1.0)) + 0.25 * turn
            + 0.20 * F.least(F.coalesce(c("market_cap"), zero) / 1e10, F.lit(1.0)) + 0.15 * step
            + 0.10 * F.least(F.coalesce(c("institutions_pct"), zero) / 0.7, F.lit(1.0)))


def carry_score(yield_: Column, payout: Column, cagr: Column, streak: Column) -> Column:
    """Dividend carry: yield base plus payout, growth and streak bonuses, at most 1."""
    pay = (F.when(payout.isNull(), 0.0).when(payout <= 0.3, 0.20).when(payout <= 0.5, 0.15)
           .when(payout <= 0.7, 0.05).otherwise(0.0))
    grow = F.when(cagr.isNull(), 0.0).otherwise(
        step_score(cagr, [(0.10, 0.20), (0.05, 0.15), (0.02, 0.10), (0.0, 0.05)], 0.0))
    run = step_score(F.coalesce(streak, F.lit(0)), [(10, 0.20), (5, 0.15), (3, 0.10), (1, 0.05)], 0.0)
    paid = F.when(yield_.isNotNull() & (yield_ != 0), yield_)
    return F.when(paid.isNull(), 0.0).otherwise(
        F.least(F.least(paid / 0.10, F.lit(1.0)) + pay + grow + run, F.lit(1.0)))


CURVE = (0.1, 0.3, 0.5, 0.7, 0.9, 1.0)  # fixed values at the breaks of both momentum curves


def _momentum_curve(r: Column, breaks: tuple) -> Column:
    return piecewise_linear(F.when(~F.isnan(r), r), breaks, CURVE, 0.5)


def price_momentum_score(r: Column) -> Column:
    return _momentum_curve(r, (-0.5, -0.2, 0.0, 0.3, 1.0, 2.0))


def earnings_momentum_score(r: Column) -> Column:
    return _momentum_curve(r, (-0.4, -0.15, 0.0, 0.2, 0.5, 1.0))


def momentum_score(price_part: Column, earnings_part: Column) -> Column:
    return 0.6 * price_part + 0.4 * earnings_part


def growth_bucket(rate: Column) -> Column:
    """Economic growth classes at 4, 2.5, 1 and -1 percent."""
    return F.when(rate.isNotNull(), step_score(
        rate, [(0.04, 1.0), (0.025, 0.75), (0.01, 0.5), (-0.01, 0.25)], 0.0))


def vix_band(level: Column) -> Column:
    return (F.when(level < 12, "Low Vol (<12)").when(level < 20, "Normal (12-20)")
            .when(level < 30, "Elevated (20-30)").when(level.isNotNull(), "High Vol (>30)"))


def first_text(*names: str, default: str = "N/A") -> Column:
    """First non-blank text among the columns."""
    return F.coalesce(*[F.when(F.trim(F.col(n)) != "", F.trim(F.col(n))) for n in names], F.lit(default))


# Sectors, industries and words that mark property-related companies.
PROPERTY_KEYWORDS = ("real estate", "reit", "housing", "homebuilding", "construction", "building",
                     "property", "residential", "commercial property", "mortgage", "lumber",
                     "home improvement")


def property_related(sector: Column, industry: Column, sectors: tuple = (), industries: tuple = ()) -> Column:
    """True for an excluded sector or industry or any property keyword; false when a text is missing."""
    words = "|".join(PROPERTY_KEYWORDS)
    hit = F.lower(sector).rlike(words) | F.lower(industry).rlike(words)
    if sectors:
        hit = hit | sector.isin(*sectors)
    if industries:
        hit = hit | industry.isin(*industries)
    return F.coalesce(hit, F.lit(False)) & sector.isNotNull() & industry.isNotNull()


def labels_match(label: Column, expected: Column) -> Column:
    """Whether a regime label satisfies an expected market description."""
    got, want = F.lower(label), F.lower(expected)

    def has(x, *words):
        return x.rlike("|".join(words))
    return (F.when(got == want, True)
            .when(has(want, "crisis", "bear"), has(got, "crisis", "bear"))
            .when(has(want, "bull") & has(want, "strong"), has(got, "strong") & has(got, "bull"))
            .when(has(want, "steady", "growth", "normal"), has(got, "steady", "growth"))
            .otherwise(False))


def band_agrees(label: Column, band: Column) -> Column:
    """Whether a regime label fits the volatility band of the same day."""
    got, lvl = F.lower(label), F.lower(band)
    calm = lvl.rlike("low|normal")
    return F.coalesce((got.rlike("crisis|bear") & lvl.rlike("high|elevated"))
                      | (got.rlike("bull|growth") & calm)
                      | (got.rlike("steady") & lvl.rlike("normal")), F.lit(False))
