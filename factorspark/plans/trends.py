"""Registered queries: score-history regressions, stability, forecasts, scorecard."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorspark.functions.exprs import r6
from factorspark.operators import trends as tr
from factorspark.operators.selection import full_rank
from factorspark.plans import oracle_ctes as o
from factorspark.plans.oracle_ctes import with_
from factorspark.plans.registry import query
from factorspark.plans.technical import ema_sql, r, roll
from factorspark.session import shared
from factorspark.sources import adapters as ad


def history(spark, sf, key="supplier"):
    """Score history with ranks inside each snapshot and dense sequence numbers."""
    h = ad.score_history(spark, sf, key)
    return shared(tr.snapshot_sequence(full_rank(h, ["d"], "score")))   # symbols x snapshots


def hist_sql(key="supplier"):
    return (o.score_history(key), """
h AS (SELECT *, dense_rank() OVER (ORDER BY d) - 1 AS seq, row_number() OVER (PARTITION BY d ORDER BY score DESC, symbol) AS rank
  FROM hist)""")


QUAD_SQL = """
cu AS (SELECT symbol, seq, score AS y, seq - avg(seq) OVER (PARTITION BY symbol) AS u, avg(seq) OVER (PARTITION BY symbol) AS ms FROM h),
su AS (SELECT symbol, count(*) AS n, max(seq) AS last_seq, max(ms) AS ms, sum(y) AS sy, sum(u * y) AS suy, sum(u * u * y) AS suuy,
  sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4, regr_slope(y, seq) AS slope, regr_intercept(y, seq) AS icpt,
  regr_r2(y, seq) AS r2 FROM cu GROUP BY 1),
qc AS (SELECT *, (suuy - s2 * sy / n - s3 * suy / s2) / (s4 - s2 * s2 / n - s3 * s3 / s2) AS qc FROM su),
qb AS (SELECT *, (suy - s3 * qc) / s2 AS qb, (sy - s2 * qc) / n AS qa FROM qc),
qr AS (SELECT symbol, 1 - sum(power(y - qa - qb * u - qc * u * u, 2)) / (var_pop(y) * count(*)) AS qr2
  FROM cu JOIN qb USING (symbol) GROUP BY 1)"""


@query("score_regressions", with_(*hist_sql(), QUAD_SQL, body=f"""
SELECT symbol, n AS appearances, {r('slope', 'linear_slope')}, {r('icpt', 'linear_intercept')}, {r('r2', 'linear_r2')},
  {r('qr2', 'quadratic_r2')} FROM qb JOIN qr USING (symbol)"""))
def score_regressions(spark, sf):
    return tr.score_regressions(history(spark, sf)).select(
        "symbol", "appearances", *[r6(c) for c in tr.REGRESSION_COLS[1:]])


@query("score_extrapolation", with_(*hist_sql(), QUAD_SQL, body=f"""
SELECT symbol, CAST(step AS INTEGER) AS step, {r('icpt + slope * (last_seq + step)', 'linear_pred')},
  {r('qa + qb * (last_seq + step - ms) + qc * power(last_seq + step - ms, 2)', 'quadratic_pred')}
FROM qb, unnest(range(1, 6)) AS t(step)"""))
def score_extrapolation(spark, sf):
    return tr.extrapolate(tr.score_regressions(history(spark, sf))).select(
        "symbol", "step", r6("linear_pred"), r6("quadratic_pred"))


STAB_SQL = """
ds AS (SELECT symbol, score, rank, score - lag(score) OVER w AS ds, rank - lag(rank) OVER w AS dr FROM h
  WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
sm AS (SELECT symbol, avg(score) AS avg_score, avg(rank) AS avg_rank, stddev_pop(score) AS score_std, stddev_pop(rank) AS rank_std,
  coalesce(max(abs(ds)), 0) AS max_score_change, coalesce(max(abs(dr)), 0) AS max_rank_change, max(score) - min(score) AS score_range,
  CASE WHEN avg(score) > 0 THEN stddev_pop(score) / avg(score) ELSE 'inf'::DOUBLE END AS score_cv,
  coalesce(abs(count(*) FILTER (ds > 0) - count(*) FILTER (ds < 0)) / nullif(count(ds), 0), 0) AS trend_consistency FROM ds GROUP BY 1)"""
SM_COLS = ("avg_score", "avg_rank", "score_std", "rank_std", "max_score_change", "score_range", "score_cv", "trend_consistency")


@query("score_stability_metrics", with_(*hist_sql(), STAB_SQL, body=f"""
SELECT symbol, {', '.join(r(c, c) for c in SM_COLS)}, max_rank_change FROM sm"""))
def score_stability_metrics(spark, sf):
    return tr.score_stability(history(spark, sf)).select("symbol", *[r6(c) for c in SM_COLS], "max_rank_change")


RECO = """CASE WHEN adj >= 50 AND slope > 0.3 AND r2 > 0.7 THEN 'STRONG BUY - Elite performer'
  WHEN adj >= 45 AND slope > 0.2 AND r2 > 0.6 THEN 'STRONG BUY - High conviction'
  WHEN adj >= 40 AND slope > 0.4 AND r2 > 0.5 THEN 'STRONG BUY - Strong momentum'
  WHEN adj >= 38 AND slope > 0.1 AND r2 > 0.5 THEN 'BUY - Quality growth'
  WHEN adj >= 35 AND score_std < 5 AND avg_score > 55 THEN 'BUY - Stable quality'
  WHEN avg_score >= 65 AND adj >= 32 THEN 'BUY - High score acceptable risk'
  WHEN adj >= 33 AND slope > 0.05 AND r2 > 0.4 THEN 'BUY - Consistent performer'
  WHEN slope > 0.5 AND adj >= 28 THEN 'SPECULATIVE BUY - Strong momentum'
  WHEN slope > 0.3 AND adj >= 25 AND avg_score > 50 THEN 'SPECULATIVE BUY - Recovery candidate'
  WHEN adj >= 30 AND abs(slope) < 0.1 THEN 'HOLD - Stable but flat'
  WHEN adj >= 28 AND slope > 0 THEN 'HOLD - Modest potential'
  WHEN avg_score >= 50 AND adj >= 25 THEN 'HOLD - Good fundamentals'
  WHEN adj >= 25 AND adj < 28 THEN 'HOLD - Needs monitoring'
  WHEN slope < -0.5 AND r2 > 0.7 THEN 'SELL - Reliable downtrend'
  WHEN slope < -0.2 AND adj < 25 THEN 'REDUCE - Weakening position'
  WHEN slope < -0.1 AND avg_score < 45 THEN 'REDUCE - Weak momentum'
  WHEN score_std > 15 THEN 'AVOID - Too volatile'
  WHEN adj < 20 THEN 'AVOID - Poor risk-adjusted score'
  WHEN avg_score < 35 THEN 'AVOID - Weak fundamentals'
  WHEN slope < -0.3 AND r2 > 0.5 THEN 'AVOID - Strong downtrend' ELSE 'WATCH - Monitor for opportunity' END"""
STABLE_SQL = (QUAD_SQL, STAB_SQL, f"""
s0 AS (SELECT symbol, n AS appearances, slope, r2, avg_score, avg_rank, score_std, score_cv, trend_consistency,
  least(greatest(r2 * 30 + greatest(30 - score_cv * 100, 0) + trend_consistency * 20
    + CASE WHEN slope > 0 AND r2 > 0.5 THEN least(20, slope * 1000) ELSE 0 END, 0), 100) AS stability_score,
  avg_score * r2 AS r2_adj, avg_score * r2 * (0.5 + 1 / (1 + exp(-5 * slope))) AS slope_adj,
  avg_score * r2 * (0.5 + 1 / (1 + exp(-5 * slope))) / (1 + score_std) AS adj FROM qb JOIN sm USING (symbol) WHERE n >= 5),
stable AS (SELECT *, {RECO} AS recommendation FROM s0)""")


def stability(spark, sf, key="supplier"):
    return tr.stability_table(history(spark, sf, key))


COMPANY_SQL = """
co AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS symbol, s_name AS company_name, r_name AS sector, n_name AS industry
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 9 <> 0)"""


def companies(spark, sf):
    """Company attributes; some suppliers are left out on purpose (missing companies)."""
    s, n, g = (ad.table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return (s.where(F.col("s_suppkey") % 9 != 0).join(n, s.s_nationkey == n.n_nationkey)
            .join(g, n.n_regionkey == g.r_regionkey).select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), F.col("s_name").alias("company_name"),
        F.col("r_name").alias("sector"), F.col("n_name").alias("industry")))


@query("stability_ranking", with_(*hist_sql(), *STABLE_SQL, COMPANY_SQL, body=f"""
SELECT symbol, appearances, {r('stability_score', 'stability_score')}, {r('r2_adj', 'r2_adjusted_score')},
  {r('slope_adj', 'slope_adjusted_score')}, {r('adj', 'stability_adjusted_score')}, recommendation,
  coalesce(company_name, 'Unknown') AS company_name, coalesce(sector, 'Unknown') AS sector,
  coalesce(industry, 'Unknown') AS industry FROM stable LEFT JOIN co USING (symbol)"""))
def stability_ranking(spark, sf):
    return tr.with_company(stability(spark, sf), companies(spark, sf)).select(
        "symbol", "appearances", r6("stability_score"), r6("r2_adjusted_score"), r6("slope_adjusted_score"),
        r6("stability_adjusted_score"), "recommendation", "company_name", "sector", "industry")


HOLT_SQL = """
hn AS (SELECT symbol, score, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM h),
gr AS (SELECT a.v AS alpha, b.v AS beta FROM (VALUES (0.1), (0.3), (0.5), (0.7), (0.9)) a(v), (VALUES (0.1), (0.3), (0.5), (0.7), (0.9)) b(v)),
ho AS (SELECT f.symbol, CAST(alpha AS DOUBLE) AS alpha, CAST(beta AS DOUBLE) AS beta, f.n, 1 AS i, f.score AS lvl,
    s.score - f.score AS trd, CAST(0 AS DOUBLE) AS sse
  FROM hn f JOIN hn s ON f.symbol = s.symbol AND f.i = 1 AND s.i = 2, gr WHERE f.n >= 10
  UNION ALL
  SELECT ho.symbol, alpha, beta, ho.n, ho.i + 1, alpha * score + (1 - alpha) * (lvl + trd),
    beta * (alpha * score + (1 - alpha) * (lvl + trd) - lvl) + (1 - beta) * trd, sse + power(score - lvl - trd, 2)
  FROM ho JOIN hn ON hn.symbol = ho.symbol AND hn.i = ho.i + 1),
hb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sse, alpha, beta) AS rk FROM ho WHERE i = n) WHERE rk = 1),
holt AS (SELECT symbol, alpha, beta, sse, step, lvl + step * trd AS forecast
  FROM (SELECT *, unnest(range(1, 1 + least(greatest(n // 10, 1), 30))) AS step FROM hb))"""


@query("holt_forecasts", with_(*hist_sql("brand"), HOLT_SQL, recursive=True, body=f"""
SELECT symbol, alpha, beta, {r('sse', 'sse', 4)}, CAST(step AS INTEGER) AS step, {r('forecast', 'forecast')} FROM holt"""))
def holt_forecasts(spark, sf):
    return tr.holt_forecast(history(spark, sf, "brand")).select(
        "symbol", "alpha", "beta", r6("sse", 4), "step", r6("forecast"))


AR_SQL = """
al AS (SELECT symbol, seq, score AS y, lag(score) OVER w AS a, lag(score, 2) OVER w AS b FROM h WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
am AS (SELECT symbol, count(*) AS m, arg_max(y, seq) AS y1, arg_max(a, seq) AS y2, avg(y) AS my, avg(a) AS ma, avg(b) AS mb,
  var_pop(y) AS yy, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(y, a) AS ya, covar_pop(y, b) AS yb, covar_pop(a, b) AS ab
  FROM al WHERE b IS NOT NULL GROUP BY 1 HAVING count(*) + 2 >= 10),
an AS (SELECT *, ya / aa AS p1, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS q1, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS q2 FROM am),
ao AS (SELECT symbol, m, y1, y2, my, ma, mb, 0 AS ord, m * ln(yy) + 2 AS aic, 0.0::DOUBLE AS f1, 0.0::DOUBLE AS f2 FROM an
  UNION ALL SELECT symbol, m, y1, y2, my, ma, mb, 1, m * ln(yy - p1 * ya) + 4, p1, 0 FROM an
  UNION ALL SELECT symbol, m, y1, y2, my, ma, mb, 2, m * ln(yy - q1 * ya - q2 * yb) + 6, q1, q2 FROM an),
ab AS (SELECT *, my - f1 * ma - f2 * mb AS k, least(greatest((m + 2) // 10, 1), 30) AS hz FROM
  (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY aic, ord) AS rk FROM ao) WHERE rk = 1),
ap AS (SELECT symbol, ord, aic, k, f1, f2, hz, 1 AS step, k + f1 * y1 + f2 * y2 AS l1, y1 AS l2 FROM ab
  UNION ALL SELECT symbol, ord, aic, k, f1, f2, hz, step + 1, k + f1 * l1 + f2 * l2, l1 FROM ap WHERE step < hz)"""


@query("autoregressive_forecasts", with_(*hist_sql("brand"), AR_SQL, recursive=True, body=f"""
SELECT symbol, ord AS "order", {r('aic', 'aic')}, step, {r('l1', 'forecast')} FROM ap"""))
def autoregressive_forecasts(spark, sf):
    return tr.ar_forecast(history(spark, sf, "brand")).select("symbol", "order", r6("aic"), "step", r6("forecast"))


CARD_SQL = (ema_sql("h", "score", {"e12": 2 / 13, "e26": 2 / 27}, "e"), "l AS (SELECT symbol, d, e12 - e26 AS line FROM e)",
            ema_sql("l", "line", {"sig": 0.2}, "s"), f"""
c0 AS (SELECT symbol, d, score, score - lag(score) OVER w AS v, {roll('score', 5, 'avg', 's5')}, {roll('score', 10, 'avg', 's10')},
  {roll('score', 20, 'avg', 'm20')}, {roll('score', 20, 'stddev_samp', 'sd20')},
  coalesce(greatest(score - lag(score) OVER w, 0), 0) AS g, coalesce(greatest(lag(score) OVER w - score, 0), 0) AS ls,
  (score / lag(score, 10) OVER w - 1) * 100 AS roc, {roll('score', 2, 'max', 'hi')}, {roll('score', 2, 'min', 'lo')},
  row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS rn
  FROM h WINDOW w AS (PARTITION BY symbol ORDER BY d)),
c1 AS (SELECT *, v - lag(v) OVER w AS ac, {roll('g', 14, 'avg', 'ag')}, {roll('ls', 14, 'avg', 'al')}, hi - lo AS trr,
  CASE WHEN hi - lag(hi) OVER w < 0 THEN 0 ELSE hi - lag(hi) OVER w END AS up,
  CASE WHEN lag(lo) OVER w - lo < 0 THEN 0 ELSE lag(lo) OVER w - lo END AS dn,
  CASE WHEN i >= 10 AND s5 > s10 AND lag(s5) OVER w <= lag(s10) OVER w THEN 1 ELSE 0 END AS bull,
  CASE WHEN i >= 10 AND s5 < s10 AND lag(s5) OVER w >= lag(s10) OVER w THEN 1 ELSE 0 END AS bear
  FROM c0 WINDOW w AS (PARTITION BY symbol ORDER BY d)),
c2 AS (SELECT *, CASE WHEN al = 0 AND ag > 0 THEN 100 WHEN al > 0 THEN 100 - 100 / (1 + ag / al) END AS rsi,
  100 * ({roll('up', 14)}) / nullif({roll('trr', 14)}, 0) AS pdi, 100 * ({roll('dn', 14)}) / nullif({roll('trr', 14)}, 0) AS mdi,
  (score - (m20 - 2 * sd20)) / nullif(4 * sd20, 0) AS pb, 4 * sd20 / nullif(m20, 0) AS bw FROM c1),
c3 AS (SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM c2),
c4 AS (SELECT *, {roll('dx', 14, 'avg', 'adx')} FROM c3),
c5 AS (SELECT c4.*, CASE WHEN c4.n >= 26 THEN s.line END AS macd, CASE WHEN c4.n >= 26 THEN s.sig END AS sg,
  CASE WHEN c4.n >= 26 THEN s.line - s.sig END AS mh FROM c4 JOIN s USING (symbol, d)),
c6 AS (SELECT *, mh > lag(mh) OVER (PARTITION BY symbol ORDER BY d) AS mup FROM c5),
c7 AS (SELECT symbol, max(n) AS n, max(score) FILTER (rn = 1) AS score, max(s5) FILTER (rn = 1) AS s5, max(s10) FILTER (rn = 1) AS s10,
  max(bull) AS bull5, max(bear) AS bear5, max(macd) FILTER (rn = 1) AS macd, max(sg) FILTER (rn = 1) AS sg,
  max(mh) FILTER (rn = 1) AS mh, count(mh) AS n_hist, bool_and(mup) FILTER (rn <= 4) AS rising,
  avg(rsi) FILTER (rn <= 3) AS rsi3, CASE WHEN count(rsi) >= 3 THEN -regr_slope(rsi, rn) END AS rsi_slope,
  avg(roc) FILTER (rn <= 3) AS roc3, avg(pb) FILTER (rn <= 3) AS pb3, CASE WHEN count(bw) >= 3 THEN -regr_slope(bw, rn) END AS bw_slope,
  avg(adx) FILTER (rn <= 3) AS adx3, avg(adx) AS adx5, avg(pdi) FILTER (rn <= 3) AS pdi3, avg(mdi) FILTER (rn <= 3) AS mdi3,
  avg(v) FILTER (rn <= 3) AS v, avg(ac) FILTER (rn <= 3) AS a FROM c6 WHERE rn <= 5 GROUP BY 1)""")
RULES_SQL = """
x AS (SELECT c7.*, slope, r2, ar.l1 AS ar_next, ho1.forecast AS holt_next FROM c7 JOIN qb USING (symbol)
  LEFT JOIN (SELECT * FROM ap WHERE step = 1) ar USING (symbol) LEFT JOIN (SELECT * FROM holt WHERE step = 1) ho1 USING (symbol)),
ru AS (
 SELECT symbol, 'trend' AS rule, CASE WHEN slope > 0.5 THEN 1.0 WHEN slope > 0 THEN 0.5 ELSE 0 END AS p, 1.0 AS m FROM x WHERE slope IS NOT NULL
 UNION ALL SELECT symbol, 'trend_quality', CASE WHEN r2 > 0.7 THEN 1 WHEN r2 > 0.4 THEN 0.5 ELSE 0 END, 1 FROM x WHERE r2 IS NOT NULL
 UNION ALL SELECT symbol, 'sma_position', CASE WHEN score > s5 AND s5 > s10 THEN 1 WHEN score > s5 OR score > s10 THEN 0.5 ELSE 0 END, 1 FROM x WHERE n >= 10
 UNION ALL SELECT symbol, 'recent_cross', CASE WHEN bull5 = 1 THEN 1 WHEN bear5 = 1 THEN 0 ELSE 0.3 END, 1 FROM x WHERE n >= 10
 UNION ALL SELECT symbol, 'macd', CASE WHEN macd > sg THEN 1 ELSE 0 END, 1 FROM x WHERE sg IS NOT NULL
 UNION ALL SELECT symbol, 'macd_histogram', CASE WHEN rising THEN 1 WHEN mh > 0 THEN 0.5 ELSE 0 END, 1 FROM x WHERE n_hist >= 3
 UNION ALL SELECT symbol, 'rsi_level', CASE WHEN rsi3 BETWEEN 40 AND 60 THEN 0.5 WHEN rsi3 > 60 THEN 1 ELSE 0 END, 1 FROM x WHERE rsi3 IS NOT NULL
 UNION ALL SELECT symbol, 'rsi_trend', CASE WHEN rsi_slope > 2 THEN 1 WHEN rsi_slope > -2 THEN 0.5 ELSE 0 END, 1 FROM x WHERE rsi_slope IS NOT NULL
 UNION ALL SELECT symbol, 'rate_of_change', CASE WHEN roc3 > 5 THEN 1 WHEN roc3 > 0 THEN 0.5 ELSE 0 END, 1 FROM x WHERE roc3 IS NOT NULL
 UNION ALL SELECT symbol, 'band_position', CASE WHEN pb3 BETWEEN 0.5 AND 0.8 THEN 1 WHEN pb3 BETWEEN 0.2 AND 0.9 THEN 0.5 ELSE 0 END, 1 FROM x WHERE pb3 IS NOT NULL
 UNION ALL SELECT symbol, 'band_width', CASE WHEN bw_slope < 0 THEN 0.5 ELSE 0.3 END, 1 FROM x WHERE bw_slope IS NOT NULL
 UNION ALL SELECT symbol, 'adx_strength', CASE WHEN adx3 > 40 THEN 1 WHEN adx3 > 25 THEN 0.5 ELSE 0 END, 1 FROM x WHERE adx3 IS NOT NULL
 UNION ALL SELECT symbol, 'direction', CASE WHEN pdi3 > mdi3 THEN 1 ELSE 0 END, 1 FROM x WHERE pdi3 IS NOT NULL
 UNION ALL SELECT symbol, 'ar_forecast', CASE WHEN ar_next > score THEN 1 ELSE 0 END, 1 FROM x WHERE ar_next IS NOT NULL
 UNION ALL SELECT symbol, 'smoothing_forecast', CASE WHEN holt_next > score THEN 1 ELSE 0 END, 1 FROM x WHERE holt_next IS NOT NULL
 UNION ALL SELECT symbol, 'acceleration', CASE WHEN v > 0.1 AND a > 0.05 THEN 1.5 WHEN v > 0.1 AND a < -0.05 THEN 0.5
   WHEN v < -0.1 AND a > 0.05 THEN 0.3 WHEN v < -0.1 AND a < -0.05 THEN 0 ELSE 0.7 END, 1.5 FROM x WHERE n >= 4)"""
SCORECARD_SQL = (*hist_sql("brand"), QUAD_SQL, HOLT_SQL, AR_SQL, *CARD_SQL, RULES_SQL)


def scorecard(spark, sf):
    h = history(spark, sf, "brand")
    inputs = (tr.scorecard_inputs(h).join(tr.score_regressions(h).select("symbol", "linear_slope", "linear_r2"), "symbol")
              .join(tr.ar_forecast(h).where("step = 1").select("symbol", F.col("forecast").alias("ar_next")), "symbol", "left")
              .join(tr.holt_forecast(h).where("step = 1").select("symbol", F.col("forecast").alias("holt_next")),
                    "symbol", "left"))
    return tr.technical_scorecard(inputs, ("ar_next", "holt_next"))


@query("technical_scorecard", with_(*SCORECARD_SQL, recursive=True, body="""
SELECT symbol, round(CAST(sum(p) AS DOUBLE), 4) AS technical_points, round(CAST(sum(m) AS DOUBLE), 4) AS technical_max,
  round(CAST(sum(p) AS DOUBLE) / sum(m) * 100, 4) AS percentage, CASE WHEN sum(p) / sum(m) * 100 >= 70 THEN 'STRONG BUY' WHEN sum(p) / sum(m) * 100 >= 55 THEN 'BUY'
  WHEN sum(p) / sum(m) * 100 >= 45 THEN 'HOLD' WHEN sum(p) / sum(m) * 100 >= 30 THEN 'SELL' ELSE 'STRONG SELL' END AS recommendation
FROM ru GROUP BY 1"""))
def technical_scorecard(spark, sf):
    return scorecard(spark, sf).select("symbol", r6("technical_points", 4), r6("technical_max", 4), r6("percentage", 4),
                                       "recommendation")


@query("technical_scorecard_details", with_(*SCORECARD_SQL, recursive=True, body="""
SELECT symbol, rule, CAST(p AS DOUBLE) AS points, CAST(m AS DOUBLE) AS max_points FROM ru"""))
def technical_scorecard_details(spark, sf):
    return tr.scorecard_details(scorecard(spark, sf))


@query("market_signal_summary", with_(*hist_sql("brand"), *CARD_SQL, body="""
SELECT symbol, CASE WHEN bull5 = 1 THEN 'bullish_cross' ELSE 'bearish_cross' END AS signal FROM c7 WHERE bull5 = 1 OR bear5 = 1
UNION ALL SELECT symbol, 'strong_trend' FROM c7 WHERE adx5 > 40"""))
def market_signal_summary(spark, sf):
    return tr.market_signals(tr.scorecard_inputs(history(spark, sf, "brand")))
