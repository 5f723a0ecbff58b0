"""Registered queries: regime features, periods, statistics, lookups and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factorspark.functions.exprs import day_text, r6
from factorspark.operators import regimes as rg
from factorspark.operators.indicators import returns, rolling_volatility
from factorspark.plans import oracle_ctes as o
from factorspark.plans.oracle_ctes import with_
from factorspark.plans.registry import query
from factorspark.plans.technical import DT, r, roll
from factorspark.sources import adapters as ad

BARS = o.bars("region")
RET_SQL = "rt AS (SELECT symbol, d, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS ret FROM bars)"
LABEL_SQL = (BARS, RET_SQL, f"""
vl AS (SELECT symbol, d, ret, ({roll('ret', 20, 'stddev_samp')}) * sqrt(252) AS vol FROM rt),
lb AS (SELECT symbol, d, ret, vol, ntile(3) OVER (PARTITION BY symbol ORDER BY round(vol, 9), d) - 1 AS regime FROM vl WHERE vol IS NOT NULL)""")


def labelled(spark, sf, bars=None):
    """Days labelled by the tercile of 20-day volatility inside each region series."""
    st = rolling_volatility(returns(ad.bars(spark, sf, "region") if bars is None else bars), (20,)).where("vol_20 is not null")
    w = Window.partitionBy("symbol").orderBy(F.round("vol_20", 9), "d")
    return st.select("symbol", "d", "ret", F.col("vol_20").alias("vol"), (F.ntile(3).over(w) - 1).alias("regime"))


def labels(spark, sf, bars=None):
    return labelled(spark, sf, bars).select("symbol", "d", "regime")


@query("regime_basic_features", with_(BARS, RET_SQL, """
f1 AS (SELECT symbol, d, close, coalesce(ret, first_value(ret IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN CURRENT ROW
  AND UNBOUNDED FOLLOWING), 0) AS f FROM rt),
f2 AS (SELECT symbol, d, close, least(greatest(f, -0.5), 0.5) AS ret, CASE WHEN count(f) OVER ro >= 5 THEN stddev_samp(f) OVER ro WHEN count(f) OVER gr >= 2
  THEN stddev_samp(f) OVER gr END AS vol, CASE WHEN count(f) OVER ro >= 5 THEN avg(close) OVER ro WHEN count(f) OVER gr >= 2 THEN avg(close) OVER gr END AS ma
  FROM f1 WINDOW ro AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
  gr AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""", body=f"""
SELECT symbol, {DT}, {r('ret', 'ret')}, {r('least(vol, 1)', 'vol')}, {r('least(greatest(close / ma, 0.5), 2.0)', 'ma_ratio')}
FROM f2 WHERE vol IS NOT NULL AND ma IS NOT NULL"""))
def regime_basic_features(spark, sf):
    return rg.basic_features(ad.bars(spark, sf, "region")).select("symbol", day_text(), r6("ret"), r6("vol"), r6("ma_ratio"))


@query("regime_nine_features", with_(BARS, RET_SQL, f"""
n1 AS (SELECT symbol, d, ret, {roll('ret', 5, 'avg', 'r5')}, {roll('ret', 21, 'avg', 'r21')}, ({roll('ret', 21, 'stddev_samp')}) * sqrt(252) AS v21,
  ({roll('ret', 63, 'stddev_samp')}) * sqrt(252) AS v63, {roll('close', 50, 'avg', 's50')}, {roll('close', 200, 'avg', 's200')},
  close / lag(close, 63) OVER (PARTITION BY symbol ORDER BY d) - 1 AS momentum FROM rt),
n2 AS (SELECT *, v21 / lag(v21, 21) OVER (PARTITION BY symbol ORDER BY d) - 1 AS vc,
  (v21 - ({roll('v21', 252)})) / nullif({roll('v21', 252, 'stddev_samp')}, 0) AS vn, (s50 - s200) / s200 AS trend FROM n1)""", body=f"""
SELECT symbol, {DT}, {r('ret', 'return_1d')}, {r('r5', 'return_5d')}, {r('r21', 'return_21d')}, {r('v21', 'volatility_21d')}, {r('v63', 'volatility_63d')},
  {r('vc', 'vol_change')}, {r('vn', 'vol_norm')}, {r('trend', 'trend')}, {r('momentum', 'momentum')} FROM n2
WHERE ret + r5 + r21 + v21 + v63 + vc + vn + trend + momentum IS NOT NULL"""))
def regime_nine_features(spark, sf):
    return rg.nine_features(ad.bars(spark, sf, "region")).select("symbol", day_text(), *[r6(c) for c in rg.NINE_FEATURES])


@query("regime_three_features", with_(BARS, RET_SQL, f"""
t AS (SELECT symbol, d, ({roll('ret', 21, 'stddev_samp')}) * sqrt(252) AS v, ({roll('ret', 21, 'avg')}) * 252 AS m FROM rt)""", body=f"""
SELECT symbol, {DT}, {r('v', 'volatility')}, {r('m', 'momentum')}, {r('v / 100', 'level')} FROM t WHERE v IS NOT NULL"""))
def regime_three_features(spark, sf):
    return rg.three_features(ad.bars(spark, sf, "region")).select("symbol", day_text(), r6("volatility"), r6("momentum"), r6("level"))


SE = "strftime(start_date, '%Y-%m-%d') AS start_date, strftime(end_date, '%Y-%m-%d') AS end_date"
RUN_SQL = """
ru AS (SELECT *, sum(CASE WHEN regime = pr THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY d) AS run FROM (SELECT *, lag(regime) OVER
  (PARTITION BY symbol ORDER BY d) AS pr FROM lb)),
rp AS (SELECT symbol, regime, min(d) AS start_date, max(d) AS end_date, datediff('day', min(d), max(d)) + 1 AS days FROM ru GROUP BY symbol, run, regime)"""
GAP_SQL = """
gp0 AS (SELECT *, sum(CASE WHEN datediff('day', pd, d) <= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, regime ORDER BY d) AS run FROM
  (SELECT *, lag(d) OVER (PARTITION BY symbol, regime ORDER BY d) AS pd FROM lb)),
gp AS (SELECT symbol, regime, min(d) AS start_date, max(d) AS end_date, datediff('day', min(d), max(d)) AS days FROM gp0 GROUP BY symbol, regime, run)"""


def period_cols(df):
    return df.select("symbol", "regime", day_text("start_date"), day_text("end_date"), "days")


@query("regime_run_periods", with_(*LABEL_SQL, RUN_SQL, body=f"SELECT symbol, CAST(regime AS INTEGER) AS regime, {SE}, CAST(days AS INTEGER) AS days FROM rp"))
def regime_run_periods(spark, sf):
    return period_cols(rg.run_periods(labels(spark, sf)))


@query("regime_gap_periods", with_(*LABEL_SQL, GAP_SQL, body=f"SELECT symbol, CAST(regime AS INTEGER) AS regime, {SE}, CAST(days AS INTEGER) AS days FROM gp"))
def regime_gap_periods(spark, sf):
    return period_cols(rg.gap_periods(labels(spark, sf)))


NAMES = {0: "Strong Bull", 1: "Steady Growth", 2: "Crisis/Bear"}
NAME_E = "CASE regime WHEN 0 THEN 'Strong Bull' WHEN 1 THEN 'Steady Growth' ELSE 'Crisis/Bear' END"


def name_col():
    return F.when(F.col("regime") == 0, NAMES[0]).when(F.col("regime") == 1, NAMES[1]).otherwise(NAMES[2]).alias("regime_name")


SEQ_SQL = f"""
ps AS (SELECT {NAME_E} AS regime_name, start_date, end_date, days, row_number() OVER (ORDER BY regime, symbol, start_date) AS period_seq
  FROM gp),
dr AS (SELECT d, arg_min(regime_name, period_seq) AS regime_name FROM (SELECT DISTINCT d FROM bars) b JOIN ps ON d BETWEEN start_date AND end_date GROUP BY 1)"""


def overlapping_periods(spark, sf, bars=None):
    """Periods of all series in one table, in regime order: they overlap."""
    p = rg.gap_periods(labels(spark, sf, bars))
    return p.select(name_col(), "start_date", "end_date", "days", F.struct("regime", "symbol", "start_date").alias("period_seq"))


@query("regime_for_dates", with_(*LABEL_SQL, GAP_SQL, SEQ_SQL, body=f"""
SELECT {DT}, regime_name FROM (SELECT DISTINCT d FROM bars) LEFT JOIN dr USING (d)"""))
def regime_for_dates(spark, sf):
    dates = ad.bars(spark, sf, "region").select("d").distinct()
    return rg.regime_for_dates(dates, overlapping_periods(spark, sf)).select(day_text(), "regime_name")


@query("regime_filtered_returns", with_(*LABEL_SQL, GAP_SQL, SEQ_SQL, """
hit AS (SELECT lb.*, EXISTS (SELECT 1 FROM ps WHERE regime_name = 'Crisis/Bear' AND lb.d BETWEEN start_date AND end_date) AS h FROM lb),
hc AS (SELECT *, (SELECT count(DISTINCT d) FROM hit WHERE h) AS n FROM hit)""", body=f"""
SELECT symbol, {DT}, {r('ret', 'ret')} FROM hc WHERE h OR n < 60"""))
def regime_filtered_returns(spark, sf):
    rows = labelled(spark, sf).select(F.lit("all").alias("portfolio"), "symbol", "d", "ret")
    return rg.restrict_to_regime(rows, overlapping_periods(spark, sf), "Crisis/Bear").select("symbol", day_text(), r6("ret"))


@query("regime_statistics", with_(*LABEL_SQL, body="""
SELECT symbol, CAST(regime AS INTEGER) AS regime, count(*) AS days, CAST(sum(CASE WHEN pr <> regime THEN 1 ELSE 0 END) AS BIGINT) AS entries,
  round(count(*) / sum(count(*)) OVER (PARTITION BY symbol), 6) AS share FROM (SELECT *, lag(regime) OVER (PARTITION BY symbol ORDER BY d) AS pr FROM lb) GROUP BY 1, 2"""))
def regime_statistics(spark, sf):
    return rg.regime_statistics(labels(spark, sf)).select("symbol", "regime", "days", "entries", r6("share"))


CHAR_SQL = """
cg AS (SELECT *, product(1 + ret) OVER (PARTITION BY symbol, regime ORDER BY d) AS g FROM lb),
cd AS (SELECT *, g / max(g) OVER (PARTITION BY symbol, regime ORDER BY d) - 1 AS dd FROM cg),
ch AS (SELECT symbol, regime, count(*) AS total_days, count(*) / sum(count(*)) OVER (PARTITION BY symbol) AS frequency, avg(ret) * 252 AS mean_return,
  stddev_samp(ret) * sqrt(252) AS volatility, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, skewness(ret) AS skewness, kurtosis(ret) AS kurtosis,
  min(dd) AS max_drawdown FROM cd GROUP BY 1, 2)"""
CHAR_COLS = ("frequency", "mean_return", "volatility", "sharpe", "skewness", "kurtosis", "max_drawdown")


@query("regime_characteristics", with_(*LABEL_SQL, CHAR_SQL, body=f"""
SELECT symbol, CAST(regime AS INTEGER) AS regime, total_days, {', '.join(r(c, c, 5) for c in CHAR_COLS)} FROM ch"""))
def regime_characteristics(spark, sf):
    lab = labelled(spark, sf)
    return rg.characterise(lab.select("symbol", "d", "regime"), lab).select("symbol", "regime", "total_days", *[r6(c, 5) for c in CHAR_COLS])


NAMING_SQL = """
nr AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC, regime) AS rk FROM ch),
nn AS (SELECT *, CASE WHEN rk = 1 THEN CASE WHEN sharpe > 0.4 AND mean_return > 0 THEN 'Strong Bull' ELSE 'Steady Growth' END
  WHEN rk = 2 THEN CASE WHEN mean_return < -0.05 OR sharpe < -0.2 THEN 'Crisis/Bear' ELSE 'Steady Growth' END
  ELSE CASE WHEN sharpe < 0.3 OR mean_return < 0.02 OR volatility > 0.22 THEN 'Crisis/Bear' ELSE 'Steady Growth' END END AS nm FROM nr),
nz AS (SELECT symbol, regime, CASE WHEN count(*) FILTER (nm = 'Steady Growth') OVER (PARTITION BY symbol) = 0 AND row_number() OVER (PARTITION BY symbol
  ORDER BY abs(sharpe - 0.5) + abs(mean_return - 0.08), rk) = 1 THEN 'Steady Growth' ELSE nm END AS regime_name FROM nn)"""


@query("regime_names", with_(*LABEL_SQL, CHAR_SQL, NAMING_SQL, body="SELECT symbol, CAST(regime AS INTEGER) AS regime, regime_name FROM nz"))
def regime_names(spark, sf):
    return named_regimes(spark, sf).select("symbol", "regime", "regime_name")


def named_regimes(spark, sf):
    lab = labelled(spark, sf)
    return rg.name_regimes(rg.characterise(lab.select("symbol", "d", "regime"), lab))


TRANS_SQL = """
ld AS (SELECT symbol, regime AS f, lead(regime) OVER (PARTITION BY symbol ORDER BY d) AS t FROM lb),
tr AS (SELECT symbol, f, t, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY symbol, f) AS p FROM ld WHERE t IS NOT NULL GROUP BY 1, 2, 3)"""


@query("regime_transitions", with_(*LABEL_SQL, TRANS_SQL, body="""
SELECT symbol, CAST(f AS INTEGER) AS from_regime, CAST(t AS INTEGER) AS to_regime, n, round(p, 6) AS probability,
  round(CASE WHEN f = t THEN 1 / nullif(1 - p, 0) END, 5) AS expected_duration FROM tr"""))
def regime_transitions(spark, sf):
    return rg.transitions(labels(spark, sf)).select(
        "symbol", "from_regime", "to_regime", "n", r6("probability"), r6("expected_duration", 5))


MEANS_SQL = """
mf AS (SELECT symbol, regime, avg(ret) AS ret, avg(vol) AS vol, avg(abs(ret)) AS size FROM lb GROUP BY 1, 2)"""
FEATS = ("ret", "vol", "size")


def means(spark, sf):
    lab = labelled(spark, sf).withColumn("size", F.abs("ret"))
    return rg.regime_feature_means(lab.select("symbol", "d", "regime"), lab.drop("regime"), FEATS)


@query("regime_feature_means", with_(*LABEL_SQL, MEANS_SQL, body=f"""
SELECT symbol, CAST(regime AS INTEGER) AS regime, {', '.join(r(c, c) for c in FEATS)} FROM mf"""))
def regime_feature_means(spark, sf):
    return means(spark, sf).select("symbol", "regime", *[r6(c) for c in FEATS])


@query("regime_feature_importance", with_(*LABEL_SQL, MEANS_SQL, body=f"""
SELECT symbol, feature, {r('v', 'importance')}, row_number() OVER (PARTITION BY symbol ORDER BY v DESC, feature) AS rank FROM (
  SELECT symbol, feature, var_samp(x) AS v FROM (UNPIVOT mf ON ret, vol, size INTO NAME feature VALUE x) GROUP BY 1, 2)"""))
def regime_feature_importance(spark, sf):
    return rg.feature_importance(means(spark, sf), FEATS).select("symbol", "feature", r6("importance"), "rank")


@query("regime_separation", with_(*LABEL_SQL, MEANS_SQL, body="""
SELECT a.symbol, round(avg(sqrt(power(a.ret - b.ret, 2) + power(a.vol - b.vol, 2) + power(a.size - b.size, 2))), 6) AS separation
FROM mf a JOIN mf b ON a.symbol = b.symbol AND a.regime < b.regime GROUP BY 1"""))
def regime_separation(spark, sf):
    return rg.separation(means(spark, sf), FEATS).select("symbol", r6("separation"))


NAMED_SQL = "nd AS (SELECT lb.symbol, d, vol, regime_name FROM lb JOIN nz USING (symbol, regime))"


def named_days(spark, sf):
    return labelled(spark, sf).join(named_regimes(spark, sf).select("symbol", "regime", "regime_name"), ["symbol", "regime"])


@query("regime_event_validation", with_(*LABEL_SQL, CHAR_SQL, NAMING_SQL, NAMED_SQL, """
ev AS (SELECT DISTINCT 'Y' || year(d) AS event, make_date(year(d), 3, 1) AS s, make_date(year(d), 8, 31) AS e,
  CASE year(d) % 3 WHEN 0 THEN 'Crisis/Bear' WHEN 1 THEN 'Strong Bull' ELSE 'Normal' END AS expected FROM bars),
vc AS (SELECT symbol, event, expected, regime_name, count(*) AS n FROM nd JOIN ev ON d BETWEEN s AND e GROUP BY 1, 2, 3, 4),
vt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, event ORDER BY n DESC, regime_name) AS rn FROM vc) WHERE rn = 1)""", body="""
SELECT symbol, event, expected, regime_name, n, CASE expected WHEN 'Crisis/Bear' THEN regime_name = 'Crisis/Bear' WHEN 'Strong Bull' THEN
  regime_name = 'Strong Bull' ELSE regime_name = 'Steady Growth' END AS matched FROM vt"""))
def regime_event_validation(spark, sf):
    y = F.year("d")
    ev = ad.bars(spark, sf, "region").select(y.alias("y")).distinct().select(
        F.concat(F.lit("Y"), F.col("y").cast("string")).alias("event"),
        F.make_date("y", F.lit(3), F.lit(1)).alias("start_date"), F.make_date("y", F.lit(8), F.lit(31)).alias("end_date"),
        F.when(F.col("y") % 3 == 0, "Crisis/Bear").when(F.col("y") % 3 == 1, "Strong Bull").otherwise("Normal").alias("expected"))
    return rg.validate_events(named_days(spark, sf), ev)


@query("volatility_band_alignment", with_(*LABEL_SQL, CHAR_SQL, NAMING_SQL, NAMED_SQL, body="""
SELECT symbol, count(*) AS days, round(avg(CASE WHEN (regime_name = 'Crisis/Bear' AND vol >= 20) OR (regime_name IN ('Strong Bull', 'Steady Growth')
  AND vol < 20) THEN 1.0::DOUBLE ELSE 0 END), 6) AS alignment FROM nd GROUP BY 1"""))
def volatility_band_alignment(spark, sf):
    nd = named_days(spark, sf)
    return rg.band_alignment(nd, nd.withColumn("level", F.col("vol"))).select("symbol", "days", r6("alignment"))


@query("regime_share_of_days", with_(*LABEL_SQL, RUN_SQL, body=f"""
SELECT symbol, {NAME_E} AS regime_name, CAST(sum(days) AS BIGINT) AS days,
  round(sum(days) / sum(sum(days)) OVER (PARTITION BY symbol) * 100, 6) AS percentage FROM rp GROUP BY symbol, regime"""))
def regime_share_of_days(spark, sf):
    p = rg.run_periods(labels(spark, sf)).withColumn("regime_name", name_col())
    return rg.share_of_days(p).select("symbol", "regime_name", "days", r6("percentage"))


@query("current_regime_probabilities", with_(*LABEL_SQL, RUN_SQL, f"""
cu AS (SELECT symbol, arg_max({NAME_E}, end_date) AS current, count(*) AS t FROM rp GROUP BY 1),
fq AS (SELECT rp.symbol, {NAME_E} AS regime_name, current, count(*) / max(t) AS p FROM rp JOIN cu USING (symbol) GROUP BY 1, 2, 3),
bq AS (SELECT *, max(p) FILTER (regime_name = current) OVER (PARTITION BY symbol) AS pc FROM fq),
bb AS (SELECT *, CASE WHEN regime_name = current THEN least(pc * 2, 0.8) WHEN pc < 1 THEN p * (1 - least(pc * 2, 0.8)) / (1 - pc) ELSE p * 0.1 END AS q FROM bq)""",
                                             body="""
SELECT symbol, regime_name, current, round(q / sum(q) OVER (PARTITION BY symbol), 6) AS probability FROM bb"""))
def current_regime_probabilities(spark, sf):
    p = rg.run_periods(labels(spark, sf)).withColumn("regime_name", name_col())
    return rg.current_regime(p).select("symbol", "regime_name", "current", r6("probability"))


FILTER_SQL = """
am AS MATERIALIZED (SELECT symbol, """ + ", ".join(f"coalesce(max(p) FILTER (f = {i} AND t = {j}), 0) AS a{i}{j}" for i in range(3) for j in range(3)) + """ FROM tr GROUP BY 1),
pb AS MATERIALIZED (SELECT symbol, d, row_number() OVER (PARTITION BY symbol ORDER BY d) AS i, CASE regime WHEN 0 THEN 0.6 ELSE 0.2 END AS p0,
  CASE regime WHEN 1 THEN 0.6 ELSE 0.2 END AS p1, CASE regime WHEN 2 THEN 0.6 ELSE 0.2 END AS p2 FROM lb),
fl AS (SELECT symbol, d, i, p0::DOUBLE AS q0, p1::DOUBLE AS q1, p2::DOUBLE AS q2 FROM pb WHERE i = 1
  UNION ALL SELECT symbol, d, i, x0 / (x0 + x1 + x2), x1 / (x0 + x1 + x2), x2 / (x0 + x1 + x2) FROM (
   SELECT pb.symbol, pb.d, pb.i, (q0 * a00 + q1 * a10 + q2 * a20) * p0 AS x0, (q0 * a01 + q1 * a11 + q2 * a21) * p1 AS x1,
     (q0 * a02 + q1 * a12 + q2 * a22) * p2 AS x2 FROM fl JOIN pb ON pb.symbol = fl.symbol AND pb.i = fl.i + 1 JOIN am ON am.symbol = fl.symbol))"""


def _soft(lab):
    return lab.select("symbol", "d", *[F.when(F.col("regime") == i, 0.6).otherwise(0.2).alias(f"p_{i}") for i in range(3)])


@query("regime_filtered_labels", with_(*LABEL_SQL, TRANS_SQL, FILTER_SQL, recursive=True, body=f"""
SELECT symbol, {DT}, CAST(CASE WHEN q0 >= q1 AND q0 >= q2 THEN 0 WHEN q1 >= q2 THEN 1 ELSE 2 END AS INTEGER) AS regime, {r('q0', 'q_0')}, {r('q1', 'q_1')},
  {r('q2', 'q_2')} FROM fl"""))
def regime_filtered_labels(spark, sf):
    lab = labels(spark, sf)
    return rg.filter_labels(_soft(lab), rg.transition_rows(lab)).select("symbol", day_text(), "regime", r6("q_0"), r6("q_1"), r6("q_2"))


@query("current_regime_filtered", with_(*LABEL_SQL, TRANS_SQL, FILTER_SQL, recursive=True, body=f"""
SELECT symbol, {DT}, CAST(CASE WHEN q0 >= q1 AND q0 >= q2 THEN 0 WHEN q1 >= q2 THEN 1 ELSE 2 END AS INTEGER) AS regime,
  {r('greatest(q0, q1, q2)', 'probability')} FROM (SELECT *, max(i) OVER (PARTITION BY symbol) AS n FROM fl) WHERE i = n"""))
def current_regime_filtered(spark, sf):
    lab = labels(spark, sf)
    return rg.current_probability(rg.filter_labels(_soft(lab), rg.transition_rows(lab))).select(
        "symbol", day_text(), "regime", r6("probability"))


@query("regime_mixture_labels")
def regime_mixture_labels(spark, sf):
    f = rg.nine_features(ad.bars(spark, sf, "region"))
    model = rg.fit_mixture(f, rg.NINE_FEATURES)
    return rg.label_days(model, f).select("symbol", day_text(), "regime", r6("p_0"), r6("p_1"), r6("p_2"))
