"""Registered queries: tables written as the files the readers take, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorspark.functions.exprs import day_text, r6
from factorspark.operators.selection import ALIASES, normalise_columns, table_kind
from factorspark.plans import flow as fp
from factorspark.plans import oracle_ctes as o
from factorspark.plans.operations import run_folder
from factorspark.plans.oracle_ctes import with_
from factorspark.plans.registry import ORACLES, query
from factorspark.plans.selection import DAY, RANKED
from factorspark.plans.technical import r
from factorspark.sources import adapters as ad
from factorspark.sources import readers
from factorspark.sources.sinks import write_report


@query("transactions_from_files", with_(o.TX, body=f"""
SELECT symbol, type, {r('price', 'price', 8)}, shares, strftime(d, '%Y-%m-%d') AS d, {r('commission', 'commission')}, count(*) AS n
FROM (SELECT upper(symbol) AS symbol, type, price, shares, d, CASE WHEN shares > 40 THEN 0 ELSE commission END AS commission FROM tx WHERE portfolio <> 7)
GROUP BY ALL"""))
def transactions_from_files(spark, sf):
    """Trades as text files: prices of one portfolio are no numbers, commissions of large trades are missing."""
    path = f"{run_folder(spark)}/trades.csv"
    t = ad.transactions(spark, sf)
    price = F.when(F.col("portfolio") == 7, F.lit("n/a")).otherwise(F.col("price").cast("string"))
    t.select(F.concat(F.lit(" "), F.lower("symbol")).alias("ticker"), F.lower("type").alias("type"), price.alias("price"), F.col("shares").cast("string").alias("shares"),
             F.date_format("d", "yyyy-MM-dd").alias("date"), F.when(F.col("shares") <= 40, F.col("commission").cast("string")).alias("commission")).write.option(
        "header", True).csv(path)
    back = readers.read_transactions(spark, path)
    return back.groupBy("symbol", "type", r6("price", 8), "shares", day_text(), r6("commission")).agg(F.count(F.lit(1)).alias("n"))


@query("portfolio_from_files", "SELECT n_name AS symbol, CAST(n_nationkey AS DOUBLE) AS shares FROM nation")
def portfolio_from_files(spark, sf):
    """A portfolio document with names to trim, read as members and shares."""
    path = f"{run_folder(spark)}/portfolio"
    n = ad.table(spark, sf, "nation").select(F.concat(F.lit(" "), F.lower("n_name")).alias("t"), F.col("n_nationkey").cast("double").alias("v"))
    doc = n.agg(F.collect_list("t").alias("tickers"), F.map_from_entries(F.collect_list(F.struct("t", "v"))).alias("shares"))     # one row for each nation
    doc.coalesce(1).write.json(path)
    return readers.read_portfolio(spark, path).select("symbol", "shares")


@query("universe_from_files", "SELECT DISTINCT upper(p_brand) AS symbol FROM part")
def universe_from_files(spark, sf):
    """A list with comments, blank lines and repeated names in any case."""
    path = f"{run_folder(spark)}/universe"
    p = ad.table(spark, sf, "part")
    line = F.explode(F.array(F.lower("p_brand"), F.concat(F.lit("  "), F.col("p_brand")), F.lit("# names"), F.lit("")))
    p.select(line.alias("value")).write.text(path)
    return readers.read_universe(spark, path)


@query("report_from_files", ORACLES["flow_alert_report"])
def report_from_files(spark, sf):
    """The alert report written as text and read back."""
    path = f"{run_folder(spark)}/report"
    rep = fp.flow_alert_report(spark, sf)
    write_report(rep, path)
    return spark.read.option("header", True).schema(rep.schema).csv(path)


@query("normalised_columns", with_(*RANKED, body=f"SELECT {DAY}, symbol, sector, {r('score', 'score')}, {r('value', 'value')}, 'ranked' AS kind FROM rk"))
def normalised_columns(spark, sf):
    """A table with the spellings of the input files, under the library's names again, with the kind its columns tell."""
    spelled = {v: k for k, v in reversed(ALIASES.items())}
    t = ad.ranked(spark, sf)
    t = t.withColumnsRenamed({c: spelled[c] for c in t.columns if c in spelled})
    return normalise_columns(t).select(F.date_format("as_of", "yyyy-MM-dd").alias("as_of"), "symbol", "sector", r6("score"), r6("value"), F.lit(table_kind(t)).alias("kind"))
