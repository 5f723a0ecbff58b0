"""Driver tables presented as the domain tables the operators take.

Every adapter first aggregates to the grain of its domain table with partial (map-side)
aggregation, so a key that owns a large share of the raw rows costs no more downstream
than any other. Only the columns used reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed_lines(spark: SparkSession, sf_dir: str, key: str, extra: list[str]) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        F.to_date("l_shipdate").alias("d"), *extra)
    if key == "brand":
        part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
        return li.join(part, li.l_partkey == part.p_partkey).withColumn("symbol", F.col("p_brand"))
    if key == "region":
        sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
        geo = sup.join(nat, sup.s_nationkey == nat.n_nationkey)
        return (li.join(geo, li.l_suppkey == geo.s_suppkey)
                .withColumn("symbol", F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))))
    if key == "nation":
        sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        return li.join(sup, li.l_suppkey == sup.s_suppkey).withColumn("symbol", F.concat(F.lit("SY"), F.chr((65 + F.col("s_nationkey")))))
    if key == "supplier":
        return li.withColumn("symbol", F.col("l_suppkey"))
    if key == "market":
        return li.withColumn("symbol", F.lit("MKT"))
    raise ValueError(f"unknown bar key {key}")


def bars(spark: SparkSession, sf_dir: str, key: str = "supplier") -> DataFrame:
    """``bars(symbol, d, high, low, close, volume)``: one row per symbol and ship date."""
    lines = _keyed_lines(spark, sf_dir, key, [])
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    out = lines.groupBy("symbol", "d").agg(
        F.max(unit).alias("high"),
        F.min(unit).alias("low"),
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"),
        F.sum("l_quantity").alias("volume"))
    if key == "supplier":
        out = out.withColumn("symbol", F.concat(F.lit("S"), F.col("symbol").cast("string")))
    return out


def region_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines under the region of their supplier as ``symbol``."""
    return _keyed_lines(spark, sf_dir, "region", [])


def closes(spark: SparkSession, sf_dir: str, key: str = "supplier") -> DataFrame:
    return bars(spark, sf_dir, key).select("symbol", "d", "close")


def score_history(spark: SparkSession, sf_dir: str, key: str = "brand") -> DataFrame:
    """Monthly ``(symbol, d, score, rank)`` with the month start as snapshot date."""
    lines = _keyed_lines(spark, sf_dir, key, [])
    out = (lines.groupBy("symbol", F.trunc("d", "month").alias("d"))
           .agg((F.sum("l_extendedprice") / F.sum("l_quantity") / 100).alias("score")))
    if key == "supplier":
        out = out.withColumn("symbol", F.concat(F.lit("S"), F.col("symbol").cast("string")))
    return out


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot per supplier and year built from line-item totals.

    A few keys get nulls on purpose so that the renormalising scores meet missing inputs.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        F.year("l_shipdate").alias("yr"))
    ext, disc, tax, qty = (F.col(c) for c in
                           ("l_extendedprice", "l_discount", "l_tax", "l_quantity"))
    agg = li.groupBy("l_suppkey", "yr").agg(
        F.sum(ext).alias("market_cap"),
        F.sum(ext * (1 - disc)).alias("total_revenue"),
        F.sum(ext * tax).alias("total_debt"),
        F.sum(ext * disc * (1 - tax)).alias("free_cashflow"),
        F.sum(ext * (1 - disc) * tax).alias("ebit"),
        F.avg(disc).alias("avg_disc"), F.avg(tax).alias("avg_tax"),
        F.avg(qty).alias("avg_qty"), F.count(F.lit(1)).alias("n_lines"),
        (F.sum(ext) / F.sum(qty)).alias("price"))
    return company_snapshots(agg, spark, sf_dir)


def company_snapshots(agg: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly totals by ``(l_suppkey, yr)`` as company snapshots with their attributes."""
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    reg = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    ref = (sup.join(nat, sup.s_nationkey == nat.n_nationkey)
           .join(reg, nat.n_regionkey == reg.r_regionkey))
    k = F.col("l_suppkey")
    return (agg.join(ref, agg.l_suppkey == ref.s_suppkey).select(
        F.concat(F.lit("S"), k.cast("string")).alias("symbol"),
        F.make_date(F.col("yr"), F.lit(12), F.lit(31)).alias("as_of"),
        F.col("r_name").alias("sector"), F.col("n_name").alias("industry"),
        F.col("s_name").alias("company_name"), F.col("n_name").alias("country"),
        F.when(k % 7 != 0, F.col("avg_qty") * 0.8).alias("trailing_pe"),
        (F.col("avg_disc") * 60).alias("price_to_book"),
        F.when(k % 5 != 0, F.col("avg_qty") * 0.5).alias("ev_to_ebitda"),
        (F.col("avg_tax") * 50).alias("ev_to_revenue"),
        "free_cashflow", "market_cap", "total_revenue", "total_debt", "ebit", "price",
        F.col("s_acctbal").alias("total_cash"),
        (F.col("total_debt") * 0.2).alias("interest_expense"),
        (F.col("total_revenue") * 0.7).alias("total_assets"),
        (F.col("total_revenue") * 0.3).alias("total_current_liabilities"),
        (F.col("avg_tax") * 2000).alias("debt_to_equity"),
        F.when(k % 11 != 0, F.col("avg_qty") / 15).alias("current_ratio"),
        (F.col("avg_disc") * 3).alias("return_on_equity"),
        F.when(k % 3 != 0, 1 - F.col("avg_disc") - F.col("avg_tax")).alias("gross_margins"),
        (F.col("avg_disc") * 2.5).alias("operating_margins"),
        (F.col("avg_tax") * 3).alias("profit_margins"),
        F.when(k % 4 != 0, F.col("avg_disc") * 2).alias("revenue_growth"),
        (F.col("avg_qty") / 20).alias("peg_ratio"),
        (F.col("price") * (1 + F.col("avg_disc") * 4)).alias("target_mean_price"),
        F.when(k % 6 != 0, F.col("avg_tax")).alias("dividend_yield"),
        (F.col("avg_disc") * 8).alias("payout_ratio"),
        (F.col("avg_qty") * 100000).alias("avg_volume_10d"),
        (F.col("n_lines") * 1000000).cast("double").alias("shares_outstanding"),
        (F.col("avg_disc") * 10).alias("institutions_pct"),
        (F.col("n_lines") % 13).cast("int").alias("num_analysts")))


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyst estimates per supplier, year and period as ``earnings`` structs.

    ``avg`` and its values 30, 60 and 90 days ago come from the quarters' average prices.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_discount", "l_tax",
        F.year("l_shipdate").alias("yr"), F.quarter("l_shipdate").alias("qr"))
    agg = li.groupBy("l_suppkey", "yr", "qr").agg(
        F.avg("l_discount").alias("ad"), F.avg("l_tax").alias("at"))
    return quarterly_estimates(agg.withColumn("symbol", F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))))


def quarterly_estimates(agg: DataFrame) -> DataFrame:
    """Quarterly means ``(symbol, yr, qr, ad, at)`` as the estimates of their year."""
    period = (F.when(F.col("qr") == 1, "0q").when(F.col("qr") == 2, "+1q")
              .when(F.col("qr") == 3, "0y").otherwise("+1y"))
    return agg.select(
        "symbol", F.make_date(F.col("yr"), F.lit(12), F.lit(31)).alias("as_of"), period.alias("period"),
        F.struct((F.col("ad") * 100).alias("avg"), (F.col("at") * 120).alias("d30"),
                 (F.col("ad") * 90 + 1).alias("d60"), (F.col("at") * 125).alias("d90")
                 ).alias("earnings"),
        (F.col("at") * 3).alias("revenue_growth"))


def dividends(spark: SparkSession, sf_dir: str, key: str = "brand") -> DataFrame:
    """``dividends(symbol, ex_date, amount)`` from the lines flagged A, per key and day."""
    lines = _keyed_lines(spark, sf_dir, key, ["l_tax", "l_returnflag"])
    out = (lines.where(F.col("l_returnflag") == "A").groupBy("symbol", F.col("d").alias("ex_date"))
           .agg(F.sum(F.col("l_tax") * F.col("l_extendedprice") / F.col("l_quantity")
                      ).alias("amount")))
    if key == "supplier":
        out = out.withColumn("symbol", F.concat(F.lit("S"), F.col("symbol").cast("string")))
    return out


def surprises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(symbol, d, surprise_pct)`` per supplier and quarter."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_discount", "l_tax", F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("d"))
    return li.groupBy("l_suppkey", "d").agg(
        ((F.avg("l_discount") - F.avg("l_tax")) * 1000).alias("surprise_pct")).select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), "d", "surprise_pct")


def insider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``insider(symbol, d, text, value, filer, shares)`` from orders and their lines."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_extendedprice", "l_quantity",
        F.to_date("l_shipdate").alias("d"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    p = F.col("o_orderpriority")
    text = (F.when(p.isin("1-URGENT", "2-HIGH"), "Purchase at market")
            .when(p.isin("4-NOT SPECIFIED", "5-LOW"), "Sale at market")
            .otherwise("Stock gift"))
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), "d",
        text.alias("text"), F.col("l_extendedprice").alias("value"),
        F.col("o_custkey").alias("filer"), F.col("l_quantity").alias("shares"))


def option_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``option_day(contract, d, volume, close, oi)`` encoded from the event stream."""
    ev = table(spark, sf_dir, "events")
    u = F.col("user_id") % 20
    d = F.to_date("ts")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = (F.when(F.col("event_type").isin("click", "purchase"), "C")
            .when(F.col("event_type") == "view", "P"))
    expiry = F.date_add(d, (F.col("event_id") % 90).cast("int"))
    strike = (80 + F.col("user_id") % 41) * 1000
    contract = F.concat(
        F.lit("O:"), F.concat(F.lit("SY"), F.chr((65 + u))), F.date_format(expiry, "yyMMdd"),
        F.coalesce(kind, F.lit("X")), F.lpad(strike.cast("string"), 8, "0"))
    return ev.select(contract.alias("contract"), d.alias("d"), k.cast("long").alias("volume"),
                     F.col("value").alias("close"),
                     (k * 20 + F.col("event_id") % 50).cast("long").alias("oi"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tx(portfolio, symbol, type, price, shares, d, commission, <tie-break keys>)``.

    The order of trades inside a day is fixed by the line's own keys; ``(order, line)``
    alone is not unique, so all the distinguishing columns are carried as ``seq`` struct.
    """
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    manual = (F.col("l_suppkey") % 10 == 3) & (F.col("l_linenumber") == 1) & F.col("p_brand").endswith("5")
    kind = F.when(manual, "Dividend").when(F.col("l_returnflag") == "R", "Sell").otherwise("Buy")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        (F.col("l_suppkey") % 10).cast("int").alias("portfolio"),
        F.col("p_brand").alias("symbol"), kind.alias("type"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("shares"), F.to_date("l_shipdate").alias("d"),
        (F.col("l_tax") * 10).alias("commission"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                 "l_extendedprice", "l_tax").alias("tx_seq"))


def unit_price() -> Column:
    return F.col("l_extendedprice") / F.col("l_quantity")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unranked yearly snapshots with a score, six factor columns (some null) and attributes."""
    f = fundamentals(spark, sf_dir)
    return f.select("as_of", "symbol", "sector", "industry", (F.col("price") / 100).alias("score"),
                    F.col("price_to_book").alias("value"), F.col("return_on_equity").alias("quality"),
                    F.col("ev_to_revenue").alias("technical"), F.col("trailing_pe").alias("momentum"),
                    F.col("revenue_growth").alias("growth"), F.col("current_ratio").alias("stability"))


def option_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Underlying ``(symbol, d, close)`` for 25 symbols; every seventh day of one is missing."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    u = F.col("user_id") % 25
    d = F.to_date("ts")
    rows = ev.where(~((u == 3) & (F.dayofmonth(d) % 7 == 0)))
    return rows.groupBy(F.concat(F.lit("SY"), F.chr((65 + u))).alias("symbol"), d.alias("d")).agg(
        (100 + (F.avg(k) - 50) / 10).alias("close"))


def option_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted symbols: one per nation."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("SY"), F.chr((65 + F.col("n_nationkey")))).alias("symbol"))
