"""SQL spellings of the source adapters, used as CTEs by the oracle queries."""

_KEYED = {
    "brand": ("p_brand", "lineitem JOIN part ON l_partkey = p_partkey"),
    "supplier": ("'S' || CAST(l_suppkey AS VARCHAR)", "lineitem"),
    "region": ("'R' || CAST(n_regionkey AS VARCHAR)",
               "lineitem JOIN supplier ON l_suppkey = s_suppkey "
               "JOIN nation ON s_nationkey = n_nationkey"),
    "nation": ("'SY' || chr(CAST(65 + s_nationkey AS INTEGER))", "lineitem JOIN supplier ON l_suppkey = s_suppkey"),
    "market": ("'MKT'", "lineitem"),
}


def bars(key: str = "supplier") -> str:
    sym, src = _KEYED[key]
    return f"""bars AS (
  SELECT {sym} AS symbol, CAST(l_shipdate AS DATE) AS d,
         max(l_extendedprice / l_quantity) AS high,
         min(l_extendedprice / l_quantity) AS low,
         sum(l_extendedprice) / sum(l_quantity) AS close,
         sum(l_quantity) AS volume
  FROM {src} GROUP BY 1, 2)"""


def score_history(key: str = "brand") -> str:
    sym, src = _KEYED[key]
    return f"""hist AS (
  SELECT {sym} AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS d,
         sum(l_extendedprice) / sum(l_quantity) / 100 AS score
  FROM {src} GROUP BY 1, 2)"""


FUNDAMENTALS = """fa AS (
  SELECT l_suppkey AS k, year(l_shipdate) AS yr, sum(l_extendedprice) AS market_cap,
         sum(l_extendedprice * (1 - l_discount)) AS total_revenue,
         sum(l_extendedprice * l_tax) AS total_debt,
         sum(l_extendedprice * l_discount * (1 - l_tax)) AS free_cashflow,
         sum(l_extendedprice * (1 - l_discount) * l_tax) AS ebit,
         avg(l_discount) AS ad, avg(l_tax) AS tv, avg(l_quantity) AS aq, count(*) AS nl,
         sum(l_extendedprice) / sum(l_quantity) AS price
  FROM lineitem GROUP BY 1, 2),
fund AS (
  SELECT 'S' || CAST(k AS VARCHAR) AS symbol, make_date(yr, 12, 31) AS as_of,
         r_name AS sector, n_name AS industry, s_name AS company_name, n_name AS country,
         CASE WHEN k % 7 <> 0 THEN aq * 0.8 END AS trailing_pe, ad * 60 AS price_to_book,
         CASE WHEN k % 5 <> 0 THEN aq * 0.5 END AS ev_to_ebitda, tv * 50 AS ev_to_revenue,
         free_cashflow, market_cap, total_revenue, total_debt, ebit, price,
         s_acctbal AS total_cash, total_debt * 0.2 AS interest_expense,
         total_revenue * 0.7 AS total_assets, total_revenue * 0.3 AS total_current_liabilities,
         tv * 2000 AS debt_to_equity, CASE WHEN k % 11 <> 0 THEN aq / 15 END AS current_ratio,
         ad * 3 AS return_on_equity, CASE WHEN k % 3 <> 0 THEN 1 - ad - tv END AS gross_margins,
         ad * 2.5 AS operating_margins, tv * 3 AS profit_margins,
         CASE WHEN k % 4 <> 0 THEN ad * 2 END AS revenue_growth, aq / 20 AS peg_ratio,
         price * (1 + ad * 4) AS target_mean_price,
         CASE WHEN k % 6 <> 0 THEN tv END AS dividend_yield, ad * 8 AS payout_ratio,
         aq * 100000 AS avg_volume_10d, CAST(nl * 1000000 AS DOUBLE) AS shares_outstanding,
         ad * 10 AS institutions_pct, nl % 13 AS num_analysts
  FROM fa JOIN supplier ON k = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey)"""

ESTIMATES = """ea AS (
  SELECT l_suppkey AS k, year(l_shipdate) AS yr, quarter(l_shipdate) AS qr,
         avg(l_discount) AS ad, avg(l_tax) AS tv FROM lineitem GROUP BY 1, 2, 3),
est AS (
  SELECT 'S' || CAST(k AS VARCHAR) AS symbol, make_date(yr, 12, 31) AS as_of,
         CASE qr WHEN 1 THEN '0q' WHEN 2 THEN '+1q' WHEN 3 THEN '0y' ELSE '+1y' END AS period,
         ad * 100 AS e_avg, tv * 120 AS e30, ad * 90 + 1 AS e60, tv * 125 AS e90,
         tv * 3 AS rev_growth
  FROM ea)"""



def dividends(key: str = "brand") -> str:
    sym, src = _KEYED[key]
    return f"""divs AS (
  SELECT {sym} AS symbol, CAST(l_shipdate AS DATE) AS ex_date,
         sum(l_tax * l_extendedprice / l_quantity) AS amount
  FROM {src} WHERE l_returnflag = 'A' GROUP BY 1, 2)"""


SURPRISES = """sur AS (
  SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS symbol, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS d,
         (avg(l_discount) - avg(l_tax)) * 1000 AS surprise_pct FROM lineitem GROUP BY 1, 2)"""

INSIDER = """ins AS (
  SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS d,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Purchase at market'
              WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'Sale at market'
              ELSE 'Stock gift' END AS text,
         l_extendedprice AS value, o_custkey AS filer, l_quantity AS shares
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

CONTRACTS = """oc AS (
  SELECT 'O:SY' || chr(CAST(65 + user_id % 20 AS INTEGER))
           || strftime(CAST(ts AS DATE) + CAST(event_id % 90 AS INTEGER), '%y%m%d')
           || CASE WHEN event_type IN ('click', 'purchase') THEN 'C'
                   WHEN event_type = 'view' THEN 'P' ELSE 'X' END
           || lpad(CAST((80 + user_id % 41) * 1000 AS VARCHAR), 8, '0') AS contract,
         CAST(ts AS DATE) AS d, CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume,
         value AS close,
         CAST(json_extract_string(props, '$.k') AS BIGINT) * 20 + event_id % 50 AS oi
  FROM events)"""

TX = """tx AS (
  SELECT CAST(l_suppkey % 10 AS INTEGER) AS portfolio, p_brand AS symbol,
         CASE WHEN l_suppkey % 10 = 3 AND l_linenumber = 1 AND p_brand LIKE '%5' THEN 'Dividend'
              WHEN l_returnflag = 'R' THEN 'Sell' ELSE 'Buy' END AS type,
         l_extendedprice / l_quantity AS price, l_quantity AS shares,
         CAST(l_shipdate AS DATE) AS d, l_tax * 10 AS commission,
         row_number() OVER (PARTITION BY l_suppkey % 10, p_brand ORDER BY l_shipdate,
           l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_tax
         ) AS seq
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def with_(*ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + body
