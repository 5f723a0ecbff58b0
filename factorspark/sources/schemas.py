"""Declared schemas of the input files."""

from __future__ import annotations

BARS = "symbol string, d timestamp, open double, high double, low double, close double, adjclose double, volume double"
OPTION_DAY = "ticker string, volume long, open double, close double, high double, low double, window_start long, transactions long"
RANKED = ("Ticker string, CompanyName string, Country string, Score double, Value double, Quality double, FinancialHealth double, "
          "Technical double, Insider double, Momentum double, Stability double, Size double, OptionsFlow double, Liquidity double, "
          "Carry double, Growth double, Sector string, Industry string")
TX_JSON = ("ticker string, type string, price string, shares string, date string, commission string")
PORTFOLIO_JSON = "tickers array<string>, shares map<string,double>"
FLOW = ("symbol string, d date, score double, imbalance_notional double, imbalance_oi double, call_volume long, put_volume long, "
        "total_volume long, call_oi long, put_oi long, underlying_price double, contracts long, status string, source_seq int")
PERIODS = ("regime int, regime_name string, start_date date, end_date date, days int, mean_return double, volatility double, sharpe double")
INSIDER = "symbol string, d date, text string, value double, filer string, shares double"
DIVIDENDS = "symbol string, ex_date date, amount double"
ESTIMATES = ("symbol string, as_of date, period string, earnings struct<avg:double,d30:double,d60:double,d90:double>, "
             "revenue_growth double")
