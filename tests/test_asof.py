"""Running states at snapshots against the same measures on histories cut off at each snapshot."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from factorspark.operators import asof
from factorspark.operators import factors as fa
from factorspark.operators import indicators as ind
from factorspark.session import release_shared
from factorspark.sources import adapters as ad
from factorspark.sources import lattice as lt

SF = "/root/testdata/sf0.001"
DAY = dt.date(2021, 1, 1)


def walk(seed, n, gap):
    r = random.Random(seed)
    x, d, out = 100.0, DAY, []
    for _ in range(n):
        d += dt.timedelta(days=1 + (r.random() < gap))
        x *= math.exp(r.gauss(0, 0.02))
        out.append((d, x * 1.01, x * 0.99, x))
    return out


@pytest.fixture(scope="module")
def history(spark):
    bars = [(s, *row) for s, n, gap in (("A", 620, 0.1), ("B", 330, 0.5), ("C", 40, 0.0), ("D", 1, 0.0)) for row in walk(n, n, gap)]
    market = [(d, c) for d, _, _, c in walk(99, 900, 0.0)]
    dates = [DAY + dt.timedelta(days=k) for k in (-5, 1, 2, 30, 150, 151, 200, 290, 400, 401, 555, 700, 1500)]
    snaps = [(s, d) for s in "ABCDE" for d in dates]
    return (spark.createDataFrame(bars, "symbol string, d date, high double, low double, close double"),
            spark.createDataFrame(market, "d date, close double"),
            spark.createDataFrame(snaps, "symbol string, as_of date"))


def cut(rows, snaps, date):
    """Brute force: a copy of the history for each snapshot, under a symbol of its own."""
    tag = F.concat_ws("@", "symbol", F.date_format("as_of", "yyyy-MM-dd"))
    return rows.join(snaps, "symbol").where(F.col(date) <= F.col("as_of")).withColumn("symbol", tag).drop("as_of")


def close_to(a, b):
    return (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)


def test_bar_states_equal_cut_histories(history):
    bars, market, snaps = history
    got = {(r["symbol"], r["as_of"]): r for r in asof.bar_states(bars, market, asof.with_until(snaps)).collect()}
    assert len(got) == snaps.count()
    old = cut(bars, snaps, "d").persist()
    tech = {r["symbol"]: r for r in ind.technical_score(old).collect()}
    stab = {r["symbol"]: r for r in fa.stability_factor(old, market.withColumn("symbol", F.lit("M"))).collect()}
    assert len(tech) > 30 and any(r["technical"] for r in tech.values())
    for (s, d), r in got.items():
        tag = f"{s}@{d}"
        assert (r["n_bars"] == 0) == (tag not in tech)
        for name, want in (("technical", tech), ("momentum_12m", tech), ("stability", stab)):
            assert close_to(r[name], want[tag][name] if tag in want else None), (tag, name)
    release_shared()


def test_until_lets_a_snapshot_know_more(history):
    bars, market, snaps = history
    last = snaps.groupBy("symbol").agg(F.min("as_of").alias("as_of"))
    got = {r["symbol"]: r["n_bars"] for r in asof.bar_states(bars, market, asof.with_until(last, F.lit("9999-12-31").cast("date"))).collect()}
    assert got == {"A": 620, "B": 330, "C": 40, "D": 1, "E": 0}
    release_shared()


def test_dividends_and_surprises_as_of(spark, history):
    snaps = history[2]
    r = random.Random(5)
    divs = sorted({(s, DAY + dt.timedelta(days=r.randrange(1400))): None for s in "AB" for _ in range(60)})
    divs = spark.createDataFrame([(s, d, r.choice([0.0, 0.5, 1.25])) for s, d in divs], "symbol string, ex_date date, amount double")
    sur = spark.createDataFrame([(s, DAY + dt.timedelta(days=91 * k), r.choice([None, 1.0, -2.0, 3.5])) for s in "AC" for k in range(16)],
                                "symbol string, d date, surprise_pct double")
    got = asof.last_known([(asof.dividend_states(divs), "ex_date", ["dividend_cagr", "streak"]), (asof.surprise_states(sur), "d", ["mean_surprise"])],
                          asof.with_until(snaps)).collect()
    paid = {x["symbol"]: x for x in fa.dividend_history(cut(divs, snaps, "ex_date")).collect()}
    recent = {}
    for x in sorted(cut(sur, snaps, "d").where("surprise_pct IS NOT NULL").collect(), key=lambda x: x["d"]):
        recent.setdefault(x["symbol"], []).append(x["surprise_pct"])
    assert len(got) == snaps.count() and len(paid) > 5
    for x in got:
        tag = f"{x['symbol']}@{x['as_of']}"
        want = paid.get(tag)
        assert x["streak"] == (want["streak"] if want else None), tag
        assert close_to(x["dividend_cagr"], want["dividend_cagr"] if want else None), tag
        last = recent.get(tag, [])[-4:]
        assert close_to(x["mean_surprise"], sum(last) / len(last) if last else None), tag


def test_lattice_equals_adapters(spark):
    cells = lt.supplier_cells(spark, SF)

    def flat(v):
        return [y for x in v for y in flat(x)] if isinstance(v, tuple) else [v]

    def keyed(df, names):       # sums are added up in another order: floats are compared apart from what identifies a row
        return sorted(([str(x) for x in r if not isinstance(x, float)], [x for x in r if isinstance(x, float)])
                      for r in (flat(tuple(row)) for row in df.select(*names).collect()))
    for got, want in ((lt.bars(cells), ad.bars(spark, SF)), (lt.market_bars(cells), ad.bars(spark, SF, "market")),
                      (lt.fundamentals(cells, spark, SF), ad.fundamentals(spark, SF)), (lt.estimates(cells), ad.estimates(spark, SF)),
                      (lt.surprises(cells), ad.surprises(spark, SF)), (lt.dividends(cells), ad.dividends(spark, SF, "supplier"))):
        a, b = keyed(got, want.columns), keyed(want, want.columns)
        assert [x for x, _ in a] == [x for x, _ in b]
        for (key, x), (_, y) in zip(a, b):
            assert x == pytest.approx(y, rel=1e-9, abs=1e-9), key
    release_shared()
