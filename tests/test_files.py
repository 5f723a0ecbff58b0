"""Readers, sinks, contract parsing, session merge and the stream."""

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from factorspark.operators import flow as fl
from factorspark.operators import regimes as rg
from factorspark.operators.selection import table_kind
from factorspark.sources import readers, schemas
from factorspark.sources.sinks import write_ranked, write_report
from factorspark.streaming import alerts, ingest


def test_ranked_lists_by_file_name(spark, tmp_path):
    head = "Ticker,CompanyName,Country,Score,Value,Quality,FinancialHealth,Technical,Insider,Momentum,Stability,Size,OptionsFlow,Liquidity,Carry,Growth,Sector,Industry"
    for day, score in (("20231231", 1), ("20240105", 2), ("20240301", 3)):
        (tmp_path / f"top_ranked_stocks_Steady_Growth_{day}.csv").write_text(f"{head}\nAAA,A,US,{score}" + ",0" * 12 + ",Tech,Soft\n")
    out = readers.read_ranked(spark, str(tmp_path), "Steady_Growth", "2024-01-01", "2024-12-31").orderBy("seq").collect()
    assert [(r["symbol"], str(r["snapshot_date"]), r["seq"], r["score"]) for r in out] == [
        ("AAA", "2024-01-05", 0, 2.0), ("AAA", "2024-03-01", 1, 3.0)]


def test_universe_and_portfolio(spark, tmp_path):
    (tmp_path / "u.txt").write_text("# note\naapl\n\n MSFT \nAAPL\n")
    assert sorted(r[0] for r in readers.read_universe(spark, str(tmp_path / "u.txt")).collect()) == ["AAPL", "MSFT"]
    folder = tmp_path / "p"
    folder.mkdir()
    for name, t in (("portfolio_20240101.json", ["old"]), ("portfolio_20240201.json", [" abc ", "x"]), ("portfolio_template.json", ["t"])):
        (folder / name).write_text(json.dumps({"tickers": t, "shares": {"x": 3}}))
    out = {r["symbol"]: r["shares"] for r in readers.read_portfolio(spark, str(folder)).collect()}
    assert out == {"ABC": None, "X": 3.0}


def test_transactions_skip_bad_numbers(spark, tmp_path):
    tx = [{"ticker": "a ", "type": "buy", "price": "5", "shares": 2, "date": "2024-01-02", "commission": 1},
          {"ticker": "b", "type": "Sell", "price": "oops", "shares": 2, "date": "2024-01-02"}, {"ticker": "c", "price": 1, "shares": 1}]
    (tmp_path / "t.json").write_text(json.dumps({"transactions": tx}))
    out = readers.read_transactions(spark, str(tmp_path / "t.json"), default_date="2024-05-05").orderBy("tx_seq").collect()
    assert [(r["symbol"], r["type"], r["price"], str(r["d"]), r["commission"]) for r in out] == [
        ("A", "Buy", 5.0, "2024-01-02", 1.0), ("C", "Buy", 1.0, "2024-05-05", 0.0)]


def test_option_day_gzip_and_contracts(spark, tmp_path):
    body = "ticker,volume,open,close,high,low,window_start,transactions\n" + "\n".join(
        f"{c},10,1,2,3,1,0,1" for c in ("O:ABC240619C00150000", "O:BRK.B240619P00012500", "O:ABC1240619C00150000", "O:ABC249919C00150000", "ABC", "O:C00150000"))
    with gzip.open(tmp_path / "2024-06-03.csv.gz", "wt") as f:
        f.write(body)
    out = fl.parse_contracts(readers.read_option_day(spark, str(tmp_path / "*.csv.gz"))).orderBy("root").collect()
    assert [(r["root"], str(r["expiry"]), r["kind"], r["strike"]) for r in out] == [
        ("ABC", "2024-06-19", "C", 150.0), ("ABC1", "2024-06-19", "C", 150.0), ("BRK.B", "2024-06-19", "P", 12.5)]


def test_write_ranked_skips_then_overwrites(spark, tmp_path):
    path = str(tmp_path / "ranked")
    day = dt.date(2024, 1, 1)
    make = lambda score: spark.createDataFrame([("R", day, "A", score)], "regime string, snapshot_date date, symbol string, score double")
    write_ranked(make(1.0), path)
    write_ranked(make(2.0), path)
    assert [r["score"] for r in spark.read.parquet(path).collect()] == [1.0]
    write_ranked(make(3.0), path, overwrite=True)
    assert [r["score"] for r in spark.read.parquet(path).collect()] == [3.0]
    write_report(make(1.0), str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 1
    assert table_kind(make(1.0)) == "ranked"


def flow_rows(spark, rows):
    df = spark.createDataFrame(rows, "symbol string, d date, total_volume long, call_oi long, source_seq int")
    names = [c.split()[0] for c in schemas.FLOW.split(", ")]
    types = dict(c.split() for c in schemas.FLOW.split(", "))
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in names])


def test_stream_in_parts_equals_one_batch(spark, tmp_path):
    d = dt.date(2024, 1, 2)
    rows = [("A", d, 10, None, 0), ("A", d, 11, 5, 1), ("A", d, 12, None, 2), ("B", d, 1, None, 0),
            ("A", dt.date(2024, 1, 3), 7, None, 1), ("A", dt.date(2024, 1, 3), 8, None, 0)]
    want = {(r["symbol"], r["d"], r["total_volume"]) for r in fl.dedupe_sessions(flow_rows(spark, rows)).collect()}
    assert want == {("A", d, 11), ("A", dt.date(2024, 1, 3), 8)}
    for k, part in enumerate((rows[:2], rows[2:4], rows[4:], rows[:2])):    # the last file repeats the first
        flow_rows(spark, part).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    for _ in range(2):
        stream = ingest.session_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
        ingest.start_ingest(stream, str(tmp_path / "table"), str(tmp_path / "ckpt")).awaitTermination()
    got = {(r["symbol"], r["d"], r["total_volume"]) for r in ingest.sessions_table(spark, str(tmp_path / "table")).collect()}
    assert got == want


def test_ingest_backfill_correction_and_split_source(spark, days, tmp_path):
    """An older date after newer ones, a corrected file, and a source whose open interest comes in a later batch."""
    new, old = dt.date(2026, 6, 3), dt.date(2024, 1, 2)
    batches = [[("A", new, 10, None, 0), ("A", new, 20, 4, 1)], [("A", old, 5, None, 0)], [("A", new, 21, 4, 1)],
               [("B", old, 7, None, 2), ("B", old, 6, 3, 1)], [("C", old, 8, 2, 2)]]
    for k, part in enumerate(batches):
        flow_rows(spark, part).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        stream = ingest.session_stream(spark, str(tmp_path / f"in{k}"))
        ingest.start_ingest(stream, str(tmp_path / "table"), str(tmp_path / f"ckpt{k}")).awaitTermination()
    final = [r for b in batches for r in b if r != ("A", new, 20, 4, 1)]
    want = {(r["symbol"], r["d"], r["total_volume"]) for r in fl.dedupe_sessions(flow_rows(spark, final)).collect()}
    got = {(r["symbol"], r["d"], r["total_volume"]) for r in ingest.sessions_table(spark, str(tmp_path / "table")).collect()}
    assert got == want and any(g[1] == old for g in got) and ("A", new, 21) in got


def test_readers_see_a_version_whole_or_not_at_all(spark, days, tmp_path, monkeypatch):
    """A writer that stops after its files, before they are published, leaves the old version; the next try replaces what it left."""
    table = str(tmp_path / "table")

    def seen():
        return {(r["symbol"], r["d"], r["total_volume"]) for r in ingest.sessions_table(spark, table).collect()}
    assert seen() == set()
    ingest.merge_sessions(flow_rows(spark, [("A", days(0), 10, None, 0), ("B", days(1), 3, 1, 0)]), table)
    old = seen()
    assert old == {("A", days(0), 10), ("B", days(1), 3)}
    change = flow_rows(spark, [("A", days(0), 99, 5, 1), ("C", days(2), 7, 1, 0)])

    def stop(*_):
        raise OSError("the writer is gone")
    with monkeypatch.context() as m:
        m.setattr(ingest, "publish", stop)
        with pytest.raises(OSError):
            ingest.merge_sessions(change, table)
    assert seen() == old
    ingest.merge_sessions(change, table)
    assert seen() == {("A", days(0), 99), ("B", days(1), 3), ("C", days(2), 7)}
    ingest.merge_sessions(change, table)        # a repeated batch changes nothing
    assert seen() == {("A", days(0), 99), ("B", days(1), 3), ("C", days(2), 7)}


def test_alerts_from_state_equal_alerts_from_history(spark, days, tmp_path):
    """Sessions one by one, a repeated one among them, with gaps in the open interest."""
    import random
    r = random.Random(4)
    rows = [(s, days(t), r.choice([None, -0.9, -0.3, 0.5, 0.9]), r.choice([0, 400, 600, 5000]), None if t % 4 == 2 else r.choice([None, 2000, 4000, 9000]),
             None if t % 4 == 2 else r.choice([3000, 5000, 8000]), r.choice(["OK", "OK", "LOW_VOLUME"])) for t in range(24) for s in "AB"]
    flow = spark.createDataFrame(rows, "symbol string, d date, score double, total_volume long, call_oi long, put_oi long, status string")
    whole = fl.session_numbers(flow).persist()
    kept = whole.select("symbol", "d", "score", "total_volume", "call_oi", "put_oi", "status", "has_oi")
    for cut in (range(9), range(9, 10), range(9, 10), range(10, 24)):
        kept.where(kept.d.isin([days(t) for t in cut])).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kept.schema).parquet(str(tmp_path / "in"))
        alerts.start_alerts(stream, str(tmp_path / "events"), str(tmp_path / "progress"), min_rvol=1.5).awaitTermination()
    events = spark.read.schema(alerts.EVENTS).parquet(str(tmp_path / "events"))
    spikes = {(x["symbol"], x["d"], x["direction"], x["total_volume"], round(x["rvol"], 9)) for x in fl.volume_spikes(fl.relative_volume(whole), min_rvol=1.5).collect()}
    builds = {(x["symbol"], x["d"], x["label"], x["trigger"]) for x in fl.oi_builds(fl.oi_changes(whole)).collect()}
    got = events.collect()
    assert len(got) == len(spikes) + len(builds) and spikes and builds
    assert {(x["symbol"], x["d"], x["label"], x["total_volume"], round(x["rvol"], 9)) for x in got if x["kind"] == "SPIKE"} == spikes
    assert {(x["symbol"], x["d"], x["label"], x["trigger"]) for x in got if x["kind"] == "BUILD"} == builds


def test_ingest_calls_the_hook_with_each_batch(spark, days, tmp_path):
    seen = []
    flow_rows(spark, [("A", days(0), 10, None, 0), ("B", days(0), 3, 1, 0)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    ingest.start_ingest(ingest.session_stream(spark, str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / "ckpt"),
                        after=lambda b: seen.append({r["symbol"] for r in b.collect()})).awaitTermination()
    assert seen == [{"A", "B"}]


def test_overlapping_periods_first_wins(spark, days):
    p = spark.createDataFrame([("Late", days(0), days(9), 2), ("First", days(5), days(20), 1)],
                              "regime_name string, start_date date, end_date date, period_seq int")
    q = spark.createDataFrame([(days(2),), (days(7),), (days(20),), (days(21),)], "d date")
    out = [r["regime_name"] for r in rg.regime_for_dates(q, p).orderBy("d").collect()]
    assert out == ["Late", "First", "First", None]


@pytest.mark.parametrize("gap,n", [(5, 1), (6, 2)])
def test_gap_periods(spark, days, gap, n):
    df = spark.createDataFrame([("S", days(0), 1), ("S", days(gap), 1)], "symbol string, d date, regime int")
    assert rg.gap_periods(df).count() == n


def test_session_status(spark, days):
    d = days(0)
    c = [("A", 99, "C"), ("B", 100, "C")]
    contracts = spark.createDataFrame([(s, d, days(10), k, 100.0, v, 1.0, 5) for s, v, k in c],
                                      "root string, d date, expiry date, kind string, strike double, volume long, close double, oi long")
    px = spark.createDataFrame([(s, d, 100.0) for s in "ABC"], "symbol string, d date, close double")
    u = spark.createDataFrame([(s,) for s in "ABCD"], "symbol string")
    out = {r["symbol"]: r["status"] for r in fl.score_sessions(contracts, px, u).collect()}
    assert out == {"A": "LOW_VOLUME", "B": "OK", "C": "NO_OPTIONS", "D": "NO_PRICE"}
