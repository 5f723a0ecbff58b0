"""What the factor history keeps on disk: slices of suppliers, nothing but short tables between them."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from factorspark.operators import asof
from factorspark.plans import scoring
from factorspark.session import ensure_checkpoint_dir, release_shared
from factorspark.sources import adapters as ad
from factorspark.sources import lattice as lt

SF = "/root/testdata/sf0.001"


def shuffled(spark):
    """Bytes of each shuffle file."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f: os.path.getsize(os.path.join(at, f)) for d in folders for at, _, files in os.walk(str(d)) for f in files if f.startswith("shuffle_")}


def left(spark, before):
    """Bytes of the shuffle files that are new; a count of a table leaves some of its own."""
    return sum(n for f, n in shuffled(spark).items() if f not in before)


def size(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def rows(df):
    names = sorted(df.columns)
    return sorted(([str(v) for v in r if not isinstance(v, float)], [v for v in r if isinstance(v, float)]) for r in df.select(*names).collect())


def test_slices_leave_short_tables_and_the_same_factors(spark, monkeypatch):
    release_shared()
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before, cells, held = set(os.listdir(folder)), [], []
    cached, files = spark.sparkContext._jsc.getPersistentRDDs().size(), shuffled(spark)

    def written(df, label, plain=lt.written):
        out = plain(df, label)
        cells.append(size(out.written_in.removeprefix("file:")))
        held.append(sum(x.startswith("cells-") for x in os.listdir(folder)))
        return out
    monkeypatch.setattr(lt, "written", written)
    sliced = scoring.snapshot_factors(spark, SF, False, slice_lines=2500)
    assert len(cells) == 3 and held == [1, 1, 1] and max(cells) < 0.8 * sum(cells)      # one slice lies on disk at a time
    tables = sorted(x.split("-")[0] for x in set(os.listdir(folder)) - before if not x.startswith("run"))
    assert tables == ["insiders", "market", "snapshots", "snapshots", "snapshots"]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached and left(spark, files) < 5000
    a, b = rows(sliced), rows(scoring.factor_history(spark, SF))
    assert len(a) > 100 and [x for x, _ in a] == [x for x, _ in b]
    for (key, x), (_, y) in zip(a, b):
        assert x == pytest.approx(y, rel=1e-9, abs=1e-9), key
    release_shared()
    assert not {x for x in set(os.listdir(folder)) - before if x.split("-")[0] in ("insiders", "market", "snapshots", "cells")}


def test_every_supplier_is_in_one_slice(spark):
    slices, tasks = lt.supplier_slices(spark, SF, 1000)
    assert len(slices) == 6 and tasks >= 1
    keys = spark.createDataFrame([(k,) for k in (*range(50), -1, None)], "l_suppkey long")
    assert sorted(str(r[0]) for s in slices for r in keys.where(s).collect()) == sorted(str(r[0]) for r in keys.collect())


def test_lines_are_exchanged_once_for_the_cells(spark, monkeypatch):
    """By supplier and quarter, so that a supplier with most of the lines is dealt over many tasks."""
    plans = []
    monkeypatch.setattr(lt, "written", lambda df, label: plans.append(df) or df)
    lt.supplier_cells(spark, SF, tasks=40)
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "_quarter" in plan
    hot = spark.range(20_000).select(F.lit(7).alias("l_suppkey"), F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") % 2000).cast("int")).alias("d"))
    dealt = hot.withColumn("_quarter", F.trunc("d", "quarter")).repartition(40, "l_suppkey", "_quarter")
    assert max(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()) < 6000


def test_a_symbol_may_lie_in_several_batches(spark):
    r = random.Random(3)
    day = [dt.date(2021, 1, 1) + dt.timedelta(days=k) for k in range(400)]
    bars, price = [], 50.0
    for s, n in (("A", 300), ("B", 5), ("C", 120)):
        for d in sorted(r.sample(day, n)):
            price *= 1 + r.gauss(0, 0.03)
            bars.append((s, d, price * 1.02, price * 0.98, None if r.random() < 0.02 else price))
    bars = spark.createDataFrame(bars, "symbol string, d date, high double, low double, close double")
    market = spark.createDataFrame([(d, 100 + r.random()) for d in day], "d date, close double")
    snaps = asof.with_until(spark.createDataFrame([(s, day[k]) for s in "ABCD" for k in (0, 60, 61, 250, 399)], "symbol string, as_of date"))
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, got = spark.conf.get(most), []
    for n in ("100000", "7"):
        spark.conf.set(most, n)
        try:
            got.append(sorted(map(str, asof.bar_states(bars, market, snaps, 2).collect())))
        finally:
            spark.conf.set(most, before)
    assert len(got[0]) == 20 and got[0] == got[1] and sum("stability=None" in x for x in got[0]) < 12


def test_regions_and_insiders_come_slice_by_slice(spark):
    """A join that moves the lines, to their suppliers or orders, holds a part of them at a time."""
    release_shared()
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    files, before = shuffled(spark), set(os.listdir(folder))
    sliced = lt.region_bars(spark, SF, 500)
    assert sum(x.startswith("regions-") for x in set(os.listdir(folder)) - before) == 3 and left(spark, files) < 5000
    got, want = rows(sliced), rows(ad.bars(spark, SF, "region"))
    assert [x for x, _ in got] == [x for x, _ in want]
    for (key, x), (_, y) in zip(got, want):
        assert x == pytest.approx(y, rel=1e-12), key
    seen = rows(scoring.snapshot_factors(spark, SF, True, slice_lines=1000).select("symbol", "as_of", "regime", "insider"))
    assert sum(x.startswith("insiders-") for x in set(os.listdir(folder)) - before) == 2
    plain = rows(scoring.factor_table(spark, SF).select("symbol", "as_of", "regime", "insider"))
    assert len(seen) == 30 and [x for x, _ in seen] == [x for x, _ in plain]
    assert [x for _, x in seen] == [pytest.approx(x, rel=1e-9) for _, x in plain]
    release_shared()
