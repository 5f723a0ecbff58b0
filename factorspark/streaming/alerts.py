"""Flow alerts as sessions arrive: each symbol keeps what an alert looks back on, so no history is read again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factorspark.operators import flow as fl

#: What is kept of a symbol: the last session's date, volumes of its last ten sessions, open interest of the last five sessions that had any.
STATE = "last date, volumes array<double>, calls array<double>, puts array<double>"
EVENTS = "symbol string, d date, kind string, label string, trigger string, score double, total_volume long, rvol double"
OI_SESSIONS = 5


def _none(x) -> float | None:
    return None if x is None or pd.isna(x) else float(x)


def judge(row, volumes: list[float], calls: list, puts: list, min_score: float, min_volume: float, min_rvol: float) -> Iterator[tuple]:
    """The events of one session of a symbol, by the rules of ``flow.volume_spikes`` and ``flow.oi_builds``."""
    score, volume = _none(row.score), float(row.total_volume)
    mean = sum(volumes) / len(volumes) if volumes else 0.0
    rvol = volume / mean if mean > 0 else None
    if row.status == "OK" and score is not None and abs(score) >= min_score and volume >= min_volume and rvol is not None and rvol >= min_rvol:
        yield row.symbol, row.d, "SPIKE", "BULL FLOW" if score > 0 else "BEAR FLOW", None, score, int(volume), rvol
    if not row.has_oi:
        return
    call, put, rel = _none(row.call_oi), _none(row.put_oi), {}
    for k in (1, OI_SESSIONS):
        old = (calls[-k], puts[-k]) if len(calls) >= k else (None, None)
        known = None not in (call, put, *old)
        rel[k] = ((call - old[0]) - (put - old[1])) / (old[0] + old[1] + 1) if known else None
        if k == 1 and (None in old or old[0] + old[1] < fl.OI_MIN_BASE):
            return
    one = rel[1] is not None and abs(rel[1]) >= fl.OI_REL_1D
    if one or (rel[OI_SESSIONS] is not None and abs(rel[OI_SESSIONS]) >= fl.OI_REL_5D):
        label = "CALL BUILD" if rel[1] is not None and rel[1] > 0 else "PUT BUILD"
        yield row.symbol, row.d, "BUILD", label, "1-session" if one else "5-session", score, None, None


def flow_events(sessions: DataFrame, min_score: float = fl.SPIKE_SCORE, min_volume: float = fl.SPIKE_VOLUME, min_rvol: float = fl.SPIKE_RVOL) -> DataFrame:
    """Events of a stream of sessions ``(symbol, d, score, total_volume, call_oi, put_oi, status, has_oi)``.

    ``has_oi`` tells whether the session has open interest of any symbol. Every symbol has a row for every session, and sessions arrive in
    the order of their dates, any number in a batch; a session that isn't newer than the symbol's last one is a repeat and is skipped
    (corrections go through the ingest). A symbol's state is of fixed size, whatever the length of its history.
    """
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, volumes, calls, puts = state.get if state.exists else (None, [], [], [])
        volumes, calls, puts = list(volumes), list(calls), list(puts)
        out = []
        for row in pd.concat(list(parts)).sort_values("d").itertuples(index=False):
            if last is not None and row.d <= last:
                continue
            out.extend(judge(row, volumes, calls, puts, min_score, min_volume, min_rvol))
            last = row.d
            volumes = [*volumes, float(row.total_volume)][-fl.TRAIL_SESSIONS:]
            if row.has_oi:
                calls, puts = [*calls, _none(row.call_oi)][-OI_SESSIONS:], [*puts, _none(row.put_oi)][-OI_SESSIONS:]
        state.update((last, volumes, calls, puts))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])
    columns = ["symbol", "d", "score", "total_volume", "call_oi", "put_oi", "status", "has_oi"]
    return sessions.select(*columns).groupBy("symbol").applyInPandasWithState(run, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)


def start_alerts(sessions: DataFrame, path: str, progress: str, **limits: float) -> StreamingQuery:
    """Judge everything that has arrived and append its events to ``path``; states and progress are kept in ``progress``."""
    return (flow_events(sessions, **limits).writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", progress).trigger(availableNow=True).start())


def report(events: DataFrame, watchlist: DataFrame, holdings: DataFrame) -> DataFrame:
    """The sectioned report of ``flow.alert_report`` from the events of the stream."""
    spikes = events.where("kind = 'SPIKE'").withColumnRenamed("label", "direction")
    builds = events.where("kind = 'BUILD'")
    return fl.alert_report(spikes, builds, watchlist, holdings)
