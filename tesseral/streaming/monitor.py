"""Conformance, activity and windows over unbounded samples with Structured Streaming.

Times are event times in a timestamp column; late rows are dropped by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tesseral.operators.joins import interval_join
from tesseral.plans.airspace import query_atom


def stream_conformance(samples: DataFrame, reserved: DataFrame) -> DataFrame:
    """A stream of on-route samples (flight_id, epoch_s, lat, lon, amsl_m) against stored reservations:
    each sample with inside.

    A flight holds each of its cells in merged intervals, so a sample meets at most one interval of its cell and the
    outer join keeps one row a sample; no state is needed.
    """
    asked = samples.withColumns(query_atom(F.col("lon"), F.col("lat"), F.col("amsl_m")))
    hits = interval_join(asked, reserved, ["flight_id", "x21", "y21", "h12"], "epoch_s", how="left")
    return hits.select(*asked.columns, F.col("i_start_s").isNotNull().alias("inside"))


def window_counts(events: DataFrame, time: str, seconds: int = 5, late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Events in each tumbling window, by key."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, f"{seconds} seconds"), *by).agg(F.count("*").alias("events"))
    return rows.select(F.unix_seconds("window.start").alias("start_s"), *by, "events")


def active_reservations(samples: DataFrame, announced: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Two streams: samples (flight_id, at) with the announced intervals (flight_id, from_at, to_at) that hold them.

    The watermarks and the bound on how long before its end an interval was announced let Spark forget old rows.
    """
    s = samples.withWatermark("at", late).alias("s")
    a = announced.withWatermark("from_at", late).alias("a")
    test = F.expr("s.flight_id = a.flight_id and s.at >= a.from_at and s.at < a.to_at and s.at <= a.from_at + interval 1 hour")
    return s.join(a, test).select("s.flight_id", "s.at", "a.from_at", "a.to_at")


def gaps(samples: DataFrame, time: str, longest_s: int, late: str = "10 minutes") -> DataFrame:
    """Pauses of more than longest_s seconds in each flight's samples, as they come: flight_id, from_s, to_s.

    The state of a flight is the time of its latest sample; it is dropped when event time has passed it by an hour.
    """

    def find(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        found = []
        for batch in batches:
            for t in sorted(int(x.timestamp()) for x in batch[time]):
                if last is not None and t - last > longest_s:
                    found.append((key[0], last, t))
                last = t if last is None else max(last, t)
        state.update((last,))
        state.setTimeoutTimestamp(max((last + 3600) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(found, columns=["flight_id", "from_s", "to_s"])

    rows = samples.withWatermark(time, late)
    return rows.groupBy("flight_id").applyInPandasWithState(find, "flight_id long, from_s long, to_s long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
