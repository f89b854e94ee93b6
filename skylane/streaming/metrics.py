"""Windowed request metrics and alerts over a stream of request-log rows.

Late rows: the watermark trails the newest row by ten minutes. A row older than that is dropped, and a
window is final, and emitted once, when the watermark passes its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skylane.functions.text import status_class
from skylane.operators.monitor import ALERTS, BUCKETS, Alert, _condition, _measures, bucket_counts

LATENESS = "10 minutes"


def windowed_counts(log: DataFrame, length: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Requests and latency buckets per window, method, path and status class."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        log.withWatermark("ts", LATENESS)
        .withColumn("status_class", status_class(F.col("status")))
        .groupBy(window.alias("window"), "method", "path", "status_class")
        .agg(F.count(F.lit(1)).alias("requests"), *bucket_counts(F.col("latency_ms") / 1000.0))
        .select(
            F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
            "method", "path", "status_class", "requests", *BUCKETS,
        )
    )


def merged_counts(log: DataFrame, length: str) -> DataFrame:
    """Requests and latency buckets of longer windows, merged from the minutes' buckets rather than from raw rows."""
    minutes = (
        log.withWatermark("ts", LATENESS)
        .withColumn("status_class", status_class(F.col("status")))
        .groupBy(F.window("ts", "1 minute"), "path", "status_class")
        .agg(F.count(F.lit(1)).alias("requests"), *bucket_counts(F.col("latency_ms") / 1000.0))
    )
    return (
        minutes.groupBy(F.window(F.window_time("window"), length), "path", "status_class")
        .agg(*[F.sum(c).alias(c) for c in ("requests", *BUCKETS)])
        .select(F.col("window.start").alias("window_start"), "path", "status_class", "requests", *BUCKETS)
    )


def windowed_evaluations(log: DataFrame, alert: Alert) -> DataFrame:
    """``alert, path, at_minute, value, breached`` of one alert, from windows that slide by a minute.

    A window without any row never forms in a stream, so silence is judged by the batch job only.
    """
    window = F.window("ts", f"{alert.window_minutes} minutes", "1 minute").alias("window")
    keys = [window, F.col("path")] if alert.per_path else [window]
    sums = log.withWatermark("ts", LATENESS).groupBy(*keys).agg(*_measures())
    value, breached = _condition(alert)
    path = F.col("path") if alert.per_path else F.lit("")
    return sums.select(
        F.lit(alert.name).alias("alert"),
        path.alias("path"),
        F.col("window.end").alias("at_minute"),
        value.cast("double").alias("value"),
        F.coalesce(breached, F.lit(False)).alias("breached"),
    ).where("value is not null")


# The conditions that a stream can judge; silence forms no window and is left to the batch job.
STREAMED = tuple(a for a in ALERTS if a.window_minutes == 5)
_SUMMED = ["requests", "errors", "client_errors", "routes", "failed_routes", *BUCKETS]


def all_windowed_evaluations(log: DataFrame) -> DataFrame:
    """Every streamed alert at every final minute: ``at`` (event time of the window), ``alert, path, at_minute, value, breached``.

    Two watermarked aggregations in one query. Raw rows are counted per minute and path and leave the state with their
    minute; the sliding windows are then summed from those few rows, once per path and once over all paths.
    """
    minutes = log.withWatermark("ts", LATENESS).groupBy(F.window("ts", "1 minute"), "path").agg(*_measures())
    labelled = minutes.withColumn("label", F.explode(F.array(F.col("path"), F.lit(None).cast("string"))))
    sliding = F.window(F.window_time("window"), "5 minutes", "1 minute")
    sums = labelled.groupBy(sliding, "label").agg(*[F.sum(c).alias(c) for c in _SUMMED])
    judged = []
    for alert in STREAMED:
        value, breached = _condition(alert)
        applies = F.col("label").isNotNull() == F.lit(alert.per_path)
        judged.append(F.when(applies, F.struct(F.lit(alert.name).alias("alert"), value.cast("double").alias("value"), F.coalesce(breached, F.lit(False)).alias("breached"))))
    rows = sums.withColumn("judged", F.explode(F.array_compact(F.array(*judged)))).where("judged.value is not null")
    return rows.select(
        F.window_time("window").alias("at"), "judged.alert", F.coalesce("label", F.lit("")).alias("path"),
        F.col("window.end").alias("at_minute"), "judged.value", "judged.breached",
    )


_HELD = "alert string, path string, at_minute timestamp, value double, since timestamp"
_MINUTE_US = 60_000_000
# The state store that keyed state with timers needs; set it on the session before a stream of held alerts starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Hold(StatefulProcessor):
    """Two timestamps per alert and path: the first minute of the unbroken run, and the last minute seen."""

    def __init__(self, holds: dict[str, int]):
        self.holds = holds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "since_us long, last_us long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        since, last = self.run.get() if self.run.exists() else (-1, -1)
        held = pd.concat(list(rows)).sort_values("at_minute")
        minutes = pd.to_datetime(held["at_minute"]).astype("datetime64[us]").astype("int64")
        breached = held["breached"].astype(bool)
        gap = minutes.diff().fillna(minutes.iloc[0] - last) != _MINUTE_US
        # A run begins where a breach follows a gap or a calm minute; the first row may go on with the run kept.
        begins = breached & (gap | ~breached.shift(fill_value=since >= 0))
        started = minutes.where(begins).ffill().fillna(since).astype("int64")
        fired = breached & (minutes - started >= self.holds[key[0]] * _MINUTE_US)
        self.run.update((int(started.iloc[-1]) if breached.iloc[-1] else -1, int(minutes.iloc[-1])))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # Once the watermark has passed the minute after the next, nothing can go on with this run.
        self.handle.registerTimer(int(minutes.iloc[-1]) // 1_000 + 2 * _MINUTE_US // 1_000)
        out = held[fired]
        yield pd.DataFrame(
            {"alert": key[0], "path": key[1], "at_minute": out["at_minute"], "value": out["value"], "since": pd.to_datetime(started[fired], unit="us")}
        )

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.run.clear()
        return iter([])

    def close(self) -> None:
        pass


def held_alerts(judged: DataFrame, holds: dict[str, int] | None = None) -> DataFrame:
    """Fire at every minute at which a condition has held for its alert's whole hold time (minutes, ``holds``).

    ``judged`` comes from ``all_windowed_evaluations``, in the same query: windows arrive final, those of one micro-batch
    in any order, those of a later one after them. A minute that is not breached, or missing, ends a run; an event-time
    timer drops the state of a path that falls silent. Needs the state store named in ``STATE_STORE``.
    """
    holds = holds or {a.name: a.hold_minutes for a in STREAMED}
    return judged.groupBy("alert", "path").transformWithStateInPandas(
        _Hold(holds), outputStructType=_HELD, outputMode="Append", timeMode="EventTime"
    )
