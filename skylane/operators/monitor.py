"""Request metrics and alert conditions over a request log.

The log has ``ts, service, path, method, status, latency_ms`` and, for routes, ``algorithm``.

Windows slide by a minute. Raw rows are first counted per minute, with partial aggregation before the
shuffle; windows are then summed from those few minute rows rather than from copies of raw rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylane.functions.text import status_class

# Upper bounds of the latency buckets in seconds, and the alert limits.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
ERROR_SHARE = 0.05
CLIENT_ERROR_SHARE = 0.2
ROUTE_FAILURE_SHARE = 0.1
LATENCY_P95_SECONDS = 1.0
LOW_TRAFFIC_PER_SECOND = 0.01


@dataclass(frozen=True)
class Alert:
    name: str
    window_minutes: int
    hold_minutes: int
    per_path: bool = False


ALERTS = (
    Alert("HighErrorRate", 5, 5),
    Alert("HighLatency", 5, 10, per_path=True),
    Alert("HighRouteFailureRate", 5, 15),
    Alert("Elevated4xxRate", 5, 15),
    Alert("LowTraffic", 30, 30),
    Alert("NoRoutesCalculated", 60, 60),
)


def with_status_class(log: DataFrame) -> DataFrame:
    return log.withColumn("status_class", status_class(F.col("status")))


def request_counts(log: DataFrame, *labels: str, window: str | None = None) -> DataFrame:
    """Requests per label combination, per tumbling window when one is given."""
    keys = [F.col(c) for c in labels]
    if window is not None:
        keys = [F.window("ts", window)["start"].alias("window_start"), *keys]
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"))


def bucket_counts(seconds: Column) -> list[Column]:
    """Cumulative bucket columns ``le_0 ... le_n`` of a latency; the last one counts everything."""
    counted = [F.count_if(seconds <= b).alias(f"le_{i}") for i, b in enumerate(LATENCY_BOUNDS)]
    return [*counted, F.count(seconds).alias(f"le_{len(LATENCY_BOUNDS)}")]


BUCKETS = [f"le_{i}" for i in range(len(LATENCY_BOUNDS) + 1)]


def histogram_quantile(q: float) -> Column:
    """Quantile from cumulative bucket columns, linear within a bucket.

    Beyond the last finite bound the answer is that bound.
    """
    total = F.col(BUCKETS[-1])
    rank = F.lit(q) * total
    value = F.lit(LATENCY_BOUNDS[-1])
    for i in range(len(LATENCY_BOUNDS) - 1, -1, -1):
        low = LATENCY_BOUNDS[i - 1] if i else 0.0
        below = F.col(BUCKETS[i - 1]) if i else F.lit(0)
        inside = F.col(BUCKETS[i]) - below
        at = F.lit(low) + F.lit(LATENCY_BOUNDS[i] - low) * (rank - below) / F.nullif(inside, F.lit(0))
        value = F.when(F.col(BUCKETS[i]) >= rank, at).otherwise(value)
    return F.when(total > 0, value)


def latency_quantiles(log: DataFrame, *labels: str) -> DataFrame:
    """Requests, mean and bucketed p50 / p95 latency in seconds per label combination."""
    seconds = F.col("latency_ms") / 1000.0
    return (
        log.groupBy(*labels)
        .agg(F.avg(seconds).alias("mean_seconds"), *bucket_counts(seconds))
        .select(
            *labels,
            F.col(BUCKETS[-1]).alias("requests"),
            "mean_seconds",
            histogram_quantile(0.5).alias("p50_seconds"),
            histogram_quantile(0.95).alias("p95_seconds"),
        )
    )


def count_quantiles(rows: DataFrame, label: str, value: str) -> DataFrame:
    """Exact p50 / p95 and mean of a whole-number measure such as hops or neighbours returned.

    Rows are counted per distinct value first, so a label's rows shrink to its few distinct values
    before they meet.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(label, value).agg(F.count(F.lit(1)).alias("times"))
    return counted.groupBy(label).agg(
        F.sum("times").alias("observations"),
        (F.sum(F.col(value) * F.col("times")) / F.sum("times")).alias("mean"),
        F.percentile(value, F.lit(0.5), F.col("times")).alias("p50"),
        F.percentile(value, F.lit(0.95), F.col("times")).alias("p95"),
    )


def answer_sizes(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Per request the neighbours returned and the bytes of their names in the response; none counts as 0.

    Requests carry ``request_id, query_type``, answers ``request_id, name``. Answers shrink to one row per request
    before they meet, so a request with very many is no heavy key.
    """
    sizes = answers.groupBy("request_id").agg(F.count(F.lit(1)).alias("neighbours"), F.sum(F.octet_length("name") + 1).alias("bytes"))
    none = F.lit(0).cast("long")
    return requests.select("request_id", "query_type").join(sizes, "request_id", "left").select(
        "request_id", "query_type", F.coalesce("neighbours", none).alias("neighbours"), F.coalesce("bytes", none).alias("bytes")
    )


def size_quantiles(sizes: DataFrame, label: str, measures: list[str]) -> DataFrame:
    """Observations, mean, p50 and p95 of several whole-number measures per label, in one pass over the rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("size")) for m in measures])).alias("pair")
    rows = sizes.select(F.col(label).alias("label"), pairs).select(F.struct("label", "pair.measure").alias("of"), F.col("pair.size").alias("size"))
    return count_quantiles(rows, "of", "size").select(F.col("of.label").alias(label), F.col("of.measure").alias("measure"), "observations", "mean", "p50", "p95")


def share(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole, F.lit(0))


# --- sliding windows --------------------------------------------------------------------------------------

_SUMS = ["requests", "errors", "client_errors", "routes", "failed_routes", *BUCKETS]


def _measures() -> list[Column]:
    route = F.col("service") == "route"
    return [
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status").between(500, 599)).alias("errors"),
        F.count_if(F.col("status").between(400, 499)).alias("client_errors"),
        F.count_if(route & (F.col("status") < 400)).alias("routes"),
        F.count_if(route & (F.col("status") >= 400)).alias("failed_routes"),
        *bucket_counts(F.col("latency_ms") / 1000.0),
    ]


def minute_counts(log: DataFrame) -> DataFrame:
    """The counts every alert needs, per minute and path."""
    return log.groupBy(F.date_trunc("minute", "ts").alias("minute"), "path").agg(*_measures())


def window_sums(minutes: DataFrame, window_minutes: int, *labels: str) -> DataFrame:
    """Sums over the window that ends at ``at_minute`` (exclusive), for every minute that a row can reach."""
    ends = F.sequence(
        F.col("minute") + F.expr("interval 1 minute"),
        F.col("minute") + F.expr(f"interval {window_minutes} minutes"),
        F.expr("interval 1 minute"),
    )
    return (
        minutes.withColumn("at_minute", F.explode(ends))
        .groupBy("at_minute", *labels)
        .agg(*[F.sum(c).alias(c) for c in _SUMS])
    )


def evaluation_times(minutes: DataFrame, behind: int = 1) -> DataFrame:
    """Every minute of the log with ``behind`` minutes before it, whether or not it saw a request."""
    first = F.col("first") + F.expr(f"interval {behind} minutes")
    last = F.col("last") + F.expr("interval 1 minute")
    return (
        minutes.agg(F.min("minute").alias("first"), F.max("minute").alias("last"))
        .where(first <= last)
        .select(F.explode(F.sequence(first, last, F.expr("interval 1 minute"))).alias("at_minute"))
    )


def _condition(alert: Alert) -> tuple[Column, Column]:
    """Value an alert looks at, and whether it is out of bounds."""
    if alert.name == "HighErrorRate":
        value = share(F.col("errors"), F.col("requests"))
        return value, value > ERROR_SHARE
    if alert.name == "Elevated4xxRate":
        value = share(F.col("client_errors"), F.col("requests"))
        return value, value > CLIENT_ERROR_SHARE
    if alert.name == "HighRouteFailureRate":
        value = share(F.col("failed_routes"), F.col("routes") + F.col("failed_routes"))
        return value, value > ROUTE_FAILURE_SHARE
    if alert.name == "HighLatency":
        value = histogram_quantile(0.95)
        return value, value > LATENCY_P95_SECONDS
    if alert.name == "LowTraffic":
        value = F.coalesce("requests", F.lit(0)) / (alert.window_minutes * 60.0)
        return value, value < LOW_TRAFFIC_PER_SECOND
    value = F.coalesce("routes", F.lit(0)).cast("double")
    return value, value == 0


def evaluations(minutes: DataFrame, alert: Alert) -> DataFrame:
    """``alert, path, at_minute, value, breached`` of one alert at every minute it can be judged.

    A share needs at least one request in its window; the traffic alerts count silence too, from the
    first minute that has a whole window behind it.
    """
    labels = ["path"] if alert.per_path else []
    sums = window_sums(minutes, alert.window_minutes, *labels)
    value, breached = _condition(alert)
    if alert.name in ("LowTraffic", "NoRoutesCalculated"):
        times = evaluation_times(minutes, alert.window_minutes)
        sums = times.join(sums, "at_minute", "left")
    path = F.col("path") if alert.per_path else F.lit("")
    return sums.select(
        F.lit(alert.name).alias("alert"),
        path.alias("path"),
        "at_minute",
        value.cast("double").alias("value"),
        F.coalesce(breached, F.lit(False)).alias("breached"),
    ).where("value is not null")


def all_evaluations(log: DataFrame, alerts: tuple[Alert, ...] = ALERTS) -> DataFrame:
    minutes = minute_counts(log)
    parts = [evaluations(minutes, a) for a in alerts]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def held(judged: DataFrame, alerts: tuple[Alert, ...] = ALERTS) -> DataFrame:
    """Minutes at which an alert fires: breached at every minute for its whole hold time.

    Adds ``since``, the first minute of the unbroken run. Runs are islands of consecutive minutes; the
    rows are one per alert, path and minute, however large the log.
    """
    hold = F.lit(None).cast("int")
    for a in alerts:
        hold = F.when(F.col("alert") == a.name, a.hold_minutes).otherwise(hold)
    key = ["alert", "path"]
    number = F.floor(F.unix_micros(F.col("at_minute").cast("timestamp")) / 60_000_000)
    runs = (
        judged.where("breached")
        .withColumn("minute_no", number)
        .withColumn("run", F.col("minute_no") - F.row_number().over(Window.partitionBy(*key).orderBy("minute_no")))
        .withColumn("since", F.min("at_minute").over(Window.partitionBy(*key, "run")))
        .withColumn("first_no", F.min("minute_no").over(Window.partitionBy(*key, "run")))
    )
    return runs.where(F.col("minute_no") - F.col("first_no") >= hold).select(*key, "at_minute", "value", "since")
