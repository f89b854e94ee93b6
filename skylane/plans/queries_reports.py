"""Queries on route corpora, tokens, request metrics, alerts and their streaming twins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylane.functions.text import listed_waypoint_type, waypoint_type
from skylane.operators import corpus, monitor, tokens
from skylane.operators.edges import known_jumps
from skylane.plans import queries_routes, route_planner
from skylane.plans.registry import query, r6
from skylane.plans.sample_map import REQUEST_LOG, SCOUT_REQUESTS, SampleMap
from skylane.session import work_area, written
from skylane.streaming import feeds, metrics

# --- corpus ---------------------------------------------------------------------------------------------------


@query(
    """SELECT route_id, pos, system_id, name, route_id % 3 = 0 AS avoid_gates, CAST(route_id % 100 AS DOUBLE) AS max_ly
       FROM corpus JOIN bare ON id = system_id""",
    ("corpus", "bare"),
)
def corpus_steps(m: SampleMap) -> DataFrame:
    """Steps parsed back from the JSON path column."""
    return m.corpus_steps


@query(
    """SELECT system_id, count(*) AS occurrences FROM corpus GROUP BY system_id ORDER BY occurrences DESC, system_id LIMIT 30""",
    ("corpus",),
)
def corpus_hubs(m: SampleMap) -> DataFrame:
    return corpus.top_hubs(m.corpus_steps)


@query(
    "SELECT system_id, count(*) AS occurrences FROM corpus GROUP BY system_id HAVING count(*) >= 40",
    ("corpus",),
)
def corpus_corridor(m: SampleMap) -> DataFrame:
    return corpus.corridor(m.corpus_steps, 40)


@query(
    """SELECT route_id FROM corpus GROUP BY route_id
       HAVING bool_and(system_id IN (SELECT system_id FROM corpus GROUP BY system_id HAVING count(*) >= 40))""",
    ("corpus",),
)
def contained_routes(m: SampleMap) -> DataFrame:
    # Read twice, so the paths are put together and taken apart once.
    steps = written(m.corpus_steps.select("route_id", "system_id"), "corpus-steps")
    return corpus.contained_routes(steps, corpus.corridor(steps, 40))


@query(
    """SELECT threshold, count(*) FILTER (rarest >= threshold) AS contained, count(*) AS routes,
              round(avg(CASE WHEN rarest >= threshold THEN 1e0 ELSE 0e0 END), 6) AS share
       FROM (SELECT route_id, min(n) AS rarest FROM corpus JOIN (SELECT system_id, count(*) AS n FROM corpus GROUP BY 1) USING (system_id)
             GROUP BY route_id), (VALUES (35), (40), (45), (50)) AS t(threshold) GROUP BY threshold""",
    ("corpus",),
)
def corpus_coverage(m: SampleMap) -> DataFrame:
    return corpus.coverage(m.corpus_steps, [35, 40, 45, 50]).withColumn("share", r6("share"))


@query(
    """SELECT 'routes' AS item, count(DISTINCT route_id) AS value FROM corpus
       UNION ALL SELECT 'systems', count(DISTINCT system_id) FROM corpus""",
    ("corpus",),
)
def corpus_totals(m: SampleMap) -> DataFrame:
    return corpus.corpus_totals(m.corpus_steps)


@query(
    """SELECT route_id, min_by(system_id, pos) AS start_id, max_by(system_id, pos) AS end_id FROM corpus GROUP BY route_id
       HAVING min_by(system_id, pos) = 30000042 OR max_by(system_id, pos) = 30000042""",
    ("corpus",),
)
def routes_touching_hub(m: SampleMap) -> DataFrame:
    return corpus.routes_touching(m.corpus_routes, 30_000_042).select("route_id", "start_id", "end_id")


@query(
    """SELECT fromSystemId AS src, toSystemId AS dst FROM raw_jumps
       WHERE fromSystemId IN (SELECT system_id FROM corpus GROUP BY 1 HAVING count(*) >= 40)
         AND toSystemId IN (SELECT system_id FROM corpus GROUP BY 1 HAVING count(*) >= 40)""",
    ("raw_jumps", "corpus"),
)
def corridor_jumps(m: SampleMap) -> DataFrame:
    """Jumps with both ends in the corridor."""
    inside = corpus.corridor(m.corpus_steps, 40).select(F.col("system_id").alias("id"))
    return known_jumps(m.jumps, inside)


@query(
    """SELECT CASE WHEN event_type = 'view' THEN 'spatial' WHEN event_type = 'click' THEN 'gate' ELSE 'hybrid' END AS mode,
              count(*) AS routes, round(avg(CASE WHEN value > 30 THEN 1e0 ELSE 0e0 END), 6) AS found_share,
              round(max(CASE WHEN value > 30 THEN value / (10 + user_id) END), 6) AS worst_ratio,
              round(avg(CASE WHEN value > 30 THEN CASE WHEN value / (10 + user_id) <= 2 THEN 1e0 ELSE 0e0 END END), 6) AS within_twice
       FROM events GROUP BY 1""",
)
def search_success_rates(m: SampleMap) -> DataFrame:
    mode = F.when(F.col("event_type") == "view", "spatial").when(F.col("event_type") == "click", "gate").otherwise("hybrid")
    results = m.source("events").select(
        mode.alias("mode"),
        (F.col("value") > 30).alias("found"),
        F.col("value").alias("length"),
        (10 + F.col("user_id")).cast("double").alias("expected_length"),
    )
    return corpus.success_rates(results).withColumns({c: r6(c) for c in ("found_share", "worst_ratio", "within_twice")})


_PLAN_PARTS, _PLAN_ROWS = queries_routes._PLAN_SQL.rsplit("SELECT s.request_id, s.mode", 1)


@query(
    _PLAN_PARTS
    + f"""SELECT mode, count(*) AS routes, round(avg(CASE WHEN status = 'ok' THEN 1e0 ELSE 0e0 END), 6) AS found_share
          FROM (SELECT s.request_id, s.mode{_PLAN_ROWS}) WHERE status IN ('ok', 'not_found') GROUP BY mode""",
    queries_routes._ROUTE_PARTS,
)
def planned_success_rates(m: SampleMap) -> DataFrame:
    """Found share of the planned requests per search mode."""
    plans = route_planner.plan_routes(m.route_requests, m.systems, m.pairs, m.ships, suggest=False)
    results = plans.summary.where("status in ('ok', 'not_found')").select(
        "mode", (F.col("status") == "ok").alias("found"), F.lit(1.0).alias("length"), F.lit(1.0).alias("expected_length")
    )
    return corpus.success_rates(results).select("mode", "routes", r6("found_share").alias("found_share"))


# --- tokens ---------------------------------------------------------------------------------------------------


def _waypoints(m: SampleMap) -> DataFrame:
    steps = m.corpus_walks
    kind = waypoint_type(F.col("step") == 0, F.when(F.col("system_id") % 3 == 0, "gate").otherwise("jump"))
    return steps.select(F.col("request_id").alias("route_id"), F.col("step").alias("pos"), "system_id", kind.alias("waypoint_type"))


_WAYPOINTS_SQL = """WITH RECURSIVE waypoints AS (
  SELECT route_id, pos, system_id, CASE WHEN pos = 0 THEN 0 WHEN system_id % 3 = 0 THEN 2 ELSE 1 END AS waypoint_type FROM corpus)
"""


@query(
    _WAYPOINTS_SQL
    + """, widths AS (
      SELECT route_id, count(*) AS waypoints, CASE WHEN max(system_id) = 30000000 THEN 1 ELSE length(bin(max(system_id) - 30000000)) END AS k
      FROM waypoints GROUP BY route_id),
    bits AS (
      SELECT route_id, any_value(k) AS k, any_value(waypoints) AS waypoints,
             string_agg(concat(lpad(bin(system_id - 30000000), CAST(k AS INTEGER), '0'), lpad(bin(waypoint_type), 3, '0')), '' ORDER BY pos) AS b
      FROM waypoints JOIN widths USING (route_id) GROUP BY route_id)
    SELECT route_id, 1 AS version, CAST(k AS INTEGER) AS bit_width, waypoints,
           hex(unbin(rpad(b, CAST(ceil(length(b) / 8.0) * 8 AS INTEGER), '0'))) AS payload, CAST(NULL AS VARCHAR) AS problem FROM bits""",
    ("corpus",),
)
def route_tokens(m: SampleMap) -> DataFrame:
    """Every corpus route packed into a token."""
    return tokens.pack_tokens(_waypoints(m))


@query(_WAYPOINTS_SQL + "SELECT route_id, pos, system_id, waypoint_type, CAST(NULL AS VARCHAR) AS problem FROM waypoints", ("corpus",))
def unpacked_tokens(m: SampleMap) -> DataFrame:
    """Every corpus route packed and unpacked again."""
    packed = tokens.pack_tokens(_waypoints(m)).select("route_id", tokens.token_text().alias("token"))
    return tokens.unpack_tokens(packed)


@query(
    """SELECT route_id, CASE route_id % 5 WHEN 0 THEN 'truncated' WHEN 1 THEN 'unsupported version' WHEN 2 THEN 'invalid bit width'
              WHEN 3 THEN 'truncated' END AS problem FROM corpus GROUP BY route_id""",
    ("corpus",),
)
def damaged_tokens(m: SampleMap) -> DataFrame:
    """Tokens damaged in four ways, and what reading their header makes of each."""
    text = tokens.token_text()
    broken = (
        F.when(F.col("route_id") % 5 == 0, F.substring(text, 1, 6))
        .when(F.col("route_id") % 5 == 1, F.concat(F.lit("09"), F.expr("substring(t, 3)")))
        .when(F.col("route_id") % 5 == 2, F.concat(F.lit("011F"), F.expr("substring(t, 5)")))
        .when(F.col("route_id") % 5 == 3, F.expr("substring(t, 1, length(t) - 2)"))
        .otherwise(F.col("t"))
    )
    packed = tokens.pack_tokens(_waypoints(m)).withColumn("t", text)
    return tokens.token_headers(packed.select("route_id", broken.alias("token"))).select("route_id", "problem")


@query(
    """SELECT route_id, pos, CASE WHEN pos % 4 = 3 THEN 3 WHEN pos = 0 THEN 0 WHEN pos = last THEN 4 ELSE 1 END AS waypoint_type
       FROM corpus JOIN (SELECT route_id, max(pos) AS last FROM corpus GROUP BY 1) USING (route_id)""",
    ("corpus",),
)
def listed_waypoints(m: SampleMap) -> DataFrame:
    """Waypoint types of hand-written lists, some of them given as words."""
    steps = m.corpus_walks
    last = steps.groupBy("request_id").agg(F.max("step").alias("last"))
    given = F.when(F.col("step") % 4 == 3, "smart-gate")
    return steps.join(last, "request_id").select(
        F.col("request_id").alias("route_id"),
        F.col("step").alias("pos"),
        listed_waypoint_type(F.col("step") == 0, F.col("step") == F.col("last"), given).alias("waypoint_type"),
    )


# --- metrics ----------------------------------------------------------------------------------------------------


@query(
    """SELECT method, path, CASE WHEN status BETWEEN 200 AND 599 THEN concat(CAST(status // 100 AS VARCHAR), 'xx') ELSE 'other' END
              AS status_class, count(*) AS requests FROM request_log GROUP BY 1, 2, 3""",
    ("request_log",),
)
def request_counts(m: SampleMap) -> DataFrame:
    return monitor.request_counts(monitor.with_status_class(m.request_log), "method", "path", "status_class")


@query(
    """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, path, algorithm, count(*) AS requests
       FROM request_log GROUP BY 1, 2, 3""",
    ("request_log",),
)
def request_counts_by_window(m: SampleMap) -> DataFrame:
    return monitor.request_counts(m.request_log, "path", "algorithm", window="5 minutes")


# Upper bounds of the latency buckets in seconds; below, the hold times of the alerts in minutes.
_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def _quantile_sql(q: float) -> str:
    """The bucket quantile spelled out over ``n`` and ``le_<i>`` columns."""
    whens = []
    for i, bound in enumerate(_BOUNDS):
        low, below = (_BOUNDS[i - 1], f"le_{i - 1}") if i else (0.0, "0")
        whens.append(
            f"WHEN le_{i} >= {q:e} * n THEN {low:e} + {bound - low:e} * ({q:e} * n - {below}) / nullif(le_{i} - {below}, 0)"
        )
    return "CASE WHEN n > 0 THEN CASE " + " ".join(whens) + f" ELSE {_BOUNDS[-1]:e} END END"


_LE = ", ".join(f"count(*) FILTER (latency_ms / 1e3 <= {b:e}) AS le_{i}" for i, b in enumerate(_BOUNDS))


@query(
    f"""SELECT path, n AS requests, round(mean, 6) AS mean_seconds, round({_quantile_sql(0.5)}, 6) AS p50_seconds,
               round({_quantile_sql(0.95)}, 6) AS p95_seconds
        FROM (SELECT path, count(*) AS n, avg(latency_ms / 1e3) AS mean, {_LE} FROM request_log GROUP BY path)""",
    ("request_log",),
)
def latency_quantiles(m: SampleMap) -> DataFrame:
    found = monitor.latency_quantiles(m.request_log, "path")
    return found.withColumns({c: r6(c) for c in ("mean_seconds", "p50_seconds", "p95_seconds")})


@query(
    """SELECT mode, count(*) AS observations, round(avg(hops), 6) AS mean, round(quantile_cont(hops, 5e-1), 6) AS p50,
              round(quantile_cont(hops, 95e-2), 6) AS p95
       FROM (SELECT route_id, CASE WHEN route_id % 3 = 0 THEN 'spatial' ELSE 'hybrid' END AS mode, CAST(count(*) - 1 AS DOUBLE) AS hops
             FROM corpus GROUP BY route_id) GROUP BY mode""",
    ("corpus",),
)
def hop_quantiles(m: SampleMap) -> DataFrame:
    """Exact quantiles of route lengths."""
    lengths = m.corpus_walks.groupBy("request_id").agg((F.count(F.lit(1)) - 1).alias("hops")).withColumn(
        "mode", F.when(F.col("request_id") % 3 == 0, "spatial").otherwise("hybrid")
    )
    return monitor.count_quantiles(lengths, "mode", "hops").withColumns({c: r6(c) for c in ("mean", "p50", "p95")})


@query(
    """WITH RECURSIVE asked AS (SELECT request_id, system, CASE WHEN include_dev THEN 'all' ELSE 'listed' END AS query_type, include_dev FROM scout_requests),
       given AS (SELECT r.request_id, count(n.id) AS neighbours, coalesce(sum(strlen(n.name) + 1), 0) AS bytes
         FROM asked r LEFT JOIN (SELECT name, min(id) AS id FROM systems GROUP BY name) s ON s.name = r.system
         LEFT JOIN pairs p ON p.src = s.id
         LEFT JOIN systems n ON n.id = p.dst AND (include_dev OR NOT regexp_full_match(n.name, '(AD|V-)[0-9]+'))
         GROUP BY r.request_id),
       sizes AS (SELECT query_type, 'neighbours' AS measure, CAST(neighbours AS DOUBLE) AS size FROM asked JOIN given USING (request_id)
         UNION ALL SELECT query_type, 'bytes', CAST(bytes AS DOUBLE) FROM asked JOIN given USING (request_id))
       SELECT query_type, measure, count(*) AS observations, round(avg(size), 6) AS mean, round(quantile_cont(size, 5e-1), 6) AS p50,
              round(quantile_cont(size, 95e-2), 6) AS p95 FROM sizes GROUP BY query_type, measure""",
    ("scout_requests", "systems", "pairs"),
)
def answer_sizes(m: SampleMap) -> DataFrame:
    """Neighbours returned and response size over the answers to every gate request."""
    kinds = F.when(F.col("include_dev"), "all").otherwise("listed")
    sizes = monitor.answer_sizes(m.scout_requests.withColumn("query_type", kinds), queries_routes.scout_gates(m))
    found = monitor.size_quantiles(sizes, "query_type", ["neighbours", "bytes"])
    return found.withColumns({c: r6(c) for c in ("mean", "p50", "p95")})


_MINUTES_SQL = f"""WITH RECURSIVE
log AS MATERIALIZED (SELECT *, date_trunc('minute', ts) AS minute FROM request_log),
minutes AS MATERIALIZED (
  SELECT minute, path, count(*) AS n, count(*) FILTER (status BETWEEN 500 AND 599) AS errors,
         count(*) FILTER (status BETWEEN 400 AND 499) AS client_errors,
         count(*) FILTER (service = 'route' AND status < 400) AS routes,
         count(*) FILTER (service = 'route' AND status >= 400) AS failed, {_LE}
  FROM log GROUP BY minute, path),
reached AS MATERIALIZED (
  SELECT minute + to_minutes(o) AS at_minute, m.*, o FROM minutes m, (SELECT CAST(range AS INTEGER) AS o FROM range(1, 61))),
spine AS (
  SELECT unnest(generate_series((SELECT min(minute) FROM minutes) + INTERVAL 1 MINUTE,
                                (SELECT max(minute) FROM minutes) + INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS at_minute),
judged AS MATERIALIZED (
  SELECT 'HighErrorRate' AS alert, '' AS path, at_minute, sum(errors) / sum(n) AS value, sum(errors) / sum(n) > 5e-2 AS breached
  FROM reached WHERE o <= 5 GROUP BY at_minute
  UNION ALL
  SELECT 'Elevated4xxRate', '', at_minute, sum(client_errors) / sum(n), sum(client_errors) / sum(n) > 2e-1 FROM reached WHERE o <= 5 GROUP BY at_minute
  UNION ALL
  SELECT 'HighRouteFailureRate', '', at_minute, sum(failed) / sum(routes + failed), sum(failed) / sum(routes + failed) > 1e-1
  FROM reached WHERE o <= 5 GROUP BY at_minute HAVING sum(routes + failed) > 0
  UNION ALL
  SELECT 'HighLatency', path, at_minute, q, q > 1 FROM (
    SELECT path, at_minute, {_quantile_sql(0.95)} AS q FROM (
      SELECT path, at_minute, CAST(sum(n) AS BIGINT) AS n, {", ".join(f"CAST(sum(le_{i}) AS BIGINT) AS le_{i}" for i in range(len(_BOUNDS)))}
      FROM reached WHERE o <= 5 GROUP BY path, at_minute))
  UNION ALL
  SELECT 'LowTraffic', '', at_minute, coalesce(n, 0) / 1800e0, coalesce(n, 0) / 1800e0 < 1e-2
  FROM spine LEFT JOIN (SELECT at_minute, sum(n) AS n FROM reached WHERE o <= 30 GROUP BY at_minute) USING (at_minute)
  WHERE at_minute >= (SELECT min(minute) FROM minutes) + INTERVAL 30 MINUTE
  UNION ALL
  SELECT 'NoRoutesCalculated', '', at_minute, CAST(coalesce(r, 0) AS DOUBLE), coalesce(r, 0) = 0
  FROM spine LEFT JOIN (SELECT at_minute, sum(routes) AS r FROM reached GROUP BY at_minute) USING (at_minute)
  WHERE at_minute >= (SELECT min(minute) FROM minutes) + INTERVAL 60 MINUTE)
"""


@query(
    _MINUTES_SQL + "SELECT alert, path, at_minute, round(value, 6) AS value, breached FROM judged",
    ("request_log",),
)
def alert_evaluations(m: SampleMap) -> DataFrame:
    """Value and breach of every alert at every minute."""
    return monitor.all_evaluations(m.request_log).withColumn("value", r6("value"))


@query(
    _MINUTES_SQL
    + """, runs AS (
      SELECT *, row_number() OVER (PARTITION BY alert, path ORDER BY at_minute) AS rn FROM judged WHERE breached),
    islands AS (SELECT *, min(at_minute) OVER (PARTITION BY alert, path, at_minute - to_minutes(CAST(rn AS INTEGER))) AS since FROM runs)
    SELECT alert, path, at_minute, round(value, 6) AS value, since FROM islands
    WHERE date_diff('minute', since, at_minute) >= CASE alert WHEN 'HighErrorRate' THEN 5 WHEN 'HighLatency' THEN 10
      WHEN 'HighRouteFailureRate' THEN 15 WHEN 'Elevated4xxRate' THEN 15 WHEN 'LowTraffic' THEN 30 ELSE 60 END""",
    ("request_log",),
)
def firing_alerts(m: SampleMap) -> DataFrame:
    """Alerts whose condition held for their whole hold time."""
    return monitor.held(monitor.all_evaluations(m.request_log)).withColumn("value", r6("value"))


# --- streams ------------------------------------------------------------------------------------------------------


def _event_stream(m: SampleMap, text: str) -> DataFrame:
    """The events table read as a stream of files, shaped by the same SQL as its batch twin."""
    schema = m.source("events").schema
    stream = m.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(m.folder)
    return m.spark.sql(text.replace('"limit"', "`limit`"), events=stream)


def _drained(m: SampleMap, stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over all that is there and return what it wrote."""
    path = f"{work_area(m.spark)}/{label}-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{path}-progress").trigger(availableNow=True)
    writer.format("parquet").option("path", path).start().awaitTermination()
    return m.spark.read.schema(stream.schema).parquet(path)


def _stamped(log: DataFrame) -> DataFrame:
    """Event times as instants, which watermarks need, read as the UTC they were written in."""
    return log.withColumn("ts", F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp"))


def _wall_clock(instant: str) -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(instant).cast("timestamp_ntz"))


@query(
    """SELECT r.request_id, r.system, s.id AS system_id, n.id AS neighbour_id, n.name
       FROM scout_requests r JOIN (SELECT name, min(id) AS id FROM systems GROUP BY name) s ON s.name = r.system
       JOIN pairs p ON p.src = s.id JOIN systems n ON n.id = p.dst WHERE NOT regexp_full_match(n.name, '(AD|V-)[0-9]+')""",
    ("scout_requests", "systems", "pairs"),
)
def streamed_scout_gates(m: SampleMap) -> DataFrame:
    """A feed of scout requests answered by a stream-static join."""
    feed = _event_stream(m, SCOUT_REQUESTS).select("request_id", "system")
    systems, pairs = written(m.systems, "systems"), written(m.pairs, "pairs")
    answers = feeds.gate_feed(feed, pairs, systems).select("request_id", "system", "system_id", "neighbour_id", "name")
    return _drained(m, answers, "scout-gates")


@query(
    """SELECT request_id, system, 'system_unknown' AS problem FROM scout_requests WHERE system NOT IN (SELECT name FROM bare)""",
    ("scout_requests", "bare"),
)
def streamed_rejections(m: SampleMap) -> DataFrame:
    feed = _event_stream(m, SCOUT_REQUESTS).select("request_id", "system")
    return _drained(m, feeds.rejected_feed(feed, written(m.bare_systems, "systems")), "rejections")


@query(
    """WITH RECURSIVE w AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, * FROM request_log)
       SELECT window_start, path, CASE WHEN status BETWEEN 200 AND 599 THEN concat(CAST(status // 100 AS VARCHAR), 'xx') ELSE 'other' END
              AS status_class, count(*) AS requests, @LE@, count(latency_ms) AS le_11
       FROM w GROUP BY 1, 2, 3
       HAVING window_start + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM request_log) - INTERVAL 10 MINUTE""".replace("@LE@", _LE),
    ("request_log",),
)
def streamed_request_counts(m: SampleMap) -> DataFrame:
    """Windowed counters with a watermark; windows not yet final when the input ends are not emitted."""
    counts = metrics.windowed_counts(_stamped(_event_stream(m, REQUEST_LOG)))
    return _drained(m, counts, "counts").select(
        _wall_clock("window_start").alias("window_start"), "path", "status_class", "requests", *monitor.BUCKETS
    )


@query(
    """WITH RECURSIVE w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, * FROM request_log)
       SELECT window_start, path, CASE WHEN status BETWEEN 200 AND 599 THEN concat(CAST(status // 100 AS VARCHAR), 'xx') ELSE 'other' END
              AS status_class, count(*) AS requests, @LE@, count(latency_ms) AS le_11
       FROM w GROUP BY 1, 2, 3
       HAVING window_start + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM request_log) - INTERVAL 10 MINUTE""".replace("@LE@", _LE),
    ("request_log",),
)
def streamed_five_minute_counts(m: SampleMap) -> DataFrame:
    """Counters and latency buckets of five minutes, merged from those of single minutes within the stream."""
    counts = metrics.merged_counts(_stamped(_event_stream(m, REQUEST_LOG)), "5 minutes")
    return _drained(m, counts, "five-minutes").select(
        _wall_clock("window_start").alias("window_start"), "path", "status_class", "requests", *monitor.BUCKETS
    )


_STREAM_ALERT_SQL = _MINUTES_SQL + """, final AS (
  SELECT * FROM judged WHERE alert = 'HighErrorRate' AND at_minute <= (SELECT max(ts) FROM request_log) - INTERVAL 10 MINUTE)
"""


@query(_STREAM_ALERT_SQL + "SELECT at_minute, round(value, 6) AS value, breached FROM final", ("request_log",))
def streamed_error_rate(m: SampleMap) -> DataFrame:
    """The error-rate condition over sliding windows of a stream."""
    alert = monitor.ALERTS[0]
    judged = metrics.windowed_evaluations(_stamped(_event_stream(m, REQUEST_LOG)), alert)
    return _drained(m, judged, "error-rate").select(_wall_clock("at_minute").alias("at_minute"), r6("value").alias("value"), "breached")


_STREAMED_SQL = _MINUTES_SQL + """, final AS (
  SELECT * FROM judged WHERE alert IN ('HighErrorRate', 'Elevated4xxRate', 'HighRouteFailureRate', 'HighLatency')
    AND at_minute <= (SELECT max(ts) FROM request_log) - INTERVAL 10 MINUTE)
"""


@query(_STREAMED_SQL + "SELECT alert, path, at_minute, round(value, 6) AS value, breached FROM final", ("request_log",))
def streamed_alert_evaluations(m: SampleMap) -> DataFrame:
    """All conditions that a stream can judge, in one query of chained aggregations."""
    judged = metrics.all_windowed_evaluations(_stamped(_event_stream(m, REQUEST_LOG))).drop("at")
    return _drained(m, judged, "evaluations").select("alert", "path", _wall_clock("at_minute").alias("at_minute"), r6("value").alias("value"), "breached")


@query(
    _STREAMED_SQL
    + """, runs AS (SELECT *, row_number() OVER (PARTITION BY alert, path ORDER BY at_minute) AS rn FROM final WHERE breached),
    islands AS (SELECT *, min(at_minute) OVER (PARTITION BY alert, path, at_minute - to_minutes(CAST(rn AS INTEGER))) AS since FROM runs)
    SELECT alert, path, at_minute, round(value, 6) AS value, since FROM islands
    WHERE date_diff('minute', since, at_minute) >= CASE alert WHEN 'HighErrorRate' THEN 5 WHEN 'HighLatency' THEN 10 ELSE 15 END""",
    ("request_log",),
)
def streamed_held_alerts(m: SampleMap) -> DataFrame:
    """The same conditions held for their whole hold time, followed by a keyed state in the same query."""
    name, store = metrics.STATE_STORE
    before = m.spark.conf.get(name)
    m.spark.conf.set(name, store)
    try:
        held = _drained(m, metrics.held_alerts(metrics.all_windowed_evaluations(_stamped(_event_stream(m, REQUEST_LOG)))), "held")
    finally:
        m.spark.conf.set(name, before)
    return held.select("alert", "path", _wall_clock("at_minute").alias("at_minute"), r6("value").alias("value"), _wall_clock("since").alias("since"))


def _fed(m: SampleMap, requests: DataFrame, label: str, files: int) -> DataFrame:
    """Requests as files of a feed, read as a stream one file at a time."""
    path = f"{work_area(m.spark)}/{label}-{uuid.uuid4().hex}"
    requests.repartition(files, "request_id").write.parquet(path)
    return m.spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _answered(m: SampleMap, feed: DataFrame, sink: feeds.ReplayedSink) -> DataFrame:
    sink.answered(feed).option("checkpointLocation", f"{sink.path}-progress").trigger(availableNow=True).start().awaitTermination()
    return sink.read(m.spark)


@query(
    queries_routes._RANGE_SQL
    + """SELECT request_id, CAST(rank AS INTEGER) AS rank, dst AS system_id, round(distance, 6) AS distance FROM answers""",
    ("scout_requests", "systems", "gaps"),
)
def streamed_scout_range(m: SampleMap) -> DataFrame:
    """A feed of scout-range requests, answered batch by batch into a sink that a replay does not change."""
    systems, pairs = written(m.systems, "systems"), written(m.pairs, "pairs")
    sink = feeds.range_sink(systems, pairs, f"{work_area(m.spark)}/scout-range-{uuid.uuid4().hex}")
    found = _answered(m, _fed(m, m.scout_requests, "scout-feed", 2), sink)
    return found.select("request_id", "rank", "system_id", r6("distance").alias("distance"))


_OUTCOMES_SQL = queries_routes._PLAN_SQL.replace("SELECT s.request_id, s.mode, s.objective,", "SELECT request_id, status, cost, advice FROM (SELECT s.request_id,") + ")"


@query(_OUTCOMES_SQL, queries_routes._ROUTE_PARTS)
def streamed_routes(m: SampleMap) -> DataFrame:
    """A feed of route requests, planned batch by batch."""
    systems, pairs = written(m.systems, "systems"), written(m.pairs, "pairs")
    sink = feeds.route_sink(systems, pairs, m.ships, f"{work_area(m.spark)}/routes-{uuid.uuid4().hex}")
    found = _answered(m, _fed(m, m.route_requests, "route-feed", 1), sink)
    return found.select("request_id", "status", r6("cost").alias("cost"), "advice")
