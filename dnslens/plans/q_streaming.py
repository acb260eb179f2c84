"""Registered queries: streams over the supplied events, checked against batch SQL.

The event file is the stream's source. When it has ended, a closing row moves the watermark
past all that is still open, so the last windows are in the results.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from dnslens.functions.netaddr import client_prefix
from dnslens.plans import views as v
from dnslens.plans.fragments import bucket_sql, bucket_walk_sql, decay_walk_sql, health_walk_sql, sql
from dnslens.plans.registry import query
from dnslens.session import scratch_path
from dnslens.sources import sinks
from dnslens.streaming import jobs

HOUR = v.HOUR


def _stream(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return v.shape_events(raw)


def _closing(t, ts="ts"):
    """A stream with room for its closing row, its watermark set, and what ``_finish`` needs to close it."""
    folder = scratch_path(t.sparkSession, "closing")
    return jobs.with_event_time(jobs.with_closing(t, folder), ts=ts), (folder, t.schema, ts)


def _finish(df, closing=None):
    base = scratch_path(df.sparkSession, "stream")
    return jobs.run_to_end(df, f"{base}/out", f"{base}/state", closing=closing)


@query(
    "st2_stream_rates",
    sql(
        "att ev",
        f"SELECT t_us // {HOUR} * {HOUR} AS window_us, backend, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors FROM ev JOIN (SELECT query_id AS event_id, backend FROM att) USING (event_id) "
        "GROUP BY ALL",
    ),
)
def st2(spark, sf):
    t = _stream(spark, sf).selectExpr("ts", f"{v.BACKEND} AS backend", "CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS outcome")
    t, closing = _closing(t)
    out = _finish(jobs.stream_rates(t, "1 hour"), closing)
    return out.select("window_us", "backend", "requests", "errors")


@query(
    "st9_stream_hist",
    sql(
        "att ev",
        f"SELECT t_us // {HOUR} * {HOUR} AS window_us, backend, {bucket_sql('lat_us')} AS bucket, count(*) AS cnt FROM ev JOIN (SELECT query_id AS event_id, backend FROM att) USING (event_id) GROUP BY ALL",
    ),
)
def st9(spark, sf):
    t = _stream(spark, sf).selectExpr("ts", f"{v.BACKEND} AS backend", "lat_us AS latency_us")
    t, closing = _closing(t)
    return _finish(jobs.stream_hist(t, "1 hour"), closing)


@query(
    "st3_stream_correlate",
    sql(
        "outc",
        "SELECT query_id, recv_us, rcode FROM outc WHERE recv_us IS NOT NULL",
    ),
)
def st3(spark, sf):
    ev = _stream(spark, sf)
    att = v.shape_attempts(ev).drop("send_us", "deadline_us")
    resp = v.shape_responses(_stream(spark, sf)).drop("recv_us")
    out = _finish(jobs.stream_correlate(att, resp))
    return out.filter("recv_ts IS NOT NULL").select("query_id", F.unix_micros("recv_ts").alias("recv_us"), "rcode")


@query(
    "st8_drop_stale",
    sql(
        "resp",
        "SELECT worker_id, backend, upstream_txid, generation, question_hash, min(recv_us) AS recv_us FROM resp GROUP BY ALL",
    ),
)
def st8(spark, sf):
    out = _finish(jobs.drop_stale(v.shape_responses(_stream(spark, sf)).drop("recv_us")))
    return out.select("worker_id", "backend", "upstream_txid", "generation", "question_hash", F.unix_micros("recv_ts").alias("recv_us"))


@query(
    "s1_s2_event_log",
    sql(
        "ev",
        "SELECT t_us, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, event_type AS event, concat('q\"', k) AS name, event_id::VARCHAR AS hidden FROM ev",
    ),
)
def s1_s2(spark, sf):
    """Events written as JSON lines and read back; a field named ``event`` is renamed."""
    from dnslens.sources.event_log import read_event_log, write_event_log

    t = v.events(spark, sf).selectExpr(
        "ts", "CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level", "event_type AS event",
        "map('name', concat('q\"', k), 'event', cast(event_id AS STRING)) AS fields",
    )
    path = scratch_path(spark, "event-log")
    write_event_log(t, path)
    return read_event_log(spark, path).filter("_corrupt IS NULL").selectExpr(
        "unix_micros(ts) AS t_us", "level", "event", "fields['name'] AS name", "fields['field.event'] AS hidden"
    )


def _windows(spark, sf, shape):
    """The hourly windows of one stream, as the source of the next one."""
    t, closing = _closing(_stream(spark, sf).withColumn("backend", F.expr(v.BACKEND)))
    t = shape(t)
    base = scratch_path(spark, "windows")
    jobs.run_to_end(t, f"{base}/out", f"{base}/state", closing=closing)
    return _closing(spark.readStream.schema(t.schema).parquet(f"{base}/out"))


@query(
    "st6_stream_ewma",
    sql(
        "ev att", "SELECT backend, t_us, x, round(ewma, 6) AS ewma FROM walked",
        steps="SELECT *, row_number() OVER (PARTITION BY backend ORDER BY t_us) AS step FROM ("
        f"SELECT backend, t_us // {HOUR} * {HOUR} AS t_us, (sum(lat_us) // count(*))::DOUBLE AS x "
        "FROM ev JOIN (SELECT query_id AS event_id, backend FROM att) USING (event_id) GROUP BY ALL)",
        walked=decay_walk_sql(2 * HOUR),
    ),
)
def st6(spark, sf):
    """Decayed hourly mean latency per backend over all windows."""
    def hourly(t):
        return (
            t.groupBy(F.window("ts", "1 hour"), "backend")
            .agg(F.expr("cast(sum(lat_us) div count(*) AS DOUBLE) AS x"))
            .select("backend", F.unix_micros("window.start").alias("t_us"), "x", F.col("window.start").alias("ts"))
        )

    t, closing = _windows(spark, sf, hourly)
    out = _finish(jobs.stream_ewma(t, ["backend"], "x", 2 * HOUR), closing)
    return out.withColumn("ewma", F.round("ewma", 6))


@query(
    "st5_stream_rate_limit",
    sql(
        "ql", "SELECT worker_id::INTEGER AS worker_id, concat(prefix // 16777216, '.', prefix // 65536 % 256, '.', prefix // 256 % 256, '.0/24') AS prefix, "
        "bin, n, spent AS allowed FROM walked",
        steps="SELECT *, row_number() OVER (PARTITION BY worker_id, prefix ORDER BY bin) AS step FROM ("
        f"SELECT worker_id, client_lo - client_lo % 256 AS prefix, arrival_us // {HOUR} AS bin, count(*) AS n FROM ql GROUP BY ALL)",
        walked=bucket_walk_sql("1.0::DOUBLE / 3600.0::DOUBLE", 3, HOUR),
    ),
)
def st5(spark, sf):
    """Hourly allowance of every client network on every worker."""
    def hourly(t):
        return (
            client_prefix(v.shape_queries(t)).withColumnRenamed("arrival_ts", "ts")
            .groupBy(F.window("ts", "1 hour"), "worker_id", "prefix")
            .agg(F.count("*").alias("n"))
            .selectExpr("worker_id", "prefix", f"unix_micros(window.start) div {HOUR} AS bin", "n", "window.start AS ts")
        )

    t, closing = _windows(spark, sf, hourly)
    return _finish(jobs.stream_rate_limit(t, 1 / 3600, 3.0, HOUR), closing)


@query(
    "st4_stream_health",
    sql(
        "ev att", "SELECT * FROM walked",
        steps="SELECT *, row_number() OVER (PARTITION BY backend ORDER BY window_us) AS n, true AS traffic, true AS may_eject, "
        "errors / requests > 0.2 OR timeouts / requests > 0.2 AS poor, timeouts / requests > 0.3 AS opened FROM ("
        f"SELECT backend, t_us // {HOUR} * {HOUR} AS window_us, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, "
        f"count(*) FILTER (lat_us > {v.TIMEOUT_US}) AS timeouts, count(*) FILTER (event_id % 10 = 0) AS probes, "
        "count(*) FILTER (event_id % 10 = 0 AND event_type = 'error') AS failed "
        "FROM ev JOIN (SELECT query_id AS event_id, backend FROM att) USING (event_id) GROUP BY ALL)",
        walked=health_walk_sql(5 * HOUR, 60 * HOUR),
    ),
)
def st4(spark, sf):
    """Health of every backend over all windows."""
    from dnslens.operators.health import HealthConfig

    def hourly(t):
        return (
            t.groupBy(F.window("ts", "1 hour"), "backend")
            .agg(
                F.count("*").alias("requests"),
                F.count_if(F.col("event_type") == "error").alias("errors"),
                F.count_if(F.col("lat_us") > v.TIMEOUT_US).alias("timeouts"),
                F.count_if(F.col("event_id") % 10 == 0).alias("probes"),
                F.count_if((F.col("event_id") % 10 == 0) & (F.col("event_type") == "error")).alias("probe_failures"),
            )
            .selectExpr(
                "backend", "unix_micros(window.start) AS window_us", "requests", "errors", "timeouts",
                "cast(null AS DOUBLE) AS p95", "probes", "probe_failures", "true AS may_eject", "window.start AS ts",
            )
        )

    cfg = HealthConfig(degrade_threshold=0.2, eject_threshold=0.3, fail_threshold=2, cooldown_us=5 * HOUR, cooldown_cap_us=60 * HOUR)
    t, closing = _windows(spark, sf, hourly)
    return _finish(jobs.stream_health(t, cfg), closing)


@query("s7_advice_sink", sql("advice", "SELECT issued_us, region, backend, advice_weight, 500000 AS ttl_us FROM advice"))
def s7(spark, sf):
    """All advice in three batches, of which one is written twice, as after a failure: read back, each row is there once."""
    rows = v.stored(v.advice(spark, sf).select("issued_us", "region", "backend", "advice_weight"))
    path = scratch_path(spark, "advice")
    for batch_id in (0, 1, 2, 1):
        part = rows.filter(F.pmod(F.xxhash64("issued_us"), F.lit(3)) == batch_id)
        sinks.write_advice(part, path, 500_000, batch_id)
    return spark.read.parquet(path).drop("batch_id")
