"""Registered queries: learning jobs and the experiment reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from dnslens.operators import learning, telemetry
from dnslens.plans import reports
from dnslens.plans import views as v
from dnslens.plans.fragments import sql
from dnslens.plans.registry import query

HOUR, BIN = v.HOUR, v.BIN

# -- learning -----------------------------------------------------------------------------------


def _traces(spark, sf):
    """Hourly mean latency per backend; a day is an episode with one fault type."""
    t = v.outcomes(spark, sf).filter("latency_us IS NOT NULL").selectExpr(
        "backend", f"send_us div {HOUR} * {HOUR} AS t_us", "latency_us"
    )
    t = t.groupBy("backend", "t_us").agg(F.expr("sum(latency_us) div count(*)").cast("double").alias("x"))
    day = f"t_us div {24 * HOUR}"
    return t.selectExpr(
        f"concat('day-', {day}) AS episode_id",
        f"element_at(array('none', 'slow', 'outage', 'loss'), cast({day} % 4 AS INT) + 1) AS fault_type",
        "backend", "t_us", "x",
    )


def _dataset(spark, sf):
    keys = ["episode_id", "fault_type", "backend"]
    traces = telemetry.ewma(_traces(spark, sf), keys, "x", 2 * HOUR)
    return learning.build_dataset(traces, keys, "x", (1, 2), (3,), cell_us=24 * HOUR, baselines=("ewma",))


_TRACES = (
    f"SELECT concat('day-', t_us // {24 * HOUR}) AS episode_id, ['none', 'slow', 'outage', 'loss'][(t_us // {24 * HOUR}) % 4 + 1] AS fault_type, * FROM ("
    f"SELECT backend, send_us // {HOUR} * {HOUR} AS t_us, (sum(latency_us) // count(*))::DOUBLE AS x FROM outc WHERE latency_us IS NOT NULL GROUP BY ALL)"
)
_DATA = (
    "SELECT * FROM (SELECT episode_id, fault_type, backend, t_us, x AS f_now, lag(x, 1) OVER w AS f_lag_1, lag(x, 2) OVER w AS f_lag_2, "
    "avg(x) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS f_avg_3, max(x) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS f_max_3, lead(x) OVER w AS label "
    "FROM traces WINDOW w AS (PARTITION BY episode_id, fault_type, backend ORDER BY t_us)) WHERE f_lag_2 IS NOT NULL AND label IS NOT NULL"
)


@query(
    "ml1_build_dataset",
    sql("outc", "SELECT episode_id, backend, t_us, f_now, f_lag_1, f_lag_2, round(f_avg_3, 4) AS f_avg_3, f_max_3, label FROM d", traces=_TRACES, d=_DATA),
)
def ml1(spark, sf):
    return _dataset(spark, sf).select(
        "episode_id", "backend", "t_us", "f_now", "f_lag_1", "f_lag_2", F.round("f_avg_3", 4).alias("f_avg_3"), "f_max_3", "label"
    )


@query(
    "ml2_split_episodes",
    sql(
        "outc",
        "SELECT episode_id, backend, t_us, CASE WHEN fault_type = 'loss' THEN 'test' WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'val' ELSE 'test' END AS split FROM ("
        "SELECT *, ('0x' || substr(md5(concat_ws('/', '7', episode_id, '0')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM d)",
        traces=_TRACES,
        d=_DATA,
    ),
)
def ml2(spark, sf):
    t = learning.split_episodes(_dataset(spark, sf), 7, held_out=("loss",))
    return t.select("episode_id", "backend", "t_us", "split")


def _prepared(spark, sf):
    # Training reads the data several times.
    return v.stored(learning.split_episodes(_dataset(spark, sf), 7, held_out=("loss",)))


@query("ml3_train")
def ml3(spark, sf):
    t = _prepared(spark, sf)
    model = learning.train(t, "linear", 7)
    return learning.predict(model, t.filter("split = 'train'")).select(
        "episode_id", "backend", "t_us", "label", F.round("predicted_us", 3).alias("predicted_us")
    )


@query("ml4_evaluate")
def ml4(spark, sf):
    t = _prepared(spark, sf)
    return learning.evaluate(learning.predict(learning.train(t, "linear", 7), t))


@query("ml5_model_card")
def ml5(spark, sf):
    t = _prepared(spark, sf)
    return learning.model_card(t, learning.predict(learning.train(t, "linear", 7), t), 7, "linear")


@query("ml6_predict")
def ml6(spark, sf):
    t = _prepared(spark, sf)
    return learning.predict(learning.train(t, "gbt", 7), t).select("episode_id", "backend", "t_us", "predicted_us")


# -- reports -------------------------------------------------------------------------------------


def _tables(spark, sf):
    samples = v.samples(spark, sf).selectExpr(
        "*",
        "CASE WHEN rep % 2 = 0 THEN 'socket' ELSE 'fast_path' END AS packet_io",
        "CASE rep % 3 WHEN 0 THEN 'udp' WHEN 1 THEN 'tcp' ELSE 'dot' END AS transport",
    )
    return {
        "samples": samples,
        "runs": v.runs(spark, sf),
        "faults": v.faults(spark, sf),
        "host_samples": v.host_samples(spark, sf),
    }


_CO = "round(avg(recv_us - intended_us), 3) AS mean, round(quantile_cont(recv_us - intended_us, 0.95), 3) AS p95, round(quantile_cont(recv_us - intended_us, 0.99), 3) AS p99"


def _lat_sql(policy: str) -> str:
    return f"SELECT scenario, mode, rep, avg(recv_us - intended_us) AS mean, quantile_cont(recv_us - intended_us, 0.99) AS p99 FROM samples WHERE policy = '{policy}' GROUP BY ALL"


@query(
    "q1_latency_vs_round_robin",
    sql(
        "samples",
        "SELECT scenario, mode, rep, round(b.mean - a.mean, 3) AS mean_delta, round(b.p99 - a.p99, 3) AS p99_delta FROM a FULL JOIN b USING (scenario, mode, rep)",
        a=_lat_sql("round_robin"),
        b=_lat_sql("latency_based"),
    ),
)
def q1(spark, sf):
    t = reports.report_q1(_tables(spark, sf))
    return t.select("scenario", "mode", "rep", F.round("mean_delta", 3).alias("mean_delta"), F.round("p99_delta", 3).alias("p99_delta"))


@query(
    "q2_health_enforcement",
    sql(
        "samples",
        "SELECT scenario, mode, policy, count(*) AS queries, count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'timeout') AS timeouts FROM samples GROUP BY ALL",
    ),
)
def q2(spark, sf):
    return reports.report_q2(_tables(spark, sf), BIN, 0.6, 4).select("scenario", "mode", "policy", "queries", "failed", "timeouts")


@query(
    "q3_over_time",
    sql(
        "samples",
        f"SELECT scenario, mode, policy, send_us // {BIN} * {BIN} AS bin_us, count(recv_us) AS count, {_CO} FROM samples WHERE recv_us IS NOT NULL GROUP BY 1, 2, 3, 4",
    ),
)
def q3(spark, sf):
    t = reports.report_q3(_tables(spark, sf), BIN)
    return t.select("scenario", "mode", "policy", "bin_us", "count", *[F.round(c, 3).alias(c) for c in ("mean", "p95", "p99")])


@query("q4_model_vs_ewma")
def q4(spark, sf):
    t = _prepared(spark, sf)
    return reports.report_q4({"predictions": learning.predict(learning.train(t, "linear", 7), t)})


@query(
    "q5_flash_crowd",
    sql(
        "samples runs",
        "SELECT run_id, bin_us, coalesce(n, 0) AS n, round(good / nullif(n, 0), 6) AS success FROM (SELECT g.run_id, g.bin * {b} AS bin_us, n, good FROM "
        "(SELECT run_id, unnest(range(min(send_us // {b}), max(send_us // {b}) + 1)) AS bin FROM samples GROUP BY 1) g "
        "LEFT JOIN (SELECT run_id, send_us // {b} AS bin, count(*) AS n, count(*) FILTER (status = 'ok') AS good FROM samples GROUP BY ALL) s USING (run_id, bin))".replace("{b}", str(BIN)),
    ),
)
def q5(spark, sf):
    return reports.report_q5(_tables(spark, sf), BIN).select("run_id", "bin_us", "n", F.round("success", 6).alias("success"))


@query("q6_slow_vs_dead")
def q6(spark, sf):
    return reports.report_q6(_tables(spark, sf), BIN)


@query(
    "q7_skewed_regions",
    sql(
        "samples",
        "SELECT mode, policy, region, backend, requests, round(requests / sum(requests) OVER (PARTITION BY mode, policy, region), 6) AS share, p50 FROM (SELECT mode, policy, region, backend, count(*) AS requests FROM samples GROUP BY ALL) "
        "JOIN (SELECT mode, policy, region, round(quantile_cont(recv_us - intended_us, 0.5), 3) AS p50 FROM samples GROUP BY 1, 2, 3) USING (mode, policy, region)",
    ),
)
def q7(spark, sf):
    t = reports.report_q7(_tables(spark, sf))
    return t.select("mode", "policy", "region", "backend", "requests", F.round("share", 6).alias("share"), F.round("p50", 3).alias("p50"))


def _variant_sql(col: str, expr: str) -> str:
    return sql(
        "samples",
        f"SELECT scenario, mode, {col}, count(recv_us) AS count, round(quantile_cont(recv_us - intended_us, 0.99), 3) AS p99, round(count(*) / ((max(intended_us) - min(intended_us)) / 1e6), 9) AS per_second "
        f"FROM (SELECT *, {expr} AS v FROM samples) GROUP BY ALL".replace(f", {col},", f", v AS {col},"),
    )


def _variant(t, col):
    return t.select("scenario", "mode", col, "count", F.round("p99", 3).alias("p99"), F.round("per_second", 9).alias("per_second"))


@query("q8_control_overhead", _variant_sql("policy", "policy"))
def q8(spark, sf):
    return _variant(reports.report_q8(_tables(spark, sf)), "policy")


@query("q9_packet_path", _variant_sql("packet_io", "CASE WHEN rep % 2 = 0 THEN 'socket' ELSE 'fast_path' END"))
def q9(spark, sf):
    return _variant(reports.report_q9(_tables(spark, sf)), "packet_io")


@query("q10_transports", _variant_sql("transport", "CASE rep % 3 WHEN 0 THEN 'udp' WHEN 1 THEN 'tcp' ELSE 'dot' END"))
def q10(spark, sf):
    return _variant(reports.report_q10(_tables(spark, sf)), "transport")
