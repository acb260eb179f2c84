"""Registered queries: traffic patterns and benchmark analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from dnslens.functions.netaddr import client_prefix
from dnslens.operators import experiments as ex
from dnslens.plans import views as v
from dnslens.plans.fragments import sql
from dnslens.plans.registry import query

HOUR, BIN = v.HOUR, v.BIN


def _r(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(
    "p11_tag_traffic",
    sql(
        "outc",
        "SELECT bin_us, total, flash_crowd, regional_spike, single_client_burst, concentrated_qnames, high_nxdomain, degradation, outage, "
        "CASE WHEN flash_crowd::INT + regional_spike::INT + single_client_burst::INT + concentrated_qnames::INT + high_nxdomain::INT + degradation::INT + outage::INT >= 2 THEN 'mixed' "
        "WHEN flash_crowd THEN 'flash_crowd' WHEN regional_spike THEN 'regional_spike' WHEN single_client_burst THEN 'single_client_burst' WHEN concentrated_qnames THEN 'concentrated_qnames' "
        "WHEN high_nxdomain THEN 'high_nxdomain' WHEN degradation THEN 'degradation' WHEN outage THEN 'outage' ELSE 'normal' END AS pattern FROM flags",
        x=f"SELECT *, send_us // {HOUR} * {HOUR} AS bin_us, client_lo // 256 AS prefix FROM outc",
        tot="SELECT bin_us, count(*) AS total, avg((outcome = 'ok')::INT) AS success, avg(coalesce(rcode_class = 'nxdomain', false)::INT) AS nx, quantile_cont(latency_us, 0.95) AS p95 FROM x GROUP BY 1",
        base="SELECT *, avg(total) OVER w AS b_total, avg(p95) OVER w AS b_p95 FROM tot WINDOW w AS (ORDER BY bin_us ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)",
        reg="SELECT bin_us, bool_or(coalesce(n > 3 * b, false)) AS jump FROM (SELECT *, avg(n) OVER (PARTITION BY region ORDER BY bin_us ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS b FROM (SELECT region, bin_us, count(*) AS n FROM x GROUP BY ALL)) GROUP BY 1",
        pre="SELECT bin_us, max(n) / sum(n) AS share FROM (SELECT bin_us, prefix, count(*) AS n FROM x GROUP BY ALL) GROUP BY 1",
        qn="SELECT bin_us, max(n) / sum(n) AS share FROM (SELECT bin_us, qname, count(*) AS n FROM x GROUP BY ALL) GROUP BY 1",
        wb="SELECT bin_us, min(s) AS s FROM (SELECT bin_us, backend, avg((outcome = 'ok')::INT) AS s FROM x GROUP BY ALL) GROUP BY 1",
        flags="SELECT bin_us, total, coalesce(total > 3 * b_total, false) AS flash_crowd, coalesce(reg.jump AND total < 1.5 * b_total, false) AS regional_spike, pre.share > 0.3 AS single_client_burst, "
        "qn.share > 0.5 AS concentrated_qnames, nx > 0.3 AS high_nxdomain, coalesce(p95 > 2 * b_p95 AND success >= 0.9, false) AS degradation, wb.s < 0.5 AS outage "
        "FROM base JOIN reg USING (bin_us) JOIN pre USING (bin_us) JOIN qn USING (bin_us) JOIN wb USING (bin_us)",
    ),
)
def p11(spark, sf):
    return ex.tag_traffic(client_prefix(v.outcomes(spark, sf).withColumns({"client_family": F.lit("v4"), "client_hi": F.lit(0)})), HOUR)


@query(
    "a10_region_report",
    sql(
        "outc",
        "SELECT region, backend, requests, round(requests / sum(requests) OVER (PARTITION BY region), 6) AS share, p50, p99 FROM (SELECT region, backend, count(*) AS requests FROM outc GROUP BY ALL) "
        "JOIN (SELECT region, round(quantile_cont(latency_us, 0.5), 3) AS p50, round(quantile_cont(latency_us, 0.99), 3) AS p99 FROM outc GROUP BY 1) USING (region)",
    ),
)
def a10(spark, sf):
    t = ex.region_report(v.outcomes(spark, sf))
    return t.select("region", "backend", "requests", F.round("share", 6).alias("share"), F.round("p50", 3).alias("p50"), F.round("p99", 3).alias("p99"))


def _per_run(spark, sf):
    t = v.samples(spark, sf)
    return t.groupBy("run_id", "scenario", "policy", "rep", "mode").agg(
        F.avg(F.col("recv_us") - F.col("send_us")).alias("mean_us"),
        F.avg((F.col("status") == "ok").cast("double")).alias("success"),
    )


_PER_RUN = "SELECT run_id, scenario, policy, rep, mode, avg(recv_us - send_us) AS mean_us, avg((status = 'ok')::INT) AS success FROM samples GROUP BY ALL"


@query(
    "a11_rep_summary",
    sql(
        "samples",
        "SELECT scenario, policy, mode, count(*) AS n, round(median(mean_us), 4) AS median, round(min(mean_us), 4) AS min, round(max(mean_us), 4) AS max, count(*) < 5 AS too_few FROM r GROUP BY ALL",
        r=_PER_RUN,
    ),
)
def a11(spark, sf):
    t = ex.rep_summary(_per_run(spark, sf), ["scenario", "policy", "mode"], "mean_us")
    return _r(t, "median", "min", "max", digits=4).select("scenario", "policy", "mode", "n", "median", "min", "max", "too_few")


@query(
    "a12_throughput",
    sql(
        "samples",
        "SELECT run_id, slot, coalesce(o.n, 0) AS offered, coalesce(a.n, 0) AS achieved, coalesce(a.k, 0) AS answered, round(1 - a.k / nullif(a.n, 0), 6) AS loss, coalesce(a.n, 0) < coalesce(o.n, 0) AS saturated "
        f"FROM (SELECT run_id, intended_us // {HOUR} AS slot, count(*) AS n FROM samples GROUP BY ALL) o FULL JOIN (SELECT run_id, send_us // {HOUR} AS slot, count(*) AS n, count(recv_us) AS k FROM samples GROUP BY ALL) a USING (run_id, slot)",
    ),
)
def a12(spark, sf):
    return _r(ex.throughput(v.samples(spark, sf), HOUR), "loss")


@query(
    "a13_co_latency",
    sql(
        "samples",
        "SELECT scenario, policy, mode, count(recv_us) AS count, round(avg(recv_us - intended_us), 3) AS mean, round(quantile_cont(recv_us - intended_us, 0.5), 3) AS p50, "
        "round(quantile_cont(recv_us - intended_us, 0.95), 3) AS p95, round(quantile_cont(recv_us - intended_us, 0.99), 3) AS p99, max(recv_us - intended_us) AS max FROM samples GROUP BY 1, 2, 3",
    ),
)
def a13(spark, sf):
    return _r(ex.co_latency(v.samples(spark, sf), ["scenario", "policy", "mode"]), "mean", "p50", "p95", "p99", digits=3)


@query(
    "a14_host_usage",
    sql(
        "samples runs",
        "SELECT h.run_id, round(avg(h.cpu), 6) AS cpu_avg, max(h.cpu) AS cpu_max, max(h.rss) AS rss_max, round(avg(h.cpu) / 100 * (any_value(r.ended_us) - any_value(r.started_us)) / any_value(r.offered), 4) AS cpu_us_per_query "
        "FROM (SELECT run_id, (packet_bytes % 100)::DOUBLE AS cpu, packet_bytes::BIGINT * 1000 AS rss FROM samples WHERE seq % 3 = 0) h JOIN runs r USING (run_id) GROUP BY 1",
    ),
)
def a14(spark, sf):
    t = ex.host_usage(v.host_samples(spark, sf), v.runs(spark, sf), v.samples(spark, sf))
    return _r(t.withColumn("cpu_us_per_query", F.round("cpu_us_per_query", 4)), "cpu_avg").select("run_id", "cpu_avg", "cpu_max", "rss_max", "cpu_us_per_query")


@query(
    "a15_ablation",
    sql(
        "samples",
        "SELECT scenario, mode, round(avg(mean_us) FILTER (policy = 'round_robin'), 4) AS round_robin, round(avg(mean_us) FILTER (policy = 'latency_based'), 4) AS latency_based FROM r GROUP BY ALL",
        r=_PER_RUN,
    ),
)
def a15(spark, sf):
    return _r(ex.ablation(_per_run(spark, sf), "policy", v.POLICIES, "mean_us"), *v.POLICIES, digits=4)


@query(
    "a16_mae_report",
    sql(
        "outc",
        "SELECT predictor, round(mae, 4) AS mae FROM (SELECT avg(abs(x - lag_1)) AS persistence, avg(abs(x - avg_6)) AS moving_average FROM f) UNPIVOT (mae FOR predictor IN (persistence, moving_average))",
        series=f"SELECT backend, send_us // {HOUR} * {HOUR} AS t_us, (sum(latency_us) // count(*))::DOUBLE AS x FROM outc WHERE latency_us IS NOT NULL GROUP BY ALL",
        f="SELECT x, lag(x) OVER w AS lag_1, avg(x) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS avg_6 FROM series WINDOW w AS (PARTITION BY backend ORDER BY t_us)",
    ),
)
def a16(spark, sf):
    from dnslens.operators.learning import features
    from dnslens.plans.q_policies import _series

    t = features(_series(spark, sf), ["backend"], "x", lags=(1,), spans=(6,), cell_us=24 * HOUR)
    t = t.selectExpr("x", "lag_1 AS persistence", "avg_6 AS moving_average")
    return _r(ex.mae_report(t, "x", ["persistence", "moving_average"]), "mae", digits=4)


@query(
    "a17_workload_profile",
    sql(
        "samples",
        "SELECT run_id, kind, value, n, round(n / total, 6) AS share FROM (SELECT run_id, 'packet_size' AS kind, (packet_bytes // 64 + 1)::VARCHAR AS value, count(*) AS n FROM s GROUP BY ALL "
        "UNION ALL SELECT run_id, 'qtype', qtype::VARCHAR, count(*) FROM s GROUP BY ALL UNION ALL SELECT run_id, 'qname', qname, count(*) FROM s GROUP BY ALL) JOIN (SELECT run_id, count(*) AS total FROM s GROUP BY 1) USING (run_id)",
        s="SELECT * REPLACE (least(packet_bytes, 512) AS packet_bytes) FROM samples",
    ),
)
def a17(spark, sf):
    return _r(ex.workload_profile(v.samples(spark, sf)), "share").select("run_id", "kind", "value", "n", "share")


@query(
    "a17_peak_concurrency",
    sql(
        "samples",
        "SELECT run_id, CAST(max(c) AS BIGINT) AS peak FROM (SELECT run_id, t, sum(sum(d)) OVER (PARTITION BY run_id ORDER BY t) AS c FROM (SELECT run_id, send_us AS t, 1 AS d FROM samples "
        "UNION ALL SELECT run_id, coalesce(recv_us, send_us + 200000), -1 FROM samples) GROUP BY run_id, t) GROUP BY 1",
    ),
)
def a17_peak(spark, sf):
    return ex.peak_concurrency(v.samples(spark, sf))


_BINS = (
    "SELECT g.run_id, g.bin * {b} AS bin_us, coalesce(n, 0) AS n, coalesce(good, 0) AS good FROM (SELECT run_id, unnest(range(min(send_us // {b}), max(send_us // {b}) + 1)) AS bin FROM samples GROUP BY 1) g "
    "LEFT JOIN (SELECT run_id, send_us // {b} AS bin, count(*) AS n, count(*) FILTER (status = 'ok') AS good FROM samples GROUP BY ALL) s USING (run_id, bin)"
).format(b=BIN)
_HELD = (
    "SELECT run_id, bin_us, bool_and(n > 0 AND good >= 0.6::DOUBLE * n) OVER w AS sustained FROM bins WINDOW w AS (PARTITION BY run_id ORDER BY bin_us ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) QUALIFY count(*) OVER w = 4"
)


def _bins(spark, sf):
    return ex.dense_bins(v.samples(spark, sf), ["run_id"], BIN)


@query("w9_sustained", sql("samples", "SELECT * FROM held", bins=_BINS, held=_HELD))
def w9(spark, sf):
    return ex.sustained(_bins(spark, sf), ["run_id"], BIN, 0.6, 4)


@query(
    "h3_recovery_time",
    sql(
        "samples faults",
        "SELECT fault_id, min(h.bin_us) - any_value(injected_us) AS recovery_us FROM faults f LEFT JOIN (SELECT * FROM held WHERE sustained) h ON h.run_id = f.run_id AND h.bin_us >= f.injected_us GROUP BY 1",
        bins=_BINS,
        held=_HELD,
    ),
)
def h3(spark, sf):
    return ex.recovery_time(v.faults(spark, sf), _bins(spark, sf), BIN, 0.6, 4).select("fault_id", "recovery_us")


@query(
    "j11_bins_after_fault",
    sql("samples faults", "SELECT fault_id, bin_us, n, good FROM faults f JOIN bins b ON b.run_id = f.run_id AND b.bin_us >= f.injected_us", bins=_BINS),
)
def j11(spark, sf):
    return ex.bins_after_fault(v.faults(spark, sf), _bins(spark, sf)).select("fault_id", "bin_us", "n", "good")


@query(
    "j11_latest_fault",
    sql(
        "samples faults",
        "SELECT b.run_id, b.bin_us, b.n, b.good, f.fault_id, b.bin_us - f.injected_us AS age_us FROM bins b ASOF LEFT JOIN faults f ON b.run_id = f.run_id AND b.bin_us >= f.injected_us",
        bins=_BINS,
    ),
)
def j11_latest(spark, sf):
    return ex.latest_fault(_bins(spark, sf), v.faults(spark, sf))


_SHARES = f"SELECT run_id, send_us // {BIN} * {BIN} AS bin_us, backend, count(*) / sum(count(*)) OVER (PARTITION BY run_id, send_us // {BIN}) AS share FROM samples GROUP BY run_id, send_us // {BIN}, backend"


@query(
    "w10_oscillation",
    sql(
        "samples",
        "SELECT run_id, backend, count(*) FILTER (sign(d1) * sign(d0) < 0) AS flips, round(sum(abs(d1)), 6) AS variation, count(*) AS bins FROM (SELECT *, share - lag(share, 1) OVER w AS d1, lag(share, 1) OVER w - lag(share, 2) OVER w AS d0 "
        "FROM shares WINDOW w AS (PARTITION BY run_id, backend ORDER BY bin_us)) GROUP BY 1, 2",
        shares=_SHARES,
    ),
)
def w10(spark, sf):
    shares = ex.share_shift(v.samples(spark, sf), ["run_id"], BIN)
    return _r(ex.oscillation(shares, ["run_id", "backend"]), "variation")


@query(
    "w11_time_to_shift",
    sql(
        "samples faults",
        "SELECT f.fault_id, min(b.bin_us) - any_value(f.injected_us) AS shift_us FROM faults f LEFT JOIN (SELECT f.fault_id, s.bin_us FROM faults f JOIN shares s ON s.run_id = f.run_id AND s.bin_us >= f.injected_us "
        "GROUP BY ALL HAVING coalesce(max(s.share) FILTER (s.backend = f.backend), 0) < 0.1) b USING (fault_id) GROUP BY 1",
        shares=_SHARES,
    ),
)
def w11(spark, sf):
    shares = ex.share_shift(v.samples(spark, sf), ["run_id"], BIN).select("run_id", "bin_us", "backend", "share")
    return ex.time_to_shift(v.faults(spark, sf), shares, 0.1).select("fault_id", "shift_us")


@query(
    "j12_compare_runs",
    sql(
        "samples",
        "SELECT scenario, mode, rep, round(b.mean_us - a.mean_us, 4) AS delta, round(b.mean_us / a.mean_us, 6) AS ratio FROM (SELECT * FROM r WHERE policy = 'round_robin') a FULL JOIN (SELECT * FROM r WHERE policy = 'latency_based') b USING (scenario, mode, rep)",
        r=_PER_RUN,
    ),
)
def j12(spark, sf):
    r = _per_run(spark, sf)
    t = ex.compare_runs(r.filter("policy = 'round_robin'"), r.filter("policy = 'latency_based'"), ["scenario", "mode", "rep"], ["mean_us"])
    return t.select("scenario", "mode", "rep", F.round("mean_us_delta", 4).alias("delta"), F.round("mean_us_ratio", 6).alias("ratio"))


@query(
    "j13_crosscheck",
    sql(
        "samples",
        "SELECT scenario, rep, round(abs(b.success - a.success) / greatest(a.success, b.success), 6) AS relative, abs(b.success - a.success) / greatest(a.success, b.success) <= 0.05 AS agrees "
        "FROM (SELECT * FROM r WHERE policy = 'round_robin') a JOIN (SELECT * FROM r WHERE policy = 'latency_based') b USING (scenario, rep)",
        r=_PER_RUN,
    ),
)
def j13(spark, sf):
    r = _per_run(spark, sf)
    t = ex.crosscheck(r.filter("policy = 'round_robin'"), r.filter("policy = 'latency_based'"), ["scenario", "rep"], "success", 0.05)
    return t.select("scenario", "rep", F.round("relative", 6).alias("relative"), "agrees")


