"""The ten experiment questions, each as a report over the recorded tables.

``tables`` is a dict of frames: ``samples``, ``runs``, ``faults``, ``host_samples`` and,
where named, ``outcomes``, ``states`` or ``predictions``. Every report groups by ``mode``;
the caller's ``runs`` say which scenarios exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnslens.operators import experiments as ex
from dnslens.operators.telemetry import latency_summary

Tables = dict[str, DataFrame]

GROUP = ("scenario", "mode", "policy")


def _latency(t: DataFrame, keys) -> DataFrame:
    return ex.co_latency(t, list(keys))


def report_q1(tables: Tables, base: str = "round_robin", other: str = "latency_based") -> DataFrame:
    """Latency of one policy against another, paired by scenario, mode and repetition."""
    lat = _latency(tables["samples"], [*GROUP, "rep"])
    a, b = lat.filter(F.col("policy") == base), lat.filter(F.col("policy") == other)
    return ex.compare_runs(a, b, ["scenario", "mode", "rep"], ["mean", "p95", "p99"])


def report_q2(tables: Tables, bin_us: int, threshold: float = 0.99, count: int = 10) -> DataFrame:
    """Failed and timed-out queries and the recovery time per variant."""
    s = tables["samples"]
    failed = s.groupBy(*GROUP).agg(
        F.count("*").alias("queries"),
        F.count_if(F.col("status") == "fail").alias("failed"),
        F.count_if(F.col("status") == "timeout").alias("timeouts"),
    )
    bins = ex.dense_bins(s, ["run_id"], bin_us)
    rec = ex.recovery_time(tables["faults"], bins, bin_us, threshold, count)
    meta = tables["runs"].select("run_id", *GROUP)
    per = rec.drop(*[c for c in GROUP if c in rec.columns]).join(meta, "run_id").groupBy(*GROUP).agg(
        F.count("recovery_us").alias("recovered"), F.avg("recovery_us").alias("recovery_us")
    )
    return failed.join(per, list(GROUP), "left")


def report_q3(tables: Tables, bin_us: int) -> DataFrame:
    """p95 and p99 over time per policy."""
    t = tables["samples"].withColumn("bin_us", F.expr(f"send_us div {bin_us} * {bin_us}"))
    return _latency(t, [*GROUP, "bin_us"])


def report_q4(tables: Tables) -> DataFrame:
    """Prediction error of the model and its baselines per split."""
    from dnslens.operators.learning import evaluate

    return evaluate(tables["predictions"])


def report_q5(tables: Tables, bin_us: int) -> DataFrame:
    """Success rate and peak queue depth per bin."""
    from dnslens.operators.telemetry import inflight

    s = tables["samples"]
    bins = ex.dense_bins(s, ["run_id"], bin_us)
    depth = inflight(s.withColumn("deadline_us", F.coalesce("recv_us", F.col("send_us") + 200_000)), ["run_id"])
    peak = depth.groupBy("run_id", F.expr(f"t_us div {bin_us} * {bin_us}").alias("bin_us")).agg(
        F.max("inflight").cast("long").alias("peak_depth")
    )
    meta = tables["runs"].select("run_id", "scenario", "mode", "policy")
    return (
        bins.join(peak, ["run_id", "bin_us"], "left").na.fill(0, ["peak_depth"]).join(meta, "run_id")
        .withColumn("success", F.expr("CASE WHEN n > 0 THEN good / n END"))
        .select("run_id", "scenario", "mode", "policy", "bin_us", "n", "success", "peak_depth")
    )


def report_q6(tables: Tables, bin_us: int, x: float = 0.1) -> DataFrame:
    """Tail latency and the speed of traffic shift per fault kind."""
    shares = ex.share_shift(tables["samples"], ["run_id"], bin_us).select("run_id", "bin_us", "backend", "share")
    shift = ex.time_to_shift(tables["faults"], shares, x).select("run_id", "kind", "shift_us")
    meta = tables["runs"].select("run_id", "mode")
    p99 = latency_summary(
        tables["samples"].withColumn("co_us", F.col("recv_us") - F.col("intended_us")), ["run_id"], "co_us", (0.99,)
    ).select("run_id", "p99")
    return shift.join(p99, "run_id").join(meta, "run_id").groupBy("kind", "mode").agg(
        F.count("*").alias("runs"), F.avg("p99").alias("p99"), F.avg("shift_us").alias("shift_us"),
        F.count("shift_us").alias("shifted"),
    )


def report_q7(tables: Tables) -> DataFrame:
    """Latency per client region, and each backend's load."""
    s = tables["samples"]
    lat = _latency(s, ["mode", "policy", "region"]).select("mode", "policy", "region", "count", "p50", "p99")
    load = s.groupBy("mode", "policy", "region", "backend").agg(F.count("*").alias("requests"))
    totals = load.groupBy("mode", "policy", "region").agg(F.sum("requests").alias("t"))
    return (
        load.join(totals, ["mode", "policy", "region"]).join(lat, ["mode", "policy", "region"], "left")
        .select("mode", "policy", "region", "backend", "requests", (F.col("requests") / F.col("t")).alias("share"), "p50", "p99")
    )


def _by_variant(tables: Tables, variant: str) -> DataFrame:
    """Rate, latency and CPU per value of one variant column."""
    s = tables["samples"]
    keys = ["scenario", "mode", variant]
    lat = _latency(s, keys).select(*keys, "count", "p50", "p99")
    meta = tables["runs"].select("run_id", *keys) if variant in tables["runs"].columns else None
    usage = ex.host_usage(tables["host_samples"], tables["runs"], s).select("run_id", "cpu_us_per_query")
    meta = meta if meta is not None else s.select("run_id", *keys).distinct()
    cpu = usage.join(meta, "run_id").groupBy(*keys).agg(F.avg("cpu_us_per_query").alias("cpu_us_per_query"))
    rate = s.groupBy(*keys).agg(
        (F.count("*") / ((F.max("intended_us") - F.min("intended_us")) / 1e6)).alias("per_second")
    )
    return rate.join(lat, keys, "left").join(cpu, keys, "left")


def report_q8(tables: Tables) -> DataFrame:
    """Overhead of the control layer: off, in process, external (column ``policy`` or ``control``)."""
    return _by_variant(tables, "control" if "control" in tables["samples"].columns else "policy")


def report_q9(tables: Tables) -> DataFrame:
    """Packet paths compared on recorded results."""
    return _by_variant(tables, "packet_io")


def report_q10(tables: Tables) -> DataFrame:
    """Transports compared with UDP."""
    return _by_variant(tables, "transport")
