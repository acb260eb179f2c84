"""Health signals, the state machine, ejection guard and run conditions."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnslens.functions.factors import DEGRADED, HEALTHY, RECOVERING, UNHEALTHY
from dnslens.operators.folds import chunked_fold
from dnslens.operators.scans import bounded_windows, run_lengths


@dataclass(frozen=True)
class HealthConfig:
    """Thresholds; counts are windows or probes, times are microseconds."""

    degrade_threshold: float = 0.05
    eject_threshold: float = 0.5
    latency_slo_us: int = 200_000
    degrade_windows: int = 3
    clean_windows: int = 5
    recover_windows: int = 5
    fail_threshold: int = 3
    recovery_threshold: int = 2
    cooldown_us: int = 5_000_000
    cooldown_cap_us: int = 60_000_000
    max_ejection_percent: int = 50


def health_signals(probes: DataFrame, rates: DataFrame, period_us: int) -> DataFrame:
    """Active probes and passive windows as one stream of (window, backend, kind, ...)."""
    window = (F.floor(F.col("t_us") / period_us) * period_us).cast("long").alias("window_us")
    active = probes.groupBy(window, "backend").agg(
        F.count("*").alias("probes"),
        F.count_if(~F.col("ok")).alias("probe_failures"),
        # Probe runs at both ends of the window decide consecutive counts across windows.
        F.max_by("ok", "t_us").alias("last_probe_ok"),
    )
    return active.withColumn("kind", F.lit("active")).unionByName(
        rates.withColumn("kind", F.lit("passive")), allowMissingColumns=True
    )


def window_signals(probes: DataFrame, rates: DataFrame, period_us: int) -> DataFrame:
    """One row per (backend, window): traffic counts, p95 if given, and probe results.

    Probes of one window count as consecutive failures (successes) if all of them fail
    (succeed); a mixed window ends both runs.
    """
    s = health_signals(probes, rates, period_us)
    has_p95 = "p95" in s.columns
    return s.groupBy("backend", "window_us").agg(
        F.coalesce(F.sum("requests"), F.lit(0)).cast("long").alias("requests"),
        F.coalesce(F.sum("errors"), F.lit(0)).cast("long").alias("errors"),
        F.coalesce(F.sum("timeouts"), F.lit(0)).cast("long").alias("timeouts"),
        (F.max("p95") if has_p95 else F.lit(None)).cast("double").alias("p95"),
        F.coalesce(F.sum("probes"), F.lit(0)).cast("long").alias("probes"),
        F.coalesce(F.sum("probe_failures"), F.lit(0)).cast("long").alias("probe_failures"),
    )


def run_length(t: DataFrame, pred: Column, keys: list[str], t_us: str = "window_us", out: str = "run", cell_us: int = 3_600_000_000) -> DataFrame:
    """Number of consecutive rows, ending here, on which ``pred`` holds."""
    return run_lengths(t, keys, t_us, {out: pred}, cell=cell_us)


def m_of_m(t: DataFrame, pred: Column, m: int, keys: list[str], t_us: str = "window_us", out: str = "held", cell_us: int = 3_600_000_000) -> DataFrame:
    """Whether ``pred`` held on each of the last ``m`` rows (false until m rows exist)."""
    def exprs(w):
        frame = w.rowsBetween(-(m - 1), 0)
        return {out: (F.min(pred.cast("int")).over(frame) == 1) & (F.count(F.lit(1)).over(frame) == m)}

    return bounded_windows(t, keys, t_us, m, exprs, cell=cell_us)


def cap_ejections(t: DataFrame, pct: int, keys: tuple[str, ...] = ("window_us",)) -> DataFrame:
    """Allow the worst ``pct`` percent of a window's backends to be ejected.

    ``t`` has ``candidate`` and ``severity`` for every backend of the window; adds
    ``ejected``. A group is one pool of backends.
    """
    w = Window.partitionBy(*keys)
    worst = w.orderBy(F.desc(F.col("candidate").cast("int")), F.desc("severity"), "backend")
    cap = F.floor(F.count(F.lit(1)).over(w) * pct / 100)
    return t.withColumn("ejected", F.col("candidate") & (F.row_number().over(worst) <= cap))


def with_ejection_guard(signals: DataFrame, cfg: HealthConfig) -> DataFrame:
    """Add ``may_eject``: passive ejection of this backend is allowed in this window."""
    rate = F.when(F.col("requests") > 0, F.col("timeouts") / F.col("requests")).otherwise(F.lit(0.0))
    t = signals.withColumn("severity", rate).withColumn("candidate", F.col("severity") > cfg.eject_threshold)
    capped = cap_ejections(t, cfg.max_ejection_percent)
    return capped.withColumn("may_eject", F.col("ejected")).drop("severity", "candidate", "ejected")


STATE_COLUMNS = ("backend", "window_us", "state", "previous", "reason", "cooldown_us")


def health_fold(cfg: HealthConfig):
    """The per-backend state machine over windows in time order.

    Batch and stream run this same function; the state survives JSON.
    """
    c = asdict(cfg)

    def fold(pdf: pd.DataFrame, state):
        s = dict(
            state
            or dict(
                state=HEALTHY, bad=0, clean=0, fails=0, oks=0, ejected_at=None, cooldown=c["cooldown_us"]
            )
        )
        out = []
        for row in pdf.itertuples(index=False):
            before, reason = s["state"], None
            traffic = row.requests > 0
            err = row.errors / row.requests if traffic else 0.0
            tmo = row.timeouts / row.requests if traffic else 0.0
            slow = traffic and row.p95 == row.p95 and row.p95 is not None and row.p95 > c["latency_slo_us"]
            bad = traffic and (err > c["degrade_threshold"] or tmo > c["degrade_threshold"] or slow)
            open_circuit = traffic and tmo > c["eject_threshold"]
            if traffic:
                s["bad"] = s["bad"] + 1 if bad else 0
                s["clean"] = 0 if bad else s["clean"] + 1
            if row.probes > 0:
                s["fails"] = s["fails"] + row.probes if row.probe_failures == row.probes else 0
                s["oks"] = s["oks"] + row.probes if row.probe_failures == 0 else 0
            elapsed = s["ejected_at"] is not None and row.window_us - s["ejected_at"] >= s["cooldown"]

            if before == UNHEALTHY and elapsed and s["oks"] >= c["recovery_threshold"]:
                s["state"], reason = RECOVERING, "cooldown_elapsed"
                s["clean"] = 0
            elif before == RECOVERING and open_circuit:
                s["state"], reason = UNHEALTHY, "eject_again"
                s["cooldown"] = min(s["cooldown"] * 2, c["cooldown_cap_us"])
                s["ejected_at"], s["oks"] = row.window_us, 0
            elif before == RECOVERING and s["clean"] >= c["recover_windows"]:
                s["state"], reason = HEALTHY, "recovered"
                s["cooldown"], s["ejected_at"] = c["cooldown_us"], None
                s["bad"] = 0
            elif before in (HEALTHY, DEGRADED) and s["fails"] >= c["fail_threshold"]:
                s["state"], reason = UNHEALTHY, "probe_failures"
                s["ejected_at"], s["oks"] = row.window_us, 0
            elif before in (HEALTHY, DEGRADED) and open_circuit and row.may_eject:
                s["state"], reason = UNHEALTHY, "timeout_rate"
                s["ejected_at"], s["oks"] = row.window_us, 0
            elif before == HEALTHY and s["bad"] >= c["degrade_windows"]:
                s["state"], reason = DEGRADED, "degraded_windows"
            elif before == DEGRADED and s["clean"] >= c["clean_windows"]:
                s["state"], reason = HEALTHY, "clean_windows"
            out.append((row.backend, row.window_us, s["state"], before, reason, s["cooldown"]))
        # Counters beyond their thresholds are all alike; capping lets states agree sooner.
        s["bad"] = min(s["bad"], c["degrade_windows"])
        s["clean"] = min(s["clean"], max(c["clean_windows"], c["recover_windows"]))
        s["fails"] = int(min(s["fails"], c["fail_threshold"]))
        s["oks"] = int(min(s["oks"], c["recovery_threshold"]))
        s = {k: (int(v) if isinstance(v, (int,)) or hasattr(v, "item") else v) for k, v in s.items()}
        return pd.DataFrame(out, columns=list(STATE_COLUMNS)), s

    return fold


HEALTH_SCHEMA = (
    "backend string, window_us long, state string, previous string, reason string, cooldown_us long"
)


def health_fsm(signals: DataFrame, cfg: HealthConfig | None = None, chunk_us: int | None = None) -> DataFrame:
    """State of every backend after every window.

    ``signals`` has one row per (backend, window) as from :func:`window_signals`. The
    ejection guard couples the backends of a window, so it is settled per window first;
    the fold then runs per backend, in time chunks.
    """
    cfg = cfg or HealthConfig()
    guarded = with_ejection_guard(signals, cfg).select(
        "backend", "window_us", "requests", "errors", "timeouts", "p95", "probes", "probe_failures", "may_eject"
    )
    chunk = chunk_us or 20 * cfg.cooldown_cap_us
    return chunked_fold(guarded, ["backend"], "window_us", health_fold(cfg), HEALTH_SCHEMA, chunk_us=chunk)


def transitions(states: DataFrame) -> DataFrame:
    """Transition events: (ts, level, event, fields)."""
    return states.filter(F.col("state") != F.col("previous")).select(
        F.timestamp_micros("window_us").alias("ts"),
        F.lit("warn").alias("level"),
        F.lit("health_transition").alias("event"),
        F.create_map(
            F.lit("backend"), F.col("backend"), F.lit("from"), F.col("previous"),
            F.lit("to"), F.col("state"), F.lit("reason"), F.col("reason"),
        ).alias("fields"),
    )
