"""Rates, histograms, exact percentiles, decayed averages and inflight counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnslens.functions.histogram import bucket_mid, bucket_of, bucket_upper
from dnslens.operators.folds import chunked_fold
from dnslens.operators.prepare import check_labels
from dnslens.operators.scans import running


def window_rates(t: DataFrame, period_us: int = 100_000, keys: Sequence[str] = ("backend",), t_us: str = "send_us") -> DataFrame:
    """Counts and rates per window and key."""
    n = F.col("requests")
    agg = t.groupBy((F.floor(F.col(t_us) / period_us) * period_us).cast("long").alias("window_us"), *keys).agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
        F.count_if(F.col("outcome") == "timeout").alias("timeouts"),
        F.count_if(F.col("rcode_class") == "servfail").alias("servfails"),
    )
    return agg.select(
        "*",
        (n / (period_us / 1e6)).alias("qps"),
        (F.col("errors") / n).alias("error_rate"),
        (F.col("timeouts") / n).alias("timeout_rate"),
        (F.col("servfails") / n).alias("servfail_rate"),
    )


def counter_delta(
    t: DataFrame, keys: Sequence[str], counters: Sequence[str], t_us: str = "t_us", cell_us: int = 3_600_000_000
) -> DataFrame:
    """Increments of cumulative counters; a decrease means a restart, so the value counts.

    For binned counters: one task sorts the bins of one key and cell.
    """
    prev = running(t, keys, t_us, before={f"p_{c}": F.col(c) for c in counters}, cell=cell_us)
    deltas = [
        F.when(F.col(f"p_{c}").isNull() | (F.col(c) < F.col(f"p_{c}")), F.col(c))
        .otherwise(F.col(c) - F.col(f"p_{c}"))
        .alias(f"d_{c}")
        for c in counters
    ]
    return prev.select(*t.columns, *deltas)


def histogram(t: DataFrame, col: str, keys: Sequence[str]) -> DataFrame:
    """Sparse latency histogram: one row per (keys, bucket)."""
    return (
        t.filter(F.col(col).isNotNull())
        .groupBy(*keys, bucket_of(F.col(col)).alias("bucket"))
        .agg(F.count("*").alias("cnt"))
    )


def merge_hist(h: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Histograms add up bucket by bucket, in any order."""
    return h.groupBy(*keys, "bucket").agg(F.sum("cnt").alias("cnt"))


def hist_percentiles(h: DataFrame, keys: Sequence[str], ps: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles on bucket midpoints (a key has at most 1,552 buckets)."""
    w = Window.partitionBy(*keys)
    cum = h.withColumn("cum", F.sum("cnt").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    cum = cum.withColumn("total", F.sum("cnt").over(w))
    picks = [
        F.min(F.when(F.col("cum") >= F.ceil(F.lit(p) * F.col("total")), F.col("bucket"))).alias(f"b_{_pname(p)}")
        for p in ps
    ]
    out = cum.groupBy(*keys).agg(F.first("total").alias("count"), *picks)
    return out.select(*keys, "count", *[bucket_mid(F.col(f"b_{_pname(p)}")).alias(_pname(p)) for p in ps])


def _pname(p: float) -> str:
    return "p" + f"{p * 100:g}".replace(".", "_")


def latency_summary(
    t: DataFrame, keys: Sequence[str], col: str = "latency_us", ps: Sequence[float] = (0.5, 0.95, 0.99)
) -> DataFrame:
    """Count, mean, exact percentiles and maximum per key, from one pass over the log.

    Everything is computed from the (key, value) counts.
    """
    keys = list(keys)
    counts = t.filter(F.col(col).isNotNull()).groupBy(*keys, F.col(col).cast("long").alias("v")).agg(F.count("*").alias("c"))
    cum = running(counts, keys, "v", sums={"cum": F.col("c")}, cell=4_096)
    totals = counts.groupBy(*keys).agg(
        F.sum("c").alias("count"), F.sum(F.col("c") * F.col("v")).alias("total"), F.max("v").alias("max")
    )
    picks = []
    for p in ps:
        pos = F.lit(float(p)) * (F.col("count") - 1)
        picks += [
            F.min(F.when(F.col("cum") > F.floor(pos), F.col("v"))).alias(f"lo_{_pname(p)}"),
            F.min(F.when(F.col("cum") > F.ceil(pos), F.col("v"))).alias(f"hi_{_pname(p)}"),
        ]
    out = (
        cum.join(totals, keys)
        .groupBy(*keys)
        .agg(*[F.first(c).alias(c) for c in ("count", "total", "max")], *picks)
    )
    cols = []
    for p in ps:
        pos = F.lit(float(p)) * (F.col("count") - 1)
        lo, hi = F.col(f"lo_{_pname(p)}"), F.col(f"hi_{_pname(p)}")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(_pname(p)))
    return out.select(*keys, "count", (F.col("total") / F.col("count")).alias("mean"), *cols, "max")


def le_buckets(h: DataFrame, bounds_us: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """Cumulative ``le`` counts: all observations in buckets that end at or below a bound."""
    bounds = sorted(bounds_us)
    counts = h.groupBy(*keys).agg(
        *[F.sum(F.when(bucket_upper(F.col("bucket")) <= b, F.col("cnt")).otherwise(0)).alias(f"le_{b}") for b in bounds],
        F.sum("cnt").alias("le_inf"),
    )
    pairs = [F.struct(F.lit(str(b)).alias("le"), F.col(f"le_{b}").alias("cnt")) for b in bounds]
    pairs.append(F.struct(F.lit("+Inf").alias("le"), F.col("le_inf").alias("cnt")))
    return counts.select(*keys, F.explode(F.array(*pairs)).alias("x")).select(*keys, "x.le", "x.cnt")


def rollup_metrics(t: DataFrame, levels: Sequence[Sequence[str]] = (("backend", "region"), ("backend",), ("region",), ())) -> DataFrame:
    """Request counters at several label levels in one aggregation."""
    labels = sorted({c for level in levels for c in level})
    check_labels(labels)
    return (
        t.groupingSets([[F.col(c) for c in level] for level in levels], *[F.col(c) for c in labels])
        .agg(
            F.count("*").alias("requests"),
            F.count_if(F.col("outcome") != "ok").alias("failures"),
            F.grouping_id().alias("level"),
        )
        .select(*labels, "requests", "failures", "level")
    )


def metric_samples(t: DataFrame, name: str, labels: Sequence[str], value: Column, ts: Column | None = None) -> DataFrame:
    """One metric as rows of (ts, name, labels, value)."""
    check_labels([c for c in labels if c not in ("le", "kind", "action", "from", "to", "rcode")])
    pairs = [x for c in labels for x in (F.lit(c), F.col(c).cast("string"))]
    labelled = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return t.select(
        (ts if ts is not None else F.current_timestamp()).alias("ts"),
        F.lit(name).alias("name"),
        labelled.alias("labels"),
        value.cast("double").alias("value"),
    )


def inflight(done: DataFrame, keys: Sequence[str], cell_us: int = 1_000_000) -> DataFrame:
    """Inflight count after every instant at which it changes.

    +1 at send, -1 at the response or, without one, at the deadline. Changes at one
    instant are summed before the running sum, so a cell of a second has a million rows at most.
    """
    end = F.coalesce(F.col("recv_us"), F.col("deadline_us"))
    steps = F.array(
        F.struct(F.col("send_us").alias("t_us"), F.lit(1).alias("d")),
        F.struct(end.alias("t_us"), F.lit(-1).alias("d")),
    )
    changes = (
        done.select(*keys, F.explode(steps).alias("s")).groupBy(*keys, "s.t_us").agg(F.sum("s.d").alias("delta"))
    )
    return running(changes, keys, "t_us", sums={"inflight": F.col("delta")}, cell=cell_us)


#: Attempts of one key and cell up to which one task sorts them with their ends.
MAX_BURST = 1_000_000


def inflight_at_send(
    done: DataFrame, backends: Sequence[str], keys: Sequence[str] = ("worker_id",), cell_us: int = 1_000_000
) -> DataFrame:
    """For each attempt, the inflight count per backend just before it is sent.

    ``backends`` is the configured pool; the result has one map per row, null without a key or a time. Where no attempt
    lasts longer than a cell, one that ends in the next cell is entered there once more, so each cell is counted on its
    own and the log is shuffled once. ``done`` is read twice for that (store it): first to see how long attempts last and
    how many a cell has. Longer ones and bursts beyond ``MAX_BURST`` take a scan over the worker's timeline.
    """
    keys = list(keys)
    known = " AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, "send_us"))
    timed = done.withColumn("__end", F.coalesce("recv_us", "deadline_us"))

    def cell(t: str) -> str:
        return f"({t} - pmod({t}, {cell_us}L)) div {cell_us}L"

    per = timed.groupBy(*keys, F.expr(cell("send_us")).alias("__cell")).agg(
        F.expr(f"count_if({known}) AS n"), F.expr(f"count_if(NOT ({known})) AS unknown"), F.expr("count_if(__end IS NULL) AS endless"),
        F.expr("max(__end - send_us) AS longest"), F.expr("min(__end - send_us) AS shortest"),
    )
    most = per.agg(F.max("n"), F.sum("unknown"), F.sum("endless"), F.max("longest"), F.min("shortest")).first()
    n, unknown, endless, longest, shortest = most
    if not n or n > MAX_BURST or endless or longest > cell_us or shortest < 0:
        return _inflight_by_scan(done, backends, keys, cell_us)

    first, last = cell("send_us"), cell("__end")
    steps = timed.filter(known).selectExpr(
        "*",
        f"explode(concat(array(struct(send_us AS t, {first} AS cell, 1 AS d, true AS sent), struct(__end AS t, {last} AS cell, -1 AS d, false AS sent)), "
        f"CASE WHEN {last} > {first} THEN array(struct({last} * {cell_us}L - 1 AS t, {last} AS cell, 1 AS d, false AS sent)) ELSE array() END)) AS __s",
    ).selectExpr(*[f"`{c}`" for c in done.columns], "__s.t AS __t", "__s.cell AS __cell", "__s.d AS __d", "__s.sent AS __sent")
    earlier = Window.partitionBy(*keys, "__cell").orderBy("__t").rangeBetween(Window.unboundedPreceding, -1)
    sums = [F.sum(F.when(F.col("backend") == b, F.col("__d"))).over(earlier).alias(f"__n{i}") for i, b in enumerate(backends)]
    pairs = [x for i, b in enumerate(backends) for x in (F.lit(b), F.coalesce(f"__n{i}", F.lit(0)).cast("long"))]
    kept = [*keys, "send_us", *[c for c in done.columns if c not in (*keys, "send_us")]]
    counted = steps.select("*", *sums).filter("__sent").select(*kept, F.create_map(*pairs).alias("inflight"))
    if not unknown:
        return counted
    rest = done.filter(f"NOT ({known})").select(*kept, F.lit(None).cast("map<string,bigint>").alias("inflight"))
    return counted.unionByName(rest)


def _inflight_by_scan(done: DataFrame, backends: Sequence[str], keys: list[str], cell_us: int) -> DataFrame:
    """``inflight_at_send`` for any length of attempts and bursts; one scan serves all backends."""
    end = F.coalesce(F.col("recv_us"), F.col("deadline_us"))
    steps = F.array(
        F.struct(F.col("send_us").alias("t_us"), F.lit(1).alias("d")),
        F.struct(end.alias("t_us"), F.lit(-1).alias("d")),
    )
    changes = done.select(*keys, "backend", F.explode(steps).alias("s")).groupBy(*keys, "s.t_us").agg(
        *[F.sum(F.when(F.col("backend") == b, F.col("s.d")).otherwise(0)).alias(f"d{i}") for i, b in enumerate(backends)]
    )
    sums = {f"n{i}": F.col(f"d{i}") for i in range(len(backends))}
    state = running(changes, keys, "t_us", sums=sums, cell=cell_us)
    # "Just before": take this instant's own changes back out.
    pairs = [x for i, b in enumerate(backends) for x in (F.lit(b), (F.col(f"n{i}") - F.col(f"d{i}")).cast("long"))]
    maps = state.select(*keys, F.col("t_us").alias("send_us"), F.create_map(*pairs).alias("inflight"))
    return done.join(maps, [*keys, "send_us"], "left")


def ewma(t: DataFrame, keys: Sequence[str], col: str, tau_us: int, t_us: str = "t_us", out: str = "ewma") -> DataFrame:
    """Time-decayed average with alpha = 1 - exp(-dt/tau), as a closed form over chunks.

    E_i = sum_j x_j g_j exp(-(t_i - t_j)/tau), with g = alpha of the step (1 for the first
    row). Inside a chunk of 200 tau the exponentials stay finite. The value carried into a
    chunk needs only the two chunks before it: anything older has decayed by e^-200, below
    what a double can add.
    """
    keys = list(keys)
    chunk = 200 * tau_us
    tau = F.lit(float(tau_us))
    s = running(t, keys, t_us, before={"prev_t": F.col(t_us)}, cell=chunk)
    s = s.withColumn("chunk_no", F.floor(F.col(t_us) / chunk).cast("long"))
    gain = F.when(F.col("prev_t").isNull(), 1.0).otherwise(1 - F.exp(-(F.col(t_us) - F.col("prev_t")) / tau))
    age = (F.col(t_us) - F.col("chunk_no") * chunk) / tau
    upto = Window.partitionBy(*keys, "chunk_no").orderBy(t_us).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("own", F.sum(F.col(col) * gain * F.exp(age)).over(upto) * F.exp(-age))
    ends = s.groupBy(*keys, "chunk_no").agg(F.max_by(F.struct(F.col(t_us).alias("t"), F.col("own").alias("v")), t_us).alias("end"))
    chain = Window.partitionBy(*keys).orderBy("chunk_no")
    ends = ends.select(*keys, "chunk_no", F.lag("end", 1).over(chain).alias("e1"), F.lag("end", 2).over(chain).alias("e2"))
    s = s.join(ends, [*keys, "chunk_no"], "left")
    back1 = F.col("e1.v") * F.exp(-(F.col(t_us) - F.col("e1.t")) / tau)
    back2 = F.col("e2.v") * F.exp(-(F.col(t_us) - F.col("e2.t")) / tau)
    value = F.col("own") + F.coalesce(back1, F.lit(0.0)) + F.coalesce(back2, F.lit(0.0))
    return s.select(*t.columns, value.alias(out))


def peak_ewma_fold(col: str, t_us: str, tau_up: float, tau_down: float, out: str):
    """Rise with tau_up, decay with tau_down; shared by the batch and streaming forms."""

    def fold(pdf: pd.DataFrame, state):
        values = []
        last_t, level = state if state else (None, None)
        for t, x in zip(pdf[t_us].tolist(), pdf[col].tolist()):
            if level is None:
                level = float(x)
            else:
                tau = tau_up if x > level else tau_down
                keep = math.exp(-(t - last_t) / tau)
                level = level * keep + x * (1 - keep)
            last_t = t
            values.append(level)
        out_pdf = pdf.assign(**{out: values})
        return out_pdf, [last_t, level]

    return fold


def peak_ewma(
    t: DataFrame,
    keys: Sequence[str],
    col: str,
    tau_up_us: int,
    tau_down_us: int,
    t_us: str = "t_us",
    out: str = "peak_ewma",
) -> DataFrame:
    """Peak-sensitive average of a binned series (one row per key and bin)."""
    names = [*keys, t_us, col]
    schema = ", ".join(f"`{c}` {t.schema[c].dataType.simpleString()}" for c in names) + f", `{out}` double"
    fold = peak_ewma_fold(col, t_us, float(tau_up_us), float(tau_down_us), out)

    def trimmed(pdf: pd.DataFrame, state):
        res, state = fold(pdf, state)
        return res[[*names, out]], state

    return chunked_fold(t.select(*names), keys, t_us, trimmed, schema, chunk_us=200 * max(tau_up_us, tau_down_us))


def decision_share(t: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Decisions per policy and backend, their share, and chi-square against the weights."""
    counts = t.groupBy("policy", "backend").agg(F.count("*").alias("decisions"))
    w = Window.partitionBy("policy")
    out = counts.withColumn("share", F.col("decisions") / F.sum("decisions").over(w))
    if weights is None:
        return out
    target = weights.select("backend", "weight")
    joined = out.join(target, "backend", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    expected = F.sum("decisions").over(w) * F.col("weight") / F.sum("weight").over(w)
    return (
        joined.withColumn("expected", expected)
        .withColumn("chi2", F.sum((F.col("decisions") - F.col("expected")) ** 2 / F.col("expected")).over(w))
        .drop("weight")
    )
