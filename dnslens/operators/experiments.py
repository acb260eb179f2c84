"""Analysis of recorded benchmark runs.

Runs of mode A (synthetic decisions) and mode B (real wire) are never mixed: reports group
by ``mode``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnslens.operators.scans import BLOCK, bounded_windows, numbered, running
from dnslens.operators.telemetry import inflight, latency_summary

# Two-sided 95 % quantiles of Student's t for 9 to 29 degrees of freedom.
T_95 = (
    2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064,
    2.060, 2.056, 2.052, 2.048, 2.045,
)

#: Bins of one row of a grid before it is spread.
GRID_BLOCK = 10_000

#: Bins and faults of a run that one task sorts: an hour, 36,000 bins of 100 ms.
FAULT_CELL = 3_600_000_000


def failovers(att: DataFrame) -> DataFrame:
    """Count of (from, to) pairs between successive attempts of a query."""
    w = Window.partitionBy("query_id").orderBy("attempt_no")
    moved = att.select(F.lag("backend").over(w).alias("from"), F.col("backend").alias("to"))
    return moved.filter("`from` <> `to`").groupBy("from", "to").agg(F.count("*").alias("n"))


def share_shift(t: DataFrame, keys: Sequence[str], bin_us: int, t_us: str = "send_us") -> DataFrame:
    """Traffic share of every backend per bin (the input of shift and oscillation measures)."""
    counts = t.groupBy(*keys, F.expr(f"{t_us} div {bin_us} * {bin_us}").alias("bin_us"), "backend").agg(
        F.count("*").alias("n")
    )
    totals = counts.groupBy(*keys, "bin_us").agg(F.sum("n").alias("total"))
    return counts.join(totals, [*keys, "bin_us"]).withColumn("share", F.col("n") / F.col("total"))


def region_report(t: DataFrame) -> DataFrame:
    """Latency per region and the share of each backend in the region's traffic."""
    load = t.groupBy("region", "backend").agg(F.count("*").alias("requests"))
    totals = load.groupBy("region").agg(F.sum("requests").alias("region_requests"))
    lat = latency_summary(t, ["region"])
    return (
        load.join(totals, "region")
        .join(lat, "region", "left")
        .withColumn("share", F.col("requests") / F.col("region_requests"))
    )


def rep_summary(per_run: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Median, minimum and maximum over repetitions; a 95 % interval from n = 10 on.

    ``per_run`` has one row per run.
    """
    out = per_run.groupBy(*keys).agg(
        F.count(metric).alias("n"),
        F.median(metric).alias("median"),
        F.min(metric).alias("min"),
        F.max(metric).alias("max"),
        F.avg(metric).alias("mean"),
        F.stddev(metric).alias("sd"),
    )
    table = ", ".join(f"{x}D" for x in T_95)
    t_value = f"coalesce(try_element_at(array({table}), cast(n - 9 AS INT)), 1.96D)"
    half = f"CASE WHEN n >= 10 THEN {t_value} * sd / sqrt(n) END"
    return out.withColumns(
        {
            "ci_low": F.expr(f"mean - {half}"),
            "ci_high": F.expr(f"mean + {half}"),
            "too_few": F.col("n") < 5,
        }
    ).drop("sd")


def throughput(t: DataFrame, interval_us: int = 1_000_000) -> DataFrame:
    """Offered and achieved rate per run and interval, loss, and the saturation flag."""
    offered = t.groupBy("run_id", F.expr(f"intended_us div {interval_us}").alias("slot")).agg(F.count("*").alias("offered"))
    achieved = t.filter("send_us IS NOT NULL").groupBy("run_id", F.expr(f"send_us div {interval_us}").alias("slot")).agg(
        F.count("*").alias("achieved"), F.count("recv_us").alias("answered")
    )
    both = offered.join(achieved, ["run_id", "slot"], "full").na.fill(0, ["offered", "achieved", "answered"])
    return both.withColumns(
        {
            "loss": F.expr("CASE WHEN achieved > 0 THEN 1 - answered / achieved END"),
            "saturated": F.expr("achieved < offered"),
        }
    )


def run_validity(t: DataFrame, interval_us: int = 1_000_000) -> DataFrame:
    """Whole-run view: a run whose sends fell behind is invalid for throughput claims."""
    span = t.groupBy("run_id").agg(
        F.count("*").alias("offered"),
        F.count("send_us").alias("achieved"),
        F.count("recv_us").alias("answered"),
        F.max(F.col("send_us") - F.col("intended_us")).alias("max_lag_us"),
    )
    return span.withColumn("valid", F.expr(f"achieved >= offered AND max_lag_us < {interval_us}"))


def co_latency(t: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latency from the *intended* send time, free of coordinated omission."""
    return latency_summary(t.withColumn("co_us", F.col("recv_us") - F.col("intended_us")), keys, "co_us")


def host_usage(samples: DataFrame, runs: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """CPU and memory of the host samples that fall inside each run."""
    span = runs.select("run_id", "started_us", "ended_us")
    inside = samples.join(span, "run_id").filter("t_us BETWEEN started_us AND ended_us")
    out = inside.groupBy("run_id", "process").agg(
        F.avg("cpu_pct").alias("cpu_avg"), F.max("cpu_pct").alias("cpu_max"), F.max("rss_bytes").alias("rss_max")
    )
    if queries is None:
        return out
    counts = queries.groupBy("run_id").agg(F.count("*").alias("queries"))
    wide = out.join(counts, "run_id").join(span, "run_id")
    busy = F.expr("cpu_avg / 100 * (ended_us - started_us) / queries")
    return wide.withColumn("cpu_us_per_query", busy).drop("started_us", "ended_us")


def ablation(t: DataFrame, variant_col: str, variants: Sequence[str], metric: str, keys: Sequence[str] = ("scenario", "mode")) -> DataFrame:
    """One column per variant, filled with the mean of the metric."""
    return t.groupBy(*keys).pivot(variant_col, list(variants)).agg(F.avg(metric))


def mae_report(t: DataFrame, truth: str, predictions: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean absolute error of each predictor, one row per predictor."""
    wide = t.groupBy(*keys).agg(*[F.avg(F.abs(F.col(truth) - F.col(p))).alias(p) for p in predictions])
    items = ", ".join(f"'{p}', `{p}`" for p in predictions)
    return wide.selectExpr(*[f"`{k}`" for k in keys], f"stack({len(predictions)}, {items}) AS (predictor, mae)")


def workload_profile(t: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Shares of packet-size buckets, query types and names within each run."""
    parts = None
    for kind, expr in (
        ("packet_size", "cast(width_bucket(packet_bytes, 0, 512, 8) AS STRING)"),
        ("qtype", "cast(qtype AS STRING)"),
        ("qname", "qname"),
    ):
        part = t.groupBy(*keys, F.expr(expr).alias("value")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
        parts = part if parts is None else parts.unionByName(part)
    totals = t.groupBy(*keys).agg(F.count("*").alias("total"))
    return parts.join(totals, list(keys)).withColumn("share", F.col("n") / F.col("total"))


def peak_concurrency(t: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Largest number of outstanding queries per run."""
    open_until = t.withColumn("deadline_us", F.coalesce("recv_us", F.col("send_us") + 200_000))
    return inflight(open_until, keys).groupBy(*keys).agg(F.max("inflight").cast("long").alias("peak"))


# -- recovery ---------------------------------------------------------------------------------


def dense_bins(t: DataFrame, keys: Sequence[str], bin_us: int, t_us: str = "send_us", ok: str = "status = 'ok'") -> DataFrame:
    """Success counts per bin with no gaps between the first and last bin of a key."""
    seen = t.groupBy(*keys, F.expr(f"{t_us} div {bin_us}").alias("bin")).agg(
        F.count("*").alias("n"), F.expr(f"count_if({ok})").alias("good")
    )
    span = seen.groupBy(*keys).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    # Two levels: no row holds more than GRID_BLOCK bins, and the blocks of a long run go to many tasks.
    blocks = span.select(*keys, "lo", "hi", F.explode(F.expr(f"sequence(lo div {GRID_BLOCK}, hi div {GRID_BLOCK})")).alias("block"))
    inside = f"sequence(greatest(lo, block * {GRID_BLOCK}), least(hi, (block + 1) * {GRID_BLOCK} - 1))"
    grid = blocks.repartition(*keys, "block").select(*keys, F.explode(F.expr(inside)).alias("bin"))
    return (
        grid.join(seen, [*keys, "bin"], "left")
        .na.fill(0, ["n", "good"])
        .withColumn("bin_us", F.col("bin") * bin_us)
        .drop("bin")
    )


def sustained(bins: DataFrame, keys: Sequence[str], bin_us: int, threshold: float = 0.99, count: int = 10) -> DataFrame:
    """For each bin that ``count - 1`` bins follow: does success stay >= threshold from here on.

    An empty bin counts as not recovered.
    """
    good = F.expr(f"n > 0 AND good >= {threshold}D * n").cast("int")

    def exprs(w):
        frame = w.rowsBetween(-(count - 1), 0)
        return {"__all": F.min(good).over(frame), "__seen": F.count(F.lit(1)).over(frame)}

    looked = bounded_windows(bins, keys, "bin_us", count, exprs, cell=1_000 * bin_us)
    return looked.filter(F.col("__seen") == count).select(
        *keys,
        (F.col("bin_us") - (count - 1) * bin_us).alias("bin_us"),
        (F.col("__all") == 1).alias("sustained"),
    )


def bins_after_fault(faults: DataFrame, bins: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Every fault with the bins of its run from the injection on.

    Faults are few per run, so the join key is the run and the time is a filter.
    """
    return faults.join(bins, list(keys)).filter("bin_us >= injected_us")


def latest_fault(bins: DataFrame, faults: DataFrame, keys: Sequence[str] = ("run_id",), cell: int = FAULT_CELL) -> DataFrame:
    """Bins with the last fault of their run injected by then (of several at one instant the largest id), and its age.

    One row per bin however many faults a run has; bins before the first fault have nulls.
    """
    keys, names = list(keys), [c for c in bins.columns if c not in keys]
    fault = F.struct("injected_us", "fault_id")
    line = bins.select(*keys, F.col("bin_us").alias("t"), F.lit(1).alias("kind"), F.struct(*names).alias("bin"), F.lit(None).cast("struct<injected_us:bigint,fault_id:string>").alias("fault"))
    line = line.union(
        faults.select(*keys, F.col("injected_us").alias("t"), F.lit(0), F.lit(None).cast(line.schema["bin"].dataType), fault)
    )
    seen = running(_known(line, keys), keys, "t", ["kind", "fault"], lasts={"last": F.col("fault")}, cell=cell).filter("kind = 1")
    return seen.select(
        *keys, *[F.col(f"bin.{c}").alias(c) for c in names], F.col("last.fault_id").alias("fault_id"),
        (F.col("t") - F.col("last.injected_us")).alias("age_us"),
    )


def _known(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not null: the others are of no run."""
    return df.filter(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)))


def next_at(asks: DataFrame, marks: DataFrame, keys: Sequence[str], *, ask: str, mark: str, out: str, cell: int) -> DataFrame:
    """``asks`` with ``out``: the first ``mark`` of their key at or after ``ask`` (longs); null if there is none.

    An as-of lookup over time reversed: asks and marks are one timeline, on which the last mark seen is carried. No ask
    meets more than one mark. A null ask or key finds nothing; asks may repeat.
    """
    keys, names = list(keys), [c for c in asks.columns if c not in keys]
    line = asks.select(*keys, (-F.col(ask)).alias("t"), F.lit(1).alias("kind"), F.struct(*names).alias("row"), F.lit(None).cast("long").alias("mark"))
    marks = marks.select(*keys, (-F.col(mark)).alias("t"), F.lit(0), F.lit(None).cast(line.schema["row"].dataType), F.col(mark).cast("long")).distinct()
    can = F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in [*keys, "t"]))
    both = line.union(marks).filter(can)
    found = running(both, keys, "t", ["kind"], lasts={out: F.col("mark")}, cell=cell).filter("kind = 1")
    kept = found.select(*keys, "row", out).union(line.filter(~can).select(*keys, "row", F.lit(None).cast("long")))
    return kept.select(*keys, *[F.col(f"row.{c}").alias(c) for c in names], out)


def recovery_time(
    faults: DataFrame, bins: DataFrame, bin_us: int, threshold: float = 0.99, count: int = 10, cell: int = FAULT_CELL
) -> DataFrame:
    """Time from the fault to the first bin after which success holds; null if never."""
    held = sustained(bins, ["run_id"], bin_us, threshold, count).filter("sustained")
    found = next_at(faults, held, ["run_id"], ask="injected_us", mark="bin_us", out="recovered_us", cell=cell)
    return found.withColumn("recovery_us", F.col("recovered_us") - F.col("injected_us"))


def time_to_shift(faults: DataFrame, shares: DataFrame, x: float = 0.1, cell: int = FAULT_CELL) -> DataFrame:
    """Time from the fault to the first bin in which the faulty backend's share is below x.

    ``shares`` has run_id, bin_us, backend, share; a bin without the backend counts as zero. The bins of a run are
    numbered, and a bin in which a backend has its share is the end of a loaded span if it has not in the next one. A
    fault finds the run's next bin, and if the backend is loaded there the end of that span; one bin on, it is shifted.
    """
    bins = _known(shares, ["run_id", "bin_us"]).select("run_id", "bin_us").distinct()
    bins = numbered(bins, ["run_id"], ["bin_us"], "no")
    low = F.max("share") < x
    loaded = shares.groupBy("run_id", "bin_us", "backend").agg(F.coalesce(low, F.lit(True)).alias("low")).filter("NOT low")
    loaded = loaded.join(bins, ["run_id", "bin_us"]).select("run_id", "backend", "no")
    ends = loaded.join(loaded.withColumn("no", F.col("no") - 1), ["run_id", "backend", "no"], "left_anti")
    at = next_at(faults, bins, ["run_id"], ask="injected_us", mark="bin_us", out="first_us", cell=cell)
    at = at.join(bins.select("run_id", F.col("bin_us").alias("first_us"), "no"), ["run_id", "first_us"], "left")
    at = at.join(loaded.withColumn("busy", F.lit(True)), ["run_id", "backend", "no"], "left")
    at = next_at(at, ends, ["run_id", "backend"], ask="no", mark="no", out="until", cell=BLOCK)
    at = at.withColumn("no", F.when(F.col("busy"), F.col("until") + 1).otherwise(F.col("no")))
    out = at.join(bins.select("run_id", "no", F.col("bin_us").alias("shifted_us")), ["run_id", "no"], "left")
    return out.select(*faults.columns, "shifted_us").withColumn("shift_us", F.col("shifted_us") - F.col("injected_us"))


def oscillation(shares: DataFrame, keys: Sequence[str] = ("backend",), cell: int = 3_600_000_000_000) -> DataFrame:
    """Sign changes of successive share differences, and their total variation."""
    def exprs(w):
        d1 = F.col("share") - F.lag("share", 1).over(w)
        d0 = F.lag("share", 1).over(w) - F.lag("share", 2).over(w)
        return {"delta": d1, "flip": F.coalesce(F.signum(d1) * F.signum(d0) < 0, F.lit(False))}

    steps = bounded_windows(shares, keys, "bin_us", 2, exprs, cell=cell)
    return steps.groupBy(*keys).agg(
        F.count_if("flip").alias("flips"), F.sum(F.abs("delta")).alias("variation"), F.count("*").alias("bins")
    )


# -- comparisons ---------------------------------------------------------------------------------


def compare_runs(a: DataFrame, b: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Paired differences (b against a) for equal keys; unpaired rows stay visible."""
    left = a.select(*keys, *[F.col(m).alias(f"{m}_a") for m in metrics])
    right = b.select(*keys, *[F.col(m).alias(f"{m}_b") for m in metrics])
    out = left.join(right, list(keys), "full")
    for m in metrics:
        out = out.withColumn(f"{m}_delta", F.col(f"{m}_b") - F.col(f"{m}_a"))
        out = out.withColumn(f"{m}_ratio", F.try_divide(F.col(f"{m}_b"), F.col(f"{m}_a")))
    return out


def crosscheck(a: DataFrame, b: DataFrame, keys: Sequence[str], metric: str, tol: float) -> DataFrame:
    """Whether two tools agree on a metric within a relative tolerance."""
    both = compare_runs(a, b, keys, [metric])
    rel = F.abs(F.col(f"{metric}_delta")) / F.greatest(F.abs(F.col(f"{metric}_a")), F.abs(F.col(f"{metric}_b")))
    return both.withColumn("relative", rel).withColumn("agrees", F.coalesce(rel <= tol, F.lit(False)))


# -- traffic patterns -------------------------------------------------------------------------------


def tag_traffic(t: DataFrame, bin_us: int, history: int = 24) -> DataFrame:
    """Traffic-pattern flags per bin.

    ``t`` has send_us, region, backend, prefix, qname, outcome, rcode_class, latency_us.
    Ratios are against the mean of the previous ``history`` bins; bins without history get
    no ratio flag.
    """
    t = t.withColumn("bin_us", F.expr(f"send_us div {bin_us} * {bin_us}"))
    # One pass over the log serves the totals, the regions and the backends.
    cells = t.groupBy("bin_us", "region", "backend").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("outcome") == "ok").alias("ok"),
        F.count_if(F.col("rcode_class") == "nxdomain").alias("nx"),
    )
    total = cells.groupBy("bin_us").agg(
        F.sum("n").alias("total"),
        (F.sum("ok") / F.sum("n")).alias("success"),
        (F.sum("nx") / F.sum("n")).alias("nxdomain"),
    )

    def top(col: str, name: str) -> DataFrame:
        counts = t.groupBy("bin_us", col).agg(F.count("*").alias("n"))
        return counts.groupBy("bin_us").agg((F.max("n") / F.sum("n")).alias(name))

    worst = (
        cells.groupBy("bin_us", "backend").agg((F.sum("ok") / F.sum("n")).alias("s"))
        .groupBy("bin_us").agg(F.min("s").alias("worst_backend"))
    )
    p95 = latency_summary(t, ["bin_us"], ps=(0.95,)).select("bin_us", "p95")
    regions = cells.groupBy("region", "bin_us").agg(F.sum("n").alias("n"))
    cell = 1_000 * bin_us

    def mean_before(col: str):
        return lambda w: {f"base_{col}": F.avg(col).over(w.rowsBetween(-history, -1))}

    regional = bounded_windows(regions, ["region"], "bin_us", history, mean_before("n"), cell=cell)
    spike = regional.groupBy("bin_us").agg(F.max(F.coalesce(F.col("n") > 3 * F.col("base_n"), F.lit(False))).alias("region_jump"))
    base = total.join(p95, "bin_us", "left")
    base = bounded_windows(
        base, [], "bin_us", history, lambda w: {**mean_before("total")(w), **mean_before("p95")(w)}, cell=cell
    )
    for part in (spike, top("prefix", "top_prefix"), top("qname", "top_qname"), worst):
        base = base.join(part, "bin_us", "left")
    flags = {
        "flash_crowd": "total > 3 * base_total",
        "regional_spike": "region_jump AND total < 1.5D * base_total",
        "single_client_burst": "top_prefix > 0.3D",
        "concentrated_qnames": "top_qname > 0.5D",
        "high_nxdomain": "nxdomain > 0.3D",
        "degradation": "p95 > 2 * base_p95 AND success >= 0.9D",
        "outage": "worst_backend < 0.5D",
    }
    base = base.withColumns({k: F.expr(f"coalesce({c}, false)") for k, c in flags.items()})
    hits = " + ".join(f"cast({k} AS INT)" for k in flags)
    first = " ".join(f"WHEN {k} THEN '{k}'" for k in flags)
    return base.withColumn("pattern", F.expr(f"CASE WHEN {hits} >= 2 THEN 'mixed' {first} ELSE 'normal' END")).select(
        "bin_us", "total", *flags, "pattern"
    )
