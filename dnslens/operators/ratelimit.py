"""Token buckets per (worker, source prefix) and the limit seen across workers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnslens.functions.netaddr import client_prefix
from dnslens.operators.scans import TIE_SPAN, running
from dnslens.session import shared_dir


#: Queries of one (key, bin) that one task puts in order; bins with more are numbered in chunks.
BIN_ROWS = 65_536


def bucket_walk(rate: float, burst: float, bin_us: int):
    """Tokens over consecutive bins of one key, as plain numbers.

    At each bin start the bucket gains rate x elapsed time, up to ``burst``; whole tokens
    are then spent on the bin's queries. A new key starts full.
    """

    def walk(bins: list[int], counts: list[int], state) -> tuple[list[int], list]:
        last, tokens = state if state else (None, float(burst))
        allowed = []
        for b, n in zip(bins, counts):
            if last is not None:
                tokens = min(float(burst), tokens + rate * (b - last) * bin_us / 1e6)
            spend = min(n, math.floor(tokens + 1e-9))
            tokens -= spend
            last = b
            allowed.append(spend)
        return allowed, [last, tokens]

    return walk


def bucket_fold(rate: float, burst: float, bin_us: int):
    """``bucket_walk`` over the rows of one key; the stream's fold."""
    walk = bucket_walk(rate, burst, bin_us)

    def fold(pdf: pd.DataFrame, state):
        allowed, state = walk(pdf["bin"].tolist(), pdf["n"].tolist(), state)
        return pdf.assign(allowed=allowed), state

    return fold


def bin_allowance(counts: DataFrame, rate: float, burst: float, bin_us: int, keys=("worker_id", "prefix")) -> DataFrame:
    """How many queries of each (key, bin) pass; rows with a null key or bin are left out.

    The bins of a key pass one task in order, batch by batch, with two numbers as state. A key has at most as many
    rows as there are bins in the log's time, however many queries it sends. A bucket under permanent load keeps its
    fraction of a token for ever, so a start guessed in the middle of such a series is hardly ever right.
    """
    keys = list(keys)
    names = [*keys, "bin", "n"]
    schema = ", ".join(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in names) + ", allowed long"
    walk = bucket_walk(rate, burst, bin_us)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            turns = np.zeros(max(batch.num_rows - 1, 0), bool)
            for c in columns:
                turns |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(turns) + 1).tolist()]
            bins, ns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bin", "n"))
            allowed: list[int] = []
            for low, high in zip(starts, [*starts[1:], batch.num_rows]):
                now = [c[low].as_py() for c in columns]
                if now != key:
                    key, state = now, None
                some, state = walk(bins[low:high], ns[low:high], state)
                allowed += some
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed, pa.int64())], [*batch.schema.names, "allowed"])

    rows = counts.select(*names).dropna(subset=[*keys, "bin"])
    return rows.repartition(*keys).sortWithinPartitions(*keys, "bin").mapInArrow(run, schema)


def rate_limit(
    q: DataFrame,
    rate: float,
    burst: float,
    bin_us: int = 100_000,
    action: str = "drop",
) -> DataFrame:
    """Add ``allowed`` and ``action`` per query.

    The log is counted per (worker, prefix, bin) first - a flooding prefix becomes one row
    per bin - and only the counts go through the bucket. Inside a bin the first
    ``allowed`` queries by arrival pass: they are ranked where the counts meet the log, but those of a flooded bin
    (``BIN_ROWS``) in chunks of instants and ids. Queries without a worker, prefix or arrival are not decided.
    """
    if action not in ("drop", "refused", "truncate"):
        raise ValueError(f"unknown overload action {action!r}")
    shared_dir(q.sparkSession)
    q = (q if "prefix" in q.columns else client_prefix(q)).withColumn("bin", F.expr(f"arrival_us div {bin_us}"))
    keys = ["worker_id", "prefix", "bin"]
    counts = q.groupBy(*keys).agg(F.count("*").alias("n"))
    allowance = bin_allowance(counts, rate, burst, bin_us).checkpoint()
    quotas = allowance.select(*keys, F.col("allowed").alias("quota"))
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    # There is at most one flooded bin for every BIN_ROWS queries.
    flooded = allowance.filter(F.col("n") > BIN_ROWS).select(*keys)
    some = not flooded.isEmpty()
    rest = q.filter(known)
    calm = rest.join(F.broadcast(flooded), keys, "left_anti") if some else rest
    order = Window.partitionBy(*keys).orderBy("arrival_us", "query_id")
    out = calm.join(quotas, keys, "left").withColumn("pos", F.row_number().over(order))
    if some:
        flood = rest.join(F.broadcast(flooded), keys, "left_semi")
        ranked = running(flood, keys, "arrival_us", ["query_id"], sums={"pos": F.lit(1)}, cell=bin_us, tie_span=TIE_SPAN)
        out = out.unionByName(ranked.join(F.broadcast(quotas.join(flooded, keys)), keys, "left"))
    undecided = q.filter(f"NOT ({known})").select("*", F.expr("cast(NULL AS LONG) AS quota"), F.expr("cast(NULL AS LONG) AS pos"))
    out = out.unionByName(undecided)
    ok = F.col("pos") <= F.col("quota")
    return out.withColumn("allowed", ok).withColumn("action", F.when(~ok, F.lit(action))).drop("pos", "quota", "bin")


def limit_slack(q: DataFrame, rate: float, bin_us: int = 1_000_000) -> DataFrame:
    """Configured against effective limit per prefix: one bucket exists on every worker."""
    q = (q if "prefix" in q.columns else client_prefix(q)).withColumn("bin", F.expr(f"arrival_us div {bin_us}"))
    per_bin = q.groupBy("prefix", "bin").agg(F.count("*").alias("n"))
    # A prefix is seen by a handful of workers: pairs first, then their number.
    workers = q.groupBy("prefix", "worker_id").agg(F.lit(1).alias("one")).groupBy("prefix").agg(F.count("*").alias("workers"))
    peak = per_bin.groupBy("prefix").agg(F.max("n").alias("peak_per_bin"), F.sum("n").alias("queries"))
    return peak.join(workers, "prefix").select(
        "prefix",
        "queries",
        "workers",
        F.lit(float(rate)).alias("configured_qps"),
        (F.lit(float(rate)) * F.col("workers")).alias("effective_qps"),
        (F.col("peak_per_bin") / (bin_us / 1e6)).alias("observed_peak_qps"),
    )
