"""Normalisation, softmax, the adaptive score and weight smoothing."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnslens.operators.folds import chunked_fold
from dnslens.operators.scans import bounded_windows

#: The five terms that are normalised; ``risk`` is added as it is.
TERMS = ("latency", "load", "error", "geo", "queue")


def minmax(t: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Add ``n_<col>``: position between the group's minimum and maximum; 0 if constant.

    A group is one backend pool (region x window).
    """
    w = Window.partitionBy(*keys)
    def norm(c: str) -> Column:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(hi > lo, F.least(F.greatest((F.col(c) - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return t.select("*", *[norm(c).alias(f"n_{c}") for c in cols])


def softmax(t: DataFrame, score: str, temperature: float, keys: Sequence[str], out: str = "weight") -> DataFrame:
    """Weights proportional to exp(-score / temperature), per group."""
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    w = Window.partitionBy(*keys)
    z = -F.col(score) / F.lit(float(temperature))
    t = t.withColumn("__z", z)
    t = t.withColumn("__e", F.exp(F.col("__z") - F.max("__z").over(w)))
    return t.withColumn(out, F.col("__e") / F.sum("__e").over(w)).drop("__z", "__e")


def adaptive_score(
    t: DataFrame,
    keys: Sequence[str] = ("version", "region"),
    weights: dict[str, float] | None = None,
    temperature: float = 0.2,
    estimator: str = "ewma",
) -> DataFrame:
    """Score and weight of each backend for each region.

    Needs ``ewma_us`` (or ``predicted_us`` for ``estimator="model"`` - nothing else
    changes), ``qps``, ``capacity``, ``error_rate``, ``timeout_rate``, ``geo_distance``,
    ``inflight`` and ``failure_risk``. Only eligible backends belong in ``t``.
    """
    if estimator not in ("ewma", "model"):
        raise ValueError(f"unknown estimator {estimator!r}")
    weight = {**dict.fromkeys((*TERMS, "risk"), 1.0), **(weights or {})}
    latency = F.col("ewma_us") if estimator == "ewma" else F.col("predicted_us")
    t = (
        t.withColumn("latency", latency.cast("double"))
        .withColumn("load", F.col("qps") / F.col("capacity"))
        .withColumn("error", F.col("error_rate") + F.col("timeout_rate"))
        .withColumn("geo", F.col("geo_distance"))
        .withColumn("queue", F.col("inflight").cast("double"))
    )
    t = minmax(t, TERMS, keys)
    score = F.lit(weight["risk"]) * F.col("failure_risk")
    for term in TERMS:
        score = score + F.lit(weight[term]) * F.col(f"n_{term}")
    return softmax(t.withColumn("score", score), "score", temperature, keys, "score_weight").drop(*TERMS)


def failure_risk(
    t: DataFrame, keys: Sequence[str], t_us: str, span: int = 20, cell: int = 3_600_000_000
) -> DataFrame:
    """Share of the last windows in which the backend was not healthy (binned input)."""
    bad = (F.col("health") != "HEALTHY").cast("double")
    return bounded_windows(
        t, keys, t_us, span, lambda w: {"failure_risk": F.avg(bad).over(w.rowsBetween(-(span - 1), 0))}, cell=cell
    )


def smoothing_fold(beta: float, cap: float, t_us: str, out: str = "smoothed"):
    """One tick: blend, limit the step, renormalise; shared by batch and stream.

    The state maps each backend to its last weight. A backend without a previous weight
    starts at its new one; one that vanishes is forgotten.
    """

    def fold(pdf: pd.DataFrame, state):
        rows = []
        prev = dict(state or {})
        for tick, part in pdf.groupby(t_us, sort=True):
            new = dict(zip(part["backend"], part["weight"]))
            step = {}
            for b in sorted(new):
                target = float(new[b])
                if b in prev:
                    blended = beta * target + (1 - beta) * prev[b]
                    step[b] = min(max(blended, prev[b] - cap), prev[b] + cap)
                else:
                    step[b] = target
            total = sum(step.values())
            prev = {b: (v / total if total > 0 else 1.0 / len(step)) for b, v in step.items()}
            rows += [(part["region"].iloc[0], tick, b, float(new[b]), prev[b]) for b in sorted(prev)]
        return pd.DataFrame(rows, columns=["region", t_us, "backend", "weight", out]), prev

    return fold


def smooth(
    t: DataFrame, beta: float = 0.3, cap: float = 0.1, t_us: str = "t_us", chunk_us: int = 3_600_000_000
) -> DataFrame:
    """Smoothed weights per region over ticks; ``t`` has region, ``t_us``, backend, weight."""
    schema = f"region string, `{t_us}` long, backend string, weight double, smoothed double"
    return chunked_fold(
        t.select("region", t_us, "backend", "weight"), ["region"], t_us, smoothing_fold(beta, cap, t_us), schema,
        chunk_us=chunk_us, tol=1e-10,
    )
