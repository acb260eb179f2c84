"""Scalar weight factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEALTHY, DEGRADED, UNHEALTHY, RECOVERING = "HEALTHY", "DEGRADED", "UNHEALTHY", "RECOVERING"

STATES = (HEALTHY, DEGRADED, UNHEALTHY, RECOVERING)


def health_factor(state: Column, degraded: float = 0.25, probe_fraction: float = 0.1) -> Column:
    """Share of its weight a backend keeps in each health state."""
    table = {HEALTHY: 1.0, DEGRADED: degraded, RECOVERING: probe_fraction, UNHEALTHY: 0.0}
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(lookup[state], F.lit(0.0))


def with_health_factor(t: DataFrame, degraded: float = 0.25, probe_fraction: float = 0.1) -> DataFrame:
    return t.withColumn("health_factor", health_factor(F.col("health"), degraded, probe_fraction))


def inverse_latency(ewma_us: Column, k: float = 1.0) -> Column:
    """1 / latency^k, null-safe for a latency of zero."""
    return F.lit(1.0) / F.pow(F.greatest(ewma_us.cast("double"), F.lit(1.0)), F.lit(float(k)))


def with_inverse_latency(t: DataFrame, k: float = 1.0) -> DataFrame:
    return t.withColumn("inv_latency", inverse_latency(F.col("ewma_us"), k))
