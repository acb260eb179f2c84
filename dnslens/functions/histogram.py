"""Log-linear latency buckets: 64 equal slices inside every power of two."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_US = 1
MAX_US = 10_000_000
SLICES = 64


def bucket_of(latency_us: Column) -> Column:
    """Bucket number; integer arithmetic only, so every engine agrees."""
    v = F.least(F.greatest(latency_us.cast("long"), F.lit(MIN_US).cast("long")), F.lit(MAX_US).cast("long"))
    e = F.length(F.bin(v)) - 1
    sub = F.call_function("shiftright", v * SLICES, e) - SLICES
    return (e * SLICES + sub).cast("int")


def bucket_lower(bucket: Column) -> Column:
    """Lower bound in microseconds."""
    e = F.floor(bucket / SLICES)
    return F.pow(F.lit(2.0), e) * (1 + (bucket % SLICES) / F.lit(float(SLICES)))


def bucket_upper(bucket: Column) -> Column:
    """Exclusive upper bound in microseconds."""
    return bucket_lower(bucket) + F.pow(F.lit(2.0), F.floor(bucket / SLICES)) / SLICES


def bucket_mid(bucket: Column) -> Column:
    """Midpoint in microseconds."""
    return (bucket_lower(bucket) + bucket_upper(bucket)) / 2
