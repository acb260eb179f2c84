"""Duration text: an unsigned integer and one of the units us, ms, s, m."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Microseconds per unit.
UNIT_US = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000}

_SHAPE = r"^([0-9]+)(us|ms|s|m)$"


def duration_us(text: Column) -> Column:
    """Microseconds, or null where the text is malformed or does not fit a long."""
    scale = F.create_map(*[F.lit(x) for pair in UNIT_US.items() for x in pair])
    # Keep the line-end rule strict: `$` alone also matches before a final newline.
    shaped = text.rlike(_SHAPE) & ~text.contains("\n")
    value = F.regexp_extract(text, _SHAPE, 1).try_cast("long")
    unit = F.regexp_extract(text, _SHAPE, 2)
    return F.when(shaped, F.try_multiply(value, scale[unit]))


def duration_text(us: Column) -> Column:
    """The largest of s, ms, us that expresses the value exactly."""
    return (
        F.when(us % 1_000_000 == 0, F.concat((us / 1_000_000).cast("long").cast("string"), F.lit("s")))
        .when(us % 1_000 == 0, F.concat((us / 1_000).cast("long").cast("string"), F.lit("ms")))
        .otherwise(F.concat(us.cast("string"), F.lit("us")))
    )


def normalise_durations(t: DataFrame, col: str, out: str = "us") -> DataFrame:
    """Add the microsecond value of a duration text column."""
    return t.withColumn(out, duration_us(F.col(col)))
