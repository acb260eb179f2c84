"""Sinks: metric samples, advice, results and alerts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnslens.operators.health import transitions
from dnslens.operators.learning import Predictor
from dnslens.sources.event_log import event_lines


def write_metrics(t: DataFrame, path: str, mode: str = "append") -> None:
    """Append metric samples (ts, name, labels, value), partitioned by metric."""
    t.select("ts", "name", "labels", "value").write.mode(mode).partitionBy("name").parquet(path)


def _per_batch(path: str, shape: Callable[[DataFrame], DataFrame], fmt: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer whose repetition of a batch replaces that batch's output."""

    def write(batch: DataFrame, batch_id: int) -> None:
        shape(batch).write.mode("overwrite").format(fmt).save(f"{path}/batch_id={batch_id}")

    return write


def metrics_writer(path: str) -> Callable[[DataFrame, int], None]:
    return _per_batch(path, lambda b: b.select("ts", "name", "labels", "value"), "parquet")


def with_ttl(t: DataFrame, ttl_us: int) -> DataFrame:
    return t.withColumn("ttl_us", F.lit(ttl_us).cast("long"))


def write_advice(t: DataFrame, path: str, ttl_us: int, batch_id: int = 0) -> None:
    """Write advice with its time to live; writing a batch again replaces it."""
    _per_batch(path, lambda b: with_ttl(b, ttl_us), "parquet")(t, batch_id)


def advice_writer(path: str, ttl_us: int) -> Callable[[DataFrame, int], None]:
    return _per_batch(path, lambda b: with_ttl(b, ttl_us), "parquet")


def prediction_writer(path: str, predictor: Predictor, keys: Sequence[str], issued_us: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer of versioned predictions: keys, when they were issued, ``predicted_us``."""
    return _per_batch(path, lambda b: predictor.predict(b).select(*keys, issued_us, "predicted_us"), "parquet")


def alert_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Health states in, transition events out as JSON lines."""
    return _per_batch(path, lambda b: event_lines(transitions(b)), "text")


def write_results(t: DataFrame, path: str, runs: DataFrame | None = None) -> None:
    """Result summary with full run metadata, as JSON and as CSV with header.

    Nested columns are written to CSV as JSON text. Unmeasured values say so.
    """
    full = t if runs is None else t.join(runs, "run_id", "left")
    full.write.mode("overwrite").json(f"{path}/json")
    flat = []
    for f in full.schema.fields:
        if f.dataType.typeName() in ("struct", "map", "array"):
            flat.append(F.to_json(f.name).alias(f.name))
        elif f.dataType.typeName() in ("double", "float", "long", "integer"):
            flat.append(F.coalesce(F.col(f.name).cast("string"), F.lit("NOT MEASURED")).alias(f.name))
        else:
            flat.append(F.col(f.name))
    full.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
