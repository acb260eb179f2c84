"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, **options: str) -> tuple[DataFrame, str]:
    """Write ``df`` below the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has no more than ``rows`` rows; otherwise Spark shuffles it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later plan reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of an Arrow column; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def give_back() -> None:
    """Return free memory to the system: Python workers outlive their tasks, and their executors run other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that no slice of several rows holds much more than ``max_bytes`` of text.

    Behind the last one, free memory goes back to the system.
    """
    batch = None
    for batch in batches:
        if not batch.num_rows:
            continue
        # What the batch before took is free by now.
        pa.default_memory_pool().release_unused()
        per_row = max(1, batch.column(batch.schema.get_field_index(text)).nbytes // batch.num_rows)
        step = max(1, max_bytes // per_row)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    del batch
    give_back()
