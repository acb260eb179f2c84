"""As-of lookups: the latest published row at or before each query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnslens.operators.scans import running
from dnslens.session import shared_dir


#: Rows of the right side up to which their spans are broadcast, and how many spans may share a key and cell.
MAX_SPANS, MAX_SHARED = 100_000, 64


def asof(
    left: DataFrame,
    right: DataFrame,
    left_t: str,
    right_t: str,
    payload: Sequence[str],
    keys: Sequence[str] = (),
    *,
    cell_us: int = 1_000_000,
) -> DataFrame:
    """Add ``payload`` of the last ``right`` row with right_t <= left_t (same ``keys``).

    ``right`` is stored and counted. Up to ``MAX_SPANS`` rows of it are broadcast with the time each is in force, and the
    rows of ``left`` stay where they are; beyond that, or where the times crowd (``MAX_SHARED``), both sides are scanned
    in cells of ``cell_us``. ``right`` must be unique per (keys, right_t); null keys and times find nothing.
    """
    keys = list(keys)
    shared_dir(left.sparkSession)
    rows = right.select(*keys, F.col(right_t).alias("__from"), F.struct(*payload).alias("__row")).dropna(subset=[*keys, "__from"])
    rows = rows.groupBy(*keys, "__from").agg(F.max("__row").alias("__row")).checkpoint()
    found = _by_spans(left, rows, left_t, keys)
    if found is None:
        found = _by_scan(left, rows, left_t, keys, cell_us)
    kept = [c for c in left.columns if c not in payload]
    return found.select(*kept, *[F.col(f"__row.{c}").alias(c) for c in payload])


def _by_spans(left: DataFrame, rows: DataFrame, left_t: str, keys: list[str]) -> DataFrame | None:
    """``left`` with the ``__row`` in force, by the cells each row's span touches; None where that is no small table.

    There are about as many cells as rows of a key on average, so spans are a few times as many as rows.
    """
    if not 0 < rows.limit(MAX_SPANS + 1).count() <= MAX_SPANS:
        return None
    n, groups, low, high = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__from").alias("low"), F.max("__from").alias("high")).agg(
        F.sum("n"), F.count("*"), F.min("low"), F.max("high")
    ).first()
    width = (high - low) * groups // n + 1

    def cell(t: str) -> str:
        return f"({t} - pmod({t}, {width}L)) div {width}L"

    last = high // width
    until = F.lead("__from").over(Window.partitionBy(*keys).orderBy("__from"))
    spans = rows.withColumn("__until", until).selectExpr(
        *[f"`{k}` AS `__k_{k}`" for k in keys], "__from", "__until", "__row",
        f"explode(sequence({cell('__from')}, coalesce({cell('(__until - 1)')}, {last}L))) AS __cell",
    ).checkpoint()
    if spans.groupBy(*[f"__k_{k}" for k in keys], "__cell").count().agg(F.max("count")).first()[0] > MAX_SHARED:
        return None
    at = f"`{left_t}`"
    same = [F.col(k) == F.col(f"__k_{k}") for k in keys]
    inside = F.expr(f"least({cell(at)}, {last}L) = __cell AND {at} >= __from AND ({at} < __until OR __until IS NULL)")
    joined = left.join(F.broadcast(spans), [*same, inside] if same else inside, "left")
    return joined.select(*left.columns, "__row")


def _by_scan(left: DataFrame, rows: DataFrame, left_t: str, keys: list[str], cell_us: int) -> DataFrame:
    """``left`` with the ``__row`` in force, by one timeline of the distinct instants of ``left`` and of ``rows``.

    It is scanned in cells, and what is found is joined back on the instant. Only keys and times of the log go
    through the scan, and a burst on one instant is one row of it.
    """
    at = "instant of the lookup"
    asked = left.select(*keys, F.col(left_t).alias(at), F.lit(None).cast(rows.schema["__row"].dataType).alias("row"))
    line = asked.dropna(subset=[*keys, at]).union(rows.select(*keys, "__from", "__row"))
    line = line.groupBy(*keys, at).agg(F.max("row").alias("row"))
    found = running(line, keys, at, lasts={"found": F.col("row")}, cell=cell_us)
    found = found.select(*keys, at, F.col("found").alias("__row"))
    return left.withColumn(at, F.col(left_t)).join(found, [*keys, at], "left").select(*left.columns, "__row")


def _published(snap: DataFrame) -> DataFrame:
    return snap.groupBy("published_us").agg(F.max("version").alias("version")).withColumn("seen_us", F.col("published_us"))


def asof_snapshot(q: DataFrame, snap: DataFrame, **options) -> DataFrame:
    """Add ``version`` and ``snapshot_age_us`` of the snapshot in force at arrival."""
    out = asof(q, _published(snap), "arrival_us", "published_us", ["version", "seen_us"], **options)
    return out.withColumn("snapshot_age_us", F.col("arrival_us") - F.col("seen_us")).drop("seen_us")


def asof_advice(q: DataFrame, adv: DataFrame, **options) -> DataFrame:
    """Add ``advice_issued_us`` per region, null where the advice has expired."""
    issued = adv.groupBy("region", "issued_us").agg(F.max("ttl_us").alias("ttl_us"))
    issued = issued.withColumn("advice_issued_us", F.col("issued_us"))
    out = asof(q, issued, "arrival_us", "issued_us", ["advice_issued_us", "ttl_us"], ["region"], **options)
    valid = F.col("arrival_us") < F.col("advice_issued_us") + F.col("ttl_us")
    return out.withColumn("advice_issued_us", F.when(valid, F.col("advice_issued_us"))).drop("ttl_us")
