"""Seeded picks from small candidate arrays, as plain column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnslens.functions.hashing import uniform


def with_cumulative(t: DataFrame, weight: str, keys: Sequence[str]) -> DataFrame:
    """Add ``cum`` and ``total`` of a weight per group, in backend order.

    A group is one backend pool (a handful of rows per version and region).
    """
    order = Window.partitionBy(*keys).orderBy("backend")
    return t.select(
        "*",
        F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"),
        F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )


def candidate_arrays(t: DataFrame, keys: Sequence[str], fields: Sequence[str] = ("cum", "total")) -> DataFrame:
    """One array of ``struct<backend, ...>`` per group, sorted by backend."""
    item = F.struct("backend", *fields)
    return t.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("cands"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` where ``use`` has lambdas: they would work out an expression again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pick_by_weight(cands: Column, u: Column) -> Column:
    """The backend whose cumulative interval holds u * total; null where nothing has weight."""
    total = F.try_element_at(cands, F.lit(1))["total"]
    found = _once(u * total, lambda at: F.try_element_at(F.filter(cands, lambda x: x["cum"] > at), F.lit(1))["backend"])
    return F.when(total > 0, found)


def pick_by_scan(items: Column, u: Column) -> Column:
    """Like :func:`pick_by_weight` for arrays of (backend, w) put together per query."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("string").alias("backend"))
    total = F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x["w"])

    def scan(at: Column) -> Column:
        return F.aggregate(
            items,
            start,
            lambda acc, x: F.struct(
                (acc["sum"] + x["w"]).alias("sum"),
                F.when(acc["backend"].isNull() & (acc["sum"] + x["w"] > at), x["backend"])
                .otherwise(acc["backend"])
                .alias("backend"),
            ),
        )["backend"]

    return _once(u * total, scan)


def weighted_pick(q: DataFrame, weights: DataFrame, seed: int, keys: Sequence[str], weight: str = "weight", draw: int = 1, out: str = "pick") -> DataFrame:
    """Pick a backend per query with probability proportional to weight.

    ``weights`` becomes one sorted array per group, so this is an equi-join and an array
    lookup, never a range join.
    """
    arrays = candidate_arrays(with_cumulative(weights, weight, keys), keys)
    u = uniform(seed, F.col("query_id"), draw)
    return q.join(arrays, list(keys), "left").withColumn(out, pick_by_weight(F.col("cands"), u)).drop("cands")


def less_loaded(a: Column, b: Column, load: Column) -> Column:
    """The one of two backends with less load; the smaller name on a tie."""
    la, lb = F.coalesce(load[a], F.lit(0)), F.coalesce(load[b], F.lit(0))
    return (
        F.when(a.isNull(), b)
        .when(b.isNull(), a)
        .when((la < lb) | ((la == lb) & (a <= b)), a)
        .otherwise(b)
    )


def two_choices(pool: Column, load: Column, seed: int, key: Column, full_scan_max: int = 4) -> Column:
    """Power of two choices over a sorted pool; pools up to ``full_scan_max`` are scanned."""
    n = F.size(pool)
    i = F.floor(uniform(seed, key, 1) * n).cast("int")
    j = ((i + 1 + F.floor(uniform(seed, key, 2) * (n - 1))) % n).cast("int")
    pair = less_loaded(F.get(pool, i), F.get(pool, j), load)
    scan = F.array_min(
        F.transform(pool, lambda b: F.struct(F.coalesce(load[b], F.lit(0)).alias("load"), b.alias("backend")))
    )["backend"]
    return F.when(n <= 0, F.lit(None).cast("string")).when(n <= full_scan_max, scan).otherwise(
        F.when(n == 1, F.get(pool, F.lit(0))).otherwise(pair)
    )


def p2c(q: DataFrame, snap: DataFrame, seed: int, keys: Sequence[str] = ("version", "region"), full_scan_max: int = 4, out: str = "pick") -> DataFrame:
    """Least-loaded pick for queries that carry an ``inflight`` map."""
    pool = snap.groupBy(*keys).agg(F.array_sort(F.collect_set("backend")).alias("pool"))
    joined = q.join(pool, list(keys), "left")
    return joined.withColumn(
        out, two_choices(F.col("pool"), F.col("inflight"), seed, F.col("query_id"), full_scan_max)
    ).drop("pool")
