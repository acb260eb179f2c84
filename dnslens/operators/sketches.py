"""Mergeable sketches for huge domains and very large keys, next to the exact forms.

``top_k_large`` uses its sketch only to name candidates: they are counted exactly, and a bin whose result the sketch's
error does not prove is counted in full, so rows are those of ``geo.top_k``. KLL sketches give percentiles within a
stated rank error; one is kept for each (window, key) and merged over windows without the log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnslens.operators.geo import top_k
from dnslens.session import scratch_path

#: Candidates and bins up to which they are broadcast; beyond it they are shuffled.
BROADCAST_ROWS = 500_000

#: An item's count is off by at most this share of the rows for each place of a frequent-items sketch.
ERROR_PER_PLACE = 3.5


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def top_k_large(t: DataFrame, col: str, k: int, keys: Sequence[str] = ("bin",), tracked: int = 10_000) -> DataFrame:
    """The rows of ``geo.top_k`` without a shuffle of one row per value: keys, ``col``, n, rank, total, share.

    A frequent-items sketch per key follows ``tracked`` values (combined before the shuffle), and only these are counted
    in a second pass. Values it has lost, or does not report, have at most twice its error; so where the k-th candidate
    has more, or all rows of the key are candidates', the result is exact. Other keys are counted in full. Null values
    are counted like others; rows with a null key are left out.
    """
    keys = list(keys)
    t = t.filter(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in keys))).select(*keys, col)
    kind = t.schema[col].dataType.simpleString()
    state = t.groupBy(*keys).agg(
        F.expr(f"approx_top_k_accumulate(`{col}`, {tracked})").alias("__s"), F.count("*").alias("total")
    )
    items = f"array_union(transform(approx_top_k_estimate(__s, {tracked}), x -> x.item), array(CAST(NULL AS {kind})))"
    named = _stored(state.select(*keys, "total", F.explode(F.expr(items)).alias("__item")), "candidates")
    bins = named.select(*keys, "total").distinct()
    same = [F.col(f"t.{c}") == F.col(f"c.{c}") for c in keys] + [F.col(f"t.{col}").eqNullSafe(F.col("c.__item"))]
    counts = t.alias("t").join(_bounded(named).alias("c"), same).groupBy(*[F.col(f"t.{c}") for c in (*keys, col)]).agg(
        F.count("*").alias("n"), F.max("c.total").alias("total")
    )
    counts = _stored(counts, "counted")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), col))
    best = counts.withColumn("rank", rank).filter(F.col("rank") <= k)
    covered = counts.groupBy(*keys).agg(F.sum("n").alias("covered"))
    last = best.groupBy(*keys).agg(F.min("n").alias("least"), F.count("*").alias("found"), F.max("total").alias("of"))
    clear = (F.col("found") == k) & (F.col("least") > 2 * ERROR_PER_PLACE / tracked * F.col("of"))
    proven = last.join(covered, keys).filter((F.col("covered") == F.col("of")) | clear).select(*keys)
    rest = _stored(bins.join(proven, keys, "left_anti").select(*keys), "unproven")
    out = best.join(proven, keys, "left_semi").select(*keys, col, "n", "rank", "total")
    out = out.withColumn("share", F.col("n") / F.col("total"))
    if rest.isEmpty():
        return out
    return out.union(top_k(t.join(_bounded(rest), keys, "left_semi"), col, k, tuple(keys)).select(*out.columns))


def rank_error(k: int) -> float:
    """Rank error of a KLL sketch of size ``k``, as a share of the rows, held in 99 of 100 cases."""
    return 2.296 / k**0.9723


def value_sketches(t: DataFrame, keys: Sequence[str], col: str = "latency_us", k: int = 2_000) -> DataFrame:
    """One KLL sketch per key of a whole-number column: keys, sketch. Nulls don't count; keys of nulls alone are left out."""
    known = t.filter(F.col(col).isNotNull())
    return known.groupBy(*keys).agg(F.expr(f"kll_sketch_agg_bigint(CAST(`{col}` AS BIGINT), {k})").alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of coarser keys from those of finer ones, in any order."""
    return sketches.groupBy(*keys).agg(F.expr("kll_merge_agg_bigint(sketch)").alias("sketch"))


def sketch_percentiles(sketches: DataFrame, keys: Sequence[str], ps: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """keys, count (exact) and a value for each of ``ps`` whose rank is off by ``rank_error`` at most."""
    picks = [F.expr(f"kll_sketch_get_quantile_bigint(sketch, {float(p)}D)").alias(f"p{p * 100:g}".replace(".", "_")) for p in ps]
    return sketches.select(*keys, F.expr("kll_sketch_get_n_bigint(sketch)").alias("count"), *picks)


def rank_spans(t: DataFrame, found: DataFrame, keys: Sequence[str], names: Sequence[str], col: str = "latency_us") -> DataFrame:
    """Exact ranks of estimated values: keys, and per name the shares of rows below (``lo_``) and up to it (``hi_``)."""
    met = t.filter(F.col(col).isNotNull()).join(_bounded(found.select(*keys, *names)), list(keys))
    shares = [(f"lo_{c}", F.col(col) < F.col(c)) for c in names] + [(f"hi_{c}", F.col(col) <= F.col(c)) for c in names]
    return met.groupBy(*keys).agg(*[F.avg(x.cast("int")).alias(n) for n, x in shares])
