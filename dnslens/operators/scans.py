"""Ordered running values that never put a whole key into one task.

A running sum or "last known value" over a hot key (few backends, two workers, or no
key at all) would sort all of its rows in one task. Both are associative, so rows are
cut into chunks: each chunk is scanned on its own, one total per chunk is carried
through small tables, and the carry is joined back on the chunk key - the rows are
shuffled once for the window and the join together.

The chunk key is the same at every size: a time cell, or, where many rows may share one
instant, that instant and a range of the tie-breaking id. Chunk totals are carried level
by level (chunks in a cell, cells in a block, blocks of a key), so their number is no
burden on one task either.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnslens.session import scratch_path

#: Ids per chunk of an instant.
TIE_SPAN = 65_536

#: Cells per block.
BLOCK = 4_096

#: Rows of a carry table up to which it is broadcast.
CARRY_ROWS = 200_000


def running(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    tie: Sequence[str] = (),
    *,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    before: Mapping[str, Column] | None = None,
    cell: int,
    tie_span: int | None = None,
) -> DataFrame:
    """Add running values over rows ordered by (t, tie) inside ``keys``.

    ``sums``   running sum up to and including the row;
    ``lasts``  last non-null value up to and including the row;
    ``before`` last non-null value strictly before the row.

    ``t`` is a long, ``cell`` is in its unit. Keys must not be null. One task sorts the rows
    of one key and cell: choose ``cell`` so that they fit (a second of distinct microseconds
    has a million at most). Where rows of one key may pile up on an instant, give
    ``tie_span``: ``tie`` must then be one number, and a task sorts no more ids than that.
    """
    sums, lasts, before = dict(sums or {}), dict(lasts or {}), dict(before or {})
    keys = list(keys)
    order = [t, *tie]
    keep = [c for c in df.columns if not c.startswith("__")]
    if tie_span is None:
        df, place, widths = df.withColumn("__cell", F.expr(f"floor(`{t}` / {cell})")), ["__cell"], [BLOCK]
    else:
        (one,) = tie
        df = df.withColumn("__at", F.col(t)).withColumn("__ids", F.expr(f"floor(`{one}` / {tie_span})"))
        place, widths = ["__at", "__ids"], [cell, BLOCK]
    chunk = [*keys, *place]

    within = Window.partitionBy(*chunk).orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    local = df.select(
        "*",
        *[F.sum(c).over(upto).alias(f"__v_{n}") for n, c in sums.items()],
        *[F.last(c, ignorenulls=True).over(upto).alias(f"__v_{n}") for n, c in lasts.items()],
        *[F.last(c, ignorenulls=True).over(earlier).alias(f"__v_{n}") for n, c in before.items()],
    )

    carried = {**lasts, **before}
    totals = _totals(df, chunk, sums, carried, order)
    carry = _earlier(totals, keys, place, list(sums), list(carried), widths)
    carry = carry.select(*chunk, *[F.col(f"__b_{n}").alias(f"__c_{n}") for n in (*sums, *carried)])
    return local.join(carry, chunk, "left").selectExpr(
        *[f"`{c}`" for c in keep],
        *[f"coalesce(`__v_{n}`, 0) + coalesce(`__c_{n}`, 0) AS `{n}`" for n in sums],
        *[f"coalesce(`__v_{n}`, `__c_{n}`) AS `{n}`" for n in carried],
    )


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Add ``out``, the position (from 1) of each row among those of its key by ``order``.

    Rows are sorted once into physical ranges of (keys, order), whatever the skew of keys or instants, and written with
    their place (range number and row). A key's rows in a range are consecutive, so one total per (key, range) says how
    many of them come before; there are as many totals as keys and ranges, and they are broadcast after a count
    (``CARRY_ROWS``). The log is shuffled once. Null keys count as a key; rows equal in all of ``keys`` and ``order``
    are numbered in some order; an empty table stays empty.
    """
    spark, keys = df.sparkSession, list(keys)
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    path = scratch_path(spark, "ranges")
    ranged = ranged.withColumn("__at", F.monotonically_increasing_id())
    ranged.write.parquet(path)
    rows = spark.read.schema(ranged.schema).parquet(path).withColumn("__range", F.expr("shiftright(__at, 33)"))
    totals = rows.groupBy(*keys, "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__range").alias("__r"), "__first",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
    )
    few = carry.limit(CARRY_ROWS + 1).count() <= CARRY_ROWS
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    met = rows.join(F.broadcast(carry) if few else carry, [F.col("__range") == F.col("__r"), *same])
    return met.select(*df.columns, (F.col("__at") - F.col("__first") + 1 + F.col("__before")).alias(out))


def _totals(df: DataFrame, group: list[str], sums: Mapping[str, Column], carried: Mapping[str, Column], order: list[str]) -> DataFrame:
    """Per group the sums and the last non-null values, as columns ``__t_<name>``."""
    rank = F.struct(*order)
    return df.groupBy(*group).agg(
        *[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()],
        *[F.max_by(c, F.when(c.isNotNull(), rank)).alias(f"__t_{n}") for n, c in carried.items()],
    )


def _earlier(totals: DataFrame, keys: list[str], place: list[str], sums: list[str], carried: list[str], widths: list[int]) -> DataFrame:
    """Add ``__b_<name>``, what the rows before each one of its key add up to, for every ``__t_<name>``.

    Rows are ordered by ``place``; groups of ``widths[0]`` places are scanned on their own,
    and their totals the same way with the other widths.
    """
    group = f"__g{len(widths)}"
    level = totals.withColumn(group, F.expr(f"floor(`{place[0]}` / {widths[0]})") if widths else F.lit(0))
    upto = Window.partitionBy(*keys, group).orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    level = level.select(
        "*",
        *[F.sum(f"__t_{n}").over(upto).alias(f"__b_{n}") for n in sums],
        *[F.last(f"__t_{n}", ignorenulls=True).over(upto).alias(f"__b_{n}") for n in carried],
    )
    if not widths:
        return level
    above = _totals(level, [*keys, group], *[{n: F.col(f"__t_{n}") for n in names} for names in (sums, carried)], place)
    above = _earlier(above, keys, [group], sums, carried, widths[1:])
    above = above.select(*keys, group, *[F.col(f"__b_{n}").alias(f"__u_{n}") for n in (*sums, *carried)])
    return level.join(above, [*keys, group]).selectExpr(
        *[f"`{c}`" for c in totals.columns],
        *[f"coalesce(`__b_{n}`, 0) + coalesce(`__u_{n}`, 0) AS `__b_{n}`" for n in sums],
        *[f"coalesce(`__b_{n}`, `__u_{n}`) AS `__b_{n}`" for n in carried],
    )


def run_lengths(
    df: DataFrame, keys: Sequence[str], t: str, preds: Mapping[str, Column], *, cell: int
) -> DataFrame:
    """Add, per predicate, the number of consecutive true rows ending at the row.

    A null predicate carries the count unchanged: the row is not counted and does not
    break the run.
    """
    counts = {f"__n_{n}": F.when(p, 1).otherwise(0) for n, p in preds.items()}
    df = running(df, keys, t, sums={**counts}, cell=cell)
    df = df.select("*", *[F.col(f"__n_{n}").alias(f"r_{n}") for n in preds]).drop(*counts)
    resets = {f"z_{n}": F.when(~p, F.col(f"r_{n}")) for n, p in preds.items()}
    df = running(df, keys, t, lasts=resets, cell=cell)
    for n in preds:
        df = df.withColumn(n, (F.col(f"r_{n}") - F.coalesce(F.col(f"z_{n}"), F.lit(0))).cast("long"))
    return df.drop(*[f"r_{n}" for n in preds], *[f"z_{n}" for n in preds])


def bounded_windows(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    span: int,
    exprs: Callable[[Window], Mapping[str, Column]],
    *,
    cell: int,
    chunk_rows: int = 100_000,
) -> DataFrame:
    """Window expressions that look back at most ``span`` rows, without one task per key.

    Rows are numbered by a running count and cut into chunks of ``chunk_rows``; the last
    ``span`` rows of a chunk are handed to the next one too, only to be looked at.
    ``exprs`` receives the ordered window (no frame) and returns named columns.
    """
    if span >= chunk_rows:
        raise ValueError(f"a span of {span} rows needs chunks of more rows than {chunk_rows}")
    keys = list(keys)
    numbered = running(df, keys, t, sums={"rn": F.lit(1)}, cell=cell)
    own = F.floor((F.col("rn") - 1) / chunk_rows).cast("long")
    near_end = (F.col("rn") - 1) % chunk_rows >= chunk_rows - span
    chunks = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    spread = numbered.withColumn("chunk", F.explode(chunks))
    w = Window.partitionBy(*keys, "chunk").orderBy("rn")
    out = spread.select("*", *[c.alias(n) for n, c in exprs(w).items()])
    mine = F.col("chunk") == F.floor((F.col("rn") - 1) / chunk_rows).cast("long")
    return out.filter(mine).drop("chunk", "rn")
