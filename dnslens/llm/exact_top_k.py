"""Operator 6: exact top-k inner products by Fagin's threshold algorithm.

Vectors are dealt into blocks, and each block keeps one list per dimension, sorted by component. A query goes down the
lists of its non-zero components, from the large end for a positive and from the small end for a negative one. Vectors
met for the first time are scored in full; the scores a vector further down could reach at best are bounded by the sum
of the components at the present depth. A query is through with a block when that threshold is below the k-th best
score (at an equal one a smaller id might still tie). Depth grows geometrically, so steps are few and each is an array
operation. Queries whose next step meets so much of a block that scoring it costs more than scoring all of the block
do the latter, many queries in one product.

A block is a partition: its vectors come first, and the queries stream past them. Blocks grow with the table, from
``BLOCK`` vectors up to ``BLOCK_VALUES`` components, and until these are full there are no more than ``SPREAD`` of them.
So a query is copied once for each block, as rows that are only shuffled: neither side is joined, broadcast or
gathered in one row. No pair of rows is emitted, only k rows for each query and block, which are merged by rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnslens.llm.common import give_back, stored

BLOCK = 2_048
SPREAD = 64
BLOCK_VALUES = 1 << 21
QUERY_BLOCK = 1_024
FIRST_DEPTH = 16
#: Rows scored in a product of many queries in the time that one takes to be gathered and scored alone.
GATHERED = 16
#: Scores held at once, of some queries with a whole block.
SCORES = 1 << 20


def quantized(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) with v = floor(scale * x), of the rows whose vector has only finite components."""
    x = F.col("x")
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    return rows.filter(x.isNotNull() & ~bad & F.col("vec_id").isNotNull()).select(
        "vec_id", F.transform("x", lambda e: F.floor(e * scale).cast("double")).alias("v")
    )


def sorted_lists(rows: np.ndarray) -> np.ndarray:
    """Places of the rows by falling component, for each dimension, and behind these lists as many by rising component."""
    n, width = rows.shape
    lists = np.empty((2 * width, n), np.int32)
    for d in range(width):
        lists[width + d] = np.argsort(rows[:, d], kind="stable")
        lists[d] = lists[width + d, ::-1]
    return lists


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    at = np.arange(len(scores))
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def threshold_top_k(
    ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, lists: np.ndarray | None = None
) -> list[tuple[int, int, int]]:
    """(query id, vector id, score) of the k best of a block for each query, ties to the smaller id, not itself.

    lists: the block's sorted_lists, if they are there already.
    """
    lists = sorted_lists(rows) if lists is None else lists
    n, width = rows.shape
    tops, whole = [(ids[:0], np.empty(0, rows.dtype))] * len(queries), []
    dear = GATHERED if rows.dtype != object else 2
    for at, (query_id, query) in enumerate(zip(query_ids.tolist(), queries, strict=True)):
        dims = np.flatnonzero(query)
        weight = query[dims]
        ends = np.where(weight > 0, dims, width + dims)
        seen = ids == query_id
        best_ids, best = tops[at]
        depth, reach = 0, FIRST_DEPTH
        while depth < n and not seen.all():
            reach = min(n, reach)
            fresh = np.zeros(n, bool)
            fresh[lists[ends, depth:reach]] = True
            fresh &= ~seen
            found = np.flatnonzero(fresh)
            # Gathering many rows costs more than scoring those beside them. Without a component, all scores are zero.
            if dear * len(found) > n or not len(dims):
                whole.append((at, best[-1] if len(best) == k else None))
                break
            seen |= fresh
            all_ids, scores = np.concatenate([best_ids, ids[found]]), np.concatenate([best, rows[found] @ query])
            keep = _best(all_ids, scores, k)
            best_ids, best = all_ids[keep], scores[keep]
            depth, reach = reach, reach * 4
            if depth < n and len(best) == k and rows[lists[ends, depth], dims] @ weight < best[-1]:
                break
        tops[at] = best_ids, best
    step = max(1, SCORES // max(1, n))
    for start in range(0, len(whole), step):
        some = whole[start : start + step]
        products = queries[[at for at, _ in some]] @ rows.T
        for (at, low), scores in zip(some, products, strict=True):
            # What was met before holds k of at least this score.
            there = np.arange(n) if low is None else np.flatnonzero(scores >= low)
            there = there[ids[there] != query_ids[at]]
            there = there[_best(ids[there], scores[there], k)]
            tops[at] = ids[there], scores[there]
    pairs = zip(query_ids.tolist(), tops, strict=True)
    return [(query_id, int(i), int(s)) for query_id, top in pairs for i, s in zip(*top, strict=True)]


def _matrix(lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rows of equal length; shorter vectors are filled up with zeros."""
    width = int(lengths.max(initial=0))
    if len(values) == len(lengths) * width:
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _fitted(rows: np.ndarray, width: int) -> np.ndarray:
    """Cut or filled up with zeros to a width."""
    return np.pad(rows[:, :width], ((0, 0), (0, max(0, width - rows.shape[1]))))


def _kind(*sides: np.ndarray) -> type:
    """What all sums of products stay exact in: floats, doubles or else whole numbers of any size."""
    high = [float(np.abs(s).max(initial=1)) for s in sides]
    most = high[0] * high[1] * max(1, sides[0].shape[1])
    return np.float32 if most < 2.0**24 else np.float64 if most < 2.0**52 else object


def _as(kind: type, side: np.ndarray) -> np.ndarray:
    if kind is object:
        return np.array([[int(x) for x in r] for r in side], dtype=object).reshape(side.shape)
    return side.astype(kind)


def _exact(*sides: np.ndarray) -> list[np.ndarray]:
    """Floats or doubles while all sums of products stay exact in them, else whole numbers of any size."""
    kind = _kind(*sides)
    return [_as(kind, s) for s in sides]


def _read(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the matrix of the vectors."""
    columns = [(b.column("vec_id").to_numpy(), b.column("v")) for b in batches]
    lengths = [v.value_lengths().to_numpy() for _, v in columns]
    values = [v.flatten().to_numpy(zero_copy_only=False) for _, v in columns]
    return np.concatenate([ids for ids, _ in columns]), _matrix(np.concatenate(lengths), np.concatenate(values))


def _past(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The best of each query in a block, whose vectors come before the queries."""
    held, block, made = [], None, {}
    for batch in batches:
        vectors = batch.num_rows - batch.column("asks").true_count
        if vectors:
            held.append(batch.slice(0, vectors))
        if vectors == batch.num_rows or not held and block is None:
            continue
        if block is None:
            ids, block = _read(held)
            held, lists = [], sorted_lists(block)
        for at in range(vectors, batch.num_rows, QUERY_BLOCK):
            query_ids, queries = _read([batch.slice(at, QUERY_BLOCK)])
            # What a block's vectors don't have adds nothing to their scores.
            queries = _fitted(queries, block.shape[1])
            kind = _kind(block, queries)
            if kind not in made:
                made = {kind: _as(kind, block)}
            found = threshold_top_k(ids, made[kind], query_ids, _as(kind, queries), k, lists)
            columns = [pa.array([f[c] for f in found], pa.int64()) for c in range(3)]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])
    del held, block, made
    give_back()


def block_count(rows: int, values: int) -> int:
    """Blocks of a table with so many vectors, and components in all of them."""
    return max(1, min(SPREAD, math.ceil(rows / BLOCK)), math.ceil(values / BLOCK_VALUES))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products of every query, ties to the smaller id.

    Both inputs hold (vec_id, v array<double> of whole numbers). A query never meets the row of its own id; with fewer
    than k other rows all are returned. Vectors of unequal length are compared with zeros in the missing places; empty
    inputs give an empty result. Repeated vec_ids count as rows of their own among the candidates.
    """
    rows, values = vectors.agg(F.count("*"), F.sum(F.size("v"))).first()
    blocks = block_count(rows, values or 0)
    slot = F.pmod(F.xxhash64("vec_id", "v", F.lit("block")), F.lit(blocks)).cast("int")
    sides = vectors.select(slot.alias("block"), F.lit(False).alias("asks"), "vec_id", "v").union(
        queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), F.lit(True), "vec_id", "v")
    )
    dealt = sides.repartitionById(blocks, "block").sortWithinPartitions("asks").select("asks", "vec_id", "v")
    found = dealt.mapInArrow(lambda batches: _past(batches, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def report(embeddings: DataFrame) -> DataFrame:
    """The five best rows for every row whose vec_id is divisible by 50."""
    vectors, _ = stored(quantized(embeddings), "vectors")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


ORACLE = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
