"""Operator 9: documents into shards by vector bin packing over bytes, tokens and rows.

Law ``bytes``: the shards' sizes are near equal, tokens and rows are balanced along with them. Equal texts form a
group and stay together, unless a group alone is larger than half a shard in one dimension: it is cut into pieces by a
hash of the document id.

What is placed are *units*: the groups, merged by a hash of the text into ``BUNDLES`` bundles (a bundle is a whole
group while there are few groups), and the pieces of oversized groups. Their number is bounded by parameters, so their
sums fit the driver whatever the table's size, and their sums are made by partial aggregation before the shuffle.
Units go largest first to the shard with the highest dot product of the unit with what the shard still lacks.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnslens.llm.common import stored

BUNDLES = 1 << 15
#: Pieces of an oversized group for each whole shard it would fill.
PIECES_PER_SHARD = 64
#: Rows for each range of slots that one task numbers.
SLOT_ROWS = 20_000


def place(units: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unit (rows of non-negative sizes): largest first, highest dot product with residual capacity.

    Ties go to the earlier unit and the lower shard.
    """
    total = units.sum(axis=0, dtype=np.float64)
    share = units / np.where(total > 0, total, 1)
    order = np.lexsort((np.arange(len(units)), -share.max(axis=1, initial=0)))
    residual = np.full((shards, units.shape[1]), 1.0 / shards)
    chosen = np.zeros(len(units), np.int32)
    for i in order:
        best = int(np.argmax(residual @ share[i]))
        chosen[i] = best
        residual[best] -= share[i]
    return chosen


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, tokens and the hash of the text that names its group. Null texts are empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
        F.xxhash64(text).alias("group_key"),
    )


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: law ``bytes``), tokens; a row per input row.

    Null texts have size 1, null document ids are placed like others, repeated rows each get a slot, an empty table
    gives an empty result; further columns of the input are not carried.
    """
    spark = docs.sparkSession
    # Rows that repeat id and text are told apart by a number that is stored with them.
    rows, _ = stored(sized(docs).withColumn("row", F.monotonically_increasing_id()), "sized")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    limit = {k: (total[k] or 0) / shards for k in ("bytes", "tokens", "rows")}
    # At most two groups for each shard and dimension can be that large.
    heavy = rows.groupBy("group_key").agg(*sums).filter(
        " or ".join(f"{k} > {max(v / 2, 1)!r}D" for k, v in limit.items())
    ).collect()
    pieces = {
        g.group_key: math.ceil(PIECES_PER_SHARD * max(g[k] / limit[k] for k in limit if limit[k])) for g in heavy
    }
    cut = F.lit(None).cast("long")
    for n, key in enumerate(sorted(pieces)):
        piece = BUNDLES + n * (1 << 20) + F.pmod(F.xxhash64("row"), F.lit(pieces[key]))
        cut = F.when(F.col("group_key") == key, piece).otherwise(cut)
    rows = rows.withColumn("unit", F.coalesce(cut, F.pmod("group_key", F.lit(BUNDLES))).cast("long"))
    units = sorted(rows.groupBy("unit").agg(*sums).collect())
    chosen = place(np.array([u[1:] for u in units], np.int64).reshape(-1, 3), shards)
    # One row for each unit: at most BUNDLES and the pieces.
    placed = spark.createDataFrame(
        [(u.unit, int(s)) for u, s in zip(units, chosen, strict=True)], "unit long, shard int"
    )
    parts = max(1, math.ceil((total.rows or 0) / SLOT_ROWS))
    rows = rows.join(F.broadcast(placed), "unit").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "row")
    return (
        rows.withColumn("place", F.row_number().over(inside))
        .join(offsets, ["shard", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "tokens",
        )
    )
