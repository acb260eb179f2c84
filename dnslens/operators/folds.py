"""Order-dependent folds (state machines, clamped recursions) over long series.

Such a fold cannot be written as an associative scan, and folding a whole key in one
task would serialise it. ``chunked_fold`` cuts every key into time chunks, guesses the
state each chunk starts from by folding the previous chunk first, and then checks the
guess against the state the previous chunk really ends in. Where guesses were wrong, blocks
of chunks are folded again from the right state, with blocks twice as long each round, until
all agree - so the result is exactly that of the sequential fold. State machines and
buckets forget their past quickly; a first pass normally suffices, with two chunks per task.

The series are windows or bins, not raw rows, so a chunk has at most
``chunk_us / bin`` times the entities of the key.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnslens.session import shared_dir

#: (rows of one key in time order, state or None) -> (output rows, state)
Fold = Callable[[pd.DataFrame, object], tuple[pd.DataFrame, object]]


def _same(a: object, b: object, tol: float) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        return abs(a - b) <= tol * max(1.0, abs(a), abs(b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k], tol) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(_same(x, y, tol) for x, y in zip(a, b))
    return a == b


def _text(state: object) -> str:
    """State as JSON; numbers of the array library become plain ones."""
    return json.dumps(state, default=lambda x: x.item())


def chunked_fold(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    fold: Fold,
    schema: str,
    *,
    chunk_us: int,
    tol: float = 1e-12,
) -> DataFrame:
    """Apply ``fold`` along ``t`` for every key; ``schema`` describes its output rows.

    ``fold`` must be deterministic and its state must survive JSON.
    """
    shared_dir(df.sparkSession)
    keys = list(keys)
    key_cols = [F.col(k) for k in keys]
    df = df.withColumn("__chunk", F.floor(F.col(t) / F.lit(chunk_us)).cast("long")).checkpoint()

    # Existing chunks of each key, numbered; gaps between them do not matter.
    chain = Window.partitionBy(*keys).orderBy("__chunk")
    chunks = (
        df.select(*keys, "__chunk")
        .distinct()
        .withColumn("__no", F.row_number().over(chain) - 1)
        .withColumn("__next", F.lead("__chunk").over(chain))
    )
    key_schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    state_schema = f"{key_schema}, __chunk long, __no int, __entry string, __exit string"

    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values(t, kind="stable").reset_index(drop=True)

    def state_row(part: pd.DataFrame, entry: object, leave: object) -> dict:
        first = part.iloc[0]
        row = {k: first[k] for k in keys}
        row.update(__chunk=first["__chunk"], __no=first["__no"], __entry=_text(entry), __exit=_text(leave))
        return row

    def guess(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["__role"] == 0
        prior, mine = ordered(pdf[~own]), ordered(pdf[own])
        entry = None
        if len(prior):
            _, entry = fold(prior, None)
        _, leave = fold(mine, entry)
        return pd.DataFrame([state_row(mine, entry, leave)])

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        block = ordered(pdf)
        state = json.loads(block["__want"].iloc[0])
        rows = []
        for _, part in block.groupby("__chunk", sort=True):
            entry = state
            _, state = fold(part.reset_index(drop=True), entry)
            rows.append(state_row(part, entry, state))
        return pd.DataFrame(rows)

    own = df.join(chunks.select(*keys, "__chunk", "__no"), [*keys, "__chunk"]).withColumn("__role", F.lit(0))
    warm = (
        df.join(chunks.filter("__next IS NOT NULL").select(*keys, "__chunk", "__next"), [*keys, "__chunk"])
        .withColumn("__chunk", F.col("__next"))
        .withColumn("__no", F.lit(-1))
        .withColumn("__role", F.lit(1))
        .drop("__next")
    )
    states = (
        own.unionByName(warm).groupBy(*key_cols, "__chunk").applyInPandas(guess, schema=state_schema).checkpoint()
    )

    agree = F.udf(lambda a, b: _same(json.loads(a), json.loads(b), tol), "boolean")
    length = 1
    while True:
        # What each chunk should have started from: the end of the one before it.
        left = states.select(*keys, (F.col("__no") + 1).alias("__no"), F.col("__exit").alias("__want"))
        checked = states.join(left, [*keys, "__no"], "left").withColumn("__want", F.coalesce("__want", F.lit("null")))
        wrong = (
            checked.filter(F.col("__entry") != F.col("__want"))
            .filter(~agree("__entry", "__want"))
            .select(*keys, F.expr(f"__no div {length}").alias("__block"))
            .distinct()
            .checkpoint()
        )
        if wrong.isEmpty():
            break
        start = (
            checked.withColumn("__block", F.expr(f"__no div {length}"))
            .filter(f"__no % {length} = 0")
            .select(*keys, "__block", "__want")
            .join(wrong, [*keys, "__block"])
        )
        redo = (
            own.drop("__role")
            .withColumn("__block", F.expr(f"__no div {length}"))
            .join(start, [*keys, "__block"])
            .groupBy(*key_cols, "__block")
            .applyInPandas(again, schema=state_schema)
        )
        rest = states.withColumn("__block", F.expr(f"__no div {length}")).join(wrong, [*keys, "__block"], "left_anti")
        states = rest.select(*states.columns).unionByName(redo).checkpoint()
        length *= 2

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = ordered(pdf)
        out, _ = fold(mine, json.loads(mine.iloc[0]["__entry"]))
        return out

    return (
        df.join(states.select(*keys, "__chunk", "__entry"), [*keys, "__chunk"])
        .groupBy(*key_cols, "__chunk")
        .applyInPandas(emit, schema=schema)
    )
