"""Structured Streaming forms of the batch operators.

Each gives the rows of its batch twin. Event times are zoned timestamps: a watermark does
not accept zone-less ones. Keyed state (health, buckets, averages, weights) lives in the
state store; rows are held until the watermark has passed them, then folded in time order
with the very function the batch form uses.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dnslens.functions.histogram import bucket_of
from dnslens.operators.correlate import MATCH
from dnslens.operators.health import HEALTH_SCHEMA, HealthConfig, health_fold
from dnslens.operators.ratelimit import bucket_fold
from dnslens.operators.scoring import smoothing_fold
from dnslens.operators.telemetry import peak_ewma_fold

DELAY = "2 seconds"

#: Event time of the row behind the last one: the start of the year 2200.
CLOSING_US = 7_258_118_400_000_000


def with_event_time(t: DataFrame, delay: str = DELAY, ts: str = "ts") -> DataFrame:
    """Cast the event time and set its watermark; later rows count as dropped in progress."""
    return t.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def dropped_rows(query) -> int:
    """Rows dropped as too late so far, from the query's progress."""
    return sum(
        op.get("numRowsDroppedByWatermark", 0)
        for p in query.recentProgress
        for op in (p.jsonValue if hasattr(p, "jsonValue") else json.loads(p.json)).get("stateOperators", [])
    )


def stream_rates(t: DataFrame, period: str = "100 milliseconds", keys: tuple[str, ...] = ("backend",), ts: str = "ts") -> DataFrame:
    """Counts per tumbling window and key; append once the window is closed."""
    return (
        t.groupBy(F.window(ts, period), *keys)
        .agg(
            F.count("*").alias("requests"),
            F.count_if(F.col("outcome") == "error").alias("errors"),
            F.count_if(F.col("outcome") == "timeout").alias("timeouts"),
        )
        .select(
            F.unix_micros("window.start").alias("window_us"),
            F.col("window.end").alias("window_end"),
            *keys,
            "requests",
            "errors",
            "timeouts",
        )
    )


def stream_correlate(att: DataFrame, resp: DataFrame, delay: str = DELAY, timeout: str = "800 milliseconds") -> DataFrame:
    """Attempts with a response inside their deadline; the others once it has passed.

    Repeated responses are removed first. ``timeout`` bounds the state: no deadline may lie
    further than that after its send.
    """
    a = att.withWatermark("send_ts", delay)
    r = drop_stale(resp, delay).select(*[F.col(c).alias(f"r_{c}") for c in MATCH], "recv_ts", "rcode")
    on = " AND ".join(f"{c} = r_{c}" for c in MATCH)
    return a.join(
        r,
        F.expr(
            f"{on} AND recv_ts >= send_ts AND recv_ts <= deadline_ts AND recv_ts <= send_ts + INTERVAL {timeout}"
        ),
        "leftOuter",
    ).drop(*[f"r_{c}" for c in MATCH])


def drop_stale(resp: DataFrame, delay: str = DELAY) -> DataFrame:
    """The first response per full key; stale generations match no attempt later on."""
    return resp.withWatermark("recv_ts", delay).dropDuplicatesWithinWatermark(MATCH)


def stream_hist(t: DataFrame, period: str = "500 milliseconds", keys: tuple[str, ...] = ("backend",), ts: str = "ts", col: str = "latency_us") -> DataFrame:
    """Latency histograms per window, in update or append mode.

    Rows without a latency are not counted but move the watermark: the condition names the event time, so it stays
    behind the watermark.
    """
    return (
        t.filter(F.when(F.col(ts).isNotNull(), F.col(col)).isNotNull())
        .groupBy(F.window(ts, period), *keys, bucket_of(F.col(col)).alias("bucket"))
        .agg(F.count("*").alias("cnt"))
        .select(F.unix_micros("window.start").alias("window_us"), *keys, "bucket", "cnt")
    )


Fold = Callable[[pd.DataFrame, object], tuple[pd.DataFrame, object]]

#: State store that has lists and timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Kept:
    """How a fold's state is kept: its columns, and the way there and back."""

    schema: str
    to_row: Callable[[object], tuple] = tuple
    from_row: Callable[[tuple], object] = list


_HEALTH_KEPT = ("state", "bad", "clean", "fails", "oks", "ejected_at", "cooldown")
HEALTH_KEPT = Kept(
    "state string, bad long, clean long, fails long, oks long, ejected_at long, cooldown long",
    lambda s: tuple(s[k] for k in _HEALTH_KEPT), lambda r: dict(zip(_HEALTH_KEPT, r)),
)
BUCKET_KEPT = Kept("last_bin long, tokens double")
AVERAGE_KEPT = Kept("last_us long, level double")
WEIGHTS_KEPT = Kept("weights map<string, double>", lambda s: (s,), lambda r: dict(r[0]))


def _plain(x: object) -> object:
    """A value the state store takes: numbers of the array library become plain ones, NaN is null."""
    x = x.item() if hasattr(x, "item") else x
    return None if isinstance(x, float) and x != x else x


class TimedFold(StatefulProcessor):
    """Rows wait in a list until the watermark has passed them, then they are folded in time order.

    An event-time timer stands at the earliest waiting row. When none is left and ``ttl_us`` is given, it stands that
    far behind the last folded row; if nothing has come until then, the key's state is removed.
    """

    def __init__(self, names: list[str], rows: str, order: str, fold: Fold, columns: list[str], kept: Kept, ttl_us: int | None) -> None:
        self._names, self._rows, self._fold, self._columns, self._kept, self._ttl_us = names, rows, fold, columns, kept, ttl_us
        self._at = names.index(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", self._rows)
        self._folded = handle.getValueState("folded", self._kept.schema)
        self._last = handle.getValueState("last", "us long")

    def _wake(self, us: int, watermark_ms: int) -> None:
        when = max(us // 1000 + 1, watermark_ms + 1)
        # The timer that has just gone off is still listed.
        if not any(watermark_ms < t <= when for t in self._handle.listTimers()):
            self._handle.registerTimer(when)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = [tuple(map(_plain, r)) for pdf in rows for r in pdf[self._names].itertuples(index=False, name=None)]
        # A row that closes the input has an event time, but nothing to fold.
        got = [r for r in got if r[self._at] is not None]
        if got:
            self._waiting.appendList(got)
            self._wake(min(r[self._at] for r in got), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark_ms = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self._waiting.get()] if self._waiting.exists() else []
        ready = sorted((r for r in rows if r[self._at] < watermark_ms * 1000), key=lambda r: r[self._at])
        left = [r for r in rows if r[self._at] >= watermark_ms * 1000]
        if ready:
            before = self._kept.from_row(tuple(self._folded.get())) if self._folded.exists() else None
            out, state = self._fold(pd.DataFrame(ready, columns=self._names), before)
            self._folded.update(tuple(map(_plain, self._kept.to_row(state))))
            self._last.update((ready[-1][self._at],))
            out = out[self._columns]
            yield out.assign(**{c: out[c].astype(object) for c in out.columns if pd.api.types.is_string_dtype(out[c])})
        if left:
            self._waiting.put(left)
            self._wake(min(r[self._at] for r in left), watermark_ms)
            return
        self._waiting.clear()
        if self._ttl_us is not None and self._last.exists():
            end = self._last.get()[0] + self._ttl_us
            if end < watermark_ms * 1000:
                self._folded.clear()
                self._last.clear()
            else:
                self._wake(end, watermark_ms)

    def close(self) -> None:
        """Nothing to give back."""


def stateful_fold(
    t: DataFrame, keys: list[str], ts: str, order: str, fold: Fold, schema: str, kept: Kept, ttl_us: int | None = None
) -> DataFrame:
    """Fold every key's rows in ``order``, each as soon as the watermark has passed it.

    Late and shuffled input gives the rows of the batch form. Windowed series come from the table another stream writes:
    Spark does not place this operator after an aggregation of the same query. ``t`` carries a watermark on ``ts``;
    ``order`` is a long in microseconds of the same time. The waiting rows span the watermark delay only. Where a key
    without rows for ``ttl_us`` would be as a new one, give it: the key's state is then removed.
    """
    t.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    fields = [f for f in t.schema.fields if f.name != ts]
    rows = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    columns = [c.split()[0].strip("`") for c in schema.split(", ")]
    step = TimedFold([f.name for f in fields], rows, order, fold, columns, kept, ttl_us)
    return t.groupBy(*keys).transformWithStateInPandas(step, schema, "Append", "EventTime")


def stream_health(signals: DataFrame, cfg: HealthConfig | None = None, ts: str = "ts", ttl_us: int | None = None) -> DataFrame:
    """Health states per backend and window. ``signals`` has the columns of the batch form, ``may_eject`` included, and a
    watermark on ``ts``. A backend that leaves for ``ttl_us`` starts anew."""
    fold = health_fold(cfg or HealthConfig())
    return stateful_fold(signals, ["backend"], ts, "window_us", fold, HEALTH_SCHEMA, HEALTH_KEPT, ttl_us)


def stream_rate_limit(counts: DataFrame, rate: float, burst: float, bin_us: int, ts: str = "ts") -> DataFrame:
    """Allowed queries per (worker, prefix, bin); ``counts`` are per-bin counts from ST2.

    A bucket left alone for ``burst / rate`` seconds is full, as a new one is: its state goes then.
    """
    schema = "worker_id int, prefix string, bin long, n long, allowed long"
    binned = counts.withColumn("t_us", F.col("bin") * bin_us)
    full_us = math.ceil(burst / rate * 1e6) + bin_us if rate > 0 else None
    return stateful_fold(binned, ["worker_id", "prefix"], ts, "t_us", bucket_fold(rate, burst, bin_us), schema, BUCKET_KEPT, full_us)


def stream_ewma(rates: DataFrame, keys: list[str], col: str, tau_us: float, tau_down_us: float | None = None, ts: str = "ts", t_us: str = "t_us") -> DataFrame:
    """Decayed average of a windowed series; with ``tau_down_us`` the peak-sensitive one.

    After 40 time constants the old level counts less than a double can tell, so the state goes then.
    """
    fold = peak_ewma_fold(col, t_us, float(tau_us), float(tau_down_us or tau_us), "ewma")
    types = {f.name: f.dataType.simpleString() for f in rates.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in (*keys, t_us, col)) + ", `ewma` double"
    forgotten = math.ceil(40 * max(tau_us, tau_down_us or tau_us))
    return stateful_fold(rates.select(*keys, t_us, col, ts), keys, ts, t_us, fold, schema, AVERAGE_KEPT, forgotten)


def stream_advice(ticks: DataFrame, beta: float = 0.3, cap: float = 0.1, ts: str = "ts", t_us: str = "t_us") -> DataFrame:
    """Smoothed weights per region and tick, to be written with an advice sink."""
    schema = f"region string, `{t_us}` long, backend string, weight double, smoothed double"
    return stateful_fold(ticks, ["region"], ts, t_us, smoothing_fold(beta, cap, t_us), schema, WEIGHTS_KEPT)


def with_latest(table: Callable[[], DataFrame], join: Callable[[DataFrame, DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that joins every micro-batch with the table as it is then.

    ``table`` reads the snapshots or advice anew; ``join`` is a batch lookup such as the
    as-of join; ``sink`` takes the result.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        sink(join(batch, table()), batch_id)

    return step


def with_closing(t: DataFrame, folder: str, ts: str = "ts") -> DataFrame:
    """``t`` and what ``run_to_end`` puts into ``folder`` when the input has ended. Set the watermark behind it."""
    spark = t.sparkSession
    spark.createDataFrame([], t.schema).write.mode("append").parquet(folder)
    return t.unionByName(spark.readStream.schema(t.schema).parquet(folder))


def run_to_end(t: DataFrame, path: str, checkpoint: str, mode: str = "append", closing: tuple[str, str, str] | None = None) -> DataFrame:
    """Process all available input, write it as parquet and return what was written.

    Windows and folds that wait for the watermark stay open at the end of the input. With ``closing`` = (folder, schema,
    event-time column) of ``with_closing``, a row of nulls but for a far event time follows the input, and the same
    stream goes on from its checkpoint: all that was open comes out, and the row itself is part of nothing.
    """
    spark = t.sparkSession

    def run() -> None:
        query = (
            t.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path)
            .outputMode(mode).trigger(availableNow=True).start()
        )
        query.awaitTermination()

    run()
    if closing:
        folder, schema, ts = closing
        last = spark.range(1).select(F.timestamp_micros(F.lit(CLOSING_US)).alias(ts))
        spark.createDataFrame([], schema).unionByName(last, allowMissingColumns=True).write.mode("append").parquet(folder)
        run()
    return spark.read.schema(t.schema).parquet(path)
