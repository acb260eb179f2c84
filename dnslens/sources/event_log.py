"""JSON-lines event logs: one object per line, ``ts, level, event`` first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keys a field may not take.
RESERVED = ("ts", "level", "event")

_SCHEMA = "ts string, level string, event string"


def parse_event_log(lines: DataFrame) -> DataFrame:
    """(value) to (ts, level, event, fields, _corrupt); a bad line is kept as ``_corrupt``."""
    known = F.from_json("value", _SCHEMA, {"mode": "PERMISSIVE"})
    every = F.from_json("value", "map<string,string>")
    t = lines.withColumns({"__k": known, "__m": every})
    ts = F.expr("try_to_timestamp(__k.ts)")
    bad = F.col("__m").isNull() | ts.isNull() | F.col("__k.level").isNull() | F.col("__k.event").isNull()
    fields = F.map_filter("__m", lambda k, _: ~k.isin(*RESERVED))
    return t.select(
        F.when(~bad, ts).alias("ts"),
        F.when(~bad, F.col("__k.level")).alias("level"),
        F.when(~bad, F.col("__k.event")).alias("event"),
        F.when(~bad, fields).alias("fields"),
        F.when(bad, F.col("value")).alias("_corrupt"),
    )


def read_event_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Event logs below ``path``, as a batch or a stream."""
    reader = spark.readStream if streaming else spark.read
    return parse_event_log(reader.text(path))


def event_line(ts: Column, level: Column, event: Column, fields: Column) -> Column:
    """One JSON line; a field that would hide a fixed key is renamed ``field.<key>``."""
    safe = F.transform_keys(
        fields, lambda k, _: F.when(k.isin(*RESERVED), F.concat(F.lit("field."), k)).otherwise(k)
    )
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    head = F.to_json(
        F.struct(
            F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), level.alias("level"), event.alias("event")
        )
    )
    tail = F.to_json(safe)
    has_fields = F.coalesce(F.size(fields) > 0, F.lit(False))
    return F.when(
        has_fields, F.concat(F.regexp_replace(head, r"\}$", ","), F.substr(tail, F.lit(2)))
    ).otherwise(head)


def event_lines(t: DataFrame) -> DataFrame:
    """(ts, level, event, fields) to a single text column."""
    return t.select(event_line(F.col("ts"), F.col("level"), F.col("event"), F.col("fields")).alias("value"))


def write_event_log(t: DataFrame, path: str, mode: str = "append") -> None:
    """Write events as JSON lines, times in UTC."""
    event_lines(t).write.mode(mode).text(path)
