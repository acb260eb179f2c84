"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnslens.functions.durations import UNIT_US
from dnslens.functions.hashing import hash_bucket, question_hash

# Log levels in ascending order.
LEVELS = ("trace", "debug", "info", "warn", "error")

# The only labels that may leave the system.
LABELS = ("backend", "region", "policy", "rcode_class", "transport", "state")

#: Measures may accompany labels; anything else is refused.
MEASURES = ("ts", "name", "value", "count", "n", "bucket")


def level_rank(level: Column) -> Column:
    """Position of a level name, null for an unknown (or differently cased) one."""
    return F.when(level.isin(*LEVELS), F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level))


def filter_level(t: DataFrame, min_level: str) -> DataFrame:
    """Rows at or above a level; an IN list, so that it reaches the file scan."""
    if min_level not in LEVELS:
        raise ValueError(f"unknown log level {min_level!r}: expected one of {', '.join(LEVELS)}")
    return t.filter(F.col("level").isin(*LEVELS[LEVELS.index(min_level):]))


def eligible(snap: DataFrame, enforce: bool = True) -> DataFrame:
    """Backends a policy may use; ``enforce=False`` is the health-blind variant."""
    if not enforce:
        return snap
    return snap.filter(F.col("health").isin("HEALTHY", "DEGRADED", "RECOVERING"))


def panic(snap: DataFrame, mode: str = "fail_open", enforce: bool = True, keys: tuple[str, ...] = ("version", "region")) -> DataFrame:
    """Eligible rows, or - where none is left - all rows (fail_open) or none (fail_closed).

    Adds ``panic``. The window covers one backend pool per group.
    """
    if mode not in ("fail_open", "fail_closed"):
        raise ValueError(f"unknown panic mode {mode!r}")
    ok = F.col("health").isin("HEALTHY", "DEGRADED", "RECOVERING") if enforce else F.lit(True)
    alive = F.sum(ok.cast("int")).over(Window.partitionBy(*keys))
    marked = snap.withColumn("__ok", ok).withColumn("panic", alive == 0)
    use = F.col("__ok") | (F.col("panic") & F.lit(mode == "fail_open"))
    return marked.filter(use).drop("__ok")


def rcode_class(rcode: Column) -> Column:
    return (
        F.when(rcode == "NOERROR", F.lit("noerror"))
        .when(rcode == "NXDOMAIN", F.lit("nxdomain"))
        .when(rcode == "SERVFAIL", F.lit("servfail"))
        .when(rcode.isNotNull(), F.lit("other"))
    )


def classify_outcome(t: DataFrame) -> DataFrame:
    """Add ``rcode_class`` and ``outcome``: rate_limited, mismatch, timeout, error or ok.

    An authoritative "no such name" is an answer, not an error. Optional boolean columns
    ``rate_limited`` and ``mismatch`` take precedence.
    """
    flag = {c: F.coalesce(F.col(c), F.lit(False)) if c in t.columns else F.lit(False) for c in ("rate_limited", "mismatch")}
    cls = rcode_class(F.col("rcode"))
    return t.withColumn("rcode_class", cls).withColumn(
        "outcome",
        F.when(flag["rate_limited"], F.lit("rate_limited"))
        .when(flag["mismatch"], F.lit("mismatch"))
        .when(F.col("rcode").isNull(), F.lit("timeout"))
        .when(F.col("rcode_class").isin("noerror", "nxdomain"), F.lit("ok"))
        .otherwise(F.lit("error")),
    )


def safe_labels(t: DataFrame, measures: tuple[str, ...] = ()) -> DataFrame:
    """Keep the allowed labels and the named measures; names and addresses never leave."""
    private = [c for c in measures if c in ("qname", "client_ip", "client_hi", "client_lo", "edns", "ecs_ip", "prefix")]
    if private:
        raise ValueError(f"not exportable: {', '.join(private)}")
    return t.select(*[c for c in t.columns if c in LABELS or c in measures])


def check_labels(keys: list[str] | tuple[str, ...]) -> None:
    """Refuse an aggregate that keys on anything but allowed labels."""
    bad = [k for k in keys if k not in LABELS]
    if bad:
        raise ValueError(f"not a metric label: {', '.join(bad)}")


def _period(text: str) -> int:
    for unit in ("us", "ms", "s", "m"):
        number = text[: -len(unit)]
        if text.endswith(unit) and number.isdigit():
            return int(number) * UNIT_US[unit]
    raise ValueError(f"not a duration: {text!r}")


def drop_warmup(t: DataFrame, warmup: str = "5s", t_us: str = "intended_us") -> DataFrame:
    """Discard the first part of every run; the start comes from the data itself."""
    starts = t.groupBy("run_id").agg(F.min(t_us).alias("__start"))
    return t.join(starts, "run_id").filter(F.col(t_us) >= F.col("__start") + _period(warmup)).drop("__start")


def hash_sample(t: DataFrame, key: str, pct: float, salt: str = "") -> DataFrame:
    """A reproducible sample: the same keys stay in, whatever the partitioning."""
    return t.filter(hash_bucket(F.col(key), 10_000, salt) < int(round(pct * 100)))


def with_question_hash(t: DataFrame) -> DataFrame:
    return t.withColumn("question_hash", question_hash(F.col("qname"), F.col("qtype"), F.col("qclass")))


def malformed(qname: Column, qtype: Column, qclass: Column) -> Column:
    """Why a logged question cannot be forwarded, or null."""
    labels = F.split(F.regexp_replace(qname, r"\.$", ""), r"\.")
    return (
        F.when(qname.isNull() | (qname == ""), F.lit("no_question"))
        .when(F.length(qname) > 253, F.lit("name_too_long"))
        .when(F.exists(labels, lambda x: F.length(x) == 0) & (qname != "."), F.lit("empty_label"))
        .when(F.exists(labels, lambda x: F.length(x) > 63), F.lit("label_too_long"))
        .when(qtype.isNull() | ~qtype.between(1, 65535), F.lit("bad_qtype"))
        .when(qclass.isNull() | ~qclass.between(1, 65535), F.lit("bad_qclass"))
    )


def split_malformed(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to forward, quarantined rows with ``reason`` and ``action``).

    A row whose header is unusable is dropped, any other is answered with FORMERR.
    """
    marked = t.withColumn("reason", malformed(F.col("qname"), F.col("qtype"), F.col("qclass")))
    bad = marked.filter("reason is not null").withColumn(
        "action", F.when(F.col("reason") == "no_question", F.lit("drop")).otherwise(F.lit("formerr"))
    )
    return marked.filter("reason is null").drop("reason"), bad


def shed(t: DataFrame, max_inflight: int, action: str = "drop") -> DataFrame:
    """Add ``shed_action`` where the inflight count at arrival is over the limit."""
    if action not in ("drop", "refused", "truncate"):
        raise ValueError(f"unknown overload action {action!r}")
    return t.withColumn("shed_action", F.when(F.col("inflight") > max_inflight, F.lit(action)))
