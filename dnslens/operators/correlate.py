"""Matching upstream attempts with responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A response belongs to an attempt only if all of these agree.
MATCH = ["worker_id", "backend", "upstream_txid", "generation", "question_hash"]


def outcomes(att: DataFrame, resp: DataFrame) -> DataFrame:
    """Every attempt with the first response inside its deadline, or nulls.

    The join key is one 64-bit hash of the five columns (checked in full as well), so rows
    are shuffled and sorted by a number instead of several strings. Exact repeats of a
    response are collapsed before the shuffle. The aggregation groups by a superset of the
    join key and reuses its partitioning.
    """
    match = f"xxhash64({', '.join(MATCH)}) AS match_key"
    first = resp.selectExpr(match, *MATCH, "recv_us", "rcode").distinct()
    same = " AND ".join(f"a.{c} = r.{c}" for c in MATCH)
    on = f"a.match_key = r.match_key AND {same} AND r.recv_us BETWEEN a.send_us AND a.deadline_us"
    hits = att.selectExpr("*", match).alias("a").join(first.alias("r"), F.expr(on), "left").selectExpr(
        "a.*", "CASE WHEN r.recv_us IS NOT NULL THEN struct(r.recv_us, r.rcode) END AS hit"
    )
    rest = [c for c in att.columns if c not in ("query_id", "attempt_no")]
    return (
        hits.groupBy("match_key", "query_id", "attempt_no")
        .agg(*[F.expr(f"first(`{c}`) AS `{c}`") for c in rest], F.expr("min(hit) AS hit"))
        .selectExpr(
            *[f"`{c}`" for c in att.columns],
            "hit.recv_us AS recv_us",
            "hit.rcode AS rcode",
            "hit.recv_us - send_us AS latency_us",
        )
    )


def correlate(att: DataFrame, resp: DataFrame) -> DataFrame:
    """Accepted pairs only."""
    return outcomes(att, resp).filter("recv_us is not null")


def timeouts(att: DataFrame, resp: DataFrame) -> DataFrame:
    """Attempts without an accepted response by their deadline."""
    return outcomes(att, resp).filter("recv_us is null").select(*att.columns)


def mismatches(att: DataFrame, resp: DataFrame) -> DataFrame:
    """Responses no attempt accepted, with the reason.

    Each lookup side is aggregated to unique keys first: transaction ids recur all the
    time, and joining raw attempts on them would multiply the responses.
    """
    ids = att.groupBy("worker_id", "backend", "upstream_txid").agg(F.lit(True).alias("has_txid"))
    slots = att.groupBy("worker_id", "backend", "upstream_txid", "generation").agg(F.lit(True).alias("has_gen"))
    full = (
        outcomes(att, resp)
        .groupBy(*MATCH)
        .agg(
            F.max("deadline_us").alias("last_deadline"),
            F.min("send_us").alias("first_send"),
            # Attempts sharing every key (a reused slot) each accept one response.
            F.collect_set("recv_us").alias("accepted"),
        )
    )
    copy_no = F.col("copies")
    counted = resp.groupBy(*MATCH, "recv_us", "rcode").agg(F.count("*").alias("copies"))
    marked = (
        counted.join(ids, ["worker_id", "backend", "upstream_txid"], "left")
        .join(slots, ["worker_id", "backend", "upstream_txid", "generation"], "left")
        .join(full, MATCH, "left")
    )
    hit = F.coalesce(F.array_contains("accepted", F.col("recv_us")), F.lit(False))
    reason = (
        F.when(F.col("has_txid").isNull(), F.lit("unknown_txid"))
        .when(F.col("has_gen").isNull(), F.lit("generation"))
        .when(F.col("last_deadline").isNull(), F.lit("question"))
        .when(F.col("recv_us") > F.col("last_deadline"), F.lit("late"))
        .when(F.col("recv_us") < F.col("first_send"), F.lit("early"))
        .otherwise(F.lit("duplicate"))
    )
    # Of several identical copies of an accepted response, all but one are duplicates.
    spare = F.when(hit, copy_no - 1).otherwise(copy_no)
    return (
        marked.withColumn("reason", F.when(hit, F.lit("duplicate")).otherwise(reason))
        .withColumn("copies", spare)
        .filter("copies > 0")
        .select(*MATCH, "recv_us", "rcode", "reason", "copies")
    )


def retry_plan(
    done: DataFrame,
    snap: DataFrame,
    max_attempts: int = 2,
    budget_us: int = 800_000,
    timeout_us: int = 200_000,
    on_timeout: str = "servfail",
    keys: tuple[str, ...] = ("version", "region"),
) -> DataFrame:
    """What happens to each timed-out attempt: a retry target or a final outcome.

    ``done`` is the timed-out attempts with the columns of ``keys``; ``snap`` lists the
    eligible backends per key. The target is the next backend by name, cyclically. One
    extra attempt at most, and only if it can still finish inside the client budget.
    """
    if on_timeout not in ("servfail", "drop"):
        raise ValueError(f"unknown action {on_timeout!r}")
    if not 1 <= max_attempts <= 2:
        raise ValueError("max_attempts must be 1 or 2: a query gets one extra attempt at most")
    pool = snap.groupBy(*keys).agg(F.array_sort(F.collect_set("backend")).alias("pool"))
    df = done.join(pool, list(keys), "left")
    later = F.filter("pool", lambda b: b > F.col("backend"))
    others = F.filter("pool", lambda b: b != F.col("backend"))
    target = F.when(F.size(later) > 0, F.try_element_at(later, F.lit(1))).otherwise(F.try_element_at(others, F.lit(1)))
    fits = (
        (F.col("attempt_no") < max_attempts)
        & (F.col("deadline_us") + timeout_us <= F.col("send_us") + budget_us)
    )
    return (
        df.withColumn("retry_backend", F.when(fits, target))
        .withColumn("retry_send_us", F.when(F.col("retry_backend").isNotNull(), F.col("deadline_us")))
        .withColumn("final", F.when(F.col("retry_backend").isNull(), F.lit(on_timeout)))
        .drop("pool")
    )


def mismatch_counts(att: DataFrame, resp: DataFrame) -> DataFrame:
    """Mismatches per backend and reason."""
    return mismatches(att, resp).groupBy("backend", "reason").agg(F.sum("copies").alias("n"))
