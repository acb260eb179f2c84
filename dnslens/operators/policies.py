"""Routing policies replayed over a recorded log.

A policy answers "which backend would have been picked for this query, given the
recorded signals". Picks do not feed back. Every policy sees the snapshot rows that pass
the health filter (or the panic rule), one small array of candidates per (version,
region); apart from the round-robin cursor a pick is a column expression on the query row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnslens.functions.factors import health_factor, inverse_latency
from dnslens.functions.hashing import uniform
from dnslens.operators.asof import asof_advice, asof_snapshot
from dnslens.operators.choice import (
    candidate_arrays,
    less_loaded,
    pick_by_scan,
    pick_by_weight,
    two_choices,
    with_cumulative,
)
from dnslens.operators.geo import geo_rank
from dnslens.operators.prepare import panic
from dnslens.operators.scans import numbered

KEYS = ("version", "region")

# The policy names.
NAMES = ("round_robin", "weighted", "least_inflight", "latency_based", "geo_aware", "health_aware", "adaptive")


class Policy(Protocol):
    """Anything with a name that turns (queries, snapshot) into queries + backend."""

    name: str

    def assign(self, queries: DataFrame, snapshot: DataFrame) -> DataFrame: ...


_REGISTRY: dict[str, Callable[..., Policy]] = {}


def register(name: str, factory: Callable[..., Policy]) -> None:
    """Make a policy selectable by name."""
    _REGISTRY[name] = factory


def make(name: str, **params) -> Policy:
    if name not in _REGISTRY:
        raise ValueError(f"unknown policy {name!r}: expected one of {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name](**params)


def in_force(queries: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Queries with the snapshot version in force, unless they carry one already."""
    return queries if "version" in queries.columns else asof_snapshot(queries, snapshot)


def _attach(queries: DataFrame, usable: DataFrame, weight: Column, name: str = "cands") -> DataFrame:
    weighed = with_cumulative(usable.withColumn("__w", weight), "__w", KEYS)
    arrays = candidate_arrays(weighed, KEYS).withColumnRenamed("cands", name)
    return queries.join(arrays, list(KEYS), "left")


@dataclass
class _Base:
    seed: int = 7
    enforce: bool = True
    panic_mode: str = "fail_open"

    def usable(self, snapshot: DataFrame) -> DataFrame:
        return panic(snapshot, self.panic_mode, self.enforce, KEYS)

    def u(self, draw: int) -> Column:
        return uniform(self.seed, F.col("query_id"), draw)


@dataclass
class RoundRobin(_Base):
    """The worker's cursor, modulo the number of usable backends."""

    name: str = "round_robin"

    def assign(self, queries: DataFrame, snapshot: DataFrame) -> DataFrame:
        q = in_force(cursor(queries), snapshot)
        pool = self.usable(snapshot).groupBy(*KEYS).agg(F.array_sort(F.collect_set("backend")).alias("pool"))
        q = q.join(pool, list(KEYS), "left")
        turn = F.when(F.size("pool") > 0, ((F.col("cursor") - 1) % F.size("pool")).cast("int"))
        return q.withColumn("pick", F.get("pool", turn)).drop("pool", "cursor")


def cursor(q: DataFrame) -> DataFrame:
    """Add ``cursor``: the query's position on its worker, from 1."""
    return numbered(q, ["worker_id"], ["arrival_us", "query_id"], "cursor")


@dataclass
class Weighted(_Base):
    """Static weights."""

    name: str = "weighted"

    def assign(self, queries: DataFrame, snapshot: DataFrame) -> DataFrame:
        q = _attach(in_force(queries, snapshot), self.usable(snapshot), F.col("weight"))
        return q.withColumn("pick", pick_by_weight(F.col("cands"), self.u(1))).drop("cands")


@dataclass
class LeastInflight(_Base):
    """Power of two choices on the worker's own inflight counts."""

    name: str = "least_inflight"
    full_scan_max: int = 4

    def assign(self, queries: DataFrame, snapshot: DataFrame) -> DataFrame:
        pool = self.usable(snapshot).groupBy(*KEYS).agg(F.array_sort(F.collect_set("backend")).alias("pool"))
        q = in_force(queries, snapshot).join(pool, list(KEYS), "left")
        pick = two_choices(F.col("pool"), F.col("inflight"), self.seed, F.col("query_id"), self.full_scan_max)
        return q.withColumn("pick", pick).drop("pool")


@dataclass
class LatencyBased(_Base):
    """Two draws with weights 1/latency^k; the less loaded one wins."""

    name: str = "latency_based"
    k: float = 1.0

    def assign(self, queries: DataFrame, snapshot: DataFrame) -> DataFrame:
        weight = inverse_latency(F.col("ewma_us"), self.k)
        q = _attach(in_force(queries, snapshot), self.usable(snapshot), weight)
        q = q.select("*", *[pick_by_weight(F.col("cands"), self.u(d)).alias(f"__p{d}") for d in (1, 2)])
        return q.withColumn("pick", less_loaded(F.col("__p1"), F.col("__p2"), F.col("inflight"))).drop("cands", "__p1", "__p2")


@dataclass
class GeoAware(_Base):
    """Preference tiers and measured latency; ``mode`` says which one leads."""

    name: str = "geo_aware"
    mode: str = "geo_first"
    affinity: DataFrame | None = None

    def assign(self, queries: DataFrame, snapshot: DataFrame) -> DataFrame:
        usable = self.usable(snapshot)
        if self.affinity is not None:
            usable = usable.join(self.affinity, ["region", "site"], "left")
        usable = usable.withColumn("tier", F.coalesce("tier", F.lit(2147483647)))
        best = geo_rank(usable.select(*KEYS, "tier", "ewma_us", "backend"), self.mode, KEYS)
        return in_force(queries, snapshot).join(best.select(*KEYS, F.col("backend").alias("pick")), list(KEYS), "left")


@dataclass
class HealthAware(_Base):
    """Static weights times the health factor."""

    name: str = "health_aware"
    degraded: float = 0.25
    probe_fraction: float = 0.1

    def assign(self, queries: DataFrame, snapshot: DataFrame) -> DataFrame:
        weight = F.col("weight") * health_factor(F.col("health"), self.degraded, self.probe_fraction)
        q = _attach(in_force(queries, snapshot), self.usable(snapshot), weight)
        return q.withColumn("pick", pick_by_weight(F.col("cands"), self.u(1))).drop("cands")


@dataclass
class Adaptive(_Base):
    """Two draws from the region's advice; expired advice falls back to latency x health."""

    name: str = "adaptive"
    k: float = 1.0
    degraded: float = 0.25
    probe_fraction: float = 0.1
    advice: DataFrame | None = None

    def assign(self, queries: DataFrame, snapshot: DataFrame) -> DataFrame:
        usable = self.usable(snapshot)
        fallback = inverse_latency(F.col("ewma_us"), self.k) * health_factor(
            F.col("health"), self.degraded, self.probe_fraction
        )
        q = in_force(queries, snapshot)
        if "advice_issued_us" not in q.columns:
            q = asof_advice(q, self.advice)
        q = _attach(q, usable, fallback, "builtin")
        advised = self.advice.groupBy("region", F.col("issued_us").alias("advice_issued_us")).agg(
            F.array_sort(F.collect_list(F.struct("backend", F.col("advice_weight").alias("w")))).alias("advised")
        )
        # Advice counts only for the backends that are usable now.
        pool = F.col("builtin.backend")
        q = q.join(advised, ["region", "advice_issued_us"], "left").withColumn(
            "advised", F.filter("advised", lambda x: F.array_contains(pool, x["backend"]))
        )
        follow = F.coalesce(F.size("advised") > 0, F.lit(False)) & F.col("advised").isNotNull()
        # Each draw is a column of its own: written into the choice, it would be made again at each mention.
        q = q.select("*", *[
            F.when(follow, pick_by_scan(F.col("advised"), self.u(d))).otherwise(pick_by_weight(F.col("builtin"), self.u(d))).alias(f"__p{d}")
            for d in (1, 2)
        ])
        return (
            q.withColumn("pick", less_loaded(F.col("__p1"), F.col("__p2"), F.col("inflight")))
            .withColumn("source", F.when(follow, F.lit("advice")).otherwise(F.lit("builtin")))
            .drop("advised", "builtin", "__p1", "__p2")
        )


@dataclass
class Switching(_Base):
    """The policy named by the snapshot in force decides each query."""

    name: str = "switching"
    policies: tuple = field(default_factory=tuple)

    def assign(self, queries: DataFrame, snapshot: DataFrame) -> DataFrame:
        q = in_force(queries, snapshot)
        chosen = snapshot.groupBy("version").agg(F.min("policy").alias("policy"))
        q = q.join(chosen, "version", "left")
        parts = None
        for p in self.policies:
            part = p.assign(q.filter(F.col("policy") == p.name), snapshot).select(*q.columns, "pick")
            parts = part if parts is None else parts.unionByName(part)
        names = [p.name for p in self.policies]
        rest = q.filter(F.col("policy").isNull() | ~F.col("policy").isin(*names)).withColumn(
            "pick", F.lit(None).cast("string")
        )
        return rest if parts is None else parts.unionByName(rest)


for _cls in (RoundRobin, Weighted, LeastInflight, LatencyBased, GeoAware, HealthAware, Adaptive, Switching):
    register(_cls.name, _cls)
