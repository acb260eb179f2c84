"""Sketches against the exact forms."""

import random

import pytest
from pyspark.sql import functions as F

from dnslens.operators import geo, sketches


@pytest.fixture(scope="module")
def log(spark):
    """A bin of few frequent and many single names, one of single names alone, one of equal counts, one of nulls; a null bin."""
    rng = random.Random(5)
    rows = [(1, f"hot{int(rng.paretovariate(1.0))}" if i % 2 else f"one{i}") for i in range(6000)]
    rows += [(2, f"only{i}") for i in range(4000)]
    rows += [(3, f"same{i % 40}") for i in range(800)]
    rows += [(4, None)] * 7 + [(5, "a"), (5, None), (5, None), (None, "a")]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "bin long, qname string").repartition(5)


@pytest.mark.parametrize("tracked", [20, 200, 10_000])
@pytest.mark.parametrize("limit", [0, 1_000])
def test_top_k_large_is_exact(log, tracked, limit, monkeypatch):
    monkeypatch.setattr(sketches, "BROADCAST_ROWS", limit)
    got = sketches.top_k_large(log, "qname", 4, tracked=tracked)
    want = geo.top_k(log, "qname", 4)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert sketches.top_k_large(log.limit(0), "qname", 4, tracked=tracked).count() == 0


def test_proven_bins_are_not_counted_in_full(log, monkeypatch):
    """The frequent names of a bin are proven by the sketch: the exact form is not asked."""
    monkeypatch.setattr(sketches, "top_k", None)
    rows = sketches.top_k_large(log.filter("bin = 1"), "qname", 2, tracked=500).orderBy("rank").collect()
    assert [r.qname for r in rows] == ["hot1", "hot2"]


def test_percentile_sketches(spark):
    rng = random.Random(9)
    rows = [(w, "hot" if i % 3 else "b", int(rng.lognormvariate(9, 1))) for w in range(6) for i in range(5000)]
    rows += [(0, "null", None), (1, "one", 5)]
    t = spark.createDataFrame(rows, "w int, k string, latency_us long").repartition(6)
    fine = sketches.value_sketches(t, ["w", "k"], k=400)
    found = sketches.sketch_percentiles(sketches.merge_sketches(fine, ["k"]), ["k"], (0.5, 0.99))
    found = spark.createDataFrame(found.collect(), found.schema)
    assert {r.k: r["count"] for r in found.collect()} == {"hot": sum(k == "hot" for _, k, _ in rows), "b": sum(k == "b" for _, k, _ in rows), "one": 1}
    off = 3 * sketches.rank_error(400)
    for r in sketches.rank_spans(t, found, ["k"], ["p50", "p99"]).collect():
        for name, p in (("p50", 0.5), ("p99", 0.99)):
            assert r[f"lo_{name}"] <= p + off and r[f"hi_{name}"] >= p - off
    # A value in the wrong place is told: the median is no 99th percentile.
    wrong = found.select("k", F.col("p50").alias("p99"))
    assert any(r.hi_p99 < 0.99 - off for r in sketches.rank_spans(t, wrong, ["k"], ["p99"]).collect())
