"""Chunked scans and folds against plain sequential code, also with hot cells."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dnslens.operators.asof import asof
from dnslens.operators.experiments import dense_bins, latest_fault, next_at, time_to_shift
from dnslens.operators.folds import chunked_fold
from dnslens.operators.scans import bounded_windows, numbered, run_lengths, running
from dnslens.operators.telemetry import ewma, latency_summary


@pytest.fixture(scope="module")
def rows():
    """A third of all rows share one instant of one key; another burst fills one slice."""
    rng = random.Random(3)
    out = []
    for i in range(3000):
        if i % 3 == 0:
            key, t = "a", 50_000
        elif i % 3 == 1:
            key, t = "a", 70_000 + rng.randrange(40)
        else:
            key, t = rng.choice("ab"), rng.randrange(100_000)
        out.append((key, t, i, rng.choice([None, i]), rng.randrange(10)))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("tie_span", [None, 128])
@pytest.mark.parametrize("cell", [700, 20_000])
def test_running(spark, rows, cell, tie_span, monkeypatch):
    monkeypatch.setattr("dnslens.operators.scans.BLOCK", 5)
    df = spark.createDataFrame(rows, "k string, t long, id long, x long, n long")
    got = running(
        df, ["k"], "t", ["id"], sums={"s": F.col("n"), "rank": F.lit(1)}, lasts={"l": F.col("x")},
        before={"b": F.col("x")}, cell=cell, tie_span=tie_span,
    ).toPandas()
    want = pd.DataFrame(rows, columns=["k", "t", "id", "x", "n"]).sort_values(["k", "t", "id"])
    want["s"] = want.groupby("k")["n"].cumsum()
    want["rank"] = want.groupby("k").cumcount() + 1
    want["l"] = want.groupby("k")["x"].ffill()
    want["b"] = want.groupby("k")["l"].shift(1)
    got = got.sort_values(["k", "t", "id"]).reset_index(drop=True)
    want = want.reset_index(drop=True)
    assert len(got) == len(rows)
    for c in ("s", "rank", "l", "b"):
        pd.testing.assert_series_equal(got[c].astype(float), want[c].astype(float), check_names=False)


def test_run_lengths(spark):
    rng = random.Random(1)
    data = [(rng.choice("ab"), i, rng.choice([True, True, True, False, None])) for i in range(500)]
    df = spark.createDataFrame(data, "k string, t long, p boolean")
    got = {(r["k"], r["t"]): r["run"] for r in run_lengths(df, ["k"], "t", {"run": F.col("p")}, cell=37).collect()}
    count = {"a": 0, "b": 0}
    for k, t, p in data:
        if p is not None:
            count[k] = count[k] + 1 if p else 0
        assert got[(k, t)] == count[k], (k, t)


def test_bounded_windows(spark):
    data = [("a", i * 3, float((i * 7) % 11)) for i in range(400)]
    df = spark.createDataFrame(data, "k string, t long, x double")
    got = bounded_windows(
        df, ["k"], "t", 5, lambda w: {"m": F.max("x").over(w.rowsBetween(-5, -1)), "p": F.lag("x", 2).over(w)},
        cell=50, chunk_rows=20,
    ).toPandas().sort_values("t")
    want = pd.DataFrame(data, columns=["k", "t", "x"])
    assert len(got) == 400
    pd.testing.assert_series_equal(got["m"].reset_index(drop=True), want["x"].shift(1).rolling(5, 1).max(), check_names=False)
    pd.testing.assert_series_equal(got["p"].reset_index(drop=True), want["x"].shift(2), check_names=False)


@pytest.mark.parametrize("cell", [7, 100])
def test_asof(spark, cell):
    rng = random.Random(9)
    right = sorted(rng.sample(range(100, 1000), 40))
    left = [(i, rng.choice([500, rng.randrange(1000)]), "r") for i in range(598)] + [(598, 700, None), (599, None, "r")]
    q = spark.createDataFrame(left, "query_id long, at_us long, region string")
    s = spark.createDataFrame([(t, t * 2, "r") for t in right], "pub long, v long, region string")
    got = asof(q, s, "at_us", "pub", ["v"], ["region"], cell_us=cell).collect()
    assert len(got) == 600
    for r in got:
        known = r["region"] is not None and r["at_us"] is not None
        want = max((t for t in right if t <= r["at_us"]), default=None) if known else None
        assert r["v"] == (None if want is None else want * 2)


@pytest.mark.parametrize("tau", [10, 500, 40_000])
def test_ewma(spark, tau):
    import math

    rng = random.Random(tau)
    data, t = [], 0
    for _ in range(800):
        t += rng.choice([1, 3, 50, 4_000])
        data.append(("a", t, float(rng.randrange(1, 1_000))))
    df = spark.createDataFrame(data, "k string, t_us long, x double")
    got = {r["t_us"]: r["ewma"] for r in ewma(df, ["k"], "x", tau).collect()}
    value = last = None
    for _, t, x in data:
        value = x if value is None else value * math.exp(-(t - last) / tau) + x * (1 - math.exp(-(t - last) / tau))
        last = t
        assert got[t] == pytest.approx(value, rel=1e-9)


def test_percentiles_are_exact(spark):
    rng = random.Random(2)
    data = [(rng.choice("ab"), rng.choice([7, rng.randrange(1, 100_000)])) for _ in range(2_000)]
    df = spark.createDataFrame(data, "k string, latency_us long")
    want = pd.DataFrame(data, columns=["k", "v"]).groupby("k")["v"]
    for r in latency_summary(df, ["k"], ps=(0.5, 0.95, 0.99)).collect():
        group = want.get_group(r["k"])
        assert r["count"] == len(group) and r["max"] == group.max()
        assert r["mean"] == pytest.approx(group.mean())
        for p, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
            assert r[name] == pytest.approx(group.quantile(p))


@pytest.mark.parametrize("resets", [True, False])
def test_chunked_fold_is_sequential(spark, resets):
    def counter(pdf, state):
        """Counts modulo 7, reset by x = 0: a fold that forgets only at resets."""
        n, out = state or 0, []
        for x in pdf["x"]:
            n = 0 if x == 0 else (n + x) % 7
            out.append(n)
        return pdf[["k", "t", "x"]].assign(n=out), n

    rng = random.Random(4)
    low = 0 if resets else 1
    data = [(rng.choice("ab"), i, rng.randrange(low, 9)) for i in range(900)]
    df = spark.createDataFrame(data, "k string, t long, x long")
    got = chunked_fold(df, ["k"], "t", counter, "k string, t long, x long, n long", chunk_us=40).toPandas()
    assert len(got) == 900
    for k, part in got.groupby("k"):
        part = part.sort_values("t")
        want, _ = counter(part.drop(columns="n"), None)
        assert part["n"].tolist() == want["n"].tolist()


@pytest.mark.parametrize("limit", [0, 1_000])
def test_numbered(spark, rows, limit, monkeypatch):
    """Positions over physical ranges, with one instant of one key holding a third of the rows; null keys, no rows."""
    monkeypatch.setattr("dnslens.operators.scans.CARRY_ROWS", limit)
    rows = [(None if i % 10 == 9 else k, t, i) for k, t, i, _, _ in rows]
    df = spark.createDataFrame(rows, "k string, t long, id long").repartition(7)
    got = {r.id: r.rn for r in numbered(df, ["k"], ["t", "id"], "rn").collect()}
    want, seen = {}, {}
    for k, _, i in sorted(rows, key=lambda r: (r[1], r[2])):
        seen[k] = seen.get(k, 0) + 1
        want[i] = seen[k]
    assert got == want
    assert numbered(df.limit(0), ["k"], ["t", "id"], "rn").count() == 0


@pytest.mark.parametrize("cell", [3, 1_000])
def test_fault_lookups(spark, cell, monkeypatch):
    """Next mark, latest fault and time to shift against plain loops; many faults at one instant, null and unknown runs."""
    monkeypatch.setattr("dnslens.operators.experiments.GRID_BLOCK", 4)
    rng = random.Random(11)
    shares = [(r, t, b, rng.choice([0.05, 0.1, 0.4])) for r in "xy" for t in range(0, 60, 2) for b in "ab" if rng.random() < 0.8]
    faults = [(f"f{i:02}", rng.choice(["x", "y", "z", None]), rng.choice("abc"), rng.choice([-5, 20, rng.randrange(70)])) for i in range(60)]
    s = spark.createDataFrame(shares, "run_id string, bin_us long, backend string, share double")
    f = spark.createDataFrame(faults, "fault_id string, run_id string, backend string, injected_us long")

    got = {r.fault_id: r.shifted_us for r in time_to_shift(f, s, 0.1, cell=cell).collect()}
    want = {}
    for name, run, backend, at in faults:
        bins = sorted({t for r, t, _, _ in shares if r == run and t >= at})
        have = {t: x for r, t, b, x in shares if r == run and b == backend}
        want[name] = next((t for t in bins if have.get(t, 0.0) < 0.1), None)
    assert got == want and None in want.values()

    found = next_at(f, s, ["run_id"], ask="injected_us", mark="bin_us", out="next", cell=cell)
    first = {r.fault_id: r.next for r in found.collect()}
    assert first == {n: min((t for r, t, _, _ in shares if r == run and t >= at), default=None) for n, run, _, at in faults}

    bins = s.select("run_id", "bin_us").distinct()
    for row in latest_fault(bins, f, cell=cell).collect():
        past = [(at, n) for n, run, _, at in faults if run == row.run_id and at <= row.bin_us]
        assert (row.fault_id, row.age_us) == ((max(past)[1], row.bin_us - max(past)[0]) if past else (None, None))

    sent = [("x", t) for t in (3, 4, 19, 47)]
    grid = dense_bins(spark.createDataFrame(sent, "run_id string, send_us long").selectExpr("*", "'ok' AS status"), ["run_id"], 2)
    assert sorted((r.bin_us, r.n) for r in grid.collect()) == [(t, sum(t <= x < t + 2 for _, x in sent)) for t in range(2, 48, 2)]


@pytest.mark.parametrize("limits", [(100_000, 64), (3, 64), (100_000, 0)])
@pytest.mark.parametrize("times", ["even", "crowded", "one", "none"])
def test_asof_by_spans_and_by_scan(spark, monkeypatch, limits, times):
    from dnslens.operators import asof as module

    monkeypatch.setattr(module, "MAX_SPANS", limits[0])
    monkeypatch.setattr(module, "MAX_SHARED", limits[1])
    rng = random.Random(4)
    some = {"even": range(-500, 900, 7), "crowded": [*range(100, 150), 10**15], "one": [40], "none": []}[times]
    right = [(t, t * 2 if t % 3 else None, k) for t in some for k in "rs" if k == "r" or t % 2]
    left = [(i, rng.choice([rng.randrange(-600, 1000), 10**15 + i, 0]), rng.choice("rsx")) for i in range(300)]
    left += [(300, 700, None), (301, None, "r"), (301, None, "r")]
    q = spark.createDataFrame(left, "query_id long, at_us long, region string")
    s = spark.createDataFrame(right, "pub long, v long, region string").withColumn("since", F.col("pub"))
    got = asof(q, s, "at_us", "pub", ["v", "since"], ["region"], cell_us=50)
    want = []
    for i, at, k in left:
        row = max(((t, v) for t, v, name in right if name == k and at is not None and t <= at), key=lambda r: r[0], default=(None, None))
        want.append((i, at, k, row[1], row[0]))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_asof_with_few_rows_leaves_the_log_where_it_is(spark):
    q, s = spark.range(1000).selectExpr("id", "id * 3 AS at_us"), spark.range(20).selectExpr("id * 50 AS pub", "id AS v")
    plan = asof(q, s, "at_us", "pub", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("longest, burst, odd", [(50, 10**6, False), (50, 10**6, True), (700, 10**6, False), (50, 3, True)])
def test_inflight_at_send(spark, monkeypatch, longest, burst, odd):
    from dnslens.operators import telemetry

    monkeypatch.setattr(telemetry, "MAX_BURST", burst)
    rng = random.Random(longest + burst)
    data = []
    for i in range(400):
        t = rng.choice([0, 100, 199, rng.randrange(-150, 1500)])
        recv = rng.choice([None, t, t + rng.randrange(longest)])
        data.append((i, rng.randrange(2), rng.choice(["a", "b", None]), t, recv, t + longest))
    if odd:
        data += [(400, None, "a", 5, 6, 7), (401, 0, "a", None, None, None), (401, 0, "a", None, None, None)]
    done = spark.createDataFrame(data, "query_id long, worker_id int, backend string, send_us long, recv_us long, deadline_us long")
    got = telemetry.inflight_at_send(done, ["a", "b", "c"], cell_us=100).collect()
    assert sorted(str(tuple(r[c] for c in done.columns)) for r in got) == sorted(map(str, data))
    for r in got:
        if r.worker_id is None or r.send_us is None:
            assert r.inflight is None
            continue
        mine = [(b, s, e if e is not None else x) for _, w, b, s, e, x in data if w == r.worker_id and s is not None]
        for b in "abc":
            assert r.inflight[b] == sum(n == b and s < r.send_us for n, s, _ in mine) - sum(n == b and e < r.send_us for n, _, e in mine)
