"""Invariants of policies, health, rate limits and correlation on small frames."""

import random
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dnslens.operators import choice, correlate, geo, health, learning, policies, prepare, ratelimit, scoring, telemetry
from dnslens.plans import views as v

POOL = [("a", 1.0), ("b", 2.0), ("c", 5.0)]


def snapshot(spark, health_of=None, ewma=None):
    rows = [
        (1, 0, "weighted", "r", b, "s", w, (ewma or {}).get(b, 1000.0), (health_of or {}).get(b, "HEALTHY"), i)
        for i, (b, w) in enumerate(POOL)
    ]
    return spark.createDataFrame(
        rows, "version long, published_us long, policy string, region string, backend string, site string, weight double, "
        "ewma_us double, health string, tier int"
    )


def log(spark, n=2000):
    df = spark.range(n).selectExpr(
        "id AS query_id", "id * 10 AS arrival_us", "cast(id % 2 AS INT) AS worker_id", "'r' AS region", "1L AS version"
    )
    return df.withColumn("inflight", F.expr("map('a', 3L, 'b', 1L, 'c', 2L)"))


def shares(df):
    rows = df.groupBy("pick").count().collect()
    total = sum(r["count"] for r in rows)
    return {r["pick"]: r["count"] / total for r in rows}


def test_weighted_follows_weights(spark):
    got = shares(policies.make("weighted").assign(log(spark, 8000), snapshot(spark)))
    for b, w in POOL:
        assert got[b] == pytest.approx(w / 8, abs=0.02)


def test_round_robin_is_even_per_worker(spark):
    picks = policies.make("round_robin").assign(log(spark, 600), snapshot(spark))
    counts = picks.groupBy("worker_id", "pick").count().collect()
    assert {r["count"] for r in counts} == {100}


def test_picks_do_not_depend_on_partitions(spark):
    p = policies.make("latency_based")
    a = p.assign(log(spark), snapshot(spark)).select("query_id", "pick")
    b = p.assign(log(spark).repartition(13, "arrival_us"), snapshot(spark)).select("query_id", "pick")
    assert a.exceptAll(b).count() == 0


@pytest.mark.parametrize("name", ["round_robin", "weighted", "least_inflight", "latency_based", "geo_aware", "health_aware"])
def test_picks_are_eligible(spark, name):
    snap = snapshot(spark, {"c": "UNHEALTHY"})
    got = shares(policies.make(name).assign(log(spark, 300), snap))
    assert set(got) <= {"a", "b"}
    blind = policies.make(name, enforce=False).assign(log(spark, 300), snap)
    assert blind.filter("pick IS NULL").count() == 0


def test_panic(spark):
    snap = snapshot(spark, dict.fromkeys("abc", "UNHEALTHY"))
    assert policies.make("weighted").assign(log(spark, 50), snap).filter("pick IS NULL").count() == 0
    closed = policies.make("weighted", panic_mode="fail_closed").assign(log(spark, 50), snap)
    assert closed.filter("pick IS NOT NULL").count() == 0


def test_least_inflight_scans_small_pools(spark):
    assert shares(policies.make("least_inflight").assign(log(spark, 100), snapshot(spark))) == {"b": 1.0}
    pairs = shares(policies.make("least_inflight", full_scan_max=0).assign(log(spark, 900), snapshot(spark)))
    assert set(pairs) == {"b", "c"} and pairs["b"] == pytest.approx(2 / 3, abs=0.06)


def test_geo_modes(spark):
    snap = snapshot(spark, ewma={"a": 900.0, "b": 500.0, "c": 100.0})
    assert shares(policies.make("geo_aware").assign(log(spark, 20), snap)) == {"a": 1.0}
    assert shares(policies.make("geo_aware", mode="latency_first").assign(log(spark, 20), snap)) == {"c": 1.0}


def test_adaptive_uses_advice_only_while_valid(spark):
    adv = spark.createDataFrame([(0, 10_000, "r", "a", 1.0)], "issued_us long, ttl_us long, region string, backend string, advice_weight double")
    out = policies.make("adaptive", advice=adv).assign(log(spark, 2000), snapshot(spark))
    early = out.filter("arrival_us < 10000")
    assert early.filter("source <> 'advice' OR pick <> 'a'").count() == 0
    assert out.filter("arrival_us >= 10000 AND source <> 'builtin'").count() == 0


@pytest.mark.parametrize("name", ["latency_based", "adaptive"])
def test_each_draw_is_made_once(spark, name):
    """A draw is a digest; written into every mention of the pick it took most of the time of the last stage."""
    adv = spark.createDataFrame([(0, 10_000, "r", "a", 1.0)], "issued_us long, ttl_us long, region string, backend string, advice_weight double")
    policy = policies.make(name, **({"advice": adv} if name == "adaptive" else {}))
    text = policy.assign(log(spark, 10), snapshot(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert 2 <= text.count("md5(") <= 4


def test_user_policy_can_be_registered(spark):
    class Last:
        name = "last"

        def assign(self, queries, snapshot):
            best = snapshot.groupBy("version", "region").agg(F.max("backend").alias("pick"))
            return queries.join(best, ["version", "region"])

    policies.register("last", Last)
    assert shares(policies.make("last").assign(log(spark, 10), snapshot(spark))) == {"c": 1.0}
    with pytest.raises(ValueError):
        policies.make("nope")


def test_longest_prefix_wins(spark):
    q = spark.createDataFrame(
        [(1, "v4", 0, 10 << 24), (2, "v4", 0, (10 << 24) + (1 << 16)), (3, "v4", 0, 5), (4, "v6", 0, 10 << 24)],
        "query_id long, client_family string, client_hi long, client_lo long",
    )
    nets = spark.createDataFrame([("wide", "10.0.0.0/8"), ("narrow", "10.1.0.0/16"), ("six", "2001:db8::/32"), ("bad", "x/1")], "region string, cidr string")
    want = {1: "wide", 2: "narrow", 3: None, 4: None}
    assert {r["query_id"]: r["region"] for r in geo.region_lpm(q, nets).collect()} == want


def test_correlation_edges(spark):
    a = spark.createDataFrame(
        [(1, 1, 0, "a", 5, 1, "h", 100, 200), (2, 1, 0, "a", 6, 2, "h", 100, 200), (3, 1, 0, "a", 5, 3, "h", 300, 400)],
        "query_id long, attempt_no int, worker_id int, backend string, upstream_txid int, generation long, question_hash string, send_us long, deadline_us long",
    )
    r = spark.createDataFrame(
        [
            (0, "a", 5, 1, "h", 200, "NOERROR", False), (0, "a", 5, 1, "h", 150, "NXDOMAIN", False), (0, "a", 5, 1, "h", 150, "NXDOMAIN", False),
            (0, "a", 6, 2, "h", 201, "NOERROR", False), (0, "a", 6, 9, "h", 150, "NOERROR", False), (0, "a", 7, 1, "h", 150, "NOERROR", False),
            (0, "a", 5, 3, "x", 350, "NOERROR", False), (0, "a", 5, 3, "h", 299, "NOERROR", False),
        ],
        "worker_id int, backend string, upstream_txid int, generation long, question_hash string, recv_us long, rcode string, tc boolean",
    )
    done = {x["query_id"]: (x["recv_us"], x["rcode"]) for x in correlate.outcomes(a, r).collect()}
    assert done == {1: (150, "NXDOMAIN"), 2: (None, None), 3: (None, None)}
    reasons = sorted((x["reason"], x["recv_us"], x["copies"]) for x in correlate.mismatches(a, r).collect())
    assert reasons == [
        ("duplicate", 150, 1), ("duplicate", 200, 1), ("early", 299, 1), ("generation", 150, 1), ("late", 201, 1),
        ("question", 350, 1), ("unknown_txid", 150, 1),
    ]


def test_softmax_and_smoothing(spark):
    t = spark.createDataFrame([("r", "a", 0.0), ("r", "b", 1.0), ("r", "c", 1.0)], "region string, backend string, s double")
    w = {r["backend"]: r["weight"] for r in scoring.softmax(t, "s", 0.5, ["region"]).collect()}
    assert sum(w.values()) == pytest.approx(1) and w["a"] > w["b"] == w["c"]
    rng = random.Random(0)
    ticks = []
    for i in range(120):
        x = rng.random()
        ticks += [("r", i, "a", x), ("r", i, "b", 1 - x)]
    df = spark.createDataFrame(ticks, "region string, t_us long, backend string, weight double")
    got = scoring.smooth(df, chunk_us=10).toPandas().sort_values(["t_us", "backend"])
    want, _ = scoring.smoothing_fold(0.3, 0.1, "t_us")(pd.DataFrame(ticks, columns=["region", "t_us", "backend", "weight"]), None)
    assert got["smoothed"].tolist() == pytest.approx(want["smoothed"].tolist(), abs=1e-9)
    assert got.groupby("t_us")["smoothed"].sum().tolist() == pytest.approx([1.0] * 120)


def signals(rng, n, backends="ab"):
    rows = []
    for b in backends:
        state = 0
        for i in range(n):
            state = rng.choice([0, 1, 2]) if rng.random() < 0.08 else state
            req = rng.choice([0, 20, 20])
            tmo = int(req * [0, 0.1, 0.8][state])
            probes = rng.choice([0, 1])
            rows.append((b, i * 1_000_000, req, 0, tmo, None, probes, probes if state == 2 else 0, True))
    return rows


COLUMNS = "backend string, window_us long, requests long, errors long, timeouts long, p95 double, probes long, probe_failures long"


def test_health_machine_equals_sequential(spark):
    cfg = health.HealthConfig(max_ejection_percent=100)
    rows = signals(random.Random(11), 900)
    df = spark.createDataFrame([r[:8] for r in rows], COLUMNS)
    got = health.health_fsm(df, cfg, chunk_us=60_000_000).toPandas()
    names = [c.split()[0] for c in COLUMNS.split(", ")] + ["may_eject"]
    seen = set()
    for b in "ab":
        part = pd.DataFrame([r for r in rows if r[0] == b], columns=names)
        part["p95"] = part["p95"].astype(float)
        part["may_eject"] = part["timeouts"] > 0.5 * part["requests"]
        want, _ = health.health_fold(cfg)(part, None)
        mine = got[got["backend"] == b].sort_values("window_us")
        assert mine["state"].tolist() == want["state"].tolist()
        assert mine["cooldown_us"].tolist() == want["cooldown_us"].tolist()
        seen |= set(want["reason"].dropna())
    assert {"timeout_rate", "cooldown_elapsed", "recovered"} <= seen


def machine(cfg, rows):
    names = ["backend", "window_us", "requests", "errors", "timeouts", "p95", "probes", "probe_failures", "may_eject"]
    out, _ = health.health_fold(cfg)(pd.DataFrame(rows, columns=names), None)
    return out


def test_health_paths():
    cfg = health.HealthConfig()
    s = 1_000_000

    def w(i, tmo=0, probes=0, fail=0, p95=float("nan"), req=100, may=True):
        return ("a", i * s, req, 0, tmo, p95, probes, fail, may)

    # Three bad windows degrade, five clean ones heal; empty windows do not count.
    rows = [w(0, 10), w(1, 10), w(2, req=0), w(3, 10)] + [w(4 + i) for i in range(5)]
    assert machine(cfg, rows)["state"].tolist() == ["HEALTHY"] * 3 + ["DEGRADED"] * 5 + ["HEALTHY"]
    # Slow answers degrade too.
    assert machine(cfg, [w(i, p95=300_000.0) for i in range(3)])["state"].tolist()[-1] == "DEGRADED"
    # Ejection, half-open, ejected again with twice the cooldown.
    rows = [w(0, 80), w(2, req=0, probes=2), w(5, req=0, probes=1), w(6, 80), w(12, req=0, probes=2), w(16, req=0, probes=1)]
    out = machine(cfg, rows)
    assert out["state"].tolist() == ["UNHEALTHY", "UNHEALTHY", "RECOVERING", "UNHEALTHY", "UNHEALTHY", "RECOVERING"]
    assert out["cooldown_us"].tolist()[-1] == 10 * s
    # The guard holds back passive ejection, not probe failures.
    assert machine(cfg, [w(0, 80, may=False)])["state"].tolist() == ["HEALTHY"]
    assert machine(cfg, [w(0, probes=3, fail=3, may=False)])["state"].tolist() == ["UNHEALTHY"]


def test_ejection_cap(spark):
    t = spark.createDataFrame([(0, b, True, s) for b, s in zip("abcd", (0.6, 0.9, 0.7, 0.8))], "window_us long, backend string, candidate boolean, severity double")
    got = {r["backend"] for r in health.cap_ejections(t, 50).filter("ejected").collect()}
    assert got == {"b", "d"}


@pytest.mark.parametrize("rate,burst", [(2.0, 5.0), (0.7, 3.0)])
def test_token_bucket(spark, rate, burst):
    rng = random.Random(8)
    rows = []
    for i in range(3000):
        flood = i % 3 == 0
        t = rng.randrange(0, 200_000_000) if not flood else rng.randrange(90_000_000, 140_000_000)
        rows.append((i, t, 0, "x" if flood else rng.choice("xy")))
    q = spark.createDataFrame(rows, "query_id long, arrival_us long, worker_id int, prefix string")
    got = ratelimit.rate_limit(q, rate, burst, 100_000, "refused").collect()
    assert len(got) == 3000
    by_key = defaultdict(list)
    for r in got:
        by_key[r["prefix"]].append((r["arrival_us"], r["query_id"], r["allowed"], r["action"]))
    for items in by_key.values():
        items.sort()
        counts = pd.Series([t // 100_000 for t, *_ in items]).value_counts().sort_index()
        want, _ = ratelimit.bucket_fold(rate, burst, 100_000)(pd.DataFrame({"bin": counts.index, "n": counts.values}), None)
        quota = dict(zip(want["bin"], want["allowed"]))
        used = defaultdict(int)
        for t, _, ok, action in items:
            used[t // 100_000] += 1
            assert ok == (used[t // 100_000] <= quota[t // 100_000])
            assert (action is None) == ok
        passed = [t for t, _, ok, _ in items if ok]
        for i in range(0, len(passed), 25):
            for j in range(i, len(passed), 25):
                assert j - i + 1 <= burst + rate * (passed[j] - passed[i] + 100_000) / 1e6 + 1e-6


def test_rate_limit_under_permanent_load_takes_few_jobs(spark):
    # One query a bin against a third of a token: the bucket is never full again, over many stretches of 1000 bins.
    q = spark.range(40_000).selectExpr("id AS query_id", "id * 50000 AS arrival_us", "0 AS worker_id", "concat('p', id % 2) AS prefix")
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    got = ratelimit.rate_limit(q, 10 / 3, 3.0, 100_000).groupBy("prefix").agg(F.count_if("allowed").alias("n")).collect()
    jobs = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before
    assert len(jobs) <= 16
    for r in got:
        want, _ = ratelimit.bucket_walk(10 / 3, 3.0, 100_000)(list(range(20_000)), [1] * 20_000, None)
        assert r["n"] == sum(want)


def test_rate_limit_of_flooded_bins_and_unknown_sources(spark, monkeypatch):
    rows = [(i, i % 7, 0, "x") for i in range(300)] + [(1000 + i, 100_000 + i, 0, "y") for i in range(20)]
    rows += [(2000, 5, None, "x"), (2001, 5, 0, None), (2002, None, 0, "x")]
    q = spark.createDataFrame(rows, "query_id long, arrival_us long, worker_id int, prefix string")
    calm = {r["query_id"]: (r["allowed"], r["action"]) for r in ratelimit.rate_limit(q, 1.0, 9.0, 100_000).collect()}
    monkeypatch.setattr(ratelimit, "BIN_ROWS", 50)
    got = {r["query_id"]: (r["allowed"], r["action"]) for r in ratelimit.rate_limit(q, 1.0, 9.0, 100_000).collect()}
    assert got == calm and len(got) == 323
    first = sorted((t, i) for i, t, _, p in rows[:300])[:9]
    assert {i for i, (ok, _) in got.items() if ok and i < 1000} == {i for _, i in first}
    assert sum(ok is True for i, (ok, _) in got.items() if 1000 <= i < 2000) == 9
    assert all(got[i] == (None, None) for i in (2000, 2001, 2002))


def test_histograms_merge(spark, sf_dir):
    done = v.outcomes(spark, sf_dir)
    direct = telemetry.histogram(done, "latency_us", ["backend"])
    merged = telemetry.merge_hist(telemetry.histogram(done, "latency_us", ["worker_id", "backend"]), ["backend"])
    assert direct.exceptAll(merged).count() == 0 == merged.exceptAll(direct).count()
    approx = {r["backend"]: r for r in telemetry.hist_percentiles(merged, ["backend"]).collect()}
    for r in telemetry.latency_summary(done, ["backend"], ps=(0.5, 0.95)).collect():
        assert approx[r["backend"]]["p50"] == pytest.approx(r["p50"], rel=0.06)


def test_privacy(spark, sf_dir):
    done = v.outcomes(spark, sf_dir)
    assert not {"qname", "client_lo"} & set(prepare.safe_labels(done).columns)
    with pytest.raises(ValueError):
        prepare.safe_labels(done, ("qname",))
    with pytest.raises(ValueError):
        telemetry.rollup_metrics(done, [("qname",)])


def test_levels(spark):
    t = spark.createDataFrame([(x,) for x in ("trace", "debug", "info", "warn", "error", "WARN", "loud")], "level string")
    assert {r[0] for r in prepare.filter_level(t, "info").collect()} == {"info", "warn", "error"}
    with pytest.raises(ValueError):
        prepare.filter_level(t, "loud")


def test_splits_keep_episodes_together(spark):
    t = spark.range(400).selectExpr("concat('e', id % 40) AS episode_id", "CASE WHEN id % 40 = 7 THEN 'new' ELSE 'old' END AS fault_type")
    s = learning.split_episodes(t, 3, held_out=("new",))
    assert s.groupBy("episode_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert s.filter("fault_type = 'new' AND split <> 'test'").count() == 0


def test_pick_arrays_agree(spark):
    q = spark.range(500).selectExpr("id AS query_id", "'r' AS region", "1L AS version")
    w = snapshot(spark)
    a = choice.weighted_pick(q, w, 7, ["version", "region"]).select("query_id", "pick")
    items = w.groupBy("version", "region").agg(F.array_sort(F.collect_list(F.struct("backend", F.col("weight").alias("w")))).alias("i"))
    u = choice.uniform(7, F.col("query_id"), 1)
    b = q.join(items, ["version", "region"]).select("query_id", choice.pick_by_scan(F.col("i"), u).alias("pick"))
    assert a.exceptAll(b).count() == 0


def test_region_lpm_replaces_a_region_and_keeps_rows(spark):
    from dnslens.operators.geo import region_lpm

    listed = [("a", "10.0.0.0/8"), ("b", "10.7.0.0/16"), ("d", "10.7.3.0/24"), ("c", "10.7.3.0/24"), ("all", "::/0"), ("one", "::9/128")]
    cidrs = spark.createDataFrame(listed, "region string, cidr string")
    rows = [
        (1, "old", "v4", 0, 0x0A070309), (1, "old", "v4", 0, 0x0A070309), (2, None, "v4", 0, 0x0A080000),
        (3, "old", "v4", 0, 0x0B000000), (4, "x", None, None, None), (5, "x", "v6", 0, 9), (6, "x", "v6", -1, -1),
    ]
    q = spark.createDataFrame(rows, "id int, region string, client_family string, client_hi long, client_lo long")
    out = region_lpm(q, cidrs)
    assert out.columns == ["id", "client_family", "client_hi", "client_lo", "region"]
    assert sorted((r.id, r.region or "") for r in out.collect()) == [(1, "c"), (1, "c"), (2, "a"), (3, ""), (4, ""), (5, "one"), (6, "all")]
    assert region_lpm(q, cidrs.filter("false")).filter("region IS NULL").count() == len(rows)


def test_bounds_are_rejected_not_applied_silently(spark):
    from dnslens.operators.correlate import retry_plan
    from dnslens.operators.scans import bounded_windows

    df = spark.createDataFrame([(1, 1)], "k int, t long")
    with pytest.raises(ValueError):
        retry_plan(df, df, max_attempts=3)
    with pytest.raises(ValueError):
        bounded_windows(df, ["k"], "t", 10, lambda w: {}, cell=10, chunk_rows=10)


@pytest.mark.parametrize("few", [True, False])
def test_nested_prefixes_against_brute_force(spark, monkeypatch, few):
    """Nested and adjoining prefixes of both families, edges of each, default routes, ends of the address space."""
    import ipaddress
    import random

    monkeypatch.setattr(geo, "MAX_PREFIXES", 10**6 if few else 0)
    rng = random.Random(11)
    nets = {(4, 0, 0): "v4 rest", (6, 0, 0): "v6 rest", (4, 1, 1 << 31): "upper half", (6, 1, 1 << 127): "upper six"}
    for k in range(1_500):
        version, width = (4, 32) if k % 2 else (6, 128)
        around = rng.choice([10 << 24, 0xFFFFFFFF, 0]) if version == 4 else rng.choice([0x20010DB8 << 96, (1 << 128) - 1, (1 << 127) - 1])
        plen = rng.choice([9, 15, 16, 17, 24, 32] if version == 4 else [17, 32, 47, 48, 49, 64, 127, 128])
        start = (around ^ rng.getrandbits(rng.choice([8, 16, 22] if version == 4 else [8, 60, 66, 80, 90]))) >> (width - plen) << (width - plen)
        nets[version, plen, start] = f"r{k}"
    listed = [(r, f"{(ipaddress.IPv4Address if v == 4 else ipaddress.IPv6Address)(a)}/{p}") for (v, p, a), r in nets.items()]
    asked = []
    for version, plen, start in nets:
        width = 32 if version == 4 else 128
        size = 1 << (width - plen)
        asked += [(version, a) for a in (start - 1, start, start + size // 2, start + size - 1, start + size) if 0 <= a < 1 << width]

    def brute(version, a):
        width = 32 if version == 4 else 128
        found = (nets.get((version, p, a >> (width - p) << (width - p))) for p in range(width, -1, -1))
        return next((r for r in found if r), None)

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    rows = [(i, f"v{v}", 0 if v == 4 else signed(a >> 64), a if v == 4 else signed(a & ((1 << 64) - 1))) for i, (v, a) in enumerate(asked)]
    q = spark.createDataFrame(rows, "id int, client_family string, client_hi long, client_lo long")
    got = {r.id: r.region for r in geo.region_lpm(q, spark.createDataFrame(listed, "region string, cidr string")).collect()}
    assert got == {i: brute(v, a) for i, (v, a) in enumerate(asked)}


def test_published_predictions_reach_the_score(spark, tmp_path):
    """Two predictors behind one writer; a batch written twice counts once; the score follows the estimator."""
    from dnslens.operators import scoring
    from dnslens.sources.sinks import prediction_writer

    rows = [("r", b, i, float(x)) for b, xs in (("a", (10, 20, 60, 70)), ("b", (90, 30, 30, 10))) for i, x in enumerate(xs)]
    t = spark.createDataFrame([*rows, ("r", "new", 3, 40.0)], "region string, backend string, at_us long, ewma_us double")
    t = t.withColumn("f_now", F.col("ewma_us")).withColumn("label", F.col("ewma_us") * 2).withColumn("split", F.lit("train"))
    keys = ["region", "backend"]
    mean = learning.TrailingMean(keys, "ewma_us", "at_us", cell=4)
    assert {(r.backend, r.at_us): r.predicted_us for r in mean.predict(t).collect()}["a", 3] == 50.0
    estimates = {}
    for name, predictor in (("mean", mean), ("fitted", learning.Fitted(learning.train(t, "linear", 1)))):
        write = prediction_writer(str(tmp_path / name), predictor, keys, "at_us")
        for batch in (0, 1, 1):
            write(t.filter(F.col("at_us") < 3 if batch == 0 else F.lit(False)), batch)
        told = spark.read.parquet(str(tmp_path / name)).drop("batch_id").withColumnRenamed("at_us", "issued_us")
        assert told.count() == 6
        now = t.filter("at_us = 3")
        got = learning.with_estimates(now, told, keys, "at_us", "issued_us", "ewma_us", cell_us=2)
        estimates[name] = {r.backend: r.predicted_us for r in got.collect()}
        assert estimates[name]["new"] == 40.0
    assert estimates["mean"] == {"a": 30.0, "b": 50.0, "new": 40.0}
    assert estimates["fitted"]["a"] > 100 > estimates["mean"]["a"]
    flat = got.selectExpr("*", "1L AS version", "1D AS qps", "1D AS capacity", "0D AS error_rate", "0D AS timeout_rate", "0D AS geo_distance", "0 AS inflight", "0D AS failure_risk")
    best = {e: scoring.adaptive_score(flat, estimator=e).orderBy("score").first().backend for e in ("ewma", "model")}
    assert best["ewma"] == "b" and best["model"] == "new"


def test_prefixes_listed_often_are_counted_once(spark, monkeypatch):
    monkeypatch.setattr(geo, "MAX_PREFIXES", 50)
    monkeypatch.setattr(geo, "_flat", None)
    cidrs = spark.range(400).selectExpr("concat('r', id % 20) AS region", "concat('10.', id % 20, '.0.0/16') AS cidr")
    q = spark.range(40).selectExpr("id AS query_id", "'v4' AS client_family", "0L AS client_hi", "167772160L + id * 65536 + 7 AS client_lo")
    got = {r["query_id"]: r["region"] for r in geo.region_lpm(q, cidrs).collect()}
    assert got == {i: f"r{i}" if i < 20 else None for i in range(40)}
