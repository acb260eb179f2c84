"""Registered queries: windows, scoring, policies, health and rate limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dnslens.operators import asof, choice, correlate, health, learning, policies, prepare, ratelimit, scoring, telemetry
from dnslens.plans import views as v
from dnslens.plans.fragments import bucket_walk_sql, health_walk_sql, sql, uniform_sql
from dnslens.plans.registry import query

HOUR, BIN = v.HOUR, v.BIN
NAMES = [b[0] for b in v.BACKENDS]
U1, U2 = uniform_sql(7, "query_id", 1), uniform_sql(7, "query_id", 2)


def _matched(spark, sf):
    """Attempts with their responses, stored: snapshots and inflight counts both start from them, and it is the largest join."""
    done = correlate.outcomes(v.attempts(spark, sf), v.responses(spark, sf))
    return v.stored(done.select("query_id", "worker_id", "backend", "send_us", "recv_us", "deadline_us", "rcode", "latency_us"))


def _queries(spark, sf, done, snap, adv=None):
    """Queries with region, the snapshot (and advice) in force and their worker's inflight map.

    The lookups run on the narrow log; the inflight counts are joined afterwards.
    """
    q = v.queries_with_region(spark, sf).select("query_id", "arrival_us", "worker_id", "region")
    q = asof.asof_snapshot(q, snap)
    if adv is not None:
        # Advice belongs to the query id: where ids repeat, each row meets the advice of every row of its id.
        q = asof.asof_advice(q, adv).filter("query_id IS NOT NULL")
        mates = F.collect_list(F.struct("advice_issued_us")).over(Window.partitionBy("query_id"))
        q = q.withColumn("mates", mates).selectExpr(*[c for c in q.columns if c != "advice_issued_us"], "inline(mates)")
    load = telemetry.inflight_at_send(done, NAMES).select("query_id", "inflight")
    return q.join(load, "query_id")


# -- window functions -----------------------------------------------------------------------


@query("w1_cursor", sql("ql", "SELECT query_id, row_number() OVER (PARTITION BY worker_id ORDER BY arrival_us, query_id) AS cursor FROM ql"))
def w1(spark, sf):
    log = v.query_log(spark, sf).select("query_id", "worker_id", "arrival_us")
    return policies.cursor(log).select("query_id", "cursor")


def _series(spark, sf):
    """Hourly mean latency per backend, in whole microseconds."""
    t = v.outcomes(spark, sf).filter("latency_us IS NOT NULL").selectExpr(
        "backend", f"send_us div {HOUR} * {HOUR} AS t_us", "latency_us"
    )
    return t.groupBy("backend", "t_us").agg(F.expr("sum(latency_us) div count(*)").cast("double").alias("x"))


_SERIES = f"SELECT backend, send_us // {HOUR} * {HOUR} AS t_us, (sum(latency_us) // count(*))::DOUBLE AS x FROM outc WHERE latency_us IS NOT NULL GROUP BY ALL"
_CHAIN = (
    "SELECT backend, t_us, x, row_number() OVER (PARTITION BY backend ORDER BY t_us) AS rn, "
    "t_us - lag(t_us) OVER (PARTITION BY backend ORDER BY t_us) AS gap FROM series"
)
_TAU = 2 * HOUR


@query(
    "w3_ewma",
    sql("outc", "@", series=_SERIES, chain=_CHAIN)
    .replace("WITH ", "WITH RECURSIVE ", 1)
    .replace(
        " @",
        ", e AS (SELECT backend, t_us, rn, x AS v FROM chain WHERE rn = 1 UNION ALL "
        f"SELECT c.backend, c.t_us, c.rn, e.v * exp(-c.gap / {_TAU}.0::DOUBLE) + c.x * (1 - exp(-c.gap / {_TAU}.0::DOUBLE)) FROM e JOIN chain c ON c.backend = e.backend AND c.rn = e.rn + 1) "
        "SELECT backend, t_us, round(v, 4) AS ewma FROM e",
    ),
)
def w3(spark, sf):
    return telemetry.ewma(_series(spark, sf), ["backend"], "x", _TAU).select("backend", "t_us", F.round("ewma", 4).alias("ewma"))


@query(
    "w4_peak_ewma",
    sql("outc", "@", series=_SERIES, chain=_CHAIN)
    .replace("WITH ", "WITH RECURSIVE ", 1)
    .replace(
        " @",
        ", e AS (SELECT backend, t_us, rn, x AS v FROM chain WHERE rn = 1 UNION ALL SELECT backend, t_us, rn, v * keep + x * (1 - keep) FROM ("
        f"SELECT c.backend, c.t_us, c.rn, c.x, e.v, exp(-c.gap / CASE WHEN c.x > e.v THEN {HOUR}.0::DOUBLE ELSE {4 * HOUR}.0::DOUBLE END) AS keep FROM e JOIN chain c ON c.backend = e.backend AND c.rn = e.rn + 1)) "
        "SELECT backend, t_us, round(v, 4) AS peak_ewma FROM e",
    ),
)
def w4(spark, sf):
    t = telemetry.peak_ewma(_series(spark, sf), ["backend"], "x", HOUR, 4 * HOUR)
    return t.select("backend", "t_us", F.round("peak_ewma", 4).alias("peak_ewma"))


@query(
    "w5_minmax",
    sql(
        "elig",
        "SELECT version, region, backend, round(CASE WHEN hi > lo THEN (ewma_us - lo) / (hi - lo) ELSE 0.0 END, 6) AS n_ewma_us FROM ("
        "SELECT *, min(ewma_us) OVER w AS lo, max(ewma_us) OVER w AS hi FROM elig WINDOW w AS (PARTITION BY version, region))",
    ),
)
def w5(spark, sf):
    t = scoring.minmax(prepare.eligible(v.snapshots(spark, sf)), ["ewma_us"], ["version", "region"])
    return t.select("version", "region", "backend", F.round("n_ewma_us", 6).alias("n_ewma_us"))


@query(
    "w6_softmax",
    sql(
        "elig",
        "SELECT version, region, backend, round(e / sum(e) OVER (PARTITION BY version, region), 6) AS p FROM ("
        "SELECT *, exp(-(weight + ewma_us / 100000) / 0.7) AS e FROM elig)",
    ),
)
def w6(spark, sf):
    t = prepare.eligible(v.snapshots(spark, sf)).withColumn("s", F.col("weight") + F.col("ewma_us") / 100000)
    return scoring.softmax(t, "s", 0.7, ["version", "region"], "p").select("version", "region", "backend", F.round("p", 6).alias("p"))


_RATES = f"SELECT send_us // {HOUR} * {HOUR} AS window_us, backend, count(*) AS n, count(*) FILTER (outcome <> 'ok') AS bad FROM outc GROUP BY ALL"


def _bad_windows(spark, sf):
    t = v.outcomes(spark, sf).selectExpr(f"send_us div {HOUR} * {HOUR} AS window_us", "backend", "outcome")
    return t.groupBy("window_us", "backend").agg(
        F.count("*").alias("n"), F.count_if(F.col("outcome") != "ok").alias("bad")
    )


@query(
    "w7_run_length",
    sql(
        "outc",
        "SELECT window_us, backend, CASE WHEN p THEN count(*) OVER (PARTITION BY backend, grp ORDER BY window_us) - CASE WHEN grp > 0 THEN 1 ELSE 0 END ELSE 0 END AS run FROM ("
        "SELECT *, sum(CASE WHEN p THEN 0 ELSE 1 END) OVER (PARTITION BY backend ORDER BY window_us) AS grp FROM (SELECT *, bad * 5 > n AS p FROM rates))",
        rates=_RATES,
    ),
)
def w7(spark, sf):
    t = health.run_length(_bad_windows(spark, sf), F.expr("bad * 5 > n"), ["backend"], cell_us=24 * HOUR)
    return t.select("window_us", "backend", "run")


#: The backend that a second attempt goes to: the next one.
_NEXT = "CASE backend " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(NAMES, [*NAMES[1:], NAMES[0]])) + " END"
_RETRIED = (
    "SELECT query_id, 1 AS attempt_no, backend, send_us FROM att UNION ALL SELECT query_id, 2, backend_next, deadline_us FROM ("
    f"SELECT a.*, {_NEXT} AS backend_next "
    "FROM outc a WHERE recv_us IS NULL)"
)


@query(
    "w8_failovers",
    sql(
        "outc att",
        'SELECT "from", "to", count(*) AS n FROM (SELECT lag(backend) OVER (PARTITION BY query_id ORDER BY attempt_no) AS "from", backend AS "to" FROM r) WHERE "from" <> "to" GROUP BY ALL',
        r=_RETRIED,
    ),
)
def w8(spark, sf):
    from dnslens.operators.experiments import failovers

    done = v.outcomes(spark, sf)
    second = done.filter("recv_us IS NULL").selectExpr("query_id", "2 AS attempt_no", f"{_NEXT} AS backend")
    both = done.select("query_id", "attempt_no", "backend").unionByName(second)
    return failovers(both)


@query(
    "w13_cap_ejections",
    sql(
        "outc",
        "SELECT window_us, backend, cand AND rk <= floor(c * 50 / 100) AS ejected FROM (SELECT *, count(*) OVER (PARTITION BY window_us) AS c, "
        "row_number() OVER (PARTITION BY window_us ORDER BY cand DESC, bad / n DESC, backend) AS rk FROM (SELECT *, bad * 5 > n AS cand FROM rates))",
        rates=_RATES,
    ),
)
def w13(spark, sf):
    t = _bad_windows(spark, sf).withColumn("candidate", F.expr("bad * 5 > n")).withColumn("severity", F.col("bad") / F.col("n"))
    return health.cap_ejections(t, 50).select("window_us", "backend", "ejected")


@query("w14_panic", sql("usable", "SELECT version, region, backend, panic FROM usable"))
def w14(spark, sf):
    return prepare.panic(v.snapshots(spark, sf), "fail_open").select("version", "region", "backend", "panic")


@query(
    "w15_features",
    sql(
        "outc",
        "SELECT backend, t_us, x, lag(x, 1) OVER w AS lag_1, lag(x, 3) OVER w AS lag_3, round(avg(x) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 4) AS avg_6, "
        "max(x) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS max_6 FROM series WINDOW w AS (PARTITION BY backend ORDER BY t_us)",
        series=_SERIES,
    ),
)
def w15(spark, sf):
    from dnslens.operators.learning import features

    t = features(_series(spark, sf), ["backend"], "x", lags=(1, 3), spans=(6,), cell_us=24 * HOUR)
    return t.select("backend", "t_us", "x", "lag_1", "lag_3", F.round("avg_6", 4).alias("avg_6"), "max_6")


@query(
    "w16_m_of_m",
    sql(
        "outc",
        "SELECT window_us, backend, bool_and(bad * 5 > n) OVER w AND count(*) OVER w = 3 AS held FROM rates "
        "WINDOW w AS (PARTITION BY backend ORDER BY window_us ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
        rates=_RATES,
    ),
)
def w16(spark, sf):
    t = health.m_of_m(_bad_windows(spark, sf), F.expr("bad * 5 > n"), 3, ["backend"], cell_us=24 * HOUR)
    return t.select("window_us", "backend", "held")


# -- policies ---------------------------------------------------------------------------------

_LOAD = (
    "SELECT worker_id, t_us, " + ", ".join(
        f"sum(sum(d) FILTER (backend = '{b}')) OVER (PARTITION BY worker_id ORDER BY t_us) AS s{i}, coalesce(sum(d) FILTER (backend = '{b}'), 0) AS d{i}"
        for i, b in enumerate(NAMES)
    )
    + " FROM (SELECT worker_id, backend, send_us AS t_us, 1 AS d FROM outc UNION ALL SELECT worker_id, backend, coalesce(recv_us, deadline_us), -1 FROM outc) GROUP BY worker_id, t_us"
)
_LOADS = "SELECT worker_id, t_us, unnest([" + ", ".join(f"{{'backend': '{b}', 'load': CAST(coalesce(s{i}, 0) - d{i} AS BIGINT)}}" for i, b in enumerate(NAMES)) + "], recursive := true) FROM load"


def _weighted(weight: str, source: str = "usable") -> str:
    return (
        f"SELECT version, region, backend, sum(w) OVER (PARTITION BY version, region ORDER BY backend) AS cum, sum(w) OVER (PARTITION BY version, region) AS total "
        f"FROM (SELECT *, {weight} AS w FROM {source})"
    )


def _draw(u: str, table: str = "c", cond: str = "") -> str:
    return f"(SELECT min(backend) FROM {table} c WHERE c.version = q.version AND c.region = q.region{cond} AND c.cum > {u} * c.total)"


_LESS = (
    "SELECT query_id, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN la < lb OR (la = lb AND a <= b) THEN a ELSE b END AS pick FROM ("
    "SELECT p.*, x.load AS la, y.load AS lb FROM p LEFT JOIN loads x ON x.worker_id = p.worker_id AND x.t_us = p.arrival_us AND x.backend = p.a "
    "LEFT JOIN loads y ON y.worker_id = p.worker_id AND y.t_us = p.arrival_us AND y.backend = p.b)"
)


def _replay(policy, spark, sf):
    done = _matched(spark, sf) if policy.name in ("least_inflight", "latency_based") else None
    snap = v.stored(v.snapshots(spark, sf, done=done))
    q = v.queries_with_region(spark, sf).select("query_id", "arrival_us", "worker_id", "region")
    if done is not None:
        q = _queries(spark, sf, done, snap)
    return policy.assign(q, snap).select("query_id", "pick")


@query(
    "r_rr_round_robin",
    sql(
        "qv usable",
        "SELECT query_id, (SELECT backend FROM p WHERE p.version = q.version AND p.region = q.region AND p.no = q.rn0) AS pick FROM "
        "(SELECT r.*, r.rn % nullif(k.n, 0) AS rn0 FROM (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY arrival_us, query_id) - 1 AS rn FROM qv) r LEFT JOIN (SELECT version, region, count(*) AS n FROM usable GROUP BY ALL) k USING (version, region)) q",
        p="SELECT *, row_number() OVER (PARTITION BY version, region ORDER BY backend) - 1 AS no FROM usable",
    ),
)
def r_rr(spark, sf):
    return _replay(policies.make("round_robin"), spark, sf)


@query("r_wt_weighted", sql("qv usable", f"SELECT query_id, {_draw('u')} AS pick FROM (SELECT *, {U1} AS u FROM qv) q", c=_weighted("weight")))
def r_wt(spark, sf):
    return _replay(policies.make("weighted"), spark, sf)


_SCAN = (
    "SELECT q.query_id, (SELECT arg_min(l.backend, (l.load, l.backend)) FROM loads l JOIN usable u ON u.backend = l.backend "
    "WHERE l.worker_id = q.worker_id AND l.t_us = q.arrival_us AND u.version = q.version AND u.region = q.region) AS pick FROM qv q"
)


@query("r_li_least_inflight", sql("outc qv usable", _SCAN, load=_LOAD, loads=_LOADS))
def r_li(spark, sf):
    return _replay(policies.make("least_inflight"), spark, sf)


@query(
    "t2_power_of_two",
    sql(
        "outc qv elig",
        _LESS,
        load=_LOAD,
        loads=_LOADS,
        pool="SELECT *, row_number() OVER (PARTITION BY version, region ORDER BY backend) - 1 AS no, count(*) OVER (PARTITION BY version, region) AS pn FROM elig",
        d=f"SELECT q.*, s.pn, floor({U1} * s.pn)::BIGINT AS i, (floor({U1} * s.pn)::BIGINT + 1 + floor({U2} * (s.pn - 1))::BIGINT) % nullif(s.pn, 0) AS j FROM qv q LEFT JOIN (SELECT DISTINCT version, region, pn FROM pool) s USING (version, region)",
        p="SELECT d.*, x.backend AS a, y.backend AS b FROM d LEFT JOIN pool x ON x.version = d.version AND x.region = d.region AND x.no = d.i "
        "LEFT JOIN pool y ON y.version = d.version AND y.region = d.region AND y.no = d.j",
    ),
)
def t2(spark, sf):
    done = _matched(spark, sf)
    snap = v.stored(v.snapshots(spark, sf, done=done))
    q = _queries(spark, sf, done, snap)
    return choice.p2c(q, prepare.eligible(snap), 7, full_scan_max=0).select("query_id", "pick")


@query(
    "r_lb_latency_based",
    sql(
        "outc qv usable",
        _LESS,
        load=_LOAD,
        loads=_LOADS,
        c=_weighted("1.0 / greatest(ewma_us, 1.0)"),
        p=f"SELECT q.*, {_draw(U1)} AS a, {_draw(U2)} AS b FROM qv q",
    ),
)
def r_lb(spark, sf):
    return _replay(policies.make("latency_based"), spark, sf)


@query(
    "r_geo_aware",
    sql(
        "qv usable affinity",
        "SELECT q.query_id, g.backend AS pick FROM qv q LEFT JOIN g USING (version, region)",
        g="SELECT version, region, arg_min(backend, (tier, ewma_us, backend)) AS backend FROM usable JOIN affinity USING (region, site) GROUP BY 1, 2",
    ),
)
def r_geo(spark, sf):
    return _replay(policies.make("geo_aware", affinity=v.affinity(spark)), spark, sf)


_FACTOR = "CASE health WHEN 'HEALTHY' THEN 1.0 WHEN 'DEGRADED' THEN 0.25 WHEN 'RECOVERING' THEN 0.1 ELSE 0.0 END::DOUBLE"


@query(
    "r_ha_health_aware",
    sql("qv usable", f"SELECT query_id, CASE WHEN {_draw('u')} IS NOT NULL THEN {_draw('u')} END AS pick FROM (SELECT *, {U1} AS u FROM qv) q", c=_weighted(f"weight * {_FACTOR}")),
)
def r_ha(spark, sf):
    return _replay(policies.make("health_aware"), spark, sf)


@query(
    "r_ad_adaptive",
    sql(
        "outc qv usable advice",
        _LESS,
        load=_LOAD,
        loads=_LOADS,
        q2="SELECT q.*, CASE WHEN q.arrival_us < a.issued_us + a.ttl_us THEN a.issued_us END AS issued FROM qv q ASOF LEFT JOIN "
        "(SELECT DISTINCT region, issued_us, ttl_us FROM advice) a ON q.region = a.region AND q.arrival_us >= a.issued_us",
        c=_weighted(f"1.0 / greatest(ewma_us, 1.0) * {_FACTOR}"),
        pairs="SELECT DISTINCT version, region, issued FROM q2 WHERE issued IS NOT NULL AND version IS NOT NULL",
        adv="SELECT p.version, p.region, p.issued, u.backend, sum(a.advice_weight) OVER w AS cum, sum(a.advice_weight) OVER (PARTITION BY p.version, p.region, p.issued) AS total "
        "FROM pairs p JOIN usable u ON u.version = p.version AND u.region = p.region JOIN advice a ON a.issued_us = p.issued AND a.region = p.region AND a.backend = u.backend "
        "WINDOW w AS (PARTITION BY p.version, p.region, p.issued ORDER BY u.backend)",
        p=f"SELECT q.*, CASE WHEN k.n > 0 THEN {_draw(U1, 'adv', ' AND c.issued = q.issued')} ELSE {_draw(U1)} END AS a, "
        f"CASE WHEN k.n > 0 THEN {_draw(U2, 'adv', ' AND c.issued = q.issued')} ELSE {_draw(U2)} END AS b "
        "FROM q2 q LEFT JOIN (SELECT version, region, issued, count(*) AS n FROM adv GROUP BY ALL) k ON k.version = q.version AND k.region = q.region AND k.issued = q.issued",
    ),
)
def r_ad(spark, sf):
    done = _matched(spark, sf)
    snap = v.stored(v.snapshots(spark, sf, done=done))
    adv = v.advice(spark, sf, snap=snap)
    policy = policies.make("adaptive", advice=adv)
    return policy.assign(_queries(spark, sf, done, snap, adv), snap).select("query_id", "pick")


@query(
    "r_sw_switching",
    sql(
        "qv usable affinity",
        f"SELECT q.query_id, CASE q.version % 2 WHEN 0 THEN {_draw('u')} ELSE g.backend END AS pick FROM (SELECT *, {U1} AS u FROM qv) q LEFT JOIN g USING (version, region)",
        c=_weighted("weight"),
        g="SELECT version, region, arg_min(backend, (tier, ewma_us, backend)) AS backend FROM usable JOIN affinity USING (region, site) GROUP BY 1, 2",
    ),
)
def r_sw(spark, sf):
    snap = v.stored(v.snapshots(spark, sf)).withColumn("policy", F.expr("CASE WHEN version % 2 = 0 THEN 'weighted' ELSE 'geo_aware' END"))
    q = v.queries_with_region(spark, sf).select("query_id", "arrival_us", "worker_id", "region")
    both = (policies.make("weighted"), policies.make("geo_aware", affinity=v.affinity(spark)))
    return policies.make("switching", policies=both).assign(q, snap).select("query_id", "pick")


@query(
    "a9_decision_share",
    sql(
        "qv usable backends",
        "SELECT d.backend, d.n AS decisions, round(d.n / sum(d.n) OVER (), 6) AS share, round(sum(pow(d.n - d.e, 2) / d.e) OVER (), 4) AS chi2 FROM ("
        "SELECT p.backend, p.n, sum(p.n) OVER () * b.weight / sum(b.weight) OVER () AS e FROM (SELECT pick AS backend, count(*) AS n FROM picks WHERE pick IS NOT NULL GROUP BY 1) p JOIN backends b USING (backend)) d",
        c=_weighted("weight"),
        picks=f"SELECT query_id, {_draw('u')} AS pick FROM (SELECT *, {U1} AS u FROM qv) q",
    ),
)
def a9(spark, sf):
    picks = r_wt(spark, sf).filter("pick IS NOT NULL").selectExpr("'weighted' AS policy", "pick AS backend")
    t = telemetry.decision_share(picks, v.backends(spark))
    return t.select("backend", "decisions", F.round("share", 6).alias("share"), F.round("chi2", 4).alias("chi2"))


# -- scoring ------------------------------------------------------------------------------------


def _scored(spark, sf, snap=None):
    snap = (v.snapshots(spark, sf) if snap is None else snap).join(v.affinity(spark).select("region", "site", "geo_distance"), ["region", "site"])
    risk = scoring.failure_risk(snap, ["region", "backend"], "version", 20, cell=64)
    return prepare.eligible(risk).selectExpr(
        "*", f"n / {BIN / 1e6}D AS qps", "weight * 1000 AS capacity", "CASE WHEN n > 0 THEN bad / n ELSE 0.0D END AS error_rate",
        "0.0D AS timeout_rate", "n AS inflight",
    )


def _score_sql(latency: str, source: str = "risk", **more: str) -> str:
    cols = {"latency": latency, "load": f"n / {BIN / 1e6} / (weight * 1000)", "error": "CASE WHEN n > 0 THEN bad / n ELSE 0.0 END", "geo": "geo_distance", "queue": "n"}
    bounds = ", ".join(f"min({c}) OVER w AS lo_{c}, max({c}) OVER w AS hi_{c}" for c in cols)
    total = " + ".join(f"CASE WHEN hi_{c} > lo_{c} THEN ({c} - lo_{c}) / (hi_{c} - lo_{c}) ELSE 0.0 END" for c in cols)
    return sql(
        "snap affinity",
        "SELECT version, region, backend, round(score, 6) AS score, round(exp(-score / 0.2) / sum(exp(-score / 0.2)) OVER (PARTITION BY version, region), 6) AS score_weight FROM scored",
        risk="SELECT s.*, a.geo_distance, avg((health <> 'HEALTHY')::INTEGER) OVER (PARTITION BY s.region, backend ORDER BY version ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS risk FROM snap s JOIN affinity a ON a.region = s.region AND a.site = s.site",
        **more,
        terms="SELECT version, region, backend, risk, " + ", ".join(f"({e})::DOUBLE AS {c}" for c, e in cols.items()) + f" FROM {source} WHERE health <> 'UNHEALTHY'",
        ranges=f"SELECT *, {bounds} FROM terms WINDOW w AS (PARTITION BY version, region)",
        scored=f"SELECT version, region, backend, risk + {total} AS score FROM ranges",
    )


@query("r_score_adaptive", _score_sql("ewma_us"))
def r_score(spark, sf):
    t = scoring.adaptive_score(_scored(spark, sf))
    return t.select("version", "region", "backend", F.round("score", 6).alias("score"), F.round("score_weight", 6).alias("score_weight"))


# Predictions come out with every other snapshot, so a score mostly finds one by as-of, not beside it.
@query(
    "r_est_model_estimator",
    _score_sql(
        "predicted_us",
        "estimated",
        means="SELECT version, region, backend, published_us AS issued_us, avg(ewma_us) OVER (PARTITION BY region, backend ORDER BY version ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mean_us FROM snap",
        estimated="SELECT r.*, coalesce(p.mean_us, r.ewma_us) AS predicted_us FROM risk r ASOF LEFT JOIN (SELECT * FROM means WHERE version % 2 = 0) p ON r.region = p.region AND r.backend = p.backend AND r.published_us >= p.issued_us",
    ),
)
def r_est(spark, sf):
    keys = ["region", "backend"]
    snap = v.stored(v.snapshots(spark, sf))
    means = learning.TrailingMean(keys, "ewma_us", "version", cell=64).predict(snap.select(*keys, "version", "published_us", "ewma_us"))
    published = means.filter("version % 2 = 0").withColumnRenamed("published_us", "issued_us")
    rows = learning.with_estimates(_scored(spark, sf, snap), published, keys, "published_us", "issued_us", "ewma_us", cell_us=64 * BIN)
    t = scoring.adaptive_score(rows, estimator="model")
    return t.select("version", "region", "backend", F.round("score", 6).alias("score"), F.round("score_weight", 6).alias("score_weight"))


def _smoothed_sql(beta: float = 0.3, cap: float = 0.1) -> str:
    """One region's ticks in order, each a list by backend; the walk carries the list of the tick before."""
    blended = f"{beta} * x.w + (1 - {beta}) * list_filter(k.st, lambda y: y.b = x.b)[1].w"
    before = "list_filter(k.st, lambda y: y.b = x.b)[1].w"
    step = f"list_transform(a.ws, lambda x: {{'b': x.b, 'w': CASE WHEN {before} IS NULL THEN x.w ELSE least(greatest({blended}, {before} - {cap}), {before} + {cap}) END}})"
    share = "list_transform({0}, lambda z: {{'b': z.b, 'w': CASE WHEN list_sum(list_transform({0}, lambda o: o.w)) > 0 THEN z.w / list_sum(list_transform({0}, lambda o: o.w)) ELSE 1.0 / len({0}) END}})"
    return (
        f"WITH RECURSIVE s AS ({_score_sql('ewma_us')}), "
        f"ticks AS (SELECT region, version * {BIN} AS t_us, row_number() OVER (PARTITION BY region ORDER BY version) AS n, "
        "list({'b': backend, 'w': score_weight} ORDER BY backend) AS ws FROM s GROUP BY region, version), "
        f"walk AS (SELECT region, t_us, n, {share.format('ws')} AS st FROM ticks WHERE n = 1 "
        f"UNION ALL SELECT region, t_us, n, {share.format('moved')} FROM (SELECT a.region, a.t_us, a.n, {step} AS moved "
        "FROM walk k JOIN ticks a ON a.region = k.region AND a.n = k.n + 1)) "
        "SELECT region, t_us, e.b AS backend, round(e.w, 6) AS smoothed FROM (SELECT region, t_us, unnest(st) AS e FROM walk)"
    )


@query("w12_smooth", _smoothed_sql())
def w12(spark, sf):
    ticks = r_score(spark, sf).selectExpr("region", f"version * {BIN} AS t_us", "backend", "score_weight AS weight")
    return scoring.smooth(ticks, chunk_us=60 * BIN).select("region", "t_us", "backend", F.round("smoothed", 6).alias("smoothed"))


# -- health and limits ---------------------------------------------------------------------------


def _health(spark, sf):
    rates = telemetry.window_rates(v.outcomes(spark, sf), HOUR, ["backend"]).select("window_us", "backend", "requests", "errors", "timeouts")
    signals = health.window_signals(v.probes(spark, sf), rates, HOUR)
    cfg = health.HealthConfig(
        degrade_threshold=0.2, eject_threshold=0.3, fail_threshold=2, cooldown_us=5 * HOUR, cooldown_cap_us=60 * HOUR
    )
    return health.health_fsm(signals, cfg, chunk_us=240 * HOUR)


#: The health machine once more as recursive SQL, window by window.
_HEALTH_SQL = sql(
    "outc probes", "SELECT * FROM walked",
    rated=f"SELECT send_us // {HOUR} * {HOUR} AS window_us, backend, count(*) AS requests, count(*) FILTER (outcome = 'error') AS errors, "
    "count(*) FILTER (outcome = 'timeout') AS timeouts FROM outc GROUP BY ALL",
    probed=f"SELECT t_us // {HOUR} * {HOUR} AS window_us, backend, count(*) AS probes, count(*) FILTER (NOT ok) AS failed FROM probes GROUP BY ALL",
    signals="SELECT window_us, backend, coalesce(requests, 0) AS requests, coalesce(errors, 0) AS errors, coalesce(timeouts, 0) AS timeouts, "
    "coalesce(probes, 0) AS probes, coalesce(failed, 0) AS failed FROM rated FULL JOIN probed USING (window_us, backend)",
    ranked="SELECT *, CASE WHEN requests > 0 THEN timeouts / requests ELSE 0 END AS severity, row_number() OVER (PARTITION BY window_us ORDER BY "
    "(CASE WHEN requests > 0 THEN timeouts / requests ELSE 0 END > 0.3) DESC, CASE WHEN requests > 0 THEN timeouts / requests ELSE 0 END DESC, backend) AS place, "
    "floor(count(*) OVER (PARTITION BY window_us) * 50 / 100) AS cap FROM signals",
    steps="SELECT backend, window_us, row_number() OVER (PARTITION BY backend ORDER BY window_us) AS n, requests > 0 AS traffic, "
    "requests > 0 AND (errors / requests > 0.2 OR timeouts / requests > 0.2) AS poor, requests > 0 AND timeouts / requests > 0.3 AS opened, "
    "severity > 0.3 AND place <= cap AS may_eject, probes, failed FROM ranked",
    walked=health_walk_sql(5 * HOUR, 60 * HOUR),
)

#: The token bucket once more as recursive SQL, bin by bin.
_BUCKET_SQL = sql(
    "ql",
    "SELECT query_id, place <= spent AS allowed, CASE WHEN place > spent THEN 'drop' END AS action FROM ("
    "SELECT *, row_number() OVER (PARTITION BY worker_id, prefix, bin ORDER BY arrival_us, query_id) AS place FROM binned) "
    "JOIN filled USING (worker_id, prefix, bin)",
    binned="SELECT *, client_lo - client_lo % 256 AS prefix, arrival_us // 60000000 AS bin FROM ql",
    steps="SELECT *, row_number() OVER (PARTITION BY worker_id, prefix ORDER BY bin) AS step FROM ("
    "SELECT worker_id, prefix, bin, count(*) AS n FROM binned GROUP BY ALL)",
    filled=bucket_walk_sql("1.0::DOUBLE / 3600.0::DOUBLE", 3, 60_000_000),
)


@query("h1_health_fsm", _HEALTH_SQL)
def h1(spark, sf):
    return _health(spark, sf)


@query(
    "h2_cooldown",
    f"SELECT backend, window_us, cooldown_us FROM ({_HEALTH_SQL}) WHERE reason = 'eject_again'",
)
def h2(spark, sf):
    return _health(spark, sf).filter("reason = 'eject_again'").select("backend", "window_us", "cooldown_us")


@query("r1_rate_limit", _BUCKET_SQL)
def r1(spark, sf):
    return ratelimit.rate_limit(v.query_log(spark, sf), 1 / 3600, 3, 60_000_000).select("query_id", "allowed", "action")


@query(
    "r2_limit_slack",
    sql(
        "ql",
        "SELECT prefix_lo, queries, workers, 5.0::DOUBLE AS configured_qps, 5.0::DOUBLE * workers AS effective_qps, round(peak / 3600.0, 9) AS observed_peak_qps FROM ("
        "SELECT prefix_lo, CAST(sum(n) AS BIGINT) AS queries, max(n) AS peak FROM (SELECT client_lo - client_lo % 256 AS prefix_lo, "
        f"arrival_us // {HOUR} AS bin, count(*) AS n FROM ql GROUP BY ALL) GROUP BY 1) JOIN (SELECT client_lo - client_lo % 256 AS prefix_lo, count(DISTINCT worker_id) AS workers FROM ql GROUP BY 1) USING (prefix_lo)",
    ),
)
def r2(spark, sf):
    t = ratelimit.limit_slack(v.query_log(spark, sf), 5.0, HOUR)
    octets = [f"cast(split_part(prefix, '.', {i}) AS BIGINT)" for i in (1, 2, 3)]
    return t.selectExpr(
        f"{octets[0]} * 16777216 + {octets[1]} * 65536 + {octets[2]} * 256 AS prefix_lo", "queries", "workers",
        "configured_qps", "effective_qps", "round(observed_peak_qps, 9) AS observed_peak_qps",
    )


