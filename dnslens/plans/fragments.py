"""The derived tables once more as plain SQL, for checking results in another engine."""

from __future__ import annotations

from dnslens.plans.views import AFFINITY, BACKENDS, BIN, CLIENT, POLICIES, REGION_CIDRS, REGIONS, SCENARIOS, TIMEOUT_US, ZONES

_BACKEND = "CASE k % 4 " + " ".join(f"WHEN {i} THEN '{b[0]}'" for i, b in enumerate(BACKENDS)) + " END"
_QTYPE = (
    "CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 28 WHEN 'signup' THEN 15 "
    "WHEN 'purchase' THEN 16 WHEN 'error' THEN 5 ELSE 1 END"
)
_QHASH = f"md5(concat_ws('/', lower(concat('q', k, '.example')), {_QTYPE}, 1))"


def _net(cidr: str) -> tuple[int, int]:
    address, plen = cidr.split("/")
    number = 0
    for part in address.split("."):
        number = number * 256 + int(part)
    return number, int(plen)


_CIDR_ROWS = ", ".join(f"('{r}', {_net(c)[0]}, {_net(c)[1]})" for r, c in REGION_CIDRS)
_AFFINITY_ROWS = ", ".join(f"('{r}', '{s}', {t}, {d}::DOUBLE)" for r, s, t, d in AFFINITY)
_BACKEND_ROWS = ", ".join(f"('{b}', {w}::DOUBLE, '{s}', {i})" for i, (b, w, s) in enumerate(BACKENDS))
_REGION_ROWS = ", ".join(f"('{r}')" for r in REGIONS)

#: name -> (names it needs, definition)
FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": (
        (),
        "SELECT event_id, epoch_us(ts) AS t_us, user_id, event_type, "
        "CAST(floor(value * 1000 + 0.5) AS BIGINT) AS lat_us, "
        "CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
    ),
    "ql": (
        ("ev",),
        "SELECT event_id AS query_id, t_us AS arrival_us, event_id % 2 AS worker_id, "
        f"CAST({CLIENT} AS BIGINT) AS client_lo, user_id, event_type, "
        f"concat('q', k, '.example') AS qname, {_QTYPE} AS qtype, {_QHASH} AS question_hash, k FROM ev",
    ),
    "cidrs": ((), f"SELECT * FROM (VALUES {_CIDR_ROWS}) v(region, net, plen)"),
    "affinity": ((), f"SELECT * FROM (VALUES {_AFFINITY_ROWS}) v(region, site, tier, geo_distance)"),
    "backends": ((), f"SELECT * FROM (VALUES {_BACKEND_ROWS}) v(backend, weight, site, i)"),
    "clients": (
        ("ql", "cidrs"),
        "SELECT c.client_lo, arg_max(d.region, d.plen) AS region FROM (SELECT DISTINCT client_lo FROM ql) c "
        "JOIN cidrs d ON c.client_lo >= d.net AND c.client_lo < d.net + (1::BIGINT << (32 - d.plen)) GROUP BY 1",
    ),
    "qr": (("ql", "clients"), "SELECT ql.*, region FROM ql LEFT JOIN clients USING (client_lo)"),
    "att": (
        ("ev",),
        "SELECT event_id AS query_id, 1 AS attempt_no, event_id % 2 AS worker_id, "
        f"{_BACKEND} AS backend, (event_id * 7919) % 65536 AS upstream_txid, event_id AS generation, "
        f"{_QHASH} AS question_hash, t_us AS send_us, t_us + {TIMEOUT_US} AS deadline_us FROM ev",
    ),
    "resp": (
        ("ev",),
        f"SELECT event_id % 2 AS worker_id, {_BACKEND} AS backend, "
        "(event_id * 7919 + CASE WHEN event_id % 89 = 0 THEN 1 ELSE 0 END) % 65536 AS upstream_txid, "
        "event_id + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS generation, "
        f"CASE WHEN event_id % 83 = 0 THEN 'other' ELSE {_QHASH} END AS question_hash, "
        "t_us + lat_us + c.d AS recv_us, "
        "CASE event_type WHEN 'error' THEN 'SERVFAIL' WHEN 'signup' THEN 'NXDOMAIN' ELSE 'NOERROR' END AS rcode "
        "FROM ev JOIN (VALUES (0), (500)) c(d) ON c.d = 0 OR event_id % 41 = 0 "
        f"WHERE lat_us <= {TIMEOUT_US} OR event_id % 3 = 0",
    ),
    "matched": (
        ("att", "resp"),
        "SELECT a.query_id, a.attempt_no, min(r.recv_us) AS recv_us, arg_min(r.rcode, r.recv_us) AS rcode "
        "FROM att a JOIN resp r USING (worker_id, backend, upstream_txid, generation, question_hash) "
        "WHERE r.recv_us BETWEEN a.send_us AND a.deadline_us GROUP BY 1, 2",
    ),
    "outc": (
        ("matched", "qr"),
        "SELECT a.*, m.recv_us, m.rcode, m.recv_us - a.send_us AS latency_us, q.region, q.client_lo, q.qname, "
        "CASE WHEN m.rcode IS NULL THEN 'timeout' WHEN m.rcode IN ('NOERROR', 'NXDOMAIN') THEN 'ok' "
        "ELSE 'error' END AS outcome, lower(m.rcode) AS rcode_class "
        "FROM att a LEFT JOIN matched m USING (query_id, attempt_no) JOIN qr q USING (query_id)",
    ),
    "snap": (
        ("outc", "backends"),
        f"SELECT b.bin AS version, (b.bin + 1) * {BIN} AS published_us, r.region, d.backend, d.site, d.weight, "
        "d.i, coalesce(o.lat_sum // nullif(o.lat_n, 0), 50000)::DOUBLE AS ewma_us, "
        "coalesce(o.n, 0) AS n, coalesce(o.bad, 0) AS bad, "
        "CASE WHEN o.n > 0 AND o.bad * 100 >= o.n * 45 THEN 'UNHEALTHY' "
        "WHEN o.n > 0 AND o.bad * 100 >= o.n * 25 THEN 'DEGRADED' "
        "WHEN (b.bin + d.i) % 11 = 0 THEN 'RECOVERING' ELSE 'HEALTHY' END AS health "
        f"FROM (SELECT DISTINCT send_us // {BIN} AS bin FROM outc) b "
        f"CROSS JOIN (VALUES {_REGION_ROWS}) r(region) CROSS JOIN backends d LEFT JOIN ("
        f"SELECT send_us // {BIN} AS bin, region, backend, count(*) AS n, "
        "count(*) FILTER (outcome IN ('timeout', 'error')) AS bad, "
        "CAST(sum(latency_us) AS BIGINT) AS lat_sum, count(latency_us) AS lat_n FROM outc GROUP BY ALL) o "
        "ON o.bin = b.bin AND o.region = r.region AND o.backend = d.backend",
    ),
    "elig": (("snap",), "SELECT * FROM snap WHERE health <> 'UNHEALTHY'"),
    "usable": (
        ("snap",),
        "SELECT * EXCLUDE (alive), alive = 0 AS panic FROM (SELECT *, "
        "count(*) FILTER (health <> 'UNHEALTHY') OVER (PARTITION BY version, region) AS alive FROM snap) "
        "WHERE health <> 'UNHEALTHY' OR alive = 0",
    ),
    "qv": (
        ("qr", "snap"),
        "SELECT q.*, s.version, s.published_us FROM qr q ASOF LEFT JOIN "
        "(SELECT DISTINCT version, published_us FROM snap) s ON q.arrival_us >= s.published_us",
    ),
    "advice": (
        ("snap",),
        f"SELECT published_us AS issued_us, {BIN}::BIGINT AS ttl_us, region, backend, "
        "round(10000.0 / ewma_us, 6) AS advice_weight FROM snap WHERE version % 2 = 0",
    ),
    "probes": (
        ("ev",),
        f"SELECT t_us, {_BACKEND} AS backend, lat_us AS rtt_us, event_type <> 'error' AS ok FROM ev "
        "WHERE event_id % 10 = 0",
    ),
    "counters": (
        ("ev",),
        "SELECT (bin + 1) * {bin} AS t_us, worker_id, backend, "
        "CAST(sum(n) OVER w AS BIGINT) AS queries, CAST(sum(tmo) OVER w AS BIGINT) AS timeouts FROM ("
        f"SELECT t_us // {{bin}} AS bin, event_id % 2 AS worker_id, {_BACKEND} AS backend, count(*) AS n, "
        f"count(*) FILTER (lat_us > {TIMEOUT_US}) AS tmo FROM ev GROUP BY ALL) "
        "WINDOW w AS (PARTITION BY worker_id, backend, bin // 40 ORDER BY bin)".replace("{bin}", str(BIN)),
    ),
    "samples": (
        ("ev",),
        "SELECT *, concat_ws('-', scenario, policy, rep) AS run_id FROM (SELECT "
        f"CASE event_id % 2 WHEN 0 THEN '{SCENARIOS[0]}' ELSE '{SCENARIOS[1]}' END AS scenario, "
        f"CASE (event_id // 2) % 2 WHEN 0 THEN '{POLICIES[0]}' ELSE '{POLICIES[1]}' END AS policy, "
        "(event_id // 4) % 5 AS rep, CASE WHEN (event_id // 4) % 5 = 4 THEN 'A' ELSE 'B' END AS mode, "
        "event_id AS seq, CASE user_id % 4 "
        + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(ZONES))
        + " END AS region, t_us AS intended_us, t_us + (event_id % 7) * 1000 AS send_us, "
        f"CASE WHEN lat_us <= {TIMEOUT_US} THEN t_us + (event_id % 7) * 1000 + lat_us END AS recv_us, "
        f"CASE WHEN lat_us > {TIMEOUT_US} THEN 'timeout' WHEN event_type = 'error' THEN 'fail' ELSE 'ok' END AS status, "
        f"{_BACKEND} AS backend, concat('q', k, '.example') AS qname, {_QTYPE} AS qtype, 40 + k * 5 AS packet_bytes "
        "FROM ev)",
    ),
    "runs": (
        ("samples",),
        "SELECT run_id, scenario, policy, rep, mode, min(intended_us) AS started_us, max(intended_us) AS ended_us, "
        "count(*) AS offered FROM samples GROUP BY ALL",
    ),
    "faults": (
        ("runs",),
        "SELECT 'f-' || run_id AS fault_id, run_id, scenario, policy, CASE rep % 4 "
        + " ".join(f"WHEN {i} THEN '{b[0]}'" for i, b in enumerate(BACKENDS))
        + " END AS backend, started_us + (ended_us - started_us) // 3 AS injected_us FROM runs",
    ),
}


def uniform_sql(seed: int, key: str, draw: int) -> str:
    """The seeded uniform number in SQL."""
    return f"(('0x' || substr(md5(concat_ws('/', '{seed}', {key}, '{draw}')), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def health_walk_sql(cooldown: int, cap: int) -> str:
    """The health machine over ``steps``, window by window."""
    return f"""
  SELECT backend, window_us, state, previous, reason, cooldown_us FROM (WITH RECURSIVE w AS (
    SELECT backend, 0::BIGINT AS n, NULL::BIGINT AS window_us, 'HEALTHY' AS state, 'HEALTHY' AS previous, NULL::VARCHAR AS reason,
      0::BIGINT AS bad, 0::BIGINT AS clean, 0::BIGINT AS fails, 0::BIGINT AS oks, NULL::BIGINT AS ejected, {cooldown}::BIGINT AS cooldown_us
    FROM (SELECT DISTINCT backend FROM steps)
    UNION ALL
    SELECT backend, n, window_us, CASE rule WHEN 0 THEN state WHEN 1 THEN 'RECOVERING' WHEN 3 THEN 'HEALTHY' WHEN 6 THEN 'DEGRADED'
        WHEN 7 THEN 'HEALTHY' ELSE 'UNHEALTHY' END, state,
      CASE rule WHEN 1 THEN 'cooldown_elapsed' WHEN 2 THEN 'eject_again' WHEN 3 THEN 'recovered' WHEN 4 THEN 'probe_failures'
        WHEN 5 THEN 'timeout_rate' WHEN 6 THEN 'degraded_windows' WHEN 7 THEN 'clean_windows' END,
      CASE WHEN rule = 3 THEN 0 ELSE bad END, CASE WHEN rule = 1 THEN 0 ELSE clean END, fails,
      CASE WHEN rule IN (2, 4, 5) THEN 0 ELSE oks END, CASE WHEN rule IN (2, 4, 5) THEN window_us WHEN rule = 3 THEN NULL ELSE ejected END,
      CASE rule WHEN 2 THEN least(2 * cooldown_us, {cap}) WHEN 3 THEN {cooldown} ELSE cooldown_us END
    FROM (SELECT *, CASE WHEN state = 'UNHEALTHY' AND ejected IS NOT NULL AND window_us - ejected >= cooldown_us AND oks >= 2 THEN 1
        WHEN state = 'RECOVERING' AND opened THEN 2 WHEN state = 'RECOVERING' AND clean >= 5 THEN 3
        WHEN state IN ('HEALTHY', 'DEGRADED') AND fails >= 2 THEN 4 WHEN state IN ('HEALTHY', 'DEGRADED') AND opened AND may_eject THEN 5
        WHEN state = 'HEALTHY' AND bad >= 3 THEN 6 WHEN state = 'DEGRADED' AND clean >= 5 THEN 7 ELSE 0 END AS rule
      FROM (SELECT s.backend, s.n, s.window_us, s.opened, s.may_eject, w.state, w.ejected, w.cooldown_us,
          CASE WHEN NOT traffic THEN w.bad WHEN poor THEN w.bad + 1 ELSE 0 END AS bad,
          CASE WHEN NOT traffic THEN w.clean WHEN poor THEN 0 ELSE w.clean + 1 END AS clean,
          CASE WHEN probes = 0 THEN w.fails WHEN failed = probes THEN w.fails + probes ELSE 0 END AS fails,
          CASE WHEN probes = 0 THEN w.oks WHEN failed = 0 THEN w.oks + probes ELSE 0 END AS oks
        FROM w JOIN steps s ON s.backend = w.backend AND s.n = w.n + 1)))
    SELECT * FROM w WHERE n > 0)"""


def bucket_walk_sql(rate: str, burst: int, bin_us: int) -> str:
    """The token bucket over ``steps`` (worker_id, prefix, bin, n, step), bin by bin."""
    return f"""
  SELECT worker_id, prefix, bin, n, spent FROM (WITH RECURSIVE f AS (
    SELECT worker_id, prefix, bin, n, step, least(n, {burst})::BIGINT AS spent, {burst}::DOUBLE - least(n, {burst}) AS tokens FROM steps WHERE step = 1
    UNION ALL
    SELECT worker_id, prefix, bin, n, step, least(n, floor(tokens + 1e-9))::BIGINT, tokens - least(n, floor(tokens + 1e-9)) FROM (
      SELECT s.*, least({burst}::DOUBLE, f.tokens + ({rate}) * (s.bin - f.bin)::DOUBLE * {bin_us}::DOUBLE / 1000000.0::DOUBLE) AS tokens
      FROM f JOIN steps s ON s.worker_id = f.worker_id AND s.prefix = f.prefix AND s.step = f.step + 1))
    SELECT * FROM f)"""


def decay_walk_sql(tau_us: int) -> str:
    """The decayed average over ``steps`` (backend, t_us, x, step)."""
    return f"""
  SELECT backend, t_us, x, ewma FROM (WITH RECURSIVE f AS (
    SELECT backend, t_us, x, step, x AS ewma FROM steps WHERE step = 1
    UNION ALL
    SELECT s.backend, s.t_us, s.x, s.step, f.ewma * exp(-(s.t_us - f.t_us) / {tau_us}::DOUBLE) + s.x * (1 - exp(-(s.t_us - f.t_us) / {tau_us}::DOUBLE))
    FROM f JOIN steps s ON s.backend = f.backend AND s.step = f.step + 1)
    SELECT * FROM f)"""


def bucket_sql(us: str) -> str:
    """The histogram bucket in SQL."""
    v = f"least(greatest({us}, 1), 10000000)::BIGINT"
    e = f"(length(bin({v})) - 1)"
    return f"({e} * 64 + (({v} * 64) >> {e}) - 64)::INTEGER"


def sql(needs: str, body: str, **extra: str) -> str:
    """A query over the named fragments (space separated) and extra definitions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for dep in FRAGMENTS[name][0]:
            add(dep)
        ordered.append(name)

    for name in needs.split():
        add(name)
    parts = [f"{n} AS MATERIALIZED ({FRAGMENTS[n][1]})" for n in ordered]
    parts += [f"{n} AS ({d})" for n, d in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
