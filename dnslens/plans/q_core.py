"""Registered queries: projections, joins, ordering, aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from dnslens.functions.netaddr import client_prefix, normalise_addresses, normalise_cidrs
from dnslens.functions.durations import duration_text, normalise_durations
from dnslens.functions.factors import with_health_factor, with_inverse_latency
from dnslens.operators import asof, choice, correlate, geo, prepare, sketches, telemetry
from dnslens.plans import views as v
from dnslens.plans.fragments import bucket_sql, sql, uniform_sql
from dnslens.plans.registry import query

HOUR, BIN = v.HOUR, v.BIN


# -- flagship -------------------------------------------------------------------------


@query(
    "flagship_latency_by_region",
    sql(
        "outc",
        f"SELECT send_us // {BIN} * {BIN} AS window_us, region, backend, count(*) AS requests, "
        "count(*) FILTER (outcome = 'error') AS errors, count(*) FILTER (outcome = 'timeout') AS timeouts, "
        "round(quantile_cont(latency_us, 0.5), 3) AS p50, round(quantile_cont(latency_us, 0.95), 3) AS p95, "
        "round(quantile_cont(latency_us, 0.99), 3) AS p99 FROM outc GROUP BY ALL",
    ),
)
def flagship(spark, sf):
    done = v.outcomes(spark, sf).withColumn("window_us", (F.floor(F.col("send_us") / BIN) * BIN).cast("long"))
    keys = ["window_us", "region", "backend"]
    rates = telemetry.window_rates(done.drop("window_us"), BIN, ["region", "backend"]).select(
        *keys, "requests", "errors", "timeouts"
    )
    lat = telemetry.latency_summary(done, keys)
    return rates.join(lat, keys, "left").select(
        *keys, "requests", "errors", "timeouts", *[F.round(p, 3).alias(p) for p in ("p50", "p95", "p99")]
    )


# -- projections and filters ------------------------------------------------------------

_LEVEL = "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' WHEN 'purchase' THEN 'info' WHEN 'click' THEN 'debug' ELSE 'trace' END"


@query(
    "p1_filter_level",
    sql("ev", f"SELECT event_id, {_LEVEL} AS level FROM ev WHERE {_LEVEL} IN ('warn', 'error')"),
)
def p1(spark, sf):
    return prepare.filter_level(v.events(spark, sf).select("event_id", F.expr(_LEVEL).alias("level")), "warn")


@query("p2_eligible", sql("elig", "SELECT version, region, backend, health FROM elig"))
def p2(spark, sf):
    return prepare.eligible(v.snapshots(spark, sf)).select("version", "region", "backend", "health")


@query("p3_classify_outcome", sql("outc", "SELECT query_id, outcome, rcode_class FROM outc"))
def p3(spark, sf):
    return v.outcomes(spark, sf).select("query_id", "outcome", "rcode_class")


@query(
    "p4_safe_labels",
    sql("outc", "SELECT backend, region, rcode_class, count(*) AS n FROM outc GROUP BY ALL"),
)
def p4(spark, sf):
    t = prepare.safe_labels(v.outcomes(spark, sf))
    return t.groupBy("backend", "region", "rcode_class").agg(F.count("*").alias("n"))


@query(
    "p5_client_prefix",
    sql(
        "ql",
        "SELECT query_id, client_lo - client_lo % 256 AS prefix_lo, concat(client_lo // 16777216, '.', "
        "client_lo // 65536 % 256, '.', client_lo // 256 % 256, '.0/24') AS prefix FROM ql",
    ),
)
def p5(spark, sf):
    return client_prefix(v.query_log(spark, sf)).select("query_id", "prefix_lo", "prefix")


@query(
    "p6_drop_warmup",
    sql(
        "samples",
        "SELECT seq, run_id, intended_us FROM (SELECT *, min(intended_us) OVER (PARTITION BY run_id) AS s FROM samples) "
        f"WHERE intended_us >= s + {24 * HOUR}",
    ),
)
def p6(spark, sf):
    return prepare.drop_warmup(v.samples(spark, sf), "1440m").select("seq", "run_id", "intended_us")


@query(
    "p7_hash_sample",
    sql("ql", "SELECT query_id FROM ql WHERE ('0x' || substr(md5('trace' || query_id), 1, 8))::BIGINT % 10000 < 2500"),
)
def p7(spark, sf):
    return prepare.hash_sample(v.query_log(spark, sf), "query_id", 25.0, "trace").select("query_id")


@query("p8_question_hash", sql("ql", "SELECT query_id, question_hash FROM ql"))
def p8(spark, sf):
    return prepare.with_question_hash(v.query_log(spark, sf).drop("question_hash")).select("query_id", "question_hash")


_RAW_QNAME = (
    "CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN concat('a..', k) "
    "WHEN event_id % 17 = 0 THEN concat(repeat('x', 64), '.example') WHEN event_id % 19 = 0 THEN repeat('abc.', 70) "
    "ELSE concat('q', k, '.example') END"
)
_RAW_QTYPE = "CASE WHEN event_id % 23 = 0 THEN 70000 ELSE 1 END"


@query(
    "p9_split_malformed",
    sql(
        "ev",
        "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'no_question' WHEN event_id % 13 = 0 THEN 'empty_label' "
        "WHEN event_id % 17 = 0 THEN 'label_too_long' WHEN event_id % 19 = 0 THEN 'name_too_long' "
        "WHEN event_id % 23 = 0 THEN 'bad_qtype' ELSE 'good' END AS reason FROM ev",
    ),
)
def p9(spark, sf):
    raw = v.events(spark, sf).select(
        "event_id", F.expr(_RAW_QNAME).alias("qname"), F.expr(_RAW_QTYPE).alias("qtype"), F.lit(1).alias("qclass")
    )
    good, bad = prepare.split_malformed(raw)
    return good.select("event_id", F.lit("good").alias("reason")).unionByName(bad.select("event_id", "reason"))


_INFLIGHT_SQL = (
    "SELECT worker_id, t_us, sum(sum(d)) OVER (PARTITION BY worker_id ORDER BY t_us) AS inflight, sum(d) AS d FROM ("
    "SELECT worker_id, send_us AS t_us, 1 AS d FROM outc UNION ALL "
    "SELECT worker_id, coalesce(recv_us, deadline_us), -1 FROM outc) GROUP BY worker_id, t_us"
)


@query(
    "p10_shed",
    sql(
        "outc",
        "SELECT o.query_id, CAST(i.inflight - i.d AS BIGINT) AS before, CASE WHEN i.inflight - i.d > 0 THEN 'truncate' END AS shed_action "
        "FROM outc o JOIN i ON i.worker_id = o.worker_id AND i.t_us = o.send_us",
        i=_INFLIGHT_SQL,
    ),
)
def p10(spark, sf):
    names = [b[0] for b in v.BACKENDS]
    done = v.stored(v.outcomes(spark, sf).select("query_id", "worker_id", "backend", "send_us", "recv_us", "deadline_us"))
    q = telemetry.inflight_at_send(done, names)
    total = sum((F.col("inflight")[b] for b in names), F.lit(0)).cast("long")
    return prepare.shed(q.withColumn("inflight", total), 0, "truncate").select(
        "query_id", F.col("inflight").alias("before"), "shed_action"
    )


# -- scalar normalisation -----------------------------------------------------------------

_ADDR = (
    "CASE l_partkey % 9 WHEN 0 THEN concat('10.', l_suppkey % 300, '.', l_linenumber, '.1') "
    "WHEN 1 THEN concat('10.0.0', l_linenumber, '.1') WHEN 2 THEN 'localhost' WHEN 3 THEN '' "
    "WHEN 4 THEN concat('192.0.2.', l_partkey % 256) WHEN 5 THEN concat(l_suppkey % 256, '.1.1') "
    "WHEN 6 THEN concat('1.2.3.', l_linenumber, ' ') WHEN 7 THEN concat('255.255.', l_partkey % 256, '.0') "
    "ELSE concat('0.0.0.', l_suppkey % 260) END"
)


def _v4_sql(text: str) -> str:
    octet = "(0|[1-9][0-9]{0,2})"
    shape = r"\.".join([octet] * 4)
    parts = [f"split_part({text}, '.', {i})::BIGINT" for i in range(1, 5)]
    return (
        f"CASE WHEN regexp_full_match({text}, '{shape}') THEN CASE WHEN "
        + " AND ".join(f"{p} <= 255" for p in parts)
        + f" THEN {parts[0]} * 16777216 + {parts[1]} * 65536 + {parts[2]} * 256 + {parts[3]} END END"
    )


@query(
    "f1_normalise_addresses",
    sql(
        "",
        "SELECT l_orderkey, l_linenumber, addr, n AS addr_lo, n IS NOT NULL AS addr_ok FROM a",
        r=f"SELECT l_orderkey, l_linenumber, {_ADDR} AS addr FROM lineitem",
        a=f"SELECT *, {_v4_sql('addr')} AS n FROM r",
    ),
)
def f1(spark, sf):
    t = v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_ADDR).alias("addr"))
    return normalise_addresses(t, "addr", "addr").select("l_orderkey", "l_linenumber", "addr", "addr_lo", "addr_ok")


_CIDR = (
    "CASE l_partkey % 8 WHEN 0 THEN concat('10.', l_suppkey % 256, '.0.0/16') WHEN 1 THEN concat('10.0.0.', l_linenumber, '/8') "
    "WHEN 2 THEN '10.0.0.0' WHEN 3 THEN '10.0.0.0/' WHEN 4 THEN concat('10.0.0.0/', l_suppkey % 64) "
    "WHEN 5 THEN 'x/8' WHEN 6 THEN '10.0.0.0/8x' ELSE concat('192.168.', l_partkey % 256, '.128/25') END"
)


@query(
    "f2_normalise_cidrs",
    sql(
        "",
        "SELECT l_orderkey, l_linenumber, CASE WHEN instr(cidr, '/') = 0 THEN 'missing_slash' WHEN n IS NULL THEN 'bad_address' "
        "WHEN plen IS NULL THEN 'bad_length' WHEN plen > 32 THEN 'too_long' "
        "WHEN n % (1::BIGINT << (32 - plen)) <> 0 THEN 'host_bits_set' END AS error, "
        "CASE WHEN instr(cidr, '/') > 0 AND n IS NOT NULL AND plen <= 32 AND n % (1::BIGINT << (32 - least(plen, 32))) = 0 THEN plen END AS plen FROM a",
        r=f"SELECT l_orderkey, l_linenumber, {_CIDR} AS cidr FROM lineitem",
        s="SELECT *, split_part(cidr, '/', 1) AS host, split_part(cidr, '/', 2) AS len FROM r",
        a=f"SELECT *, {_v4_sql('host')} AS n, CASE WHEN regexp_full_match(len, '[0-9]+') THEN len::INTEGER END AS plen FROM s",
    ),
)
def f2(spark, sf):
    t = v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_CIDR).alias("cidr"))
    return normalise_cidrs(t, "cidr", "net").select(
        "l_orderkey", "l_linenumber", F.col("net_error").alias("error"), F.col("net.plen").alias("plen")
    )


_DUR = (
    "CASE o_orderkey % 9 WHEN 0 THEN concat(o_custkey, 'us') WHEN 1 THEN concat(o_custkey, 'ms') WHEN 2 THEN concat(o_custkey, 's') "
    "WHEN 3 THEN concat(o_custkey, 'm') WHEN 4 THEN concat(o_custkey, '') WHEN 5 THEN 'ms' WHEN 6 THEN '1.5s' "
    "WHEN 7 THEN '99999999999999999m' ELSE concat('-', o_custkey, 's') END"
)


@query(
    "f3_normalise_durations",
    sql(
        "",
        "SELECT o_orderkey, us, CASE WHEN us % 1000000 = 0 THEN concat(us // 1000000, 's') WHEN us % 1000 = 0 THEN concat(us // 1000, 'ms') "
        "WHEN us IS NOT NULL THEN concat(us, 'us') END AS shown FROM a",
        r=f"SELECT o_orderkey, {_DUR} AS d FROM orders",
        a="SELECT *, CASE WHEN regexp_full_match(d, '[0-9]{1,12}(us|ms|s|m)') THEN CAST(regexp_extract(d, '[0-9]+') AS BIGINT) * "
        "CASE regexp_extract(d, '[a-z]+') WHEN 'us' THEN 1 WHEN 'ms' THEN 1000 WHEN 's' THEN 1000000 ELSE 60000000 END END AS us FROM r",
    ),
)
def f3(spark, sf):
    t = v.table(spark, sf, "orders").select("o_orderkey", F.expr(_DUR).alias("d"))
    return normalise_durations(t, "d").select("o_orderkey", "us", duration_text(F.col("us")).alias("shown"))


@query(
    "f4_health_factor",
    sql(
        "snap",
        "SELECT version, region, backend, CASE health WHEN 'HEALTHY' THEN 1.0 WHEN 'DEGRADED' THEN 0.25 WHEN 'RECOVERING' THEN 0.1 ELSE 0.0 END::DOUBLE "
        "AS health_factor FROM snap",
    ),
)
def f4(spark, sf):
    return with_health_factor(v.snapshots(spark, sf)).select("version", "region", "backend", "health_factor")


@query(
    "f5_inverse_latency",
    sql("snap", "SELECT version, region, backend, round(1e9 / pow(greatest(ewma_us, 1.0), 1.5), 6) AS inv FROM snap"),
)
def f5(spark, sf):
    t = with_inverse_latency(v.snapshots(spark, sf), 1.5)
    return t.select("version", "region", "backend", F.round(F.col("inv_latency") * 1e9, 6).alias("inv"))


# -- joins ----------------------------------------------------------------------------------


@query("j1_region_lpm", sql("qr", "SELECT query_id, region FROM qr"))
def j1(spark, sf):
    return v.queries_with_region(spark, sf).select("query_id", "region")


# Nested IPv6 prefixes, one per part, and clients in the same networks.
_V6_GROUP = "CASE {k} % 3 WHEN 0 THEN 0 WHEN 1 THEN {k} {div} 3 % 256 * 256 ELSE {k} {div} 3 % 256 * 256 + {k} % 4 END"
_V6_LEN = "CASE {k} % 3 WHEN 0 THEN 48 WHEN 1 THEN 56 ELSE 64 END"


@query(
    "j1_region_lpm_v6",
    sql(
        "",
        "SELECT c.event_id AS query_id, coalesce(l.region, m.region, s.region) AS region FROM c "
        "LEFT JOIN n l ON l.plen = 64 AND l.a = c.a AND l.b = c.b "
        "LEFT JOIN n m ON m.plen = 56 AND m.a = c.a AND m.b = c.b // 256 * 256 "
        "LEFT JOIN n s ON s.plen = 48 AND s.a = c.a",
        n=f"SELECT {_V6_LEN.format(k='p_partkey')} AS plen, p_partkey % 61 AS a, {_V6_GROUP.format(k='p_partkey', div='//')} AS b, "
        "min('r' || (p_partkey % 97)) AS region FROM part GROUP BY 1, 2, 3",
        c="SELECT event_id, user_id % 64 AS a, event_id // 8 % 256 * 256 + event_id % 8 AS b FROM events",
    ),
)
def j1_v6(spark, sf):
    """IPv6 clients of the event log against one nested prefix per part."""
    group = _V6_GROUP.format(k="p_partkey", div="div")
    cidrs = v.table(spark, sf, "part").selectExpr(
        "concat('r', p_partkey % 97) AS region",
        f"concat('2001:db8:', lower(hex(p_partkey % 61)), ':', lower(hex({group})), '::/', {_V6_LEN.format(k='p_partkey')}) AS cidr",
    )
    clients = v.table(spark, sf, "events").selectExpr(
        "event_id AS query_id",
        "concat('2001:db8:', lower(hex(user_id % 64)), ':', lower(hex(event_id div 8 % 256 * 256 + event_id % 8)), '::', lower(hex(event_id % 4096 + 1))) AS client",
    )
    q = normalise_addresses(clients, "client", "client")
    return geo.region_lpm(q, cidrs).select("query_id", "region")


@query(
    "j2_region_ecs",
    sql(
        "ql cidrs",
        "SELECT query_id, arg_max(region, plen) AS region FROM e JOIN cidrs d ON addr >= net AND addr < net + (1::BIGINT << (32 - plen)) GROUP BY 1",
        e=f"SELECT query_id, CASE WHEN query_id % 5 = 0 THEN {v.SHARED_SPACE} + ((user_id + 1) % 4) * {1 << v.ZONE_BITS} ELSE client_lo END AS addr FROM ql",
    ),
)
def j2(spark, sf):
    return geo.region_ecs(v.query_log(spark, sf), v.region_cidrs(spark), True, 24).select("query_id", "region")


@query("j3_correlate", sql("outc", "SELECT query_id, recv_us, rcode, latency_us FROM outc WHERE recv_us IS NOT NULL"))
def j3(spark, sf):
    return correlate.correlate(v.attempts(spark, sf), v.responses(spark, sf)).select(
        "query_id", "recv_us", "rcode", "latency_us"
    )


@query("j4_timeouts", sql("outc", "SELECT query_id, backend, deadline_us FROM outc WHERE recv_us IS NULL"))
def j4(spark, sf):
    return correlate.timeouts(v.attempts(spark, sf), v.responses(spark, sf)).select("query_id", "backend", "deadline_us")


@query(
    "j5_mismatches",
    sql(
        "matched att resp",
        "SELECT worker_id, backend, upstream_txid, generation, recv_us, reason, CAST(count(*) AS BIGINT) AS copies FROM ("
        "SELECT r.*, CASE WHEN NOT EXISTS (SELECT 1 FROM att a WHERE a.worker_id = r.worker_id AND a.backend = r.backend AND a.upstream_txid = r.upstream_txid) THEN 'unknown_txid' "
        "WHEN NOT EXISTS (SELECT 1 FROM att a WHERE a.worker_id = r.worker_id AND a.backend = r.backend AND a.upstream_txid = r.upstream_txid AND a.generation = r.generation) THEN 'generation' "
        "WHEN f.deadline_us IS NULL THEN 'question' WHEN r.recv_us > f.deadline_us THEN 'late' ELSE 'duplicate' END AS reason "
        "FROM resp r LEFT JOIN (SELECT a.*, m.recv_us AS accepted FROM att a LEFT JOIN matched m USING (query_id, attempt_no)) f "
        "USING (worker_id, backend, upstream_txid, generation, question_hash) WHERE f.accepted IS DISTINCT FROM r.recv_us) GROUP BY ALL",
    ),
)
def j5(spark, sf):
    return correlate.mismatches(v.attempts(spark, sf), v.responses(spark, sf)).select(
        "worker_id", "backend", "upstream_txid", "generation", "recv_us", "reason", "copies"
    )


@query(
    "j6_asof_snapshot",
    sql("qv", "SELECT query_id, version, arrival_us - published_us AS snapshot_age_us FROM qv"),
)
def j6(spark, sf):
    return asof.asof_snapshot(v.query_log(spark, sf), v.stored(v.snapshots(spark, sf))).select(
        "query_id", "version", "snapshot_age_us"
    )


_ADVISED = (
    "SELECT q.query_id, q.region, CASE WHEN q.arrival_us < a.issued_us + a.ttl_us THEN a.issued_us END AS advice_issued_us "
    "FROM qr q ASOF LEFT JOIN (SELECT DISTINCT region, issued_us, ttl_us FROM advice) a "
    "ON q.region = a.region AND q.arrival_us >= a.issued_us"
)


@query("j7_asof_advice", sql("qr advice", _ADVISED))
def j7(spark, sf):
    return asof.asof_advice(v.queries_with_region(spark, sf), v.stored(v.advice(spark, sf))).select(
        "query_id", "region", "advice_issued_us"
    )


@query(
    "j8_candidates",
    sql(
        "",
        "SELECT config_id, region, backend, tier, geo_distance FROM (SELECT DISTINCT c_nationkey AS config_id, c_mktsegment AS region FROM customer) r "
        "JOIN (SELECT s_nationkey AS config_id, s_name AS backend, concat('site_', s_suppkey % 5) AS site FROM supplier) b USING (config_id) "
        "LEFT JOIN a USING (region, site)",
        a="SELECT c_mktsegment AS region, concat('site_', c_custkey % 5) AS site, CAST(min(c_custkey % 3) AS INTEGER) AS tier, "
        "CAST(max(c_custkey % 17) AS DOUBLE) AS geo_distance FROM customer GROUP BY ALL",
    ),
)
def j8(spark, sf):
    c = v.table(spark, sf, "customer")
    regions = c.select(F.col("c_nationkey").alias("config_id"), F.col("c_mktsegment").alias("region")).distinct()
    pool = v.table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("config_id"),
        F.col("s_name").alias("backend"),
        F.concat(F.lit("site_"), (F.col("s_suppkey") % 5).cast("string")).alias("site"),
    )
    near = c.groupBy(
        F.col("c_mktsegment").alias("region"),
        F.concat(F.lit("site_"), (F.col("c_custkey") % 5).cast("string")).alias("site"),
    ).agg(F.min(F.col("c_custkey") % 3).cast("int").alias("tier"), F.max(F.col("c_custkey") % 17).cast("double").alias("geo_distance"))
    return geo.candidates(regions, pool, near).select("config_id", "region", "backend", "tier", "geo_distance")


@query(
    "j9_weighted_pick",
    sql(
        "qv elig",
        "SELECT q.query_id, (SELECT min(backend) FROM c WHERE c.version = q.version AND c.region = q.region AND c.cum > q.u * c.total) AS pick FROM u q",
        c="SELECT *, sum(weight) OVER (PARTITION BY version, region ORDER BY backend) AS cum, sum(weight) OVER (PARTITION BY version, region) AS total FROM elig",
        u=f"SELECT *, {uniform_sql(7, 'query_id', 1)} AS u FROM qv",
    ),
)
def j9(spark, sf):
    snap = v.stored(v.snapshots(spark, sf))
    q = asof.asof_snapshot(v.queries_with_region(spark, sf), snap)
    return choice.weighted_pick(q, prepare.eligible(snap), 7, ["version", "region"]).select("query_id", "pick")


@query(
    "j10_retry_plan",
    sql(
        "outc qv elig",
        "SELECT o.query_id, coalesce((SELECT min(backend) FROM elig e WHERE e.version = q.version AND e.region = q.region AND e.backend > o.backend), "
        "(SELECT min(backend) FROM elig e WHERE e.version = q.version AND e.region = q.region AND e.backend <> o.backend)) AS retry_backend, "
        "CASE WHEN NOT EXISTS (SELECT 1 FROM elig e WHERE e.version = q.version AND e.region = q.region AND e.backend <> o.backend) THEN 'servfail' END AS final "
        "FROM outc o JOIN qv q USING (query_id) WHERE o.recv_us IS NULL",
    ),
)
def j10(spark, sf):
    snap = v.stored(v.snapshots(spark, sf))
    q = asof.asof_snapshot(v.queries_with_region(spark, sf), snap).select("query_id", "version", "region")
    lost = correlate.timeouts(v.attempts(spark, sf), v.responses(spark, sf)).join(q, "query_id")
    return correlate.retry_plan(lost, prepare.eligible(snap)).select("query_id", "retry_backend", "final")


# -- ordering ---------------------------------------------------------------------------------


@query(
    "t1_geo_rank",
    sql(
        "elig affinity",
        "SELECT version, region, arg_min(backend, (tier, ewma_us, backend)) AS geo_first, arg_min(backend, (ewma_us, tier, backend)) AS latency_first "
        "FROM elig JOIN affinity USING (region, site) GROUP BY 1, 2",
    ),
)
def t1(spark, sf):
    c = prepare.eligible(v.snapshots(spark, sf)).join(v.affinity(spark), ["region", "site"])
    c = c.select("version", "region", "tier", "ewma_us", "backend")
    a = geo.geo_rank(c, "geo_first").select("version", "region", F.col("backend").alias("geo_first"))
    b = geo.geo_rank(c, "latency_first").select("version", "region", F.col("backend").alias("latency_first"))
    return a.join(b, ["version", "region"])


@query(
    "t3_top_k",
    sql(
        "ql",
        "SELECT bin, qname, n, rank, round(n / total, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY n DESC, qname) AS rank, "
        f"sum(n) OVER (PARTITION BY bin) AS total FROM (SELECT arrival_us // {24 * HOUR} AS bin, qname, count(*) AS n FROM ql GROUP BY ALL)) WHERE rank <= 5",
    ),
)
def t3(spark, sf):
    q = v.query_log(spark, sf).withColumn("bin", F.floor(F.col("arrival_us") / (24 * HOUR)).cast("long"))
    return geo.top_k(q, "qname", 5).select("bin", "qname", "n", "rank", F.round("share", 6).alias("share"))


@query(
    "t3_top_k_large",
    sql(
        "ql",
        "SELECT bin, qname, n, rank, round(n / total, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY n DESC, qname) AS rank, "
        f"sum(n) OVER (PARTITION BY bin) AS total FROM (SELECT arrival_us // {24 * HOUR} AS bin, qname, count(*) AS n FROM ql GROUP BY ALL)) WHERE rank <= 5",
    ),
)
def t3_large(spark, sf):
    q = v.query_log(spark, sf).withColumn("bin", F.floor(F.col("arrival_us") / (24 * HOUR)).cast("long"))
    return sketches.top_k_large(q, "qname", 5).select("bin", "qname", "n", "rank", F.round("share", 6).alias("share"))


@query(
    "t4_latest",
    sql("snap", "SELECT region, backend, max(version) AS version, arg_max(health, version) AS health FROM snap GROUP BY 1, 2"),
)
def t4(spark, sf):
    return geo.latest(v.snapshots(spark, sf)).select("region", "backend", "version", "health")


@query(
    "u1_health_signals",
    sql(
        "outc probes",
        f"SELECT send_us // {BIN} * {BIN} AS window_us, backend, 'passive' AS kind, count(*) AS n, count(*) FILTER (outcome <> 'ok') AS bad FROM outc GROUP BY ALL "
        f"UNION ALL SELECT t_us // {BIN} * {BIN}, backend, 'active', count(*), count(*) FILTER (NOT ok) FROM probes GROUP BY ALL",
    ),
)
def u1(spark, sf):
    from dnslens.operators.health import health_signals

    rates = telemetry.window_rates(v.outcomes(spark, sf), BIN, ["backend"])
    s = health_signals(v.probes(spark, sf), rates, BIN)
    bad = F.when(F.col("kind") == "active", F.col("probe_failures")).otherwise(F.col("errors") + F.col("timeouts"))
    n = F.when(F.col("kind") == "active", F.col("probes")).otherwise(F.col("requests"))
    return s.select("window_us", "backend", "kind", n.alias("n"), bad.alias("bad"))


# -- aggregations -------------------------------------------------------------------------------


@query(
    "a1_window_rates",
    sql(
        "outc",
        f"SELECT send_us // {HOUR} * {HOUR} AS window_us, backend, region, count(*) AS requests, round(count(*) / 3600.0, 9) AS qps, "
        "round(count(*) FILTER (outcome = 'error') / count(*), 6) AS error_rate, round(count(*) FILTER (outcome = 'timeout') / count(*), 6) AS timeout_rate, "
        "round(count(*) FILTER (rcode_class = 'servfail') / count(*), 6) AS servfail_rate FROM outc GROUP BY ALL",
    ),
)
def a1(spark, sf):
    t = telemetry.window_rates(v.outcomes(spark, sf), HOUR, ["backend", "region"])
    return t.select(
        "window_us", "backend", "region", "requests", F.round("qps", 9).alias("qps"),
        *[F.round(c, 6).alias(c) for c in ("error_rate", "timeout_rate", "servfail_rate")],
    )


@query(
    "a2_counter_delta",
    sql(
        "counters",
        "SELECT t_us, worker_id, backend, CASE WHEN p IS NULL OR queries < p THEN queries ELSE queries - p END AS d_queries, "
        "CASE WHEN pt IS NULL OR timeouts < pt THEN timeouts ELSE timeouts - pt END AS d_timeouts FROM ("
        "SELECT *, lag(queries) OVER w AS p, lag(timeouts) OVER w AS pt FROM counters WINDOW w AS (PARTITION BY worker_id, backend ORDER BY t_us))",
    ),
)
def a2(spark, sf):
    t = telemetry.counter_delta(v.counters(spark, sf), ["worker_id", "backend"], ["queries", "timeouts"], cell_us=24 * HOUR)
    return t.select("t_us", "worker_id", "backend", "d_queries", "d_timeouts")


_HIST = f"SELECT worker_id, backend, {bucket_sql('latency_us')} AS bucket, count(*) AS cnt FROM outc WHERE latency_us IS NOT NULL GROUP BY ALL"


def _hist(spark, sf, keys):
    return telemetry.histogram(v.outcomes(spark, sf), "latency_us", keys)


@query("a3_histogram", sql("outc", _HIST))
def a3(spark, sf):
    return _hist(spark, sf, ["worker_id", "backend"])


@query("a4_merge_hist", sql("outc", "SELECT backend, bucket, CAST(sum(cnt) AS BIGINT) AS cnt FROM h GROUP BY ALL", h=_HIST))
def a4(spark, sf):
    return telemetry.merge_hist(_hist(spark, sf, ["worker_id", "backend"]), ["backend"])


_MID = "(pow(2.0, {b} // 64) * (1 + ({b} % 64) / 64.0) + pow(2.0, {b} // 64) / 128.0)"


@query(
    "a5_hist_percentiles",
    sql(
        "outc",
        "SELECT backend, n AS count, " + ", ".join(f"{_MID.format(b='b' + str(i))} AS p{i}" for i in (50, 95, 99)) + " FROM p",
        h=_HIST,
        m="SELECT backend, bucket, sum(cnt) AS cnt FROM h GROUP BY ALL",
        c="SELECT *, sum(cnt) OVER (PARTITION BY backend ORDER BY bucket) AS cum, sum(cnt) OVER (PARTITION BY backend) AS n FROM m",
        p="SELECT backend, CAST(any_value(n) AS BIGINT) AS n, "
        + ", ".join(f"min(bucket) FILTER (cum >= ceil(n * 0.{i}::DOUBLE)) AS b{i}" for i in (50, 95, 99))
        + " FROM c GROUP BY 1",
    ),
)
def a5(spark, sf):
    merged = telemetry.merge_hist(_hist(spark, sf, ["worker_id", "backend"]), ["backend"])
    return telemetry.hist_percentiles(merged, ["backend"])


@query(
    "a6_latency_summary",
    sql(
        "outc",
        "SELECT region, backend, count(latency_us) AS count, round(avg(latency_us), 3) AS mean, round(quantile_cont(latency_us, 0.5), 3) AS p50, "
        "round(quantile_cont(latency_us, 0.95), 3) AS p95, round(quantile_cont(latency_us, 0.99), 3) AS p99, max(latency_us) AS max "
        "FROM outc WHERE latency_us IS NOT NULL GROUP BY 1, 2",
    ),
)
def a6(spark, sf):
    t = telemetry.latency_summary(v.outcomes(spark, sf), ["region", "backend"])
    return t.select("region", "backend", "count", *[F.round(c, 3).alias(c) for c in ("mean", "p50", "p95", "p99")], "max")


@query(
    "a6_latency_sketches",
    sql("outc", "SELECT region, backend, count(latency_us) AS count, true AS p50_holds, true AS p95_holds, true AS p99_holds FROM outc WHERE latency_us IS NOT NULL AND region IS NOT NULL AND backend IS NOT NULL GROUP BY 1, 2"),
)
def a6_sketches(spark, sf):
    """Sketches per hour merged per key; each percentile's true rank is held against three times the stated error."""
    keys, k, ps = ["region", "backend"], 2_000, {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    t = v.outcomes(spark, sf).filter("region IS NOT NULL AND backend IS NOT NULL")
    t = t.select(*keys, "latency_us", F.expr(f"send_us div {HOUR}").alias("hour"))
    merged = sketches.merge_sketches(sketches.value_sketches(t, [*keys, "hour"], k=k), keys)
    found = v.stored(sketches.sketch_percentiles(merged, keys, list(ps.values())))
    spans = sketches.rank_spans(t, found, keys, list(ps))
    off = 3 * sketches.rank_error(k)
    holds = [((F.col(f"lo_{n}") <= p + off) & (F.col(f"hi_{n}") >= p - off)).alias(f"{n}_holds") for n, p in ps.items()]
    return found.join(spans, keys).select(*keys, "count", *holds)


_BOUNDS = (1_000, 10_000, 50_000, 100_000, 1_000_000)


@query(
    "a7_le_buckets",
    sql(
        "outc",
        "SELECT backend, le, CAST(coalesce(sum(cnt) FILTER (pow(2.0, bucket // 64) * (1 + (bucket % 64) / 64.0) + pow(2.0, bucket // 64) / 64.0 <= b), 0) AS BIGINT) AS cnt "
        f"FROM h CROSS JOIN (VALUES {', '.join(f'({chr(39)}{b}{chr(39)}, {b}::DOUBLE)' for b in _BOUNDS)}, ('+Inf', 'inf'::DOUBLE)) v(le, b) GROUP BY ALL",
        h=_HIST,
    ),
)
def a7(spark, sf):
    return telemetry.le_buckets(_hist(spark, sf, ["worker_id", "backend"]), _BOUNDS, ["backend"])


@query(
    "a8_rollup_metrics",
    sql(
        "outc",
        "SELECT backend, region, count(*) AS requests, count(*) FILTER (outcome <> 'ok') AS failures, GROUPING_ID(backend, region) AS level FROM outc "
        "GROUP BY GROUPING SETS ((backend, region), (backend), (region), ())",
    ),
)
def a8(spark, sf):
    return telemetry.rollup_metrics(v.outcomes(spark, sf))


@query(
    "w2_inflight",
    sql(
        "outc",
        "SELECT backend, t_us, CAST(sum(sum(d)) OVER (PARTITION BY backend ORDER BY t_us) AS BIGINT) AS inflight FROM ("
        "SELECT backend, send_us AS t_us, 1 AS d FROM outc UNION ALL SELECT backend, coalesce(recv_us, deadline_us), -1 FROM outc) GROUP BY backend, t_us",
    ),
)
def w2(spark, sf):
    return telemetry.inflight(v.outcomes(spark, sf), ["backend"]).select("backend", "t_us", "inflight")


_CATALOGUE = (
    "SELECT 'dns_backend_requests_total' AS name, backend AS label, NULL AS kind, count(*)::DOUBLE AS value FROM outc GROUP BY ALL "
    "UNION ALL SELECT 'dns_responses_total', backend, rcode_class, count(*)::DOUBLE FROM outc WHERE rcode_class IS NOT NULL GROUP BY ALL "
    "UNION ALL SELECT 'dns_backend_failures_total', backend, outcome, count(*)::DOUBLE FROM outc WHERE outcome <> 'ok' GROUP BY ALL "
    "UNION ALL SELECT 'dns_queries_total', NULL, NULL, count(*)::DOUBLE FROM outc"
)


@query("s6_metric_samples", sql("outc", _CATALOGUE))
def s6(spark, sf):
    """Counters of the metric catalogue as (name, labels, value) rows."""
    done = v.outcomes(spark, sf)
    cube = done.groupBy("backend", "rcode_class", "outcome").agg(F.count("*").alias("n"))
    ts = F.lit(None).cast("timestamp")

    def total(t, *labels):
        return t.groupBy(*labels).agg(F.sum("n").alias("n"))

    failed = total(cube.filter("outcome <> 'ok'"), "backend", "outcome").withColumnRenamed("outcome", "kind")
    parts = [
        telemetry.metric_samples(total(cube, "backend"), "dns_backend_requests_total", ["backend"], F.col("n"), ts),
        telemetry.metric_samples(
            total(cube.filter("rcode_class IS NOT NULL"), "backend", "rcode_class"),
            "dns_responses_total", ["backend", "rcode_class"], F.col("n"), ts,
        ),
        telemetry.metric_samples(failed, "dns_backend_failures_total", ["backend", "kind"], F.col("n"), ts),
        telemetry.metric_samples(total(cube), "dns_queries_total", [], F.col("n"), ts),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.selectExpr("name", "labels['backend'] AS label", "coalesce(labels['rcode_class'], labels['kind']) AS kind", "value")
