"""Registered queries: validation of a fleet of deployments (one per order)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dnslens.operators import validation
from dnslens.plans import views as v
from dnslens.plans.registry import query

_POLICIES = ("round_robin", "weighted", "least_inflight", "latency_based", "geo_aware", "health_aware", "adaptive")

_LI = "SELECT l_orderkey AS id, l_linenumber - 1 AS pos, l_suppkey AS s, l_partkey AS p, l_quantity::INTEGER AS qty, l_returnflag AS flag FROM lineitem"
_PARTS = {
    "li": _LI,
    "dep": (
        "SELECT o_orderkey::VARCHAR AS config_id, CASE WHEN o_orderkey % 7 = 0 THEN 'auto' WHEN o_orderkey % 37 = 1 THEN '0' WHEN o_orderkey % 37 = 2 THEN 'abc' "
        "ELSE (o_orderkey % 64 + 1)::VARCHAR END AS workers, CASE WHEN o_orderkey % 11 = 0 THEN 'unset' WHEN o_orderkey % 11 = 1 THEN NULL ELSE '127.0.0.1' END AS admin_address, "
        "CASE WHEN o_orderkey % 13 = 0 THEN '0' WHEN o_orderkey % 13 = 1 THEN NULL ELSE '8053' END AS admin_port, CASE WHEN o_orderkey % 17 = 0 THEN 'chatty' ELSE 'info' END AS log_level, "
        "CASE WHEN o_orderkey % 19 = 0 THEN 'dice' ELSE CASE o_orderkey % 7 "
        + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_POLICIES))
        + " END END AS policy, CASE WHEN o_orderkey % 23 = 0 THEN '75' WHEN o_orderkey % 23 = 1 THEN '90s' WHEN o_orderkey % 23 = 2 THEN '900us' WHEN o_orderkey % 23 = 3 THEN NULL "
        "WHEN o_orderkey % 23 = 4 THEN '2s' WHEN o_orderkey % 23 = 5 THEN '1500us' ELSE '800ms' END AS timeout FROM orders"
    ),
    "be": (
        "SELECT id::VARCHAR AS config_id, pos, CASE WHEN p % 37 = 0 THEN 'Two Words' WHEN p % 37 = 1 THEN NULL ELSE concat('pop-', s % 20) END AS name, "
        "CASE WHEN p % 41 = 0 THEN 'unset' WHEN p % 41 = 1 THEN NULL ELSE concat('10.0.', s % 8, '.', p % 3) END AS address, "
        "CASE WHEN p % 43 = 0 THEN '-7' WHEN p % 2 = 0 THEN NULL ELSE '5401' END AS port, CASE WHEN p % 47 = 0 THEN '0' WHEN p % 47 = 1 THEN NULL ELSE qty::VARCHAR END AS weight, "
        "CASE WHEN p % 53 = 0 THEN NULL ELSE concat('site_', s % 5) END AS site FROM li"
    ),
    "ls": (
        "SELECT id::VARCHAR AS config_id, pos, CASE WHEN p % 31 = 0 THEN '127.0.0.999' ELSE concat('127.0.0.', s % 2 + 1) END AS address, "
        "CASE WHEN p % 29 = 0 THEN '90001' WHEN p % 29 = 1 THEN NULL WHEN p % 2 = 0 THEN '8053' ELSE '5353' END AS port, "
        "CASE WHEN p % 59 = 0 THEN 'quic' WHEN flag = 'A' THEN 'udp' WHEN flag = 'N' THEN 'tcp' END AS transport FROM li WHERE pos < 2 AND p % 97 <> 0"
    ),
    "rg": (
        "SELECT id::VARCHAR AS config_id, pos AS region_pos, c AS cidr_pos, CASE WHEN p % 61 = 0 THEN '-first' ELSE concat('r', s % 6) END AS region, "
        "CASE WHEN p % 67 = 0 AND c = 0 THEN '10.9.0.1/12' WHEN p % 71 = 0 AND c = 0 THEN '10.9.0.0' WHEN p % 73 = 0 AND c = 0 THEN '10.9.0.0/40' "
        "ELSE concat('10.', (p + c) % 8, '.0.0/16') END AS cidr FROM li CROSS JOIN (VALUES (0), (1)) v(c) WHERE pos < 3"
    ),
    "okl": (
        "SELECT config_id, pos, address, port, coalesce(transport, 'udp') AS transport FROM ls WHERE address NOT LIKE '%999' AND port IS NOT NULL AND port <> '90001' AND transport IS DISTINCT FROM 'quic'"
    ),
    "okb": (
        "SELECT config_id, pos, name, address, coalesce(port, '53') AS port FROM be WHERE name LIKE 'pop-%' AND address LIKE '10.0.%.%' AND regexp_full_match(address, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+') "
        "AND port IS DISTINCT FROM '-7' AND weight IS DISTINCT FROM '0' AND site IS NOT NULL"
    ),
    "okr": "SELECT * FROM rg WHERE region <> '-first'",
    "adm": (
        "SELECT config_id, '127.0.0.1' AS address, CASE WHEN admin_port IS NULL OR admin_port = '0' THEN '8053' ELSE admin_port END AS port FROM dep"
    ),
}


def _sql(needs: str, body: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({_PARTS[n]})" for n in needs.split()) + " " + body


def _only(spark, sf, check, *rules):
    return check(v.inventory(spark, sf)).filter(F.col("rule").isin(*rules)).select("config_id", "path", "rule")


def _addr(col: str) -> str:
    return f"regexp_full_match({col}, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+') AND {col} NOT LIKE '%999'"


@query(
    "v1_required",
    _sql(
        "li dep be ls",
        "SELECT config_id, concat('listeners[', pos, '].port') AS path, 'V1' AS rule FROM ls WHERE port IS NULL "
        "UNION ALL SELECT config_id, concat('backends[', pos, '].name'), 'V1' FROM be WHERE name IS NULL "
        "UNION ALL SELECT config_id, concat('backends[', pos, '].address'), 'V1' FROM be WHERE address IS NULL "
        "UNION ALL SELECT config_id, concat('backends[', pos, '].site'), 'V1' FROM be WHERE site IS NULL "
        "UNION ALL SELECT config_id, 'listeners', 'V1' FROM dep WHERE config_id NOT IN (SELECT config_id FROM ls) "
        "UNION ALL SELECT config_id, 'backends', 'V1' FROM dep WHERE config_id NOT IN (SELECT config_id FROM be)",
    ),
)
def v1(spark, sf):
    return _only(spark, sf, validation.validate_inventory, "V1")


@query(
    "v2_unknown_keys",
    _sql(
        "li",
        "SELECT o_orderkey::VARCHAR AS config_id, 'pollicy' AS path, 'V2' AS rule FROM orders WHERE o_orderkey % 79 = 0 "
        "UNION ALL SELECT id::VARCHAR, concat('backends[', pos, '].owner'), 'V2' FROM li WHERE p % 83 = 0",
    ),
)
def v2(spark, sf):
    return _only(spark, sf, validation.check_keys, "V2")


@query(
    "v3_integer_ranges",
    _sql(
        "li dep be ls",
        "SELECT config_id, 'workers' AS path, 'V3' AS rule FROM dep WHERE workers IN ('0', 'abc') "
        "UNION ALL SELECT config_id, 'admin.port', 'V3' FROM dep WHERE admin_port = '0' "
        "UNION ALL SELECT config_id, concat('listeners[', pos, '].port'), 'V3' FROM ls WHERE port = '90001' "
        "UNION ALL SELECT config_id, concat('backends[', pos, '].port'), 'V3' FROM be WHERE port = '-7' "
        "UNION ALL SELECT config_id, concat('backends[', pos, '].weight'), 'V3' FROM be WHERE weight = '0'",
    ),
)
def v3(spark, sf):
    return _only(spark, sf, validation.check_fields, "V3")


@query(
    "v4_identifiers",
    _sql(
        "li be rg",
        "SELECT config_id, concat('backends[', pos, '].name') AS path, 'V4' AS rule FROM be WHERE name = 'Two Words' "
        "UNION ALL SELECT DISTINCT config_id, concat('regions[', region_pos, '].name'), 'V4' FROM rg WHERE region = '-first'",
    ),
)
def v4(spark, sf):
    return _only(spark, sf, validation.check_fields, "V4")


@query(
    "v5_enumerations",
    _sql(
        "li dep ls",
        "SELECT config_id, 'logging.level' AS path, 'V5' AS rule FROM dep WHERE log_level = 'chatty' "
        "UNION ALL SELECT config_id, 'routing.policy', 'V5' FROM dep WHERE policy = 'dice' "
        "UNION ALL SELECT config_id, concat('listeners[', pos, '].transport'), 'V5' FROM ls WHERE transport = 'quic'",
    ),
)
def v5(spark, sf):
    return _only(spark, sf, validation.check_fields, "V5")


@query(
    "v6_timeout",
    _sql("dep", "SELECT config_id, 'upstream.timeout' AS path, 'V6' AS rule FROM dep WHERE timeout IN ('75', '90s', '900us')"),
)
def v6(spark, sf):
    return _only(spark, sf, validation.check_fields, "V6")


@query(
    "v7_addresses",
    _sql(
        "li dep be ls rg",
        "SELECT config_id, 'admin.address' AS path, 'V7' AS rule FROM dep WHERE admin_address = 'unset' "
        "UNION ALL SELECT config_id, concat('listeners[', pos, '].address'), 'V7' FROM ls WHERE address = '127.0.0.999' "
        f"UNION ALL SELECT config_id, concat('backends[', pos, '].address'), 'V7' FROM be WHERE NOT ({_addr('address')}) "
        "UNION ALL SELECT config_id, concat('regions[', region_pos, '].client_cidrs[', cidr_pos, ']'), 'V7' FROM rg WHERE cidr IN ('10.9.0.1/12', '10.9.0.0', '10.9.0.0/40')",
    ),
)
def v7(spark, sf):
    return _only(spark, sf, validation.check_fields, "V7")


def _dupes(rule: str, source: str, keys: str, path: str, text: str) -> str:
    return (
        f"SELECT config_id, '{path}' AS path, '{rule}' AS rule, {text} AS message FROM (SELECT config_id, {keys}, count(*) AS n FROM {source} GROUP BY ALL) "
        "JOIN (SELECT unnest(range(2, 50)) AS i) ON i <= n"
    )


def _dup(spark, sf, rule):
    return validation.check_duplicates(v.inventory(spark, sf)).filter(F.col("rule") == rule)


@query(
    "v8_duplicate_listener",
    _sql("li ls okl", _dupes("V8", "okl", "address, port, transport", "listeners", "concat('repeated ', address, ':', port, '/', transport)")),
)
def v8(spark, sf):
    return _dup(spark, sf, "V8")


@query(
    "v9_admin_collision",
    _sql(
        "li dep ls okl adm",
        "SELECT config_id, 'admin' AS path, 'V9' AS rule, concat(address, ':', port, ' serves both admin and tcp') AS message "
        "FROM okl JOIN adm USING (config_id, address, port) WHERE transport = 'tcp'",
    ),
)
def v9(spark, sf):
    return _dup(spark, sf, "V9")


@query(
    "v10_duplicate_region",
    _sql(
        "li rg okr",
        _dupes("V10", "(SELECT DISTINCT config_id, region_pos, region FROM okr)", "region", "regions", "concat('repeated ', region)"),
    ),
)
def v10(spark, sf):
    return _dup(spark, sf, "V10")


@query(
    "v11_shared_cidr",
    _sql(
        "li rg okr",
        "SELECT config_id, 'regions' AS path, 'V11' AS rule, concat(cidr, ': ', earlier, ', ', region) AS message FROM ("
        "SELECT config_id, cidr, region, lag(region) OVER (PARTITION BY config_id, cidr ORDER BY region_pos) AS earlier FROM ("
        "SELECT config_id, cidr, region_pos, min(region) AS region FROM okr "
        "WHERE cidr NOT IN ('10.9.0.1/12', '10.9.0.0', '10.9.0.0/40') GROUP BY ALL)) WHERE earlier IS NOT NULL",
    ),
)
def v11(spark, sf):
    return _dup(spark, sf, "V11")


@query(
    "v11_claim_counts",
    _sql(
        "li rg okr",
        "SELECT config_id, cidr, entries, entries * (entries - 1) // 2 AS pairs FROM ("
        "SELECT config_id, cidr, count(DISTINCT region_pos) AS entries FROM okr "
        "WHERE cidr NOT IN ('10.9.0.1/12', '10.9.0.0', '10.9.0.0/40') GROUP BY ALL) WHERE entries > 1",
    ),
)
def v11_counts(spark, sf):
    return validation.claim_counts(validation.named_regions(v.inventory(spark, sf)))


@query(
    "v12_duplicate_backend",
    _sql("li be okb", _dupes("V12", "okb", "name", "backends", "concat('repeated ', name)")),
)
def v12(spark, sf):
    return _dup(spark, sf, "V12")


@query(
    "v13_duplicate_endpoint",
    _sql("li be okb", _dupes("V13", "okb", "address, port", "backends", "concat('repeated ', address, ':', port)")),
)
def v13(spark, sf):
    return _dup(spark, sf, "V13")


@query(
    "v14_summary",
    _sql(
        "li dep be ls rg okl okb okr",
        "SELECT config_id, CASE WHEN policy = 'dice' THEN 'round_robin' ELSE policy END AS policy, "
        "CASE WHEN timeout IN ('2s', '1500us') THEN timeout ELSE '800ms' END AS timeout, coalesce(l.n, 0) AS listeners, coalesce(b.n, 0) AS backends, coalesce(r.n, 0) AS regions "
        "FROM dep LEFT JOIN (SELECT config_id, count(*) AS n FROM okl GROUP BY 1) l USING (config_id) "
        "LEFT JOIN (SELECT config_id, count(*) AS n FROM okb GROUP BY 1) b USING (config_id) "
        "LEFT JOIN (SELECT config_id, count(DISTINCT region_pos) AS n FROM okr GROUP BY 1) r USING (config_id)",
    ),
)
def v14(spark, sf):
    return validation.summary(v.inventory(spark, sf))


@query(
    "s3_load_inventory",
    _sql(
        "li be",
        "SELECT config_id, pos, name, coalesce(port, '53') AS port, coalesce(weight, '1') AS weight FROM be",
    ),
)
def s3(spark, sf):
    from dnslens.sources.inventory import with_defaults

    return with_defaults(v.inventory(spark, sf))["dim_backend"].select("config_id", "pos", "name", "port", "weight")
