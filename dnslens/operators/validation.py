"""Checks over a fleet of deployment inventories: one row per problem.

Raw columns are strings, so bad values survive until they are reported. Every problem is
listed, not only the first. Cross-checks (duplicates, collisions) use only the rows whose
own fields are valid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnslens.functions.durations import duration_text, duration_us
from dnslens.functions.netaddr import nets_of, normalise_addresses, normalise_cidrs
from dnslens.operators.policies import NAMES
from dnslens.operators.prepare import LEVELS
from dnslens.operators.scans import running

# Limits and allowed names.
PORT = (1, 65535)
WORKERS = (1, 256)
WEIGHT = (1, 10000)
TIMEOUT_US = (1_000, 60_000_000)
IDENTIFIER = "^[a-z0-9][a-z0-9_-]{0,62}$"
TRANSPORTS = ("udp", "tcp")
ALLOWED_KEYS = {
    "": ("listeners", "workers", "admin", "logging", "regions", "backends", "routing", "upstream"),
    "listeners": ("address", "port", "transport"),
    "admin": ("address", "port"),
    "logging": ("level",),
    "regions": ("name", "client_cidrs"),
    "backends": ("name", "address", "port", "weight", "site"),
    "routing": ("policy",),
    "upstream": ("timeout",),
}

_COLUMNS = ("config_id", "path", "rule", "message")


def _integer_sql(col: str) -> str:
    return f"CASE WHEN rlike({col}, '^[+-]?[0-9]+$') THEN try_cast({col} AS BIGINT) END"


def _in_list(col: str, allowed: tuple[str, ...]) -> str:
    names = ", ".join(f"'{x}'" for x in allowed)
    return f"{col} IN ({names})"


def _bad_int(col: str, bounds: tuple[int, int]) -> str:
    return f"{col} IS NOT NULL AND NOT coalesce(({_integer_sql(col)}) BETWEEN {bounds[0]} AND {bounds[1]}, false)"


def _bad_identifier(col: str) -> str:
    return f"{col} IS NOT NULL AND (NOT rlike({col}, '{IDENTIFIER}') OR contains({col}, '\n'))"


def _problems(t: DataFrame, checks: list[tuple[str, str, str, str]]) -> DataFrame:
    """Rows of (condition, path, rule, message) turned into violations in one pass."""
    items = ", ".join(
        f"CASE WHEN {cond} THEN named_struct('path', {path}, 'rule', '{rule}', 'message', '{message}') END"
        for cond, path, rule, message in checks
    )
    return t.selectExpr("config_id", f"explode(filter(array({items}), x -> x IS NOT NULL)) AS v").selectExpr(
        "config_id", "v.path", "v.rule", "v.message"
    )


def check_fields(dims: dict[str, DataFrame]) -> DataFrame:
    """V3-V7 and the per-row part of V1: rules that look at one row only."""
    dep = normalise_addresses(dims["dim_deployment"], "admin_address", "admin")
    dep = dep.withColumn("timeout_us", duration_us(F.col("upstream_timeout")))
    low, high = TIMEOUT_US
    deployment = _problems(
        dep,
        [
            (f"workers <> 'auto' AND {_bad_int('workers', WORKERS)}", "'workers'", "V3", f"not a whole number from {WORKERS[0]} to {WORKERS[1]}"),
            ("admin_address IS NOT NULL AND NOT admin_ok", "'admin.address'", "V7", "not an address"),
            (_bad_int("admin_port", PORT), "'admin.port'", "V3", f"not a whole number from {PORT[0]} to {PORT[1]}"),
            (f"log_level IS NOT NULL AND NOT {_in_list('log_level', LEVELS)}", "'logging.level'", "V5", "not one of the levels"),
            (f"policy IS NOT NULL AND NOT {_in_list('policy', NAMES)}", "'routing.policy'", "V5", "not one of the policies"),
            ("upstream_timeout IS NOT NULL AND timeout_us IS NULL", "'upstream.timeout'", "V6", "not a duration"),
            (f"timeout_us NOT BETWEEN {low} AND {high}", "'upstream.timeout'", "V6", f"outside {low} to {high} microseconds"),
        ],
    )
    at = "concat('listeners[', pos, '].{}')"
    listener = _problems(
        normalise_addresses(dims["dim_listener"], "address", "a"),
        [
            ("address IS NULL", at.format("address"), "V1", "absent"),
            ("port IS NULL", at.format("port"), "V1", "absent"),
            ("address IS NOT NULL AND NOT a_ok", at.format("address"), "V7", "not an address"),
            (_bad_int("port", PORT), at.format("port"), "V3", f"not a whole number from {PORT[0]} to {PORT[1]}"),
            (f"transport IS NOT NULL AND NOT {_in_list('transport', TRANSPORTS)}", at.format("transport"), "V5", "not one of the transports"),
        ],
    )
    at = "concat('backends[', pos, '].{}')"
    backend = _problems(
        normalise_addresses(dims["dim_backend"], "address", "a"),
        [
            ("name IS NULL", at.format("name"), "V1", "absent"),
            ("address IS NULL", at.format("address"), "V1", "absent"),
            ("site IS NULL", at.format("site"), "V1", "absent"),
            (_bad_identifier("name"), at.format("name"), "V4", "not a name"),
            (_bad_identifier("site"), at.format("site"), "V4", "not a name"),
            ("address IS NOT NULL AND NOT a_ok", at.format("address"), "V7", "not an address"),
            (_bad_int("port", PORT), at.format("port"), "V3", f"not a whole number from {PORT[0]} to {PORT[1]}"),
            (_bad_int("weight", WEIGHT), at.format("weight"), "V3", f"not a whole number from {WEIGHT[0]} to {WEIGHT[1]}"),
        ],
    )
    regions = normalise_cidrs(dims["dim_region_cidr"], "cidr", "net")
    cidr = _problems(
        regions,
        [
            (
                "cidr IS NOT NULL AND net_error IS NOT NULL",
                "concat('regions[', region_pos, '].client_cidrs[', cidr_pos, ']')", "V7", "not a network",
            ),
        ],
    )
    # One row per region entry for the rules about the entry itself.
    entries = dims["dim_region_cidr"].groupBy("config_id", "region_pos", "region").agg(
        F.count("cidr").alias("n"), F.max("cidr_pos").alias("last_pos")
    )
    at = "concat('regions[', region_pos, '].{}')"
    region = _problems(
        entries,
        [
            ("region IS NULL", at.format("name"), "V1", "absent"),
            (_bad_identifier("region"), at.format("name"), "V4", "not a name"),
            ("last_pos IS NULL", at.format("client_cidrs"), "V1", "absent"),
            ("last_pos IS NOT NULL AND n = 0", at.format("client_cidrs"), "V7", "holds no network"),
        ],
    )
    return reduce(DataFrame.unionByName, [deployment, listener, backend, cidr, region])


def check_required(dims: dict[str, DataFrame]) -> DataFrame:
    """V1: deployments without any listener or backend."""
    def missing(table: str, path: str, what: str) -> DataFrame:
        return (
            dims["dim_deployment"].select("config_id").join(dims[table].select("config_id"), "config_id", "left_anti")
            .select("config_id", F.lit(path).alias("path"), F.lit("V1").alias("rule"), F.lit(what).alias("message"))
        )

    return missing("dim_listener", "listeners", "no row").unionByName(
        missing("dim_backend", "backends", "no row")
    )


def check_keys(dims: dict[str, DataFrame]) -> DataFrame:
    """V2: keys that the section does not know."""
    section = F.expr("regexp_extract(path, '^[a-z_]*', 0)")
    allowed = F.create_map(
        *[x for k, names in ALLOWED_KEYS.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in names]))]
    )
    unknown = F.array_except("keys", F.coalesce(allowed[section], F.array().cast("array<string>")))
    return (
        dims["raw_keys"]
        .select("config_id", "path", F.explode(unknown).alias("key"))
        .selectExpr(
            "config_id",
            "CASE WHEN path = '' THEN key ELSE concat(path, '.', key) END AS path",
            "'V2' AS rule",
            "'key of no use here' AS message",
        )
    )


def valid_listeners(dims: dict[str, DataFrame]) -> DataFrame:
    """Listeners whose own fields are valid, with canonical address and defaults."""
    t = normalise_addresses(dims["dim_listener"], "address", "a")
    return t.filter(
        f"a_ok AND port IS NOT NULL AND NOT ({_bad_int('port', PORT)}) AND coalesce({_in_list('transport', TRANSPORTS)}, true)"
    ).selectExpr("config_id", "pos", "a_text AS address", f"{_integer_sql('port')} AS port", "coalesce(transport, 'udp') AS transport")


def valid_backends(dims: dict[str, DataFrame]) -> DataFrame:
    t = normalise_addresses(dims["dim_backend"], "address", "a")
    return t.filter(
        f"a_ok AND name IS NOT NULL AND site IS NOT NULL AND NOT ({_bad_identifier('name')}) AND NOT ({_bad_identifier('site')}) "
        f"AND NOT coalesce({_bad_int('port', PORT)}, false) AND NOT coalesce({_bad_int('weight', WEIGHT)}, false)"
    ).selectExpr(
        "config_id", "pos", "name", "a_text AS address", f"coalesce({_integer_sql('port')}, 53) AS port",
        f"coalesce({_integer_sql('weight')}, 1) AS weight", "site",
    )


def admin_endpoints(dims: dict[str, DataFrame]) -> DataFrame:
    """The admin endpoint of every deployment; defaults replace absent or bad parts."""
    t = normalise_addresses(dims["dim_deployment"], "admin_address", "a")
    return t.selectExpr(
        "config_id",
        "CASE WHEN a_ok THEN a_text ELSE '127.0.0.1' END AS address",
        f"CASE WHEN admin_port IS NULL OR ({_bad_int('admin_port', PORT)}) THEN 8053 ELSE {_integer_sql('admin_port')} END AS port",
    )


def _repeats(t: DataFrame, keys: list[str], path: str, rule: str, message: str) -> DataFrame:
    """n - 1 violations for n rows with equal keys."""
    groups = t.groupBy("config_id", *keys).agg(F.count("*").alias("n")).filter("n > 1")
    return groups.selectExpr(
        "config_id", "explode(sequence(2, cast(n AS INT))) AS i", f"'{path}' AS path", f"'{rule}' AS rule", f"{message} AS message"
    ).select(*_COLUMNS)


def check_duplicates(dims: dict[str, DataFrame]) -> DataFrame:
    """V8-V13: duplicates and collisions inside a deployment."""
    listeners, backends = valid_listeners(dims), valid_backends(dims)
    v8 = _repeats(
        listeners, ["address", "port", "transport"], "listeners", "V8",
        "concat('repeated ', address, ':', port, '/', transport)",
    )
    v9 = (
        listeners.filter("transport = 'tcp'").join(admin_endpoints(dims), ["config_id", "address", "port"])
        .selectExpr(
            "config_id", "'admin' AS path", "'V9' AS rule",
            "concat(address, ':', port, ' serves both admin and tcp') AS message",
        )
    )
    named = named_regions(dims)
    entries = named.select("config_id", "region_pos", "region").distinct()
    v10 = _repeats(entries, ["region"], "regions", "V10", "concat('repeated ', region)")
    v11 = _shared_cidrs(named)
    v12 = _repeats(backends, ["name"], "backends", "V12", "concat('repeated ', name)")
    v13 = _repeats(
        backends, ["address", "port"], "backends", "V13", "concat('repeated ', address, ':', port)"
    )
    return reduce(DataFrame.unionByName, [v8, v9, v10, v11, v12, v13])


def named_regions(dims: dict[str, DataFrame]) -> DataFrame:
    """Prefixes of region entries whose name is valid."""
    return dims["dim_region_cidr"].filter(f"region IS NOT NULL AND NOT ({_bad_identifier('region')})")


#: Region entries of one claimed prefix that one task puts in order.
CLAIM_SPAN = 65_536

_CLAIM = ["config_id", "family", "net_hi", "net_lo", "plen"]


def cidr_claims(named: DataFrame) -> DataFrame:
    """One row for each prefix that a region entry claims, however often the entry lists it: the claim, region_pos,
    region, cidr (the least of its spellings)."""
    nets = nets_of(named.select("config_id", "region_pos", "region", "cidr"), "cidr")
    return nets.groupBy(*_CLAIM, "region_pos").agg(F.min("region").alias("region"), F.min("cidr").alias("cidr"))


def claim_counts(named: DataFrame) -> DataFrame:
    """(config_id, cidr, entries, pairs) of every prefix that several region entries of a deployment claim."""
    n = cidr_claims(named).groupBy(*_CLAIM).agg(F.min("cidr").alias("cidr"), F.count("*").alias("entries"))
    return n.filter("entries > 1").selectExpr("config_id", "cidr", "entries", "entries * (entries - 1) div 2 AS pairs")


def _shared_cidrs(named: DataFrame, every_pair: bool = False) -> DataFrame:
    """V11: the same prefix in several region entries of one deployment.

    The claimants of a prefix form a chain in the order of their entries: each but the first is reported with the one
    before it, so n claimants give n - 1 rows, and a prefix that a third of all entries claim is scanned in spans.
    ``every_pair`` reports each claimant with all others instead, n (n - 1) / 2 rows.
    """
    claims = cidr_claims(named)
    if every_pair:
        a = claims.select(*_CLAIM, F.col("region_pos").alias("i"), F.col("region").alias("earlier"), "cidr")
        met = a.join(claims.select(*_CLAIM, "region_pos", "region"), _CLAIM).filter("i < region_pos")
    else:
        placed = claims.withColumn("at", F.col("region_pos").cast("long"))
        # Positions are read without parsing a prefix: with all of them in one span nothing is carried between spans.
        beyond = named.filter(f"NOT (region_pos >= 0 AND region_pos < {CLAIM_SPAN})")
        if beyond.isEmpty():
            order = Window.partitionBy(*_CLAIM, F.expr(f"floor(at / {CLAIM_SPAN})")).orderBy("at")
            met = placed.withColumn("earlier", F.lag("region").over(order))
        else:
            met = running(placed, _CLAIM, "at", before={"earlier": F.col("region")}, cell=CLAIM_SPAN)
        met = met.filter("earlier IS NOT NULL")
    return met.selectExpr(
        "config_id", "'regions' AS path", "'V11' AS rule", "concat(cidr, ': ', earlier, ', ', region) AS message"
    )


def validate_inventory(dims: dict[str, DataFrame]) -> DataFrame:
    """All violations: (config_id, path, rule, message)."""
    parts = [check_fields(dims), check_required(dims), check_keys(dims), check_duplicates(dims)]
    return reduce(DataFrame.unionByName, [p.select(*_COLUMNS) for p in parts])


def summary(dims: dict[str, DataFrame]) -> DataFrame:
    """V14: counts, policy and timeout of every deployment (accepted rows only)."""
    def count(t: DataFrame, name: str) -> DataFrame:
        return t.groupBy("config_id").agg(F.count("*").alias(name))

    named = named_regions(dims)
    entries = named.select("config_id", "region_pos").distinct()
    us = duration_us(F.col("upstream_timeout"))
    t = dims["dim_deployment"].withColumn("us", F.when(us.between(*TIMEOUT_US), us).otherwise(F.lit(800_000)))
    policy = F.when(F.col("policy").isin(*NAMES), F.col("policy")).otherwise(F.lit("round_robin"))
    t = t.select("config_id", policy.alias("policy"), duration_text(F.col("us")).alias("timeout"))
    for part, name in ((valid_listeners(dims), "listeners"), (valid_backends(dims), "backends"), (entries, "regions")):
        t = t.join(count(part, name), "config_id", "left")
    return t.na.fill(0, ["listeners", "backends", "regions"])

