"""The canonical tables, derived from the supplied data with Spark expressions.

Every view grows with ``events`` (or ``orders``/``lineitem`` for inventories). Times are
kept both as timestamp and as microseconds (``*_us``), which compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens.functions.netaddr import v4_text_sql
from dnslens.operators.correlate import outcomes as correlate_outcomes
from dnslens.operators.geo import region_lpm
from dnslens.operators.prepare import classify_outcome
from dnslens.session import shared_dir

HOUR = 3_600_000_000
BIN = 6 * HOUR
TIMEOUT_US = 200_000

# The derived fleet: one zone of client addresses for each of four supplied regions, side by side in the space shared
# by carriers, a pocket inside the second zone, and whatever the zones leave over. Zone i has a backend of weight 5 - i.
ZONES = ("africa", "america", "asia", "europe")
SHARED_SPACE, ZONE_BITS = 1_681_915_904, 20
BACKENDS = tuple((f"ns-{zone}", 5 - i, zone) for i, zone in enumerate(ZONES))
REGION_CIDRS = (
    *((zone, f"100.{64 + 16 * i}.0.0/12") for i, zone in enumerate(ZONES)),
    ("isthmus", "100.80.0.0/24"),
    ("elsewhere", "100.0.0.0/8"),
)
REGIONS = tuple(sorted(name for name, _ in REGION_CIDRS if name != "elsewhere"))
#: A client's address: its user's zone, and the user's number in it.
CLIENT = f"({SHARED_SPACE} + (user_id % {len(ZONES)}) * {1 << ZONE_BITS} + user_id % {1 << ZONE_BITS})"
# Preference tier and distance of each backend per region (our choice of numbers).
AFFINITY = tuple(
    (region, site, abs(i - j) % 3, float((i * 7 + j * 5) % 11))
    for i, region in enumerate(REGIONS)
    for j, (_, _, site) in enumerate(BACKENDS)
)
QTYPES = {"click": 1, "view": 28, "signup": 15, "purchase": 16, "error": 5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One supplied table; time columns become zoned timestamps in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.simpleString() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def shape_events(df: DataFrame) -> DataFrame:
    """The common columns of all event-derived views (also used on streams)."""
    return df.selectExpr(
        "event_id",
        "cast(ts AS TIMESTAMP) AS ts",
        "unix_micros(cast(ts AS TIMESTAMP)) AS t_us",
        "user_id",
        "event_type",
        "cast(floor(value * 1000 + 0.5) AS BIGINT) AS lat_us",
        "from_json(props, 'k INT').k AS k",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_events(table(spark, sf_dir, "events"))


def _choose(options: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), index.cast("int") + 1)


def _case(index: str, options: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(options))
    return f"CASE {index} {whens} END"


QTYPE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in QTYPES.items()) + " ELSE 1 END"
QNAME = "concat('q', k, '.example')"
QHASH = f"md5(concat_ws('/', lower({QNAME}), {QTYPE}, 1))"
BACKEND = _case("k % 4", [b[0] for b in BACKENDS])


def shape_queries(ev: DataFrame) -> DataFrame:
    lo = f"cast({CLIENT} AS BIGINT)"
    return ev.selectExpr(
        "event_id AS query_id",
        "ts AS arrival_ts",
        "t_us AS arrival_us",
        "cast(event_id % 2 AS INT) AS worker_id",
        "0 AS listener_id",
        f"{v4_text_sql(lo)} AS client_ip",
        "'v4' AS client_family",
        "0L AS client_hi",
        f"{lo} AS client_lo",
        "cast(event_id % 65536 AS INT) AS client_txid",
        f"{QNAME} AS qname",
        f"{QTYPE} AS qtype",
        "1 AS qclass",
        f"{QHASH} AS question_hash",
        "'udp' AS transport",
        # Every fifth query carries the subnet of the "next" region's population.
        "named_struct('present', event_id % 5 = 0, 'udp_size', 1232, 'do', false, "
        "'ecs_ip', CASE WHEN event_id % 5 = 0 THEN concat('100.', 64 + 16 * ((user_id + 1) % 4), '.0.77') END, "
        "'ecs_plen', CASE WHEN event_id % 5 = 0 THEN 24 END) AS edns",
    )


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_queries(events(spark, sf_dir))


def shape_attempts(ev: DataFrame) -> DataFrame:
    return ev.selectExpr(
        "event_id AS query_id",
        "1 AS attempt_no",
        "cast(event_id % 2 AS INT) AS worker_id",
        f"{BACKEND} AS backend",
        "cast((event_id * 7919) % 65536 AS INT) AS upstream_txid",
        "event_id AS generation",
        f"{QHASH} AS question_hash",
        "ts AS send_ts",
        f"timestamp_micros(t_us + {TIMEOUT_US}) AS deadline_ts",
        "t_us AS send_us",
        f"t_us + {TIMEOUT_US} AS deadline_us",
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_attempts(events(spark, sf_dir))


def shape_responses(ev: DataFrame) -> DataFrame:
    """Responses with the usual faults: lost, late, wrong id, wrong question, repeated."""
    return ev.filter(f"lat_us <= {TIMEOUT_US} OR event_id % 3 = 0").selectExpr(
        "*", "explode(CASE WHEN event_id % 41 = 0 THEN array(0, 500) ELSE array(0) END) AS copy"
    ).selectExpr(
        "cast(event_id % 2 AS INT) AS worker_id",
        f"{BACKEND} AS backend",
        "cast((event_id * 7919 + CASE WHEN event_id % 89 = 0 THEN 1 ELSE 0 END) % 65536 AS INT) AS upstream_txid",
        "event_id + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS generation",
        f"CASE WHEN event_id % 83 = 0 THEN 'other' ELSE {QHASH} END AS question_hash",
        "timestamp_micros(t_us + lat_us + copy) AS recv_ts",
        "t_us + lat_us + copy AS recv_us",
        "CASE event_type WHEN 'error' THEN 'SERVFAIL' WHEN 'signup' THEN 'NXDOMAIN' ELSE 'NOERROR' END AS rcode",
        "false AS tc",
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_responses(events(spark, sf_dir))


def _rows(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """A small fixed table as a local relation (no Python worker behind it)."""
    columns = zip(*rows)
    return spark.createDataFrame(pa.table({n: list(c) for n, c in zip(names.split(), columns)}))


def region_cidrs(spark: SparkSession) -> DataFrame:
    return _rows(spark, "region cidr", list(REGION_CIDRS))


def backends(spark: SparkSession) -> DataFrame:
    return _rows(spark, "backend weight site capacity", [(n, float(w), s, w * 1000.0) for n, w, s in BACKENDS])


def affinity(spark: SparkSession) -> DataFrame:
    return _rows(spark, "region site tier geo_distance", list(AFFINITY))


def queries_with_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region_lpm(query_log(spark, sf_dir), region_cidrs(spark))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per attempt with its outcome and the client's region."""
    done = correlate_outcomes(attempts(spark, sf_dir), responses(spark, sf_dir))
    return _classified(spark, sf_dir, done).withColumn("ts", F.col("send_ts"))


def _classified(spark: SparkSession, sf_dir: str, done: DataFrame) -> DataFrame:
    q = queries_with_region(spark, sf_dir).select("query_id", F.col("region"), "client_lo", "qname", "qtype")
    return classify_outcome(done.join(q, "query_id"))


def snapshots(spark: SparkSession, sf_dir: str, bin_us: int = BIN, done: DataFrame | None = None) -> DataFrame:
    """A published view per (bin, region, backend) of the bin's own telemetry.

    ``done`` is the attempts with their responses, where a query has matched them already.
    """
    per = (
        (outcomes(spark, sf_dir) if done is None else _classified(spark, sf_dir, done))
        .selectExpr(f"send_us div {bin_us} AS bin", "region", "backend", "outcome", "latency_us")
        .groupBy("bin", "region", "backend")
        .agg(
            F.expr("count(*) AS n"),
            F.expr("count_if(outcome IN ('timeout', 'error')) AS bad"),
            F.expr("sum(latency_us) AS lat_sum"),
            F.expr("count(latency_us) AS lat_n"),
        )
    )
    # Every version lists every cell, also those without traffic in the bin.
    cells = ", ".join(
        f"named_struct('region', '{r}', 'backend', '{b}', 'weight', {w}D, 'site', '{s}', 'i', {i})"
        for r in REGIONS
        for i, (b, w, s) in enumerate(BACKENDS)
    )
    grid = per.select("bin").distinct().selectExpr("bin", f"inline(array({cells}))")
    return grid.join(per, ["bin", "region", "backend"], "left").selectExpr(
        "bin AS version",
        f"(bin + 1) * {bin_us} AS published_us",
        f"timestamp_micros((bin + 1) * {bin_us}) AS published_ts",
        "'weighted' AS policy",
        "region",
        "backend",
        "site",
        "weight",
        "cast(coalesce(lat_sum div lat_n, 50000) AS DOUBLE) AS ewma_us",
        "CASE WHEN bad * 100 >= n * 45 THEN 'UNHEALTHY' WHEN bad * 100 >= n * 25 THEN 'DEGRADED' "
        "WHEN (bin + i) % 11 = 0 THEN 'RECOVERING' ELSE 'HEALTHY' END AS health",
        "NOT coalesce(bad * 100 >= n * 45, false) AS eligible",
        "coalesce(n, 0) AS n",
        "coalesce(bad, 0) AS bad",
    )


def stored(df: DataFrame) -> DataFrame:
    """The frame written out once below the shared folder.

    Snapshots and advice are small published tables (bins x regions x backends) that a
    query reads several times; deriving them from the log each time would repeat its joins.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def advice(spark: SparkSession, sf_dir: str, bin_us: int = BIN, snap: DataFrame | None = None) -> DataFrame:
    """Advice issued for every other bin, so that some of it has expired when used."""
    return (
        (snap if snap is not None else snapshots(spark, sf_dir, bin_us))
        .filter(F.col("version") % 2 == 0)
        .select(
            F.col("published_us").alias("issued_us"),
            F.col("published_ts").alias("issued_ts"),
            F.lit(bin_us).cast("long").alias("ttl_us"),
            "region",
            "backend",
            F.round(F.lit(10000.0) / F.col("ewma_us"), 6).alias("advice_weight"),
        )
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth event as a health probe of its backend."""
    ok = F.col("event_type") != "error"
    return (
        events(spark, sf_dir)
        .filter(F.col("event_id") % 10 == 0)
        .select(
            "ts",
            "t_us",
            _choose([b[0] for b in BACKENDS], F.col("k") % 4).alias("backend"),
            F.lit("health.example").alias("qname"),
            F.lit("NOERROR").alias("expected_rcode"),
            F.when(ok, F.lit("NOERROR")).otherwise(F.lit("SERVFAIL")).alias("rcode"),
            F.col("lat_us").alias("rtt_us"),
            ok.alias("ok"),
        )
    )


def shape_counters(ev: DataFrame, bin_us: int = BIN, restart: int = 40) -> DataFrame:
    """Per (bin, worker, backend) increments, before they are accumulated."""
    return ev.groupBy(
        F.floor(F.col("t_us") / bin_us).cast("long").alias("bin"),
        (F.col("event_id") % 2).cast("int").alias("worker_id"),
        _choose([b[0] for b in BACKENDS], F.col("k") % 4).alias("backend"),
    ).agg(
        F.count("*").alias("queries"),
        F.count_if(F.col("lat_us") > TIMEOUT_US).alias("timeouts"),
    ).withColumn("epoch", F.floor(F.col("bin") / restart).cast("long"))


def counters(spark: SparkSession, sf_dir: str, bin_us: int = BIN, restart: int = 40) -> DataFrame:
    """Cumulative counters that restart from zero every ``restart`` bins."""
    from dnslens.operators.scans import running

    inc = shape_counters(events(spark, sf_dir), bin_us, restart)
    acc = running(
        inc,
        ["worker_id", "backend", "epoch"],
        "bin",
        sums={"cum_queries": F.col("queries"), "cum_timeouts": F.col("timeouts")},
        cell=restart,
    )
    return acc.select(
        F.timestamp_micros((F.col("bin") + 1) * bin_us).alias("ts"),
        ((F.col("bin") + 1) * bin_us).alias("t_us"),
        "worker_id",
        "backend",
        F.col("cum_queries").cast("long").alias("queries"),
        F.col("cum_timeouts").cast("long").alias("timeouts"),
    )


# -- benchmark tables ---------------------------------------------------------------

POLICIES = ("round_robin", "latency_based")
SCENARIOS = ("scenario_01", "scenario_05")
REPS = 5


def shape_samples(ev: DataFrame) -> DataFrame:
    """Events dealt out to runs: 2 scenarios x 2 policies x 5 repetitions."""
    scenario = _case("event_id % 2", list(SCENARIOS))
    policy = _case("(event_id div 2) % 2", list(POLICIES))
    rep = f"cast((event_id div 4) % {REPS} AS INT)"
    sent = "(t_us + (event_id % 7) * 1000)"
    return ev.selectExpr(
        f"concat_ws('-', {scenario}, {policy}, {rep}) AS run_id",
        f"{scenario} AS scenario",
        f"{policy} AS policy",
        f"{rep} AS rep",
        f"CASE WHEN {rep} = 4 THEN 'A' ELSE 'B' END AS mode",
        "event_id AS seq",
        f"{_case('user_id % 4', [r[0] for r in REGION_CIDRS[:4]])} AS region",
        "t_us AS intended_us",
        f"{sent} AS send_us",
        f"CASE WHEN lat_us <= {TIMEOUT_US} THEN {sent} + lat_us END AS recv_us",
        f"CASE WHEN lat_us > {TIMEOUT_US} THEN 'timeout' WHEN event_type = 'error' THEN 'fail' ELSE 'ok' END AS status",
        f"{BACKEND} AS backend",
        f"{QNAME} AS qname",
        f"{QTYPE} AS qtype",
        "40 + k * 5 AS packet_bytes",
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_samples(events(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run metadata read off the samples."""
    return samples(spark, sf_dir).groupBy("run_id", "scenario", "policy", "rep", "mode").agg(
        F.min("intended_us").alias("started_us"),
        F.max("intended_us").alias("ended_us"),
        F.count("*").alias("offered"),
    )


def host_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).filter(F.col("seq") % 3 == 0).select(
        "run_id",
        F.col("intended_us").alias("t_us"),
        F.lit("lb").alias("process"),
        (F.col("packet_bytes") % 100).cast("double").alias("cpu_pct"),
        (F.col("packet_bytes") * 1000).cast("long").alias("rss_bytes"),
    )


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One injected fault per run, a third into its span, on a backend picked by run."""
    return runs(spark, sf_dir).select(
        F.concat(F.lit("f-"), F.col("run_id")).alias("fault_id"),
        "run_id",
        "scenario",
        _choose([b[0] for b in BACKENDS], F.col("rep") % 4).alias("backend"),
        F.lit("outage").alias("kind"),
        (F.col("started_us") + F.floor((F.col("ended_us") - F.col("started_us")) / 3)).cast("long").alias("injected_us"),
    )


# -- inventories: one deployment per order --------------------------------------------


def _text(col: Column) -> Column:
    return col.cast("string")


def inventory(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A fleet of deployments, some of them broken in every way the rules know."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        (F.col("l_linenumber") - 1).alias("pos"),
        F.col("l_suppkey").alias("s"),
        F.col("l_partkey").alias("p"),
        F.col("l_quantity").cast("int").alias("qty"),
        F.col("l_returnflag").alias("flag"),
    )
    i, p, s = F.col("id"), F.col("p"), F.col("s")
    policies = ["round_robin", "weighted", "least_inflight", "latency_based", "geo_aware", "health_aware", "adaptive"]
    deployment = o.select(
        _text(i).alias("config_id"),
        F.when(i % 7 == 0, F.lit("auto")).when(i % 37 == 1, F.lit("0")).when(i % 37 == 2, F.lit("abc"))
        .otherwise(_text(i % 64 + 1)).alias("workers"),
        F.when(i % 11 == 0, F.lit("unset")).when(i % 11 == 1, F.lit(None)).otherwise(F.lit("127.0.0.1")).alias("admin_address"),
        F.when(i % 13 == 0, F.lit("0")).when(i % 13 == 1, F.lit(None)).otherwise(F.lit("8053")).alias("admin_port"),
        F.when(i % 17 == 0, F.lit("chatty")).otherwise(F.lit("info")).alias("log_level"),
        F.when(i % 19 == 0, F.lit("dice")).otherwise(_choose(policies, i % 7)).alias("policy"),
        F.when(i % 23 == 0, F.lit("75")).when(i % 23 == 1, F.lit("90s")).when(i % 23 == 2, F.lit("900us"))
        .when(i % 23 == 3, F.lit(None)).when(i % 23 == 4, F.lit("2s")).when(i % 23 == 5, F.lit("1500us"))
        .otherwise(F.lit("800ms")).alias("upstream_timeout"),
    )
    backend = li.select(
        _text(i).alias("config_id"),
        F.col("pos").cast("int").alias("pos"),
        F.when(p % 37 == 0, F.lit("Two Words")).when(p % 37 == 1, F.lit(None)).otherwise(F.concat(F.lit("pop-"), _text(s % 20))).alias("name"),
        F.when(p % 41 == 0, F.lit("unset")).when(p % 41 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("10.0."), _text(s % 8), F.lit("."), _text(p % 3))).alias("address"),
        F.when(p % 43 == 0, F.lit("-7")).when(p % 2 == 0, F.lit(None)).otherwise(F.lit("5401")).alias("port"),
        F.when(p % 47 == 0, F.lit("0")).when(p % 47 == 1, F.lit(None)).otherwise(_text(F.col("qty"))).alias("weight"),
        F.when(p % 53 == 0, F.lit(None)).otherwise(F.concat(F.lit("site_"), _text(s % 5))).alias("site"),
        F.lit(None).cast("string").alias("capacity"),
    )
    listener = li.filter("pos < 2 and p % 97 <> 0").select(
        _text(i).alias("config_id"),
        F.col("pos").cast("int").alias("pos"),
        F.when(p % 31 == 0, F.lit("127.0.0.999")).otherwise(F.concat(F.lit("127.0.0."), _text(s % 2 + 1))).alias("address"),
        F.when(p % 29 == 0, F.lit("90001")).when(p % 29 == 1, F.lit(None)).otherwise(F.when(p % 2 == 0, F.lit("8053")).otherwise(F.lit("5353"))).alias("port"),
        F.when(p % 59 == 0, F.lit("quic")).when(F.col("flag") == "A", F.lit("udp")).when(F.col("flag") == "N", F.lit("tcp")).alias("transport"),
    )
    region = li.filter("pos < 3").select(
        _text(i).alias("config_id"),
        F.col("pos").cast("int").alias("region_pos"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("cidr_pos"),
        F.when(p % 61 == 0, F.lit("-first")).otherwise(F.concat(F.lit("r"), _text(s % 6))).alias("region"),
        "p",
        "s",
    ).select(
        "config_id",
        "region_pos",
        "cidr_pos",
        "region",
        F.when((p % 67 == 0) & (F.col("cidr_pos") == 0), F.lit("10.9.0.1/12"))
        .when((p % 71 == 0) & (F.col("cidr_pos") == 0), F.lit("10.9.0.0"))
        .when((p % 73 == 0) & (F.col("cidr_pos") == 0), F.lit("10.9.0.0/40"))
        .otherwise(F.concat(F.lit("10."), _text((p + F.col("cidr_pos")) % 8), F.lit(".0.0/16")))
        .alias("cidr"),
    )
    keys = (
        o.select(
            _text(i).alias("config_id"),
            F.lit("").alias("path"),
            F.when(i % 79 == 0, F.array(F.lit("listeners"), F.lit("backends"), F.lit("pollicy")))
            .otherwise(F.array(F.lit("listeners"), F.lit("backends"), F.lit("routing")))
            .alias("keys"),
        )
        .unionByName(
            li.select(
                _text(i).alias("config_id"),
                F.concat(F.lit("backends["), _text(F.col("pos")), F.lit("]")).alias("path"),
                F.when(p % 83 == 0, F.array(F.lit("name"), F.lit("address"), F.lit("owner")))
                .otherwise(F.array(F.lit("name"), F.lit("address"), F.lit("site")))
                .alias("keys"),
            )
        )
    )
    return {
        "dim_deployment": deployment,
        "dim_listener": listener,
        "dim_region_cidr": region,
        "dim_backend": backend,
        "raw_keys": keys,
    }


View = Callable[[SparkSession, str], DataFrame]
