"""Explicit schemas of the tables this package reads and writes."""

from __future__ import annotations

EDNS = "struct<present:boolean,udp_size:int,do:boolean,ecs_ip:string,ecs_plen:int>"

QUERY_LOG = (
    "query_id long, arrival_ts timestamp, worker_id int, listener_id int, client_ip string, "
    "client_family string, client_hi long, client_lo long, client_txid int, qname string, qtype int, "
    f"qclass int, question_hash string, transport string, edns {EDNS}"
)
UPSTREAM_ATTEMPTS = (
    "query_id long, attempt_no int, worker_id int, backend string, upstream_txid int, generation long, "
    "question_hash string, send_ts timestamp, deadline_ts timestamp"
)
RESPONSES = (
    "worker_id int, backend string, upstream_txid int, generation long, question_hash string, "
    "recv_ts timestamp, rcode string, tc boolean"
)
TELEMETRY = (
    "ts timestamp, worker_id int, backend string, queries long, responses map<string,long>, timeouts long, "
    "mismatches long, rate_limited long, retries long"
)
LATENCY_HIST = "ts timestamp, worker_id int, backend string, bucket int, cnt long"
PROBES = "ts timestamp, backend string, qname string, expected_rcode string, rcode string, rtt_us long, ok boolean"
ADVICE = "issued_ts timestamp, ttl_us long, region string, backend string, weight double"
SNAPSHOTS = (
    "version long, published_ts timestamp, policy string, region string, backend string, eligible boolean, "
    "weight double, ewma_us double, health string"
)
FAULTS = "fault_id string, run_id string, backend string, kind string, injected_ts timestamp, cleared_ts timestamp"
BENCH_RUNS = (
    "run_id string, scenario string, mode string, policy string, variant map<string,string>, rep int, "
    "started_ts timestamp, offered_qps double, git_commit string, config string, host string, "
    "transport string, workers int"
)
BENCH_SAMPLES = (
    "run_id string, seq long, region string, intended_ts timestamp, send_ts timestamp, recv_ts timestamp, "
    "status string"
)
HOST_SAMPLES = "run_id string, ts timestamp, process string, cpu_pct double, rss_bytes long"
TRACE_FEATURES = (
    "episode_id string, fault_type string, ts timestamp, region string, backend string, "
    "features map<string,double>, next_latency_us double"
)
METRICS = "ts timestamp, name string, labels map<string,string>, value double"

EVENT_LOG = "ts timestamp, level string, event string, fields map<string,string>, _corrupt string"

DEPLOYMENT = (
    "config_id string, workers string, admin_address string, admin_port string, log_level string, "
    "policy string, upstream_timeout string"
)
LISTENER = "config_id string, pos int, address string, port string, transport string"
REGION_CIDR = "config_id string, region_pos int, cidr_pos int, region string, cidr string"
BACKEND = (
    "config_id string, pos int, name string, address string, port string, weight string, site string, "
    "capacity string"
)
RAW_KEYS = "config_id string, path string, keys array<string>"

INVENTORY = {
    "dim_deployment": DEPLOYMENT,
    "dim_listener": LISTENER,
    "dim_region_cidr": REGION_CIDR,
    "dim_backend": BACKEND,
    "raw_keys": RAW_KEYS,
}

FACTS = {
    "query_log": QUERY_LOG,
    "upstream_attempts": UPSTREAM_ATTEMPTS,
    "responses": RESPONSES,
    "telemetry_counters": TELEMETRY,
    "latency_hist": LATENCY_HIST,
    "probes": PROBES,
    "routing_snapshots": SNAPSHOTS,
    "advice": ADVICE,
    "faults": FAULTS,
    "bench_runs": BENCH_RUNS,
    "bench_samples": BENCH_SAMPLES,
    "host_samples": HOST_SAMPLES,
    "trace_features": TRACE_FEATURES,
}
