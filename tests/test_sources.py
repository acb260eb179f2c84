import json

from pyspark.sql import functions as F

from dnslens.operators import telemetry
from dnslens.plans import views as v
from dnslens.sources import event_log, facts, sinks
from dnslens.sources.inventory import explode_regions


def test_event_log_round_trip(spark, tmp_path):
    odd = "tab\t, \\ and \"both\" ends\r\nüñ [1]"
    rows = [
        ("2031-02-08T23:59:59.120007Z", "error", "cache_flush", {"node": "oslo", "items": "1200"}),
        ("2031-02-09T00:00:00Z", "debug", "note", {"body": odd, "": "unnamed"}),
        ("2031-02-09T00:00:01.5Z", "info", "shadow", {"ts": "never", "event": "other", "level": "none"}),
        ("2031-02-09T00:00:02Z", "warn", "bare", {}),
    ]
    t = spark.createDataFrame(rows, "ts string, level string, event string, fields map<string,string>")
    t = t.withColumn("ts", F.to_timestamp("ts"))
    path = str(tmp_path / "log")
    event_log.write_event_log(t.coalesce(1), path)
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert lines[0].startswith('{"ts":"2031-02-08T23:59:59.120007Z","level":"error","event":"cache_flush"')
    parsed = [json.loads(x) for x in lines]
    assert parsed[1]["body"] == odd
    assert parsed[2]["event"] == "shadow" and parsed[2]["field.event"] == "other" and parsed[2]["field.level"] == "none"
    assert list(parsed[3]) == ["ts", "level", "event"]
    broken = ["[1, 2", '{"level":7']
    spark.createDataFrame([(x,) for x in broken], "value string").write.mode("append").text(path)
    back = event_log.read_event_log(spark, path)
    assert back.filter("_corrupt IS NULL").count() == len(rows)
    assert sorted(r[0] for r in back.filter("_corrupt IS NOT NULL").select("_corrupt").collect()) == sorted(broken)
    row = back.filter("event = 'cache_flush'").first()
    assert row["fields"] == {"node": "oslo", "items": "1200"}


def test_facts_round_trip(spark, sf_dir, tmp_path):
    resp = v.responses(spark, sf_dir)
    cols = [c.split()[0] for c in facts.FACTS["responses"].split(", ")]
    facts.write_facts(resp.select(*cols), str(tmp_path), "responses")
    back = facts.read_facts(spark, str(tmp_path), names=["responses"])["responses"]
    assert back.count() == resp.count()
    plan = back.filter("dt = DATE '2024-01-05'").select("rcode")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan


def test_telemetry_stream(spark, tmp_path):
    rows = [("2026-01-01 00:00:00", 0, "a", 1, {"noerror": 1}, 0, 0, 0, 0)]
    t = spark.createDataFrame(rows, facts.FACTS["telemetry_counters"].replace("ts timestamp", "ts string"))
    facts.write_facts(t.withColumn("ts", F.to_timestamp("ts")), str(tmp_path), "telemetry_counters")
    s = facts.stream_telemetry(spark, str(tmp_path))
    assert s.isStreaming
    q = s.writeStream.format("memory").queryName("polls").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("polls").count() == 1


def test_advice_batches_are_idempotent(spark, tmp_path):
    t = spark.createDataFrame([("r", "a", 1.0)], "region string, backend string, weight double")
    path = str(tmp_path / "advice")
    for _ in range(2):
        sinks.write_advice(t, path, 500_000, batch_id=3)
    back = spark.read.parquet(path)
    assert back.count() == 1 and back.first()["ttl_us"] == 500_000


def test_metrics_and_results(spark, sf_dir, tmp_path):
    done = v.outcomes(spark, sf_dir)
    counts = done.groupBy("backend").agg(F.count("*").alias("n"))
    m = telemetry.metric_samples(counts, "dns_backend_requests_total", ["backend"], F.col("n"))
    sinks.write_metrics(m, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).filter("name = 'dns_backend_requests_total'").count() == 4
    res = spark.createDataFrame([("r1", 1.5, None, {"k": "v"})], "run_id string, p50 double, p99 double, variant map<string,string>")
    sinks.write_results(res, str(tmp_path / "r"))
    row = spark.read.option("header", True).csv(str(tmp_path / "r" / "csv")).first()
    assert row["p99"] == "NOT MEASURED" and row["variant"] == '{"k":"v"}'
    assert spark.read.json(str(tmp_path / "r" / "json")).count() == 1


def test_alerts(spark, tmp_path):
    states = spark.createDataFrame(
        [("a", 1_000_000, "DEGRADED", "HEALTHY", "degraded_windows", 5), ("a", 2_000_000, "DEGRADED", "DEGRADED", None, 5)],
        "backend string, window_us long, state string, previous string, reason string, cooldown_us long",
    )
    write = sinks.alert_writer(str(tmp_path))
    write(states, 0)
    write(states, 0)
    rows = event_log.read_event_log(spark, str(tmp_path)).collect()
    assert [(r["event"], r["fields"]["from"], r["fields"]["to"]) for r in rows] == [("health_transition", "HEALTHY", "DEGRADED")]


def test_regions_explode(spark):
    t = spark.createDataFrame([("c", 0, "r", ["10.0.0.0/8", "x"]), ("c", 1, "s", [])], "config_id string, region_pos int, name string, client_cidrs array<string>")
    assert explode_regions(t).count() == 3
