"""Streams give the rows of their batch twins, also on shuffled many-file input."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dnslens.operators import health, ratelimit, scoring, telemetry
from dnslens.operators.asof import asof_snapshot
from dnslens.operators.correlate import outcomes
from dnslens.plans import views as v
from dnslens.streaming import jobs

S = 1_000_000
T0 = 1_000 * S  # a watermark starts at zero, so times must not


def as_stream(spark, df, path, files, delay_order=None):
    """Write ``df`` as files of a few rows and read them back one per trigger."""
    pdf = df.toPandas()
    step = max(1, len(pdf) // files)
    for i in range(0, len(pdf), step):
        part = spark.createDataFrame(pdf.iloc[i : i + step], df.schema)
        part.coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def same(a, b):
    a, b = a.toPandas(), b.toPandas()
    a = a.sort_values(list(a.columns)).reset_index(drop=True)
    b = b[a.columns].sort_values(list(a.columns)).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


@pytest.fixture
def finish(tmp_path):
    return lambda df: jobs.run_to_end(df, str(tmp_path / "out"), str(tmp_path / "state"))


def jitter(rows, spread, seed=1):
    rng = random.Random(seed)
    return sorted(rows, key=lambda r: r[0] + rng.uniform(0, spread))


def test_rates_with_late_rows(spark, tmp_path, finish):
    rng = random.Random(2)
    rows = jitter([(i * 100_000, rng.choice("ab"), rng.choice(["ok", "error", "timeout"])) for i in range(400)], 1.5 * S)
    rows.append((400 * S, "end", "ok"))
    df = spark.createDataFrame(rows, "send_us long, backend string, outcome string").withColumn("ts", F.timestamp_micros("send_us"))
    df = df.withColumn("rcode_class", F.lit(None).cast("string"))
    got = finish(jobs.stream_rates(jobs.with_event_time(as_stream(spark, df, tmp_path / "in", 12)), "500 milliseconds"))
    want = telemetry.window_rates(df, 500_000).filter("backend <> 'end'")
    cols = ["window_us", "backend", "requests", "errors", "timeouts"]
    same(got.select(cols), want.select(cols))


def test_correlation_emits_timeouts(spark, sf_dir, tmp_path, finish):
    att, resp = v.attempts(spark, sf_dir), v.responses(spark, sf_dir)
    last = att.agg(F.max("send_us")).first()[0]
    a = as_stream(spark, att.drop("send_us", "deadline_us"), tmp_path / "a", 4)
    r = as_stream(spark, resp.drop("recv_us").filter("recv_ts IS NOT NULL"), tmp_path / "r", 4)
    got = finish(jobs.stream_correlate(a, r)).select("query_id", F.unix_micros("recv_ts").alias("recv_us"))
    want = outcomes(att, resp).select("query_id", "recv_us", "send_us")
    hits = want.filter("recv_us IS NOT NULL").select("query_id", "recv_us")
    same(got.filter("recv_us IS NOT NULL"), hits)
    # Attempts well before the end of the log have timed out by then.
    missing = want.filter(f"recv_us IS NULL AND send_us < {last} - {3600 * S}").select("query_id")
    assert missing.exceptAll(got.filter("recv_us IS NULL").select("query_id")).count() == 0
    assert got.groupBy("query_id").count().filter("count > 1").count() == 0


def test_stale_responses(spark, tmp_path, finish):
    rows = [(0, "a", 1, g, "h", g * S + d, "NOERROR", False) for g in range(40) for d in (0, 1000)]
    df = spark.createDataFrame(rows, "worker_id int, backend string, upstream_txid int, generation long, question_hash string, us long, rcode string, tc boolean")
    df = df.withColumn("recv_ts", F.timestamp_micros("us")).drop("us")
    assert finish(jobs.drop_stale(as_stream(spark, df, tmp_path / "in", 8))).count() == 40


def test_histogram(spark, tmp_path, finish):
    rng = random.Random(3)
    rows = jitter([(i * 50_000, "a", rng.randrange(1, 100_000)) for i in range(300)], S) + [(400 * S, "end", 1)]
    df = spark.createDataFrame(rows, "send_us long, backend string, latency_us long").withColumn("ts", F.timestamp_micros("send_us"))
    got = finish(jobs.stream_hist(jobs.with_event_time(as_stream(spark, df, tmp_path / "in", 6))))
    binned = df.withColumn("window_us", F.expr("send_us div 500000 * 500000")).filter("backend <> 'end'")
    same(got, telemetry.histogram(binned, "latency_us", ["window_us", "backend"]))


def closing(rows, last):
    return jitter(rows, 1.5 * S) + last


def test_health(spark, tmp_path, finish):
    rng = random.Random(6)
    rows, state = [], 0
    for i in range(200):
        state = rng.choice([0, 2]) if rng.random() < 0.1 else state
        rows.append((T0 + i * S, "a", 20, 0, 16 if state else 0, None, 1, 1 if state else 0, True))
    end = [(5_000 * S, "end", 1, 0, 0, None, 0, 0, True)]
    names = "window_us long, backend string, requests long, errors long, timeouts long, p95 double, probes long, probe_failures long, may_eject boolean"
    df = spark.createDataFrame(closing(rows, end), names).withColumn("ts", F.timestamp_micros("window_us"))
    src = jobs.with_event_time(as_stream(spark, df, tmp_path / "in", 10))
    got = finish(jobs.stream_health(src)).filter("backend = 'a'")
    want, _ = health.health_fold(health.HealthConfig())(pd.DataFrame(rows, columns=[c.split()[0] for c in names.split(", ")]), None)
    assert set(want["state"]) >= {"UNHEALTHY", "RECOVERING"}
    same(got, spark.createDataFrame(want, health.HEALTH_SCHEMA))


def test_rate_limit(spark, tmp_path, finish):
    rng = random.Random(7)
    rows = [(i * 500_000, 0, "x", i, rng.randrange(1, 5)) for i in range(2_000, 2_150)]
    end = [(5_000 * S, 0, "end", 10_000, 1)]
    df = spark.createDataFrame(closing(rows, end), "us long, worker_id int, prefix string, bin long, n long")
    df = df.withColumn("ts", F.timestamp_micros("us")).drop("us")
    src = jobs.with_event_time(as_stream(spark, df, tmp_path / "in", 6))
    got = finish(jobs.stream_rate_limit(src, 3.0, 4.0, 500_000)).filter("prefix = 'x'")
    want = ratelimit.bin_allowance(df.filter("prefix = 'x'").drop("ts"), 3.0, 4.0, 500_000)
    same(got, want)


@pytest.mark.parametrize("down", [None, 40 * S])
def test_ewma(spark, tmp_path, finish, down):
    rng = random.Random(8)
    rows = [(T0 + i * S, "a", float(rng.randrange(1, 1000))) for i in range(150)]
    end = [(5_000 * S, "end", 1.0)]
    df = spark.createDataFrame(closing(rows, end), "t_us long, backend string, x double").withColumn("ts", F.timestamp_micros("t_us"))
    src = jobs.with_event_time(as_stream(spark, df, tmp_path / "in", 6))
    got = finish(jobs.stream_ewma(src, ["backend"], "x", 10 * S, down)).filter("backend = 'a'").toPandas().sort_values("t_us")
    flat = df.filter("backend = 'a'")
    want = (
        telemetry.peak_ewma(flat, ["backend"], "x", 10 * S, down).withColumnRenamed("peak_ewma", "ewma")
        if down else telemetry.ewma(flat, ["backend"], "x", 10 * S)
    ).toPandas().sort_values("t_us")
    assert got["ewma"].tolist() == pytest.approx(want["ewma"].tolist(), rel=1e-9)
    assert len(got) == 150


def test_advice_smoothing(spark, tmp_path, finish):
    rng = random.Random(9)
    rows = []
    for i in range(80):
        x = rng.random()
        rows += [(T0 + i * S, "r", "a", x), (T0 + i * S, "r", "b", 1 - x)]
    end = [(5_000 * S, "end", "a", 1.0)]
    df = spark.createDataFrame(closing(rows, end), "t_us long, region string, backend string, weight double").withColumn("ts", F.timestamp_micros("t_us"))
    src = jobs.with_event_time(as_stream(spark, df, tmp_path / "in", 5))
    got = finish(jobs.stream_advice(src)).filter("region = 'r'").toPandas().sort_values(["t_us", "backend"])
    want = scoring.smooth(df.filter("region = 'r'")).toPandas().sort_values(["t_us", "backend"])
    assert got["smoothed"].tolist() == pytest.approx(want["smoothed"].tolist(), rel=1e-9)


def test_latest_table_is_read_per_batch(spark, tmp_path):
    snap = spark.createDataFrame([(1, 0)], "version long, published_us long")
    q = spark.createDataFrame([(1, 5)], "query_id long, arrival_us long")
    tables = iter([snap, snap.selectExpr("version + 1 AS version", "published_us")])
    seen = []
    step = jobs.with_latest(lambda: next(tables), asof_snapshot, lambda df, i: seen.append((i, df.first()["version"])))
    step(q, 0)
    step(q, 1)
    assert seen == [(0, 1), (1, 2)]


def test_state_of_an_idle_key_goes_and_the_last_rows_come_out(spark, tmp_path):
    """Buckets idle long enough to be full again are removed; the closing row lets the open end out."""
    rows = [(T0, 0, "idle", 1_000, 3)] + [(T0 + i * S, 0, "busy", 1_000 + i, 2) for i in range(120)]
    df = spark.createDataFrame(rows, "us long, worker_id int, prefix string, bin long, n long")
    df = df.withColumn("ts", F.timestamp_micros("us")).drop("us")
    folder, state = str(tmp_path / "closing"), str(tmp_path / "state")
    src = jobs.with_event_time(jobs.with_closing(as_stream(spark, df, tmp_path / "in", 8), folder))
    out = jobs.stream_rate_limit(src, 0.5, 4.0, S)

    def kept(variable):
        t = spark.read.format("statestore").option("stateVarName", variable).load(state)
        return sorted(r.key.prefix for r in t.select("key").distinct().collect())

    got = jobs.run_to_end(out, str(tmp_path / "out"), state)
    assert got.agg(F.max("bin")).first()[0] < 1_119
    # Eight seconds fill the bucket of four tokens; a hundred have passed.
    assert kept("folded") == ["busy"]
    got = jobs.run_to_end(out, str(tmp_path / "out"), state, closing=(folder, df.schema, "ts"))
    same(got, ratelimit.bin_allowance(df.drop("ts"), 0.5, 4.0, S))
    assert kept("folded") == kept("waiting") == []
