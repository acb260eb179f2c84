"""The plans have the shape that scales."""

import re

import pytest

from dnslens.plans import views as v
from dnslens.plans.catalog import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_region_lookup_is_a_broadcast_equi_join(spark, sf_dir):
    p = plan(v.queries_with_region(spark, sf_dir))
    assert "BroadcastHashJoin" in p
    assert "Exchange hashpartitioning" not in p


@pytest.mark.parametrize(
    "name", [n for n in sorted(QUERIES) if n[:2] in ("j1", "j3", "j6", "a1", "a3", "a6") or n.startswith(("r_wt", "r_geo", "w2", "w3", "p"))]
)
def test_no_nested_loops_and_no_python(spark, sf_dir, name):
    p = plan(QUERIES[name](spark, sf_dir))
    assert "NestedLoop" not in p and "CartesianProduct" not in p
    assert "Python" not in p and "InPandas" not in p


def test_top_k_limits_inside_groups(spark, sf_dir):
    assert "WindowGroupLimit" in plan(QUERIES["t3_top_k"](spark, sf_dir))


def test_counts_are_combined_before_the_shuffle(spark, sf_dir):
    p = plan(QUERIES["a4_merge_hist"](spark, sf_dir))
    assert p.count("HashAggregate") >= 4


def test_scan_reads_only_what_is_needed(spark, sf_dir):
    p = plan(QUERIES["p1_filter_level"](spark, sf_dir))
    schema = p[p.index("ReadSchema"):].splitlines()[0]
    assert "value" not in schema and "props" not in schema


def test_level_filter_reaches_the_scan(spark, tmp_path):
    from dnslens.operators.prepare import filter_level

    spark.createDataFrame([("info",)], "level string").write.parquet(str(tmp_path / "t"))
    p = plan(filter_level(spark.read.parquet(str(tmp_path / "t")), "warn"))
    assert "PushedFilters: [In(level, [error,warn])]" in p


def test_running_values_never_window_a_bare_key(spark, sf_dir):
    """Row-level windows partition by (key, chunk); only chunk totals use the key alone."""
    p = plan(QUERIES["w2_inflight"](spark, sf_dir))
    windows = [x for x in p.splitlines() if "Window [" in x]
    assert any("__ids" in x or "__cell" in x for x in windows)


def test_cursor_does_not_shuffle_the_written_ranges(spark, sf_dir):
    """Only totals of (worker, range) are shuffled after the ranges are written."""
    p = plan(QUERIES["w1_cursor"](spark, sf_dir))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
    assert all("__n" in x or "min(__at" in x or "sum" in x for x in p.splitlines() if "Window [" in x)


def test_fault_lookups_make_no_rows_of_faults_and_bins(spark, sf_dir):
    """Bins and faults of a run meet on one timeline: no join has the run alone as its key."""
    for name in ("h3_recovery_time", "w11_time_to_shift"):
        p = plan(QUERIES[name](spark, sf_dir))
        keys = re.findall(r"Join \[([^\]]*)\]", p)
        assert "NestedLoop" not in p and not [k for k in keys if re.fullmatch(r"run_id#\d+", k)]
