"""What the physical plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from postlake.operators import traffic
from postlake.operators.running import keep_first, running, time_bucket, trailing_count
from postlake.plans import views as V

SF = "/root/testdata/sf0.001"
STREAMS = [n for n in entry.queries() if n.startswith("stream_")]
EAGER = STREAMS + ["alert_cooldown", "page_extraction"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {n: plan(q(spark, SF)) for n, q in entry.queries().items() if n not in EAGER}


def test_no_python_rows_and_no_cross_joins(plans):
    for name, text in plans.items():
        for bad in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "CartesianProduct",
                    "BroadcastNestedLoopJoin"):
            assert bad not in text, (name, bad)


def test_first_per_key_is_limited_before_the_shuffle(plans):
    for name in ("in_batch_first", "source_dedup", "insert_if_absent", "limit_per_source", "latency_stats_by_domain"):
        before_shuffle = plans[name].split("Exchange hashpartitioning")[-1]
        assert "WindowGroupLimit" in before_shuffle, name


def test_global_last_n_is_a_top_k(plans):
    for name in ("violation_history", "latency_stats"):
        assert "TakeOrderedAndProject" in plans[name], name


def test_no_window_over_everything(plans):
    """Windows without a partition only run over bucket summaries."""
    for name, text in plans.items():
        for order in re.findall(r"windowspecdefinition\((\w+)#\d+L? (?:ASC|DESC)", text):
            assert order == "_bucket", (name, order)


def test_projections_of_policies_need_no_join(plans):
    for name in ("policy_lookup", "delay_bounds", "backoff_waits", "cap_breaches"):
        assert "Join" not in plans[name], name
    assert "Exchange" not in plans["policy_lookup"] and "Exchange" not in plans["search_frontier"]


def test_scans_read_only_what_they_need(plans):
    schema = lambda n: re.findall(r"ReadSchema: struct<([^>]*)>", plans[n])
    assert schema("distinct_postings_per_domain") == ["page_id:bigint,url:string"]
    assert schema("page_domains") == ["page_id:bigint,url:string"]
    assert all("html" not in s for s in schema("canonical_url"))
    assert schema("cost_ledger") == ["l_quantity:double,l_returnflag:string,l_shipdate:timestamp_ntz"]
    assert schema("archive_manifest") == ["o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz"]


def test_filters_reach_the_scan(plans):
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", plans["latency_stats"])
    assert any("value" in p for p in pushed), pushed


def test_seen_store_joins_have_unique_sides(plans):
    """History is grouped before it is joined, so a hot hash cannot multiply."""
    text = plans["dedup_verdict"]
    assert text.count("HashAggregate") >= 6 and "SortAggregate" not in text


def test_a_hot_key_is_split_by_bucket(spark):
    rows = V.v_traffic(spark, SF).withColumn("domain", F.lit("hot"))
    for df in (trailing_count(rows, "domain", 60), running(rows, ["domain"], ["ts", "event_id"], time_bucket("ts", 86400),
                                                            {"n": ("sum", F.lit(1))})):
        text = plan(df)
        windows = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
        assert all("_bucket" in w or "_t_" in text for w in windows) and any("_bucket" in w for w in windows)


def test_running_reads_the_rows_through_one_shuffle(spark):
    df = running(V.v_traffic(spark, SF), ["domain"], ["ts", "event_id"], time_bucket("ts", 86400), {"n": ("sum", F.lit(1))})
    assert "event_id" in df.columns and plan(df).count("Exchange hashpartitioning") <= 4


@pytest.mark.parametrize("build", ["active", "attempts"])
def test_running_extremes_take_few_exchanges(spark, build):
    """With broadcast joins off, as at size: rows, bucket totals, their prefixes."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = V.v_traffic(spark, SF).withColumn("success", F.col("status") == 200)
        if build == "attempts":
            df = traffic.attempt_no(rows)
        else:
            df = traffic.clamp_running(rows.select("domain", "event_id", "ts", F.lit(1).alias("step")))
        assert plan(df).count("Exchange hashpartitioning") <= 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_keep_first_plan(spark):
    df = keep_first(traffic.violations(V.v_traffic(spark, SF)), ["domain"], ["ts", "event_id"])
    assert plan(df).count("WindowGroupLimit") == 2
