"""What the physical plans promise at scale."""

from __future__ import annotations

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from mendgrid.operators import snapshots
from mendgrid.plans import reports, views
from mendgrid.sources.storage import conform
from tests.small import T0, tracker
from trial.binding import AS_OF, tables

SF = "/root/testdata/sf0.001"


@contextmanager
def settings(spark, **values):
    old = {}
    for k, v in values.items():
        key = k.replace("__", ".")
        old[key] = spark.conf.get(key, None)
        spark.conf.set(key, v)
    try:
        yield
    finally:
        for key, v in old.items():
            spark.conf.unset(key) if v is None else spark.conf.set(key, v)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_needed_columns_and_push_filters(spark):
    text = plan(views.asset_exposure_summary(tables(spark, SF), AS_OF))
    scan = next(line for line in text.splitlines() if "FileScan" in line and "scan_findings" in line)
    assert "evidence_snippet" not in scan and "discovered_at" not in scan
    assert re.search(r"PushedFilters: \[.*Not\(In\(status", scan)


def test_lookup_reaches_the_scan(spark):
    from mendgrid.operators.listings import lookup

    text = plan(lookup(tables(spark, SF), "scan_findings", 5))
    assert "EqualTo(finding_id,5)" in text and "Exchange" not in text


def test_top_reports_do_not_sort_everything(spark):
    t = tables(spark, SF)
    for df in (reports.top_exposed_assets(t, AS_OF), reports.exploit_risk_top(t, AS_OF)):
        assert "TakeOrderedAndProject" in plan(df)


def test_no_distinct_expansion_and_no_cross_join(spark):
    t = tables(spark, SF)
    for df in (views.organization_risk_posture(t, AS_OF), reports.compliance_by_org(t, AS_OF),
               reports.dashboard_counters(t, AS_OF), reports.sla_breach_analysis(t, AS_OF)):
        text = plan(df)
        assert "Expand" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_large_sides_are_not_broadcast(spark):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        text = plan(views.patch_compliance_status(tables(spark, SF), AS_OF))
    assert "BroadcastExchange" not in text and "SortMergeJoin" in text


@pytest.mark.parametrize("hot", ["asset", "pair"])
def test_hot_key_is_split_and_sums_stay_whole(spark, hot):
    """With joins shuffled and nothing forced, adaptive execution splits a hot pair before the grouping; a hot
    asset meets its join as one row per rating."""
    third = {"asset": "if(id % 3 = 0, 1, id)", "pair": "id"}[hot]
    pair = {"asset": "11 + id % 2000", "pair": "if(id % 3 = 0, 11, 11 + id % 2000)"}[hot]
    many = spark.range(0, 200_000, 1, 8).selectExpr(
        "id finding_id", f"{third} asset_id_fk", f"{pair} sw_vuln_id_fk", "'Open' status",
        "date'2025-03-01' sla_due_date", "cast(1 as decimal(7,2)) risk_score",
    )
    t = tracker(spark).with_tables(
        scan_findings=conform(many, "scan_findings"),
        assets=conform(spark.range(200_000).selectExpr("id asset_id", "id % 2 + 1 org_id_fk", "1 criticality",
                                                       "true is_active"), "assets"),
        software_vulnerabilities=conform(
            spark.range(2000).selectExpr("11 + id sw_vuln_id", "1 software_id_fk", "1 vuln_id_fk"),
            "software_vulnerabilities"),
    )
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="10KB",
        spark__sql__adaptive__forceOptimizeSkewedJoin="false",
    ):
        met = snapshots.counted_by_rating(t, t["scan_findings"].select("asset_id_fk", "sw_vuln_id_fk"), {"n": F.lit(1)})
        assert met.groupBy("asset_id_fk").count().agg(F.max("count")).first()[0] == 1
        scored = snapshots.active_risk_by_asset(t, T0.date())
        total = scored.agg(F.sum("open_findings_count").alias("n"))
        assert total.collect()[0][0] == 200_000
        if hot == "pair":
            assert "skew=true" in plan(total)
