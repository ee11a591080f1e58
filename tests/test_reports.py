"""Identities between jobs, and fan-out and NULL traps on literal rows."""

from __future__ import annotations

from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from mendgrid.functions.scoring import count_if, overdue
from mendgrid.functions.vocabulary import not_settled
from mendgrid.operators import entities, listings, snapshots
from mendgrid.plans import reports, views
from tests.small import finding, rows, tracker
from trial.binding import AS_OF, tables

SF = "/root/testdata/sf0.001"
DAY = date(2025, 3, 10)
LATE = DAY - timedelta(days=1)


@pytest.fixture(scope="module")
def bound(spark):
    return tables(spark, SF)


def test_org_rate_equals_report(bound):
    a = entities.org_compliance_rate(bound).join(bound["organizations"], "org_id")
    b = reports.compliance_by_org(bound, AS_OF)
    assert rows(a, "org_name", "compliance_rate") == rows(b, "org_name", "compliance_pct")


def test_composite_risk_equals_snapshot(bound):
    a = snapshots.asset_composite_risk(bound, AS_OF)
    b = snapshots.refresh_risk_snapshots(bound, AS_OF)
    assert rows(a, "asset_id", "composite_risk") == rows(b, "asset_id_fk", "composite_score")


def test_snapshot_counts_equal_exposure(bound):
    a = snapshots.refresh_risk_snapshots(bound, AS_OF)
    b = views.asset_exposure_summary(bound, AS_OF)
    pairs = [("open_findings_count", "total_open_findings"), ("critical_count", "critical_count"),
             ("low_count", "low_count"), ("exploit_active_count", "exploitable_count"),
             ("sla_breached_count", "sla_breached_count")]
    assert rows(a, "asset_id_fk", *[p[0] for p in pairs]) == rows(b, "asset_id", *[p[1] for p in pairs])


def literal_posture(t, as_of):
    """The rollup as one chain of outer joins with distinct counts."""
    f = t["scan_findings"].where(not_settled("status")).drop("status")
    p = t["patch_actions"].select("action_id", F.col("finding_id_fk").alias("p_finding"), F.col("status").alias("p_status"))
    v = t["vulnerabilities"].select("vuln_id", "severity", "exploit_available")
    joined = (
        t["organizations"]
        .join(t["assets"].where("is_active").select("asset_id", F.col("org_id_fk").alias("a_org")),
              F.col("org_id") == F.col("a_org"), "left")
        .join(f, F.col("asset_id") == F.col("asset_id_fk"), "left")
        .join(t["software_vulnerabilities"].select("sw_vuln_id", "vuln_id_fk"),
              F.col("sw_vuln_id_fk") == F.col("sw_vuln_id"), "left")
        .join(v, F.col("vuln_id_fk") == F.col("vuln_id"), "left")
        .join(p, F.col("finding_id") == F.col("p_finding"), "left")
    )

    def distinct(column, condition=None):
        return F.count_distinct(column if condition is None else F.when(condition, F.col(column)))

    return joined.groupBy("org_id").agg(
        distinct("asset_id").alias("total_assets"),
        distinct("finding_id").alias("open_findings"),
        distinct("finding_id", F.col("severity") == "Critical").alias("critical_findings"),
        distinct("finding_id", F.col("exploit_available")).alias("exploitable_findings"),
        distinct("finding_id", overdue(F.col("sla_due_date"), as_of)).alias("sla_breached_findings"),
        distinct("action_id").alias("total_patch_actions"),
        distinct("action_id", F.col("p_status") == "Completed").alias("completed_actions"),
        F.round(F.coalesce(F.sum("risk_score"), F.lit(Decimal("0"))), 0).cast("decimal(18,0)").alias("aggregate_risk_score"),
    )


def test_posture_equals_row_level_form(bound):
    a, b = views.organization_risk_posture(bound, AS_OF), literal_posture(bound, AS_OF)
    assert rows(a, *b.columns) == rows(b, *b.columns)


def test_action_fan_out_is_kept(spark):
    f = finding(1, 11, risk_score=10, sla_due_date=LATE)
    acts = [{"action_id": i, "finding_id_fk": f["finding_id"], "status": s, "priority": "Low"}
            for i, s in ((1, "Completed"), (2, "Pending"), (3, "Cancelled"))]
    t = tracker(spark, scan_findings=[f, finding(1, 12, risk_score=4)], patch_actions=acts)
    posture = {r.org_id: r for r in views.organization_risk_posture(t, DAY).collect()}
    assert posture[1].aggregate_risk_score == 34 and posture[1].open_findings == 2
    assert posture[1].patch_compliance_pct == Decimal("33.3") and posture[2].patch_compliance_pct == 100
    org = {r.org_name: r for r in reports.compliance_by_org(t, DAY).collect()}
    assert org["North Bank"].sla_breaches == 3 and org["North Bank"].asset_count == 2
    assert org["Blue Clinic"].total_actions == 0 and org["Blue Clinic"].compliance_pct == 100


def test_inactive_assets_leave_the_posture_only(spark):
    t = tracker(spark, scan_findings=[finding(2, 11, risk_score=5, sla_due_date=LATE)])
    assert {r.org_id: r.open_findings for r in views.organization_risk_posture(t, DAY).collect()} == {1: 0, 2: 0}
    assert {r.org_name: r.sla_breaches for r in reports.compliance_by_org(t, DAY).collect()}["North Bank"] == 1


def test_software_report_fan_out(spark):
    t = tracker(spark, scan_findings=[finding(1, 11), finding(2, 11, "Remediated"), finding(1, 13)])
    r = reports.most_affected_software(t).first()
    assert (r.vuln_count, r.finding_count, r.exploitable_count) == (4, 3, 2)


def test_null_scores_come_first_descending(spark):
    t = tracker(spark, scan_findings=[finding(1, 11, risk_score=50), finding(3, 12)])
    assert [r.hostname for r in reports.top_exposed_assets(t, DAY).collect()] == ["db1", "web1"]
    assert [r.epss_score for r in reports.exploit_risk_top(t, DAY).collect()][0] is None
    ordered = views.exploit_risk_dashboard(t, DAY).collect()
    assert [r.risk_score for r in ordered] == [Decimal("50.00"), None]


def test_counters_keep_findings_without_pair(spark):
    t = tracker(spark, scan_findings=[finding(1, 11, sla_due_date=LATE), finding(1, 999, sla_due_date=LATE),
                                      finding(3, 12, "Accepted Risk", sla_due_date=LATE)])
    r = reports.dashboard_counters(t, DAY).first()
    assert (r.findings, r.critical_findings, r.exploitable, r.sla_breached, r.orgs) == (2, 1, 1, 3, 2)


def test_counters_on_empty_tables(spark):
    from tests.small import table_set

    assert set(reports.dashboard_counters(table_set(spark), DAY).first()) == {0}


def test_status_summary_counts_failed_as_overdue(spark):
    acts = [{"action_id": i, "finding_id_fk": 1, "status": s, "priority": p, "due_date": LATE}
            for i, (s, p) in enumerate([("Failed", "Low"), ("Completed", "High"), ("Rolled Back", "Critical")])]
    got = [tuple(r) for r in reports.patch_status_summary(tracker(spark, patch_actions=acts), DAY).collect()]
    assert got == [("Rolled Back", "Critical", 1, 1), ("Completed", "High", 1, 0), ("Failed", "Low", 1, 1)]


def test_sql_users_get_the_views(spark):
    t = tracker(spark, scan_findings=[finding(1, 11, risk_score=10)])
    views.register_views(spark, t, DAY)
    assert spark.sql("SELECT open_findings FROM vw_organization_risk_posture WHERE org_id = 1").first()[0] == 1
    assert spark.sql("SELECT count(*) FROM vw_asset_exposure_summary").first()[0] == 3


def test_pair_label_is_null_without_public_id(spark):
    got = dict(rows(listings.pair_labels(tracker(spark)), "option_id", "option_label"))
    assert got[11] == "Web — CVE-1" and got[12] is None


def test_one_asset_with_a_third_of_all_findings(spark):
    """Grouped counts stay whole when one key dominates, with broadcast joins off as on large tables."""
    many = spark.range(30_000).selectExpr(
        "id finding_id", "if(id % 3 = 0, 1, 2 + id % 2) asset_id_fk", "11 + id % 4 sw_vuln_id_fk", "'Open' status",
        "cast(1.5 as decimal(7,2)) risk_score", "date'2025-03-01' sla_due_date",
    )
    from mendgrid.sources.storage import conform

    t = tracker(spark).with_tables(scan_findings=conform(many, "scan_findings"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.asset_id: (r.total_open_findings, r.total_risk_score)
               for r in views.asset_exposure_summary(t, DAY).collect()}
        breaches = reports.sla_breach_analysis(t, DAY).agg(F.sum("breach_count")).first()[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = {r.asset_id_fk: (r.n, r.s) for r in many.groupBy("asset_id_fk").agg(
        count_if(F.lit(True)).alias("n"), F.sum("risk_score").alias("s")).collect()}
    assert got == want and breaches == 30_000
