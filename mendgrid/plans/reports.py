"""The eight reports and the dashboard counters."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendgrid.functions.scoring import compliance_pct, count_if, days_between, overdue, rounded_ratio
from mendgrid.functions.vocabulary import OPEN, action_open, not_closed, severity_rank
from mendgrid.plans import views
from mendgrid.plans.facts import (
    actions_per_finding,
    cents,
    fan_out,
    pair_vulnerabilities,
    with_asset,
    with_organization,
    with_vulnerability,
)

Tables = Mapping[str, DataFrame]

# Report lengths.
TOP_ASSETS = 10
TOP_EXPLOIT_RISKS = 20


def dashboard_counters(tables: Tables, as_of: date) -> DataFrame:
    """Twelve counters in one row, read from one version of the tables."""
    sizes = {
        "orgs": "organizations", "users": "users", "assets": "assets", "asset_groups": "asset_groups",
        "software": "software_products", "vulns": "vulnerabilities", "actions": "patch_actions",
        "scan_sources": "scan_sources",
    }
    counted = [
        tables[t].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("counter"), "n")
        for name, t in sizes.items()
    ]
    # Findings shrink to one row per pair before they meet the vulnerability.
    # Open findings are among those not closed, so closed ones need not leave the scan.
    per_pair = tables["scan_findings"].where(not_closed("status")).groupBy("sw_vuln_id_fk").agg(
        count_if(F.col("status") == OPEN).alias("n_open"),
        count_if(overdue(F.col("sla_due_date"), as_of)).alias("n_breached"),
    )
    severity = pair_vulnerabilities(tables, "severity", "exploit_available")
    f = per_pair.join(severity, F.col("sw_vuln_id_fk") == F.col("sw_vuln_id"), "left").agg(
        F.sum("n_open").alias("findings"),
        F.sum(F.when(F.col("severity") == "Critical", F.col("n_open"))).alias("critical_findings"),
        F.sum(F.when(F.col("exploit_available"), F.col("n_open"))).alias("exploitable"),
        F.sum("n_breached").alias("sla_breached"),
    )
    finding_counters = ["findings", "critical_findings", "exploitable", "sla_breached"]
    counted.append(
        f.select(
            F.explode(
                F.array(
                    *[F.struct(F.lit(c).alias("counter"), F.coalesce(c, F.lit(0)).alias("n")) for c in finding_counters]
                )
            ).alias("e")
        ).select("e.counter", "e.n")
    )
    all_counts = counted[0]
    for more in counted[1:]:
        all_counts = all_counts.unionByName(more)
    # Twelve rows turn into twelve columns of a single row.
    return all_counts.agg(
        *[F.max(F.when(F.col("counter") == c, F.col("n"))).alias(c) for c in [*sizes, *finding_counters]]
    )


def findings_by_severity(tables: Tables) -> DataFrame:
    per_pair = (
        tables["scan_findings"].where(not_closed("status")).groupBy("sw_vuln_id_fk").agg(F.count(F.lit(1)).alias("n"))
    )
    joined = with_vulnerability(per_pair, tables, "severity", "cvss_score", "epss_score", "exploit_available")
    tenths = (F.col("cvss_score") * 10).cast("bigint")
    parts = (F.col("epss_score") * 10000).cast("bigint")
    grouped = joined.groupBy("severity").agg(
        F.sum("n").alias("cnt"),
        F.sum(tenths * F.col("n")).alias("cvss_sum"),
        F.sum(F.when(tenths.isNotNull(), F.col("n"))).alias("cvss_n"),
        F.sum(parts * F.col("n")).alias("epss_sum"),
        F.sum(F.when(parts.isNotNull(), F.col("n"))).alias("epss_n"),
        F.sum(F.when(F.col("exploit_available"), F.col("n")).otherwise(F.lit(0))).alias("with_exploit"),
    )
    return grouped.select(
        "severity",
        "cnt",
        rounded_ratio(F.col("cvss_sum"), F.col("cvss_n") * 10, 2).alias("avg_cvss"),
        rounded_ratio(F.col("epss_sum"), F.col("epss_n") * 10000, 4).alias("avg_epss"),
        "with_exploit",
    ).orderBy(severity_rank("severity"), "severity")


def patch_status_summary(tables: Tables, as_of: date) -> DataFrame:
    return (
        tables["patch_actions"]
        .groupBy("status", "priority")
        .agg(
            F.count(F.lit(1)).alias("cnt"),
            count_if(overdue(F.col("due_date"), as_of) & action_open("status")).alias("overdue"),
        )
        .orderBy(severity_rank("priority", 3), "status", "priority")
    )


def top_exposed_assets(tables: Tables, as_of: date) -> DataFrame:
    live = tables["scan_findings"].where(not_closed("status"))
    per_asset = (
        with_vulnerability(
            live.select("asset_id_fk", "sw_vuln_id_fk", "risk_score", "sla_due_date"), tables, "exploit_available"
        )
        .groupBy("asset_id_fk")
        .agg(
            F.count(F.lit(1)).alias("open_findings"),
            F.max("risk_score").alias("max_risk_score"),
            count_if(F.col("exploit_available")).alias("exploitable_vulns"),
            count_if(overdue(F.col("sla_due_date"), as_of)).alias("sla_breaches"),
        )
    )
    columns = ["asset_id", "hostname", "ip_address", "environment", "criticality", "org_id_fk"]
    named = with_organization(with_asset(per_asset, tables, *columns), tables, "org_name")
    return (
        named.orderBy(F.desc("open_findings"), F.desc_nulls_first("max_risk_score"), "asset_id")
        .limit(TOP_ASSETS)
        .select(
            "hostname", "ip_address", "environment", "criticality", "org_name", "open_findings",
            "max_risk_score", "exploitable_vulns", "sla_breaches",
        )
    )


def compliance_by_org(tables: Tables, as_of: date) -> DataFrame:
    """Completion rate per organisation; a breached finding counts once per action, as the join has it."""
    actions = actions_per_finding(tables["patch_actions"])
    breached = overdue(F.col("sla_due_date"), as_of) & not_closed("status")
    per_asset = (
        tables["scan_findings"]
        .select("finding_id", "asset_id_fk", breached.alias("breached"))
        .join(actions, F.col("finding_id") == F.col("finding_id_fk"), "left")
        .groupBy("asset_id_fk")
        .agg(
            F.sum("n_actions").alias("n_actions"),
            F.sum("n_completed").alias("n_completed"),
            F.sum(F.when(F.col("breached"), fan_out(F.col("n_actions")))).alias("n_breaches"),
        )
    )
    per_org = (
        tables["assets"]
        .select("asset_id", "org_id_fk")
        .join(per_asset, F.col("asset_id") == F.col("asset_id_fk"), "left")
        .groupBy("org_id_fk")
        .agg(
            F.count("asset_id").alias("n_assets"),
            F.sum("n_actions").alias("n_actions"),
            F.sum("n_completed").alias("n_completed"),
            F.sum("n_breaches").alias("n_breaches"),
        )
    )
    zero = F.lit(0).cast("bigint")
    total = F.coalesce("n_actions", zero)
    completed = F.coalesce("n_completed", zero)
    return (
        tables["organizations"]
        .join(per_org, F.col("org_id") == F.col("org_id_fk"), "left")
        .select(
            "org_name", "industry", "regulatory_scope",
            F.coalesce("n_assets", zero).alias("asset_count"),
            total.alias("total_actions"),
            completed.alias("completed"),
            compliance_pct(completed, total).alias("compliance_pct"),
            F.coalesce("n_breaches", zero).alias("sla_breaches"),
        )
        .orderBy("compliance_pct", "org_name")
    )


def most_affected_software(tables: Tables) -> DataFrame:
    """Products by known vulnerabilities; ``exploitable_count`` counts joined rows, findings included."""
    per_pair = tables["scan_findings"].groupBy("sw_vuln_id_fk").agg(F.count("finding_id").alias("n"))
    joined = pair_vulnerabilities(
        tables, "software_id_fk", "vuln_id_fk", "cvss_score", "epss_score", "exploit_available"
    ).join(per_pair, F.col("sw_vuln_id") == F.col("sw_vuln_id_fk"), "left")
    per_product = joined.groupBy("software_id_fk").agg(
        F.count_distinct("vuln_id_fk").alias("vuln_count"),
        F.sum(F.coalesce("n", F.lit(0))).alias("finding_count"),
        F.max("cvss_score").alias("max_cvss"),
        F.max("epss_score").alias("max_epss"),
        F.sum(F.when(F.col("exploit_available"), fan_out(F.col("n"))).otherwise(F.lit(0))).alias("exploitable_count"),
    )
    return (
        per_product.join(tables["software_products"], F.col("software_id_fk") == F.col("software_id"))
        .orderBy(F.desc("vuln_count"), F.desc_nulls_first("max_cvss"), "software_id")
        .select(
            "product_name", "vendor", "version", "product_type", "is_supported", "vuln_count", "finding_count",
            F.round("max_cvss", 1).alias("max_cvss"), F.round("max_epss", 4).alias("max_epss"), "exploitable_count",
        )
    )


def exploit_risk_top(tables: Tables, as_of: date) -> DataFrame:
    return (
        views.exploit_risk_dashboard(tables, as_of, ordered=False)
        .orderBy(F.desc_nulls_first("epss_score"), F.desc_nulls_first("cvss_score"), "finding_id")
        .limit(TOP_EXPLOIT_RISKS)
    )


def org_risk_posture(tables: Tables, as_of: date) -> DataFrame:
    return views.organization_risk_posture(tables, as_of).orderBy(F.desc("aggregate_risk_score"), "org_id")


def sla_breach_analysis(tables: Tables, as_of: date) -> DataFrame:
    late = tables["scan_findings"].where(not_closed("status") & overdue(F.col("sla_due_date"), as_of))
    # Asset join before the vulnerability join: a shuffle follows it, so a hot asset can be split.
    joined = with_vulnerability(
        with_asset(
            late.select("asset_id_fk", "sw_vuln_id_fk", "risk_score", "sla_due_date"), tables, "org_id_fk"
        ),
        tables,
        "severity",
    )
    days = days_between(F.lit(as_of), F.col("sla_due_date"))
    per_org = joined.groupBy("org_id_fk", "severity").agg(
        F.count(F.lit(1)).alias("breach_count"),
        F.sum(days).alias("days"),
        F.max(days).alias("max_days_overdue"),
        F.sum(cents(F.col("risk_score"))).alias("risk_cents"),
        F.count("risk_score").alias("scored"),
    )
    # Organisation names are not unique by type, only by rule, so names are grouped once more.
    grouped = (
        with_organization(per_org, tables, "org_name")
        .groupBy("org_name", "severity")
        .agg(
            F.sum("breach_count").alias("breach_count"),
            F.sum("days").alias("days"),
            F.max("max_days_overdue").alias("max_days_overdue"),
            F.sum("risk_cents").alias("risk_cents"),
            F.sum("scored").alias("scored"),
        )
    )
    return grouped.select(
        "org_name",
        "severity",
        "breach_count",
        rounded_ratio(F.col("days"), F.col("breach_count"), 1).alias("avg_days_overdue"),
        "max_days_overdue",
        rounded_ratio(F.col("risk_cents"), F.col("scored") * 100, 2).alias("avg_risk_score"),
    ).orderBy(severity_rank("severity"), F.desc("breach_count"), "org_name", "severity")


