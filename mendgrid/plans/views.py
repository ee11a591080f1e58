"""The four standing views and their older variants."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendgrid.functions.scoring import (
    compliance_pct,
    compliance_state,
    count_if,
    days_between,
    overdue,
    sla_urgency,
    threat_level,
)
from mendgrid.functions.vocabulary import OPEN, SEVERITY_WEIGHT, action_open, not_settled
from mendgrid.plans.facts import (
    actions_per_finding,
    fan_out,
    pair_vulnerabilities,
    user_names,
    with_asset,
    with_organization,
    with_vulnerability,
)

Tables = Mapping[str, DataFrame]

_LEVELS = {"Critical": "critical_count", "High": "high_count", "Medium": "medium_count", "Low": "low_count"}


def active_findings_per_asset(tables: Tables, as_of: date, live: DataFrame) -> DataFrame:
    """Counts and stored risk of ``live`` findings per asset, severity looked up through the pair.

    The lookup is an outer one: a finding whose pair is unknown still counts as open.
    """
    vulns = pair_vulnerabilities(tables, "severity", "exploit_available")
    return (
        live.select("asset_id_fk", "sw_vuln_id_fk", "risk_score", "sla_due_date")
        .join(vulns, F.col("sw_vuln_id_fk") == F.col("sw_vuln_id"), "left")
        .groupBy("asset_id_fk")
        .agg(
            F.count(F.lit(1)).alias("total_open_findings"),
            *[count_if(F.col("severity") == level).alias(name) for level, name in _LEVELS.items()],
            count_if(F.col("exploit_available")).alias("exploitable_count"),
            count_if(overdue(F.col("sla_due_date"), as_of)).alias("sla_breached_count"),
            F.max("risk_score").alias("max_risk_score"),
            F.sum("risk_score").alias("total_risk_score"),
        )
    )


def asset_exposure_summary(tables: Tables, as_of: date) -> DataFrame:
    """Every asset with its unsettled findings; assets without any keep zeros."""
    per_asset = active_findings_per_asset(
        tables, as_of, tables["scan_findings"].where(not_settled("status"))
    )
    owners = user_names(tables, "owner_key", "asset_owner")
    named = with_organization(tables["assets"], tables, "org_name").join(
        owners, F.col("owner_id_fk") == F.col("owner_key"), "left"
    )
    counts = ["total_open_findings", *_LEVELS.values(), "exploitable_count", "sla_breached_count"]
    zero = F.lit(0).cast("bigint")
    nothing = F.lit(Decimal("0.00"))
    return named.join(per_asset, F.col("asset_id") == F.col("asset_id_fk"), "left").select(
        "asset_id", "hostname", "fqdn", "ip_address", "asset_type", "operating_system", "environment",
        "network_zone", "criticality", "business_impact", "org_name", "asset_owner",
        *[F.coalesce(c, zero).alias(c) for c in counts],
        *[F.coalesce(c, nothing).cast("decimal(18,2)").alias(c) for c in ("max_risk_score", "total_risk_score")],
    )


def patch_compliance_status(tables: Tables, as_of: date) -> DataFrame:
    """Every patch action with its finding, asset, people and compliance state."""
    actions = tables["patch_actions"].select(
        "action_id", "finding_id_fk", "assigned_to_fk", "assigned_by_fk", "action_type",
        F.col("status").alias("action_status"), "priority", "due_date", "change_ticket_id", "completed_at",
    )
    findings = tables["scan_findings"].select(
        "finding_id", "asset_id_fk", "sw_vuln_id_fk", F.col("status").alias("finding_status"),
        "sla_due_date", "risk_score",
    )
    joined = actions.join(findings, F.col("finding_id_fk") == F.col("finding_id"))
    joined = with_vulnerability(joined, tables, "cve_id", "title", "severity", "cvss_score", "exploit_available")
    joined = with_asset(joined, tables, "hostname", "environment", "criticality")
    joined = joined.join(
        user_names(tables, "to_key", "assigned_to"), F.col("assigned_to_fk") == F.col("to_key"), "left"
    ).join(user_names(tables, "by_key", "assigned_by"), F.col("assigned_by_fk") == F.col("by_key"), "left")
    return joined.select(
        "action_id", "hostname", "environment", "criticality", "cve_id", F.col("title").alias("vuln_title"),
        "severity", "cvss_score", "exploit_available", "action_type", "action_status", "priority", "due_date",
        "change_ticket_id", "completed_at", "assigned_to", "assigned_by", "finding_status", "sla_due_date",
        "risk_score",
        compliance_state(
            F.col("action_status"), action_open("action_status"), F.col("sla_due_date"), as_of
        ).alias("compliance_state"),
        days_between(F.lit(as_of), F.col("sla_due_date")).alias("days_past_sla"),
    )


def exploit_risk_dashboard(tables: Tables, as_of: date, ordered: bool = True) -> DataFrame:
    """Unsettled findings that are severe or exploitable, highest risk first."""
    findings = tables["scan_findings"].where(not_settled("status")).select(
        "finding_id", "asset_id_fk", "sw_vuln_id_fk", "scan_source_id_fk", "risk_score", "sla_due_date",
        "discovered_at", F.col("status").alias("finding_status"),
    )
    joined = with_vulnerability(
        findings, tables, "cve_id", "severity", "cvss_score", "epss_score", "epss_percentile", "attack_vector",
        "exploit_available", "exploit_maturity", "patch_available",
    ).where(F.col("severity").isin("Critical", "High") | F.col("exploit_available"))
    joined = with_asset(joined, tables, "org_id_fk", "hostname", "ip_address", "environment", "criticality")
    joined = with_organization(joined, tables, "org_name")
    sources = tables["scan_sources"].select("source_id", F.col("source_name").alias("detected_by_tool"))
    joined = joined.join(sources, F.col("scan_source_id_fk") == F.col("source_id"), "left").select(
        "finding_id", "org_name", "hostname", "ip_address", "environment",
        F.col("criticality").alias("asset_criticality"), "cve_id", "severity", "cvss_score", "epss_score",
        "epss_percentile", "attack_vector", "exploit_maturity", "patch_available", "risk_score", "sla_due_date",
        "discovered_at", "finding_status", "detected_by_tool",
        sla_urgency(F.col("sla_due_date"), as_of).alias("sla_urgency"),
        threat_level(F.col("epss_score"), F.col("exploit_available")).alias("exploitation_threat_level"),
    )
    # The id breaks score ties, so a range sort can split a score that very many findings share.
    return joined.orderBy(F.desc_nulls_last("risk_score"), "finding_id") if ordered else joined


def organization_risk_posture(tables: Tables, as_of: date) -> DataFrame:
    """Rollup per organisation in plain counts.

    Actions are summed per finding and findings per asset before the organisation, so no distinct count
    expands the rows. A finding's risk counts once per action (at least once), as in the row-level join.
    """
    live = tables["scan_findings"].where(not_settled("status")).select(
        "finding_id", "asset_id_fk", "sw_vuln_id_fk", "sla_due_date", "risk_score"
    )
    actions = actions_per_finding(tables["patch_actions"])
    with_actions = live.join(actions, F.col("finding_id") == F.col("finding_id_fk"), "left").drop("finding_id_fk")
    vulns = pair_vulnerabilities(tables, "severity", "exploit_available")
    per_asset = (
        with_actions.join(vulns, F.col("sw_vuln_id_fk") == F.col("sw_vuln_id"), "left")
        .groupBy("asset_id_fk")
        .agg(
            F.count(F.lit(1)).alias("open_findings"),
            count_if(F.col("severity") == "Critical").alias("critical_findings"),
            count_if(F.col("exploit_available")).alias("exploitable_findings"),
            count_if(overdue(F.col("sla_due_date"), as_of)).alias("sla_breached_findings"),
            F.sum("n_actions").alias("total_patch_actions"),
            F.sum("n_completed").alias("completed_actions"),
            F.sum(F.col("risk_score") * fan_out(F.col("n_actions"))).cast("decimal(38,2)").alias("risk"),
        )
    )
    sums = [
        "open_findings", "critical_findings", "exploitable_findings", "sla_breached_findings",
        "total_patch_actions", "completed_actions",
    ]
    per_org = (
        tables["assets"]
        .where("is_active")
        .select("asset_id", "org_id_fk")
        .join(per_asset, F.col("asset_id") == F.col("asset_id_fk"), "left")
        .groupBy("org_id_fk")
        .agg(
            F.count("asset_id").alias("total_assets"),
            *[F.sum(c).alias(c) for c in sums],
            F.sum("risk").alias("risk"),
        )
    )
    zero = F.lit(0).cast("bigint")
    return (
        tables["organizations"]
        .join(per_org, F.col("org_id") == F.col("org_id_fk"), "left")
        .select(
            "org_id", "org_name", "industry", "regulatory_scope",
            *[F.coalesce(c, zero).alias(c) for c in ["total_assets", *sums]],
            compliance_pct(
                F.coalesce("completed_actions", zero), F.coalesce("total_patch_actions", zero)
            ).alias("patch_compliance_pct"),
            F.round(F.coalesce("risk", F.lit(Decimal("0"))), 0).cast("decimal(18,0)").alias("aggregate_risk_score"),
        )
    )


def asset_risk_score(tables: Tables) -> DataFrame:
    """Older asset score: severity weights of open findings times criticality, 0 without any."""
    live = tables["scan_findings"].where(F.col("status") == OPEN).select("asset_id_fk", "sw_vuln_id_fk")
    weight = F.lit(0)
    for level, points in SEVERITY_WEIGHT.items():
        weight = F.when(F.col("severity") == level, F.lit(points)).otherwise(weight)
    per_asset = (
        with_vulnerability(live, tables, "severity")
        .groupBy("asset_id_fk")
        .agg(F.sum(weight).alias("points"))
    )
    return (
        tables["assets"]
        .join(per_asset, F.col("asset_id") == F.col("asset_id_fk"), "left")
        .select(
            "asset_id",
            F.coalesce(F.col("points") * F.col("criticality"), F.lit(0)).cast("bigint").alias("risk_score"),
        )
    )


def asset_exposure_summary_older(tables: Tables, as_of: date) -> DataFrame:
    """Older exposure summary: counts over findings that are exactly Open."""
    per_asset = active_findings_per_asset(
        tables, as_of, tables["scan_findings"].where(F.col("status") == OPEN)
    )
    named = with_organization(tables["assets"], tables, "org_name")
    zero = F.lit(0).cast("bigint")
    return named.join(per_asset, F.col("asset_id") == F.col("asset_id_fk"), "left").select(
        "asset_id", "hostname", "asset_type", "environment", "criticality", "org_name",
        *[F.coalesce(c, zero).alias(c) for c in ("total_open_findings", *_LEVELS.values())],
    )


def patch_compliance_status_older(tables: Tables, as_of: date) -> DataFrame:
    """Older compliance state, judged by the action's own due date."""
    state = (
        F.when(F.col("status") == "Completed", "Compliant")
        .when(overdue(F.col("due_date"), as_of) & action_open("status"), "Overdue")
        .otherwise("In Progress")
    )
    actions = tables["patch_actions"].select(
        "action_id", "finding_id_fk", "assigned_to_fk", "action_type", F.col("status").alias("action_status"),
        "due_date", "completed_at", state.alias("compliance_state"),
    )
    findings = tables["scan_findings"].select(
        "finding_id", "asset_id_fk", "sw_vuln_id_fk", F.col("status").alias("finding_status")
    )
    joined = actions.join(findings, F.col("finding_id_fk") == F.col("finding_id"))
    joined = with_asset(with_vulnerability(joined, tables, "cve_id", "title", "severity"), tables, "hostname")
    people = user_names(tables, "to_key", "assigned_to")
    return joined.join(people, F.col("assigned_to_fk") == F.col("to_key"), "left").select(
        "action_id", "hostname", "cve_id", F.col("title").alias("vuln_title"), "severity", "action_type",
        "action_status", "due_date", "completed_at", "assigned_to", "finding_status", "compliance_state",
    )


def register_views(spark: SparkSession, tables: Tables, as_of: date) -> None:
    """Offer tables and views to SQL users under their usual names."""
    for name in tables:
        tables[name].createOrReplaceTempView(name)
    asset_exposure_summary(tables, as_of).createOrReplaceTempView("vw_asset_exposure_summary")
    patch_compliance_status(tables, as_of).createOrReplaceTempView("vw_patch_compliance_status")
    exploit_risk_dashboard(tables, as_of).createOrReplaceTempView("vw_exploit_risk_dashboard")
    organization_risk_posture(tables, as_of).createOrReplaceTempView("vw_organization_risk_posture")
