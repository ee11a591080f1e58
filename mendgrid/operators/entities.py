"""Per-entity measures as one row per entity."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendgrid.functions import scoring
from mendgrid.functions.vocabulary import SETTLED
from mendgrid.operators.snapshots import scored_findings
from mendgrid.plans.facts import (
    actions_per_finding,
    with_asset,
    with_organization,
    with_vulnerability,
)

Tables = Mapping[str, DataFrame]


def finding_scores(tables: Tables) -> DataFrame:
    """The risk score of every finding, computed from vulnerability and asset."""
    keys = tables["scan_findings"].select("finding_id", "asset_id_fk", "sw_vuln_id_fk")
    return scored_findings(tables, keys).select("finding_id", F.col("fresh_score").alias("risk_score"))


def sla_days_remaining(tables: Tables, as_of: date) -> DataFrame:
    left = scoring.sla_days_remaining(F.col("sla_due_date"), F.col("status").isin(*SETTLED), as_of)
    return tables["scan_findings"].select("finding_id", left.alias("sla_days_remaining"))


def org_compliance_rate(tables: Tables) -> DataFrame:
    """Completed share of each organisation's actions; 100.0 for one without actions."""
    per_finding = actions_per_finding(tables["patch_actions"])
    keys = tables["scan_findings"].select("finding_id", "asset_id_fk")
    per_asset = (
        per_finding.join(keys, F.col("finding_id_fk") == F.col("finding_id"))
        .groupBy("asset_id_fk")
        .agg(F.sum("n_actions").alias("n_actions"), F.sum("n_completed").alias("n_completed"))
    )
    per_org = (
        with_asset(per_asset, tables, "org_id_fk")
        .groupBy("org_id_fk")
        .agg(F.sum("n_actions").alias("n_actions"), F.sum("n_completed").alias("n_completed"))
    )
    rate = scoring.compliance_pct(F.col("n_completed"), F.col("n_actions"))
    return (
        tables["organizations"]
        .join(per_org, F.col("org_id") == F.col("org_id_fk"), "left")
        .select("org_id", F.coalesce(rate, F.lit(Decimal("100.0"))).alias("compliance_rate"))
    )


def time_to_remediate(tables: Tables) -> DataFrame:
    """Average days from discovery to first fix per organisation and severity."""
    fixed = tables["scan_findings"].where("first_fixed_at is not null").select(
        "asset_id_fk", "sw_vuln_id_fk",
        scoring.days_between(F.col("first_fixed_at"), F.col("discovered_at")).alias("days"),
    )
    joined = with_vulnerability(with_asset(fixed, tables, "org_id_fk"), tables, "severity")
    per_org = joined.groupBy("org_id_fk", "severity").agg(
        F.count(F.lit(1)).alias("fixed_findings"), F.sum("days").alias("days")
    )
    return with_organization(per_org, tables, "org_name").select(
        "org_id_fk", "org_name", "severity", "fixed_findings",
        scoring.rounded_ratio(F.col("days"), F.col("fixed_findings"), 1).alias("avg_days_to_fix"),
    )
