"""Inputs of the changing jobs, derived from the bound tables.

The modulo rules say which rows change; every job still reads its tables whole.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendgrid.functions.vocabulary import REMEDIATED
from mendgrid.operators.ingest import summarize_sightings
from mendgrid.operators.snapshots import MEASURES, refresh_risk_snapshots
from mendgrid.schemas import TABLES
from mendgrid.sources.storage import TableSet, conform
from trial.binding import (
    AS_OF,
    PAIRS,
    finding_id,
    ids_run_out,
    number_in_slot,
    raw,
    sightings,
    slot_of,
)

# The status an updated action moves to, in cycle order.
STATUS_CYCLE = TABLES["patch_actions"].checks["status"]


def rekeyed_feed(feed: DataFrame, pairs: DataFrame) -> DataFrame:
    """The scan feed folded onto 100 assets and 100 vulnerabilities, so keys repeat often."""
    lowest = pairs.groupBy(F.col("vuln_id_fk").alias("pair_vuln")).agg(F.min("sw_vuln_id").alias("pair"))
    keyed = feed.selectExpr(
        "asset_id_fk % 100 a",
        "l_partkey % 100 v",
        "seen_at",
        "(asset_id_fk % 24) * 10 + l_partkey % 2 scan_source_id_fk",
        "concat('host ', cast(asset_id_fk as string)) evidence_snippet",
        "cast(null as string) notes",
    )
    return keyed.join(lowest, F.col("v") == F.col("pair_vuln"), "left").select(
        F.col("a").alias("asset_id_fk"), F.col("pair").alias("sw_vuln_id_fk"), "v", "seen_at",
        "scan_source_id_fk", "evidence_snippet", "notes",
    )


# Assets up to here have arithmetic ids of findings within 64 bits.
LAST_GIVEN = 18_446_743


def given_finding_id(slot: Column, number: Column, series: int = 0) -> Column:
    """The id a finding is given by its key, or by its number where the key doesn't fit."""
    asset, pair = F.col("asset_id_fk"), F.col("sw_vuln_id_fk")
    numbered = finding_id(asset, pair, slot, number, series)
    return F.when((pair < PAIRS) & (asset <= LAST_GIVEN), asset * PAIRS + pair).otherwise(numbered)


def known_findings(feed: DataFrame, assets: DataFrame) -> DataFrame:
    """Findings that exist before the batch; like every stored finding they have an asset."""
    before = feed.where((F.col("seen_at") < F.lit(AS_OF)) & F.col("sw_vuln_id_fk").isNotNull()).where(
        "(asset_id_fk * 7 + v) % 3 <> 0"
    ).join(assets.select("asset_id"), F.col("asset_id_fk") == F.col("asset_id"), "left_semi")
    grouped = before.groupBy("asset_id_fk", "sw_vuln_id_fk", "v").agg(
        F.min("seen_at").alias("discovered_at"), F.max("seen_at").alias("last_seen_at")
    )
    # The vulnerability tells the findings of an asset apart.
    key = given_finding_id(F.lit(0), F.col("v") + 100)
    return conform(
        grouped.withColumn("finding_id", key).selectExpr(
            "finding_id",
            "asset_id_fk",
            "sw_vuln_id_fk",
            "case (asset_id_fk + v) % 6 when 0 then 'Open' when 1 then 'In Progress' when 2 then 'Remediated' "
            "when 3 then 'Accepted Risk' when 4 then 'False Positive' else 'Pending Retest' end status",
            "discovered_at",
            "last_seen_at",
        ),
        "scan_findings",
    )


def batch_of(feed: DataFrame) -> DataFrame:
    return feed.where(F.col("seen_at") >= F.lit(AS_OF)).drop("v")


def ingest_inputs(spark: SparkSession, sf_dir: str, tables: TableSet) -> tuple[TableSet, DataFrame]:
    """Tables with the known findings, and the sightings to ingest."""
    feed = rekeyed_feed(
        sightings(raw(spark, sf_dir, "lineitem"), raw(spark, sf_dir, "orders")), tables["software_vulnerabilities"]
    )
    return tables.with_tables(scan_findings=known_findings(feed, tables["assets"])), batch_of(feed)


def stored_feed(feed: DataFrame) -> DataFrame:
    """The scan feed under its own (asset, pair) keys."""
    return feed.selectExpr(
        "asset_id_fk",
        "sw_vuln_id_fk",
        "seen_at",
        "(asset_id_fk % 24) * 10 + l_partkey % 2 scan_source_id_fk",
        "concat('host ', cast(asset_id_fk as string)) evidence_snippet",
        "cast(null as string) notes",
    )


def stored_inputs(spark: SparkSession, sf_dir: str, tables: TableSet) -> tuple[TableSet, DataFrame]:
    """Tables with the stored findings but a third of those that the batch sights first, and the sightings
    to ingest."""
    feed = stored_feed(sightings(raw(spark, sf_dir, "lineitem"), raw(spark, sf_dir, "orders")))
    known = tables["scan_findings"].where(
        (F.col("discovered_at") < F.lit(AS_OF)) | F.expr("(asset_id_fk + sw_vuln_id_fk) % 3 <> 0")
    )
    return tables.with_tables(scan_findings=known), batch_of(feed)


def ids_numbered(spark: SparkSession, sf_dir: str) -> bool:
    return ids_run_out(raw(spark, sf_dir, "lineitem"), raw(spark, sf_dir, "orders"))


def pre_insert_rows(batch: DataFrame, sources: DataFrame, numbered: bool = False) -> DataFrame:
    rows = summarize_sightings(batch, sources).where("sw_vuln_id_fk is not null")
    key = F.expr("asset_id_fk * 500000000000 + sw_vuln_id_fk")
    if numbered:
        # The stored findings have the numbers of the first series.
        rows = rows.withColumn("slot", slot_of("sw_vuln_id_fk")).withColumn("number", number_in_slot())
        key = given_finding_id(F.col("slot"), F.col("number"), series=1)
    return rows.withColumn("finding_id", key).selectExpr(
        "finding_id",
        "asset_id_fk",
        "sw_vuln_id_fk",
        "first.scan_source_id_fk scan_source_id_fk",
        "'Open' status",
        "case when (asset_id_fk + sw_vuln_id_fk) % 2 = 0 then 42.00 end risk_score",
        "case when asset_id_fk % 3 <> 0 then first.seen_at end discovered_at",
        "first.seen_at last_seen_at",
    )


def patch_requests(spark: SparkSession, findings: DataFrame) -> DataFrame:
    h = "(asset_id_fk + sw_vuln_id_fk)"
    real = (
        findings.where(f"{h} % 20 = 0")
        .withColumn("j", F.explode(F.expr(f"if({h} % 40 = 0, array(0, 1), array(0))")))
        .selectExpr(
            # Stored ids, ids given twice, unknown people and types that aren't allowed.
            f"finding_id * 10 + case when {h} % 260 = 0 then 1 when {h} % 200 = 0 then 5 else 5 + j end action_id",
            "finding_id",
            f"case when {h} % 180 = 0 then 999999 else {h} % 10 end assigned_to",
            f"case when {h} % 60 <> 0 then {h} % 9 end assigned_by",
            f"case when {h} % 140 = 0 then 'Nonsense' else 'Patch' end action_type",
            "date_add(cast(discovered_at as date), 14) due_date",
            f"concat('CHG-', cast({h} as string)) ticket",
        )
    )
    unknown = spark.range(1, 6).selectExpr(
        "-id action_id", "-id finding_id", "cast(1 as bigint) assigned_to", "cast(2 as bigint) assigned_by",
        "'Patch' action_type", "cast(null as date) due_date", "cast(null as string) ticket",
    )
    return real.unionByName(unknown)


def new_assets(customer: DataFrame) -> DataFrame:
    """Asset rows as typed into a form: padded, blank, out of range, repeated or pointing nowhere."""
    return customer.where("c_nationkey = 24").selectExpr(
        "c_custkey asset_id",
        "case when c_custkey % 17 = 0 then '99' else ' 24 ' end org_id_fk",
        "case when c_custkey % 7 = 0 then '  ' else cast(c_custkey % 10 as string) end owner_id_fk",
        "case when c_custkey % 13 = 0 then 'shared-host' else concat('  ', c_name, ' ') end hostname",
        "'' fqdn",
        "case when c_custkey % 5 = 0 then '300.1.1.1' else concat('10.0.0.', cast(c_custkey % 256 as string)) end "
        "ip_address",
        "c_mktsegment asset_type",
        "'Linux' operating_system",
        "'   ' os_version",
        "case when c_custkey % 3 = 0 then '9' when c_custkey % 19 = 0 then 'high' "
        "else cast(1 + c_custkey % 5 as string) end criticality",
        "case when c_custkey % 4 = 0 then '' else ' Lab' end environment",
        "'true ' is_active",
    )


def as_text(df: DataFrame, table: str, **changed) -> DataFrame:
    """Current rows as change-set text, with some columns replaced."""
    spec = TABLES[table]
    return df.select(
        spec.pk, *[(changed[c] if c in changed else F.col(c)).cast("string").alias(c) for c in spec.flagged("edit")]
    )


def action_updates(actions: DataFrame) -> DataFrame:
    cycle = F.array(*[F.lit(s) for s in STATUS_CYCLE])
    place = F.array_position(cycle, F.col("status")).cast("int")
    following = F.element_at(cycle, place % len(STATUS_CYCLE) + 1)
    status = F.when(F.col("action_id") % 8 == 0, F.col("status")).otherwise(following)
    return as_text(actions.where("action_id % 4 = 0"), "patch_actions", status=status)


def finding_updates(findings: DataFrame) -> DataFrame:
    rows = findings.where("(asset_id_fk + sw_vuln_id_fk) % 9 = 0")
    return as_text(rows, "scan_findings", status=F.lit(REMEDIATED))


def organization_updates(orgs: DataFrame) -> DataFrame:
    same = as_text(orgs.where("org_id % 2 = 0"), "organizations")
    unknown = as_text(orgs.where("org_id % 5 = 0").withColumn("org_id", F.col("org_id") + 1000), "organizations")
    return same.unionByName(unknown)


def deletions(tables: TableSet) -> dict[str, DataFrame]:
    return {
        "organizations": tables["organizations"].where("org_id = 3").select("org_id"),
        "users": tables["users"].where("user_id = 2").select("user_id"),
        "vulnerabilities": tables["vulnerabilities"].where("vuln_id % 50 = 0").select("vuln_id"),
    }


def stale_snapshots(tables: TableSet) -> DataFrame:
    """Snapshots a month old, half of them also filed under today with ids of their own; every measure is off by one."""
    old = refresh_risk_snapshots(tables, AS_OF - timedelta(days=30))
    old = conform(old.withColumns({m: F.col(m) + 1 for m in ("composite_score", *MEASURES)}), "risk_score_snapshots")
    today = old.where("asset_id_fk % 2 = 0").withColumns(
        {"snapshot_id": -F.col("snapshot_id"), "snapshot_date": F.lit(AS_OF)}
    )
    return old.unionByName(today)


def dated_fixes(tables: TableSet) -> TableSet:
    """Remediated findings with a fix some weeks after their discovery."""
    fixed = F.expr(
        "case when status = 'Remediated' then discovered_at + make_dt_interval(cast((asset_id_fk + sw_vuln_id_fk) % 300 as int)) end"
    )
    return tables.with_tables(scan_findings=tables["scan_findings"].withColumn("first_fixed_at", fixed))


def faulty(tables: TableSet) -> TableSet:
    """The bound tables with rows that break every kind of rule."""
    findings = tables["scan_findings"]
    again = findings.where("(asset_id_fk + sw_vuln_id_fk) % 50 = 0")
    return tables.with_tables(
        scan_findings=findings.unionByName(again),
        vulnerabilities=tables["vulnerabilities"].withColumns(
            {
                "severity": F.expr("case when vuln_id % 97 = 0 then 'Severe' else severity end"),
                "cvss_score": F.expr("case when vuln_id % 89 = 0 then cast(12.5 as decimal(3,1)) else cvss_score end"),
            }
        ),
        assets=tables["assets"].withColumns(
            {
                "hostname": F.expr("case when asset_id % 101 = 0 then repeat('h', 201) else hostname end"),
                "ip_address": F.expr("case when asset_id % 103 = 0 then '300.1.1.1' else ip_address end"),
                "mac_address": F.expr(
                    "case when asset_id % 109 = 0 then '08:00:2b:01:02' when asset_id % 2 = 0 "
                    "then '08:00:2b:01:02:03' end"
                ),
                "criticality": F.expr("case when asset_id % 107 = 0 then null else criticality end"),
            }
        ),
        patch_actions=tables["patch_actions"].withColumn(
            "finding_id_fk", F.expr("case when action_id % 113 = 0 then -action_id else finding_id_fk end")
        ),
    )
