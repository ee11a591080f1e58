"""Deduplicated ingest of scan sightings and the insert-time enrichment of findings."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendgrid.functions.scoring import finding_risk_score
from mendgrid.functions.vocabulary import CLOSED, OPEN
from mendgrid.operators.numbering import number_rows
from mendgrid.plans.facts import pair_vulnerabilities
from mendgrid.sources.storage import conform, settle, work_place

Tables = Mapping[str, DataFrame]

KEY = ["asset_id_fk", "sw_vuln_id_fk"]


FIRST = ["seen_at", "scan_source_id_fk", "evidence_snippet", "notes"]


def summarize_sightings(sightings: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per (asset, pair): the first usable sighting supplies the fields, the last one the time.

    A sighting is usable when its source is absent or known. First means earliest, then lowest source,
    then lowest evidence text, then lowest notes, absent values first; where no sighting is usable it is
    the first of all. The aggregates merge in any order and are combined before the shuffle, so repeated
    sightings of one key cost one row per map task.
    """
    known = sources.select(F.col("source_id").alias("known_source"))
    judged = sightings.join(known, F.col("scan_source_id_fk") == F.col("known_source"), "left")
    usable = F.col("scan_source_id_fk").isNull() | F.col("known_source").isNotNull()
    fields = F.struct(*FIRST)
    return judged.groupBy(*KEY).agg(
        F.coalesce(F.min(F.when(usable, fields)), F.min(fields)).alias("first"),
        F.max(usable).alias("usable"),
        F.max("seen_at").alias("last_seen"),
    )


def policy_days(policies: DataFrame) -> DataFrame:
    """Days to remediate per organisation and severity: the active policy with the lowest id."""
    return (
        policies.where("is_active")
        .groupBy(F.col("org_id_fk").alias("policy_org"), F.col("severity").alias("policy_severity"))
        .agg(F.min_by("max_days_to_remediate", "policy_id").alias("sla_days"))
    )


def with_finding_context(rows: DataFrame, tables: Tables) -> DataFrame:
    """Rows keyed by (asset, pair) with organisation, severity, fresh score and policy days.

    All joins are outer: an unknown asset or pair leaves ``known_asset`` or ``known_pair`` NULL.
    """
    assets = tables["assets"].select(
        F.col("asset_id").alias("known_asset"), F.col("org_id_fk").alias("asset_org"), "criticality"
    )
    vulns = pair_vulnerabilities(
        tables, "severity", "cvss_score", "epss_score", "exploit_available"
    ).withColumnRenamed("sw_vuln_id", "known_pair")
    policies = policy_days(tables["remediation_sla_policies"])
    score = finding_risk_score(
        F.col("cvss_score"), F.col("epss_score"), F.col("criticality"), F.col("exploit_available")
    )
    return (
        rows.join(assets, F.col("asset_id_fk") == F.col("known_asset"), "left")
        .join(vulns, F.col("sw_vuln_id_fk") == F.col("known_pair"), "left")
        .join(
            policies,
            (F.col("asset_org") == F.col("policy_org")) & (F.col("severity") == F.col("policy_severity")),
            "left",
        )
        .withColumn("fresh_score", score)
    )


def last_finding_id(findings: DataFrame) -> int:
    """The largest stored id; new findings are numbered on from it."""
    return findings.agg(F.max("finding_id")).first()[0] or 0


def record_sightings(
    tables: Tables, summaries: DataFrame, after_id: int | None = None, work: str | None = None
) -> DataFrame:
    """Outcome of each summarised key against ``tables``' findings.

    ``outcome`` is touched (a finding that is not closed exists), rejected_closed (only a closed one
    holds the key), rejected_fk (asset, pair or every source unknown) or inserted. The other columns describe
    the finding as it stands afterwards, or as it would have been inserted. New findings get the ids after
    ``after_id`` (the largest stored one, if not given) in order of their key; a refused key gets none, so
    it may hold any numbers. The outcomes are stored before they are numbered.
    """
    existing = tables["scan_findings"].select(
        F.col("asset_id_fk").alias("have_asset"),
        F.col("sw_vuln_id_fk").alias("have_pair"),
        *[F.col(c).alias(f"have_{c}") for c in _CARRIED],
    )
    matched = summaries.join(
        existing,
        (F.col("asset_id_fk") == F.col("have_asset")) & (F.col("sw_vuln_id_fk") == F.col("have_pair")),
        "left",
    )
    looked_up = with_finding_context(matched, tables)
    unknown = F.col("known_asset").isNull() | F.col("known_pair").isNull() | ~F.col("usable")
    outcome = (
        F.when(F.col("have_finding_id").isNotNull() & ~F.col("have_status").isin(*CLOSED), "touched")
        .when(F.col("have_finding_id").isNotNull(), "rejected_closed")
        .when(unknown, "rejected_fk")
        .otherwise("inserted")
    )
    fresh = {
        "finding_id": F.lit(None).cast("bigint"),
        "scan_source_id_fk": F.col("first.scan_source_id_fk"),
        "status": F.lit(OPEN),
        "risk_score": F.col("fresh_score").cast("decimal(7,2)"),
        "sla_due_date": F.date_add(F.col("first.seen_at").cast("date"), F.col("sla_days")),
        "discovered_at": F.col("first.seen_at"),
        "last_seen_at": F.col("last_seen"),
        "evidence_snippet": F.col("first.evidence_snippet"),
        "notes": F.col("first.notes"),
    }
    held = F.col("have_finding_id").isNotNull()
    kept = {c: F.when(held, F.col(f"have_{c}")).otherwise(v) for c, v in fresh.items()}
    kept["last_seen_at"] = (
        F.when(F.col("outcome") == "touched", F.greatest("have_last_seen_at", "last_seen"))
        .when(held, F.col("have_last_seen_at"))
        .otherwise(F.col("last_seen"))
    )
    judged = looked_up.withColumn("outcome", outcome).select(
        *KEY, "outcome", *[v.alias(c) for c, v in kept.items()], "first", "usable", "last_seen", "sla_days"
    )
    stored = settle(judged, work_place(summaries.sparkSession, "outcomes", work))
    after = last_finding_id(tables["scan_findings"]) if after_id is None else after_id
    new = number_rows(stored.where("outcome = 'inserted'"), "finding_id", KEY, after, work)
    return stored.where("outcome <> 'inserted'").unionByName(new.select(*stored.columns))


_CARRIED = [
    "finding_id", "scan_source_id_fk", "status", "risk_score", "sla_due_date", "discovered_at", "last_seen_at",
    "evidence_snippet", "notes",
]


def record_scan_findings(tables: Tables, sightings: DataFrame) -> DataFrame:
    """Batch ingest: one outcome row per (asset, pair) sighted in the batch."""
    return record_sightings(tables, summarize_sightings(sightings, tables["scan_sources"]))


def apply_outcomes(findings: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The next version of the findings: touched rows get their new time, inserted rows are added."""
    touched = outcomes.where("outcome = 'touched'").select(
        F.col("asset_id_fk").alias("touched_asset"),
        F.col("sw_vuln_id_fk").alias("touched_pair"),
        F.col("last_seen_at").alias("touched_at"),
    )
    same = (F.col("asset_id_fk") == F.col("touched_asset")) & (F.col("sw_vuln_id_fk") == F.col("touched_pair"))
    kept = (
        findings.join(touched, same, "left")
        .withColumn("last_seen_at", F.coalesce("touched_at", "last_seen_at"))
        .drop("touched_asset", "touched_pair", "touched_at")
    )
    new = conform(outcomes.where("outcome = 'inserted'"), "scan_findings")
    return kept.unionByName(new)


def finding_pre_insert(tables: Tables, rows: DataFrame, now: datetime) -> DataFrame:
    """Complete findings about to be inserted.

    The discovery time defaults to ``now`` and the last-seen time always becomes ``now``. A missing
    score is computed, and only then is a missing due date taken from the policy.
    """
    stamp = F.lit(now).cast("timestamp_ntz")
    unscored = F.col("risk_score").isNull()
    due = F.when(
        unscored & F.col("sla_due_date").isNull(), F.date_add(F.lit(now.date()), F.col("sla_days"))
    ).otherwise(F.col("sla_due_date"))
    completed = with_finding_context(conform(rows, "scan_findings"), tables)
    return conform(
        completed.withColumn("sla_due_date", due)
        .withColumn("risk_score", F.coalesce("risk_score", "fresh_score"))
        .withColumn("discovered_at", F.coalesce("discovered_at", stamp))
        .withColumn("last_seen_at", stamp),
        "scan_findings",
    )

