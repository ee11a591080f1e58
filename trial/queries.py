"""Every job on the bound tables, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendgrid.operators import changes, entities, ingest, integrity, listings, remediation, snapshots
from mendgrid.operators.audit import change_reason, last_history_id, patch_status_audit, status_changes
from mendgrid.plans import reports, views
from mendgrid.schemas import TABLES
from mendgrid.sources.storage import (
    TableSet,
    read_table,
    replace_dates,
    settle,
    shared_folder,
    stored_snapshots,
    write_snapshots,
    write_version,
)
from mendgrid.streaming import audit as audit_stream
from mendgrid.streaming import daily as daily_stream
from mendgrid.streaming import sightings as sighting_stream
from trial import changesets as given
from trial.binding import AS_OF, RAW, raw, sightings, status_events, tables

NOW = datetime(AS_OF.year, AS_OF.month, AS_OF.day)
ALLOWED_DELAY = "1 day"
# Columns of an ingest outcome that only later steps need.
INTERNAL = ("first", "usable", "last_seen", "sla_days")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def portable(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT and decimals as DOUBLE, so any SQL engine returns the same types."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ShortType, T.IntegerType)):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        elif isinstance(f.dataType, T.DecimalType):
            out.append(F.col(f.name).cast("double").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def job(name: str):
    """Register a function of (tables) or (tables, spark, sf_dir) under ``name``."""

    def register(fn):
        wide = fn.__code__.co_argcount == 3

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bound = tables(spark, sf_dir)
            return portable(fn(bound, spark, sf_dir) if wide else fn(bound))

        QUERIES[name] = run
        return fn

    return register


def work_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


for _t in TABLES:
    job(f"a1_source_{_t}")(lambda t, _t=_t: t[_t])
    job(f"a2_list_{_t}")(lambda t, _t=_t: listings.table_list(t, _t))
    if TABLES[_t].references:
        job(f"a3_options_{_t}")(lambda t, _t=_t: listings.reference_options(t, _t))
        job(f"a5_labeled_{_t}")(lambda t, _t=_t: listings.labeled_list(t, _t))

job("a4_pair_labels")(listings.pair_labels)
job("a6_lookup_asset")(lambda t: listings.lookup(t, "assets", 7))
job("a6_lookup_missing")(lambda t: listings.lookup(t, "assets", -1))


@job("a6_lookup_findings_of_breached_actions")
def _(t: TableSet) -> DataFrame:
    late = t["patch_actions"].where(F.col("due_date") < F.lit(AS_OF)).select("finding_id_fk")
    return listings.lookup_many(t, "scan_findings", late)


job("a7_dashboard_counters")(lambda t: reports.dashboard_counters(t, AS_OF))


@job("a8_write_version")
def _(t: TableSet, spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_version(t["scan_findings"], work_dir(spark, "version"), "scan_findings", "2")
    return read_table(spark, path, "scan_findings")


@job("a8_snapshot_partitions")
def _(t: TableSet, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dates, one of them refreshed once more for a third of the assets."""
    path = work_dir(spark, "snapshots")
    for back in (30, 0):
        write_snapshots(snapshots.refresh_risk_snapshots(t, AS_OF - timedelta(days=back)), path)
    third = t["assets"].where("asset_id % 3 = 0")
    write_snapshots(snapshots.refresh_risk_snapshots(t, AS_OF, third), path)
    return read_table(spark, path, "risk_score_snapshots")


job("r1_findings_by_severity")(reports.findings_by_severity)
job("r2_patch_status_summary")(lambda t: reports.patch_status_summary(t, AS_OF))
job("r3_top_exposed_assets")(lambda t: reports.top_exposed_assets(t, AS_OF))
job("r4_compliance_by_org")(lambda t: reports.compliance_by_org(t, AS_OF))
job("r5_most_affected_software")(reports.most_affected_software)
job("r6_exploit_risk_dashboard")(lambda t: reports.exploit_risk_top(t, AS_OF))
job("r7_org_risk_posture")(lambda t: reports.org_risk_posture(t, AS_OF))
job("r8_sla_breach_analysis")(lambda t: reports.sla_breach_analysis(t, AS_OF))

job("v1_asset_exposure_summary")(lambda t: views.asset_exposure_summary(t, AS_OF))
job("v2_patch_compliance_status")(lambda t: views.patch_compliance_status(t, AS_OF))
job("v3_exploit_risk_dashboard")(lambda t: views.exploit_risk_dashboard(t, AS_OF))
job("v4_organization_risk_posture")(lambda t: views.organization_risk_posture(t, AS_OF))

job("f1_finding_risk_score")(entities.finding_scores)
job("f2_sla_days_remaining")(lambda t: entities.sla_days_remaining(t, AS_OF))
job("f3_org_compliance_rate")(entities.org_compliance_rate)
job("f4_asset_composite_risk")(lambda t: snapshots.asset_composite_risk(t, AS_OF))

job("d1_asset_risk_score")(views.asset_risk_score)
job("d2_asset_exposure_summary_older")(lambda t: views.asset_exposure_summary_older(t, AS_OF))
job("d3_patch_compliance_status_older")(lambda t: views.patch_compliance_status_older(t, AS_OF))
job("d4_patch_compliance_rate_older")(entities.org_compliance_rate)


# A year of months and the last days.
TREND_DAYS = [AS_OF - timedelta(days=back) for back in (*range(360, 29, -30), 2, 1, 0)]


@job("d5_risk_trend")
def _(t: TableSet) -> DataFrame:
    return snapshots.risk_trend(snapshots.risk_history(given.dated_fixes(t), TREND_DAYS))


@job("p1_record_scan_findings")
def _(t: TableSet, spark: SparkSession, sf_dir: str) -> DataFrame:
    known, batch = given.ingest_inputs(spark, sf_dir, t)
    return ingest.record_scan_findings(known, batch).drop(*INTERNAL)


@job("p1_findings_after")
def _(t: TableSet, spark: SparkSession, sf_dir: str) -> DataFrame:
    known, batch = given.ingest_inputs(spark, sf_dir, t)
    return ingest.apply_outcomes(known["scan_findings"], ingest.record_scan_findings(known, batch))


@job("p1_record_stored_findings")
def _(t: TableSet, spark: SparkSession, sf_dir: str) -> DataFrame:
    known, batch = given.stored_inputs(spark, sf_dir, t)
    return ingest.record_scan_findings(known, batch).drop(*INTERNAL)


@job("p1_stored_findings_after")
def _(t: TableSet, spark: SparkSession, sf_dir: str) -> DataFrame:
    known, batch = given.stored_inputs(spark, sf_dir, t)
    return ingest.apply_outcomes(known["scan_findings"], ingest.record_scan_findings(known, batch))


def _initiated(t: TableSet, spark: SparkSession) -> remediation.Initiated:
    requests = given.patch_requests(spark, t["scan_findings"])
    return remediation.initiate_patch_actions(t, requests, NOW, work_dir(spark, "p2"))


job("p2_new_actions")(lambda t, spark, sf_dir: _initiated(t, spark).actions)
job("p2_new_history")(lambda t, spark, sf_dir: _initiated(t, spark).history)
job("p2_findings_after")(lambda t, spark, sf_dir: _initiated(t, spark).findings)
job("p2_rejected")(lambda t, spark, sf_dir: _initiated(t, spark).rejected)

job("p3_refresh_risk_snapshots")(lambda t: snapshots.refresh_risk_snapshots(t, AS_OF))


@job("p3_advanced_risk_snapshots")
def _(t: TableSet, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last month's measures corrected by the findings that were remediated since."""
    previous = AS_OF - timedelta(days=30)
    totals = settle(snapshots.active_risk_by_asset(t, previous), work_dir(spark, "totals"))
    after = settle(_remediated(t, spark, sf_dir), work_dir(spark, "findings"))
    now = after.where("(asset_id_fk + sw_vuln_id_fk) % 9 = 0")
    before = t["scan_findings"].where("(asset_id_fk + sw_vuln_id_fk) % 9 = 0")
    moved = snapshots.advance_risk(totals, t.with_tables(scan_findings=after), before, now, previous, AS_OF)
    return snapshots.snapshots_of(moved, t["assets"], AS_OF).snapshots


@job("t1_patch_status_audit")
def _(t: TableSet) -> DataFrame:
    last = last_history_id(t["patch_status_history"])
    return patch_status_audit(t["patch_actions"], given.action_updates(t["patch_actions"]), NOW, last)


@job("t1_event_feed_audit")
def _(t: TableSet, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_reason(status_changes(status_events(raw(spark, sf_dir, "events"))))


def _with_reason(history: DataFrame) -> DataFrame:
    return history.select(
        "event_id", "action_id", "old_status", "new_status", "changed_at",
        change_reason(F.col("old_status"), F.col("new_status")).alias("change_reason"),
    )


@job("t2_finding_pre_insert")
def _(t: TableSet, spark: SparkSession, sf_dir: str) -> DataFrame:
    known, batch = given.ingest_inputs(spark, sf_dir, t)
    rows = given.pre_insert_rows(batch, t["scan_sources"], given.ids_numbered(spark, sf_dir))
    return ingest.finding_pre_insert(known, rows, NOW)


@job("t2_stored_pre_insert")
def _(t: TableSet, spark: SparkSession, sf_dir: str) -> DataFrame:
    known, batch = given.stored_inputs(spark, sf_dir, t)
    rows = given.pre_insert_rows(batch, t["scan_sources"], given.ids_numbered(spark, sf_dir))
    return ingest.finding_pre_insert(known, rows, NOW)


def _updated(t: TableSet, spark: SparkSession, table: str, rows: DataFrame) -> changes.Updated:
    return changes.update_batch(t, table, rows, NOW, work_dir(spark, "update"))


def _remediated(t: TableSet, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updated(t, spark, "scan_findings", given.finding_updates(t["scan_findings"])).after


def _organizations(t: TableSet, spark: SparkSession) -> changes.Updated:
    return _updated(t, spark, "organizations", given.organization_updates(t["organizations"]))


job("t3_finding_remediated")(_remediated)
job("t4_org_updated_at")(lambda t, spark, sf_dir: _organizations(t, spark).after)
job("t5_time_to_remediate")(
    lambda t, spark, sf_dir: entities.time_to_remediate(t.with_tables(scan_findings=_remediated(t, spark, sf_dir)))
)


def _inserted(t: TableSet, spark: SparkSession, sf_dir: str) -> changes.Inserted:
    rows = given.new_assets(raw(spark, sf_dir, "customer"))
    return changes.insert_batch(t, "assets", rows, NOW, work_dir(spark, "insert"))


job("m1_inserted_assets")(lambda t, spark, sf_dir: _inserted(t, spark, sf_dir).accepted)
job("m1_rejected_assets")(lambda t, spark, sf_dir: _inserted(t, spark, sf_dir).rejected)
job("m2_updated_actions")(
    lambda t, spark, sf_dir: _updated(t, spark, "patch_actions", given.action_updates(t["patch_actions"])).after
)
job("m2_action_history")(
    lambda t, spark, sf_dir: _updated(t, spark, "patch_actions", given.action_updates(t["patch_actions"])).history
)
job("m2_unknown_organizations")(lambda t, spark, sf_dir: _organizations(t, spark).missing)


def _deleted(t: TableSet, spark: SparkSession) -> changes.Deleted:
    return changes.delete_batch(t, given.deletions(t), work_dir(spark, "m3"))


job("m3_delete_effects")(lambda t, spark, sf_dir: _deleted(t, spark).effects)
job("m3_findings_after")(lambda t, spark, sf_dir: _deleted(t, spark).after["scan_findings"])
job("m3_actions_after")(lambda t, spark, sf_dir: _deleted(t, spark).after["patch_actions"])


@job("m4_upsert_snapshots")
def _(t: TableSet, spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "m4")
    replace_dates(given.stale_snapshots(t), path)
    changes.upsert_snapshots(path, snapshots.refresh_risk_snapshots(t, AS_OF))
    return stored_snapshots(spark, path)


for _rule, _title in {
    "C1": "not_null", "C2": "primary_key", "C3": "unique", "C4": "foreign_key", "C5": "domain", "C6": "check",
}.items():
    job(f"{_rule.lower()}_{_title}")(lambda t, _rule=_rule: integrity.validate_rule(given.faulty(t), _rule))


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a file stream; the pattern fits a single file as well as a folder of files."""
    return spark.readStream.schema(RAW[name]).parquet(f"{sf_dir}/{name}.parquet*")


def in_parts(spark: SparkSession, sf_dir: str, name: str, parts: list[str], work: str, start: Callable) -> None:
    """The rows of the table that meet each condition as a micro-batch of their own, in that order;
    ``start`` takes the stream on from its checkpoint until it holds nothing more."""
    for condition in parts:
        raw(spark, sf_dir, name).where(condition).write.mode("append").parquet(f"{work}/in")
        start(spark.readStream.schema(RAW[name]).parquet(f"{work}/in")).awaitTermination()


# Unordered slices, one delivered twice.
SLICES = [f"pmod(xxhash64(l_orderkey, l_linenumber), 3) = {i}" for i in (2, 0, 1, 0)]
# Times in order, but for a part that comes late and one delivered twice.
TIMES = [f"day(ts) div 8 = {i}" for i in (0, 2, 1, 3, 2)]


def _ingested(spark: SparkSession, sf_dir: str, known: TableSet, feed_of: Callable) -> DataFrame:
    """The slices of the feed against findings stored by bucket; the log is folded halfway."""
    work = work_dir(spark, "s1")
    sighting_stream.store_findings(known["scan_findings"], f"{work}/findings")
    known = known.with_tables(scan_findings=sighting_stream.read_findings(spark, f"{work}/findings"))

    def start(lines: DataFrame):
        return sighting_stream.start_ingest(given.batch_of(feed_of(lines)), known, f"{work}/log", f"{work}/cp")

    in_parts(spark, sf_dir, "lineitem", SLICES[:2], work, start)
    sighting_stream.fold_log(spark, f"{work}/log")
    in_parts(spark, sf_dir, "lineitem", SLICES[2:], work, start)
    outcomes = sighting_stream.read_outcomes(spark, f"{work}/log").drop(*INTERNAL)
    # The ids of new findings depend on the batch they come in.
    return outcomes.withColumn("finding_id", F.when(F.col("outcome") != "inserted", F.col("finding_id")))


@job("s1_stream_record_findings")
def _(t: TableSet, spark: SparkSession, sf_dir: str) -> DataFrame:
    known, _batch = given.ingest_inputs(spark, sf_dir, t)
    pairs, orders = t["software_vulnerabilities"], raw(spark, sf_dir, "orders")
    return _ingested(spark, sf_dir, known, lambda lines: given.rekeyed_feed(sightings(lines, orders), pairs))


@job("s1_stream_stored_findings")
def _(t: TableSet, spark: SparkSession, sf_dir: str) -> DataFrame:
    known, _batch = given.stored_inputs(spark, sf_dir, t)
    orders = raw(spark, sf_dir, "orders")
    return _ingested(spark, sf_dir, known, lambda lines: given.stored_feed(sightings(lines, orders)))


@job("s2_stream_status_audit")
def _(t: TableSet, spark: SparkSession, sf_dir: str) -> DataFrame:
    work = work_dir(spark, "s2")
    in_parts(
        spark, sf_dir, "events", TIMES, work,
        lambda events: audit_stream.start_audit(status_events(events), f"{work}/out", f"{work}/cp"),
    )
    return _with_reason(audit_stream.read_trail(spark, f"{work}/out"))


@job("s3_stream_daily_counts")
def _(t: TableSet, spark: SparkSession, sf_dir: str) -> DataFrame:
    work = work_dir(spark, "s3")
    counts = daily_stream.daily_counts(stream_of(spark, sf_dir, "events"), "ts", "event_type", ALLOWED_DELAY)
    daily_stream.start_daily_counts(counts, f"{work}/out", f"{work}/cp").awaitTermination()
    return daily_stream.read_daily_counts(spark, f"{work}/out")
