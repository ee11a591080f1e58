"""Ingest, patch actions and change sets on literal rows."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from mendgrid.operators import audit, changes, ingest, integrity, remediation, snapshots
from mendgrid.schemas import TABLES
from mendgrid.sources.storage import (
    TableSet,
    conform,
    publish,
    published,
    read_table,
    replace_dates,
    stored_snapshots,
    write_snapshots,
    write_version,
)
from tests.small import T0, finding, frame, rows, tracker
from trial import changesets as given
from trial.binding import raw, tables

SF = "/root/testdata/sf0.001"
NOW = datetime(2025, 3, 10, 8)
SIGHTING = "asset_id_fk bigint, sw_vuln_id_fk bigint, seen_at timestamp_ntz, scan_source_id_fk bigint, " \
    "evidence_snippet string, notes string"


def sightings(spark, *given_rows):
    return spark.createDataFrame([(a, p, NOW + timedelta(hours=h), s, e, None) for a, p, h, s, e in given_rows], SIGHTING)


# --- ingest -------------------------------------------------------------------------------------------
def test_outcomes_of_sightings(spark):
    t = tracker(spark, scan_findings=[
        finding(1, 11, "Accepted Risk", sla_due_date=date(2025, 1, 1), risk_score=1), finding(1, 13, "False Positive"),
    ])
    batch = sightings(spark, (1, 11, 1, 1, "x"), (1, 13, 1, 1, "x"), (3, 12, 5, None, "late"), (3, 12, 2, None, "early"),
                      (9, 11, 1, None, "x"), (1, 99, 1, None, "x"), (1, 14, 1, 77, "x"))
    out = {(r.asset_id_fk, r.sw_vuln_id_fk): r for r in ingest.record_scan_findings(t, batch).collect()}
    assert {k: r.outcome for k, r in out.items()} == {
        (1, 11): "touched", (1, 13): "rejected_closed", (3, 12): "inserted", (9, 11): "rejected_fk",
        (1, 99): "rejected_fk", (1, 14): "rejected_fk",
    }
    assert out[1, 11].last_seen_at == NOW + timedelta(hours=1) and out[1, 11].status == "Accepted Risk"
    assert out[1, 11].sla_due_date == date(2025, 1, 1) and out[1, 13].last_seen_at == T0
    new = out[3, 12]
    assert (new.discovered_at, new.last_seen_at, new.evidence_snippet) == (
        NOW + timedelta(hours=2), NOW + timedelta(hours=5), "early")
    assert new.risk_score == Decimal("6.80") and new.sla_due_date is None


def test_policy_with_lowest_id_sets_the_due_date(spark):
    out = ingest.record_scan_findings(tracker(spark), sightings(spark, (1, 11, 0, 1, "x"))).first()
    assert out.sla_due_date == date(2025, 3, 17) and out.risk_score == Decimal("57.74")


def test_unknown_source_only_loses_its_own_sighting(spark):
    """The first sighting with a known source inserts; one with an unknown source still touches."""
    batch = sightings(spark, (1, 11, 1, 77, "bad"), (1, 11, 2, 1, "good"), (1, 11, 9, 78, "bad too"))
    out = ingest.record_scan_findings(tracker(spark), batch).first()
    assert (out.outcome, out.evidence_snippet, out.discovered_at, out.last_seen_at) == (
        "inserted", "good", NOW + timedelta(hours=2), NOW + timedelta(hours=9))


def test_inactive_policy_sets_none(spark):
    assert ingest.record_scan_findings(tracker(spark), sightings(spark, (1, 13, 0, 1, "x"))).first().sla_due_date is None


def test_ingest_twice_inserts_nothing_new(spark):
    t = tables(spark, SF)
    known, batch = given.ingest_inputs(spark, SF, t)
    first = ingest.record_scan_findings(known, batch)
    after = ingest.apply_outcomes(known["scan_findings"], first)
    again = ingest.record_scan_findings(known.with_tables(scan_findings=after), batch)
    count = {r.outcome: r.n for r in first.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    assert count == {"inserted": 1719, "touched": 198, "rejected_closed": 233, "rejected_fk": 66}
    count2 = {r.outcome: r.n for r in again.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    assert count2 == {"touched": 1719 + 198, "rejected_closed": 233, "rejected_fk": 66}
    twice = ingest.apply_outcomes(after, again)
    assert rows(twice, *TABLES["scan_findings"].names) == rows(after, *TABLES["scan_findings"].names)


def test_pre_insert_fills_only_what_is_missing(spark):
    given_rows = frame(spark, "scan_findings", [
        {**finding(1, 11), "discovered_at": None}, {**finding(1, 12), "risk_score": 5},
        {**finding(1, 14), "sla_due_date": date(2025, 9, 9)},
    ])
    got = {r.sw_vuln_id_fk: r for r in ingest.finding_pre_insert(tracker(spark), given_rows, NOW).collect()}
    assert got[11].discovered_at == NOW and got[11].sla_due_date == date(2025, 3, 17)
    assert got[12].risk_score == 5 and got[12].sla_due_date is None and got[12].discovered_at == T0
    assert got[14].sla_due_date == date(2025, 9, 9) and {r.last_seen_at for r in got.values()} == {NOW}


def test_no_sighting_stops_the_batch(spark, tmp_path):
    """Keys far beyond any id's range are refused or taken like others, each for itself."""
    huge = 9_000_000_000_000_000_000
    t = tracker(spark, scan_findings=[finding(1, 11)])
    far = t["assets"].unionByName(frame(spark, "assets", [{"asset_id": huge, "org_id_fk": 1, "hostname": "far", "criticality": 1}]))
    t = t.with_tables(assets=far)
    given_rows = sightings(spark, (20_000_000, 12, 1, 1, "x"), (huge - 1, huge, 1, 1, "x"), (1, 12, 1, 1, "x"), (huge, 13, 1, 1, "x"),
                           (1, 11, 1, 1, "x"))
    got = ingest.record_scan_findings(t, given_rows)
    first = finding(1, 11)["finding_id"]
    assert rows(got, "asset_id_fk", "outcome", "finding_id") == sorted([
        (1, "inserted", first + 1), (1, "touched", first), (20_000_000, "rejected_fk", None), (huge - 1, "rejected_fk", None),
        (huge, "inserted", first + 2)], key=repr)


# --- patch actions ------------------------------------------------------------------------------------
def test_requests_make_actions_history_and_progress(spark):
    t = tracker(spark, scan_findings=[finding(1, 11, "Accepted Risk"), finding(1, 14), finding(3, 12, "Remediated")])
    ids = [finding(a, p)["finding_id"] for a, p in ((1, 11), (1, 14), (3, 12))]
    requests = spark.createDataFrame(
        [(1, ids[0], 1, 2, "Patch", None, "T1"), (2, ids[0], 1, None, "Patch", None, None),
         (3, ids[1], 1, 2, "Patch", None, None), (4, ids[2], 1, 2, "Patch", None, None),
         (5, -7, 1, 2, "Patch", None, None)],
        "action_id bigint, finding_id bigint, assigned_to bigint, assigned_by bigint, action_type string, "
        "due_date date, ticket string",
    )
    got = remediation.initiate_patch_actions(t, requests, NOW)
    assert rows(got.actions, "action_id", "priority", "status") == [
        (1, "Critical", "Pending"), (2, "Critical", "Pending"), (3, "Low", "Pending")]
    assert rows(got.history, "action_id_fk", "change_reason") == [
        (1, "Patch action initiated by 2"), (2, None), (3, "Patch action initiated by 2")]
    assert rows(got.rejected, "action_id", "reason") == [(4, "rejected_closed"), (5, "rejected_missing")]
    after = sorted(tuple(r) for r in got.findings.select("finding_id", "status").collect())
    assert [status for _, status in after] == ["In Progress", "In Progress", "Remediated"]


# --- change sets --------------------------------------------------------------------------------------
ASSET_FORM = "asset_id bigint, org_id_fk string, hostname string, asset_type string, operating_system string, " \
    "criticality string, environment string, is_active string, ip_address string"


def asset_form(spark, *given_rows):
    return spark.createDataFrame(list(given_rows), ASSET_FORM)


def test_insert_trims_casts_and_refuses(spark, tmp_path):
    form = asset_form(
        spark,
        (10, " 1 ", "\t new1 ", "Server", "Linux", " 3", "Lab ", "true", ""),
        (11, "1", "new1", "Server", "Linux", "3", "Lab", "true", None),        # host taken by row 10
        (12, "1", "web1", "Server", "Linux", "3", "Lab", "true", None),        # host taken in the table
        (13, "7", "new2", "Server", "Linux", "3", "Lab", "true", None),        # unknown organisation
        (14, "1", "new3", " ", "Linux", "9", "Lab", "true", "1.2.3"),          # blank, out of range, no address
        (15, "1", "new4", "Server", "Linux", "x", "Lab", "maybe", None),       # not a number, not a flag
        (1, "1", "new5", "Server", "Linux", "3", "Lab", "true", None),         # id taken
        (16, "1", "new6", "Server", "Linux", "3", "Lab", "true", None),        # id given twice
        (16, "1", "new7", "Server", "Linux", "3", "Lab", "true", None),
    )
    got = changes.insert_batch(tracker(spark), "assets", form, NOW, str(tmp_path))
    (row,) = got.accepted.collect()
    assert (row.asset_id, row.hostname, row.criticality, row.ip_address, row.created_at) == (10, "new1", 3, None, NOW)
    assert rows(got.rejected, "key", "rule_id", "column_name") == sorted([
        ("11", "C3", "hostname"), ("12", "C3", "hostname"), ("13", "C4", "org_id_fk"), ("14", "C1", "asset_type"),
        ("14", "C6", "criticality"), ("14", "C5", "ip_address"), ("15", "C5", "criticality"),
        ("15", "C5", "is_active"), ("1", "C2", "asset_id"), ("16", "C2", "asset_id"), ("16", "C2", "asset_id"),
    ], key=repr)
    assert got.after.count() == 4


def test_accepted_and_rejected_make_the_input(spark, tmp_path):
    form = given.new_assets(raw(spark, SF, "customer"))
    got = changes.insert_batch(tables(spark, SF), "assets", form, NOW, str(tmp_path))
    refused = got.rejected.select("key").distinct().count()
    assert got.accepted.count() + refused == form.count()


def test_inserted_finding_is_completed(spark, tmp_path):
    form = spark.createDataFrame([(5, "1", "11", "", "Open", "")],
                                 "finding_id bigint, asset_id_fk string, sw_vuln_id_fk string, scan_source_id_fk string, "
                                 "status string, notes string")
    (row,) = changes.insert_batch(tracker(spark), "scan_findings", form, NOW, str(tmp_path)).accepted.collect()
    assert (row.risk_score, row.sla_due_date, row.last_seen_at) == (Decimal("57.74"), date(2025, 3, 17), NOW)


def test_update_overwrites_editable_columns_only(spark, tmp_path):
    t = tracker(spark, scan_findings=[finding(1, 11, notes="old", risk_score=9), finding(1, 12, "Remediated"),
                                      finding(1, 13)])
    ids = [finding(1, p)["finding_id"] for p in (11, 12, 13)]
    form = spark.createDataFrame(
        [(ids[0], "1", "11", "Remediated", " "), (ids[1], "1", "12", "Remediated", "n"), (ids[2], "1", "13", "Nope", ""),
         (77, "1", "14", "Open", "")],
        "finding_id bigint, asset_id_fk string, sw_vuln_id_fk string, status string, notes string",
    )
    got = changes.update_batch(t, "scan_findings", form, NOW, str(tmp_path))
    after = {r.sw_vuln_id_fk: r for r in got.after.collect()}
    assert (after[11].status, after[11].notes, after[11].risk_score, after[11].first_fixed_at) == (
        "Remediated", None, Decimal("9.00"), NOW)
    assert after[12].first_fixed_at is None and after[12].notes == "n" and after[13].status == "Open"
    assert rows(got.rejected, "key", "rule_id", "value") == [(str(ids[2]), "C6", "Nope")]
    assert rows(got.missing, "finding_id") == [(77,)]


def test_reopened_finding_keeps_its_fix_time(spark, tmp_path):
    t = tracker(spark, scan_findings=[finding(1, 11, "Remediated", first_fixed_at=T0)])
    form = given.as_text(t["scan_findings"], "scan_findings", status=F.lit("Open"))
    assert changes.update_batch(t, "scan_findings", form, NOW, str(tmp_path)).after.first().first_fixed_at == T0


def test_update_may_not_take_a_held_key(spark, tmp_path):
    form = given.as_text(tracker(spark)["assets"].where("asset_id = 3"), "assets", hostname=F.lit("web1"),
                         asset_type=F.lit("s"), operating_system=F.lit("o"))
    got = changes.update_batch(tracker(spark), "assets", form, NOW, str(tmp_path))
    assert rows(got.rejected, "key", "rule_id") == [("3", "C3")]


REQUEST = (
    "action_id bigint, finding_id bigint, assigned_to bigint, assigned_by bigint, action_type string, "
    "due_date date, ticket string"
)


def test_requests_keep_the_rules_of_actions(spark, tmp_path):
    """Ids given twice, stored or missing, people nobody knows and types that aren't allowed are refused."""
    known = finding(1, 11)["finding_id"]
    stored = {"action_id": 9, "finding_id_fk": known, "action_type": "Patch", "status": "Pending", "priority": "Low",
              "created_at": T0}
    history = {"history_id": 40, "action_id_fk": 9, "new_status": "Pending", "changed_at": T0, "automated": False}
    t = tracker(spark, scan_findings=[finding(1, 11)], patch_actions=[stored], patch_status_history=[history])
    requests = spark.createDataFrame(
        [(1, known, 999999, 1, "Nonsense", None, None), (1, known, 1, 1, "Patch", None, None), (9, known, 1, 1, "Patch", None, None),
         (None, known, 1, 1, "Patch", None, None), (2, known, 1, 999999, "Patch", None, None), (3, known, 2, None, "Patch", None, None),
         (5, known, None, 1, None, None, "x" * 101), (4, known, 1, 1, "Patch", None, None)], REQUEST)
    got = remediation.initiate_patch_actions(t, requests, NOW, str(tmp_path))
    assert rows(got.actions, "action_id") == [(3,), (4,)]
    assert rows(got.rejected, "action_id", "rule_id", "column_name") == sorted([
        (1, "C2", "action_id"), (1, "C2", "action_id"), (1, "C4", "assigned_to_fk"), (1, "C6", "action_type"),
        (2, "C4", "assigned_by_fk"), (5, "C1", "action_type"), (5, "C5", "change_ticket_id"), (9, "C2", "action_id"),
        (None, "C1", "action_id")], key=repr)
    assert rows(got.history, "history_id", "action_id_fk") == [(41, 3), (42, 4)]
    whole = t.with_tables(
        patch_actions=t["patch_actions"].unionByName(got.actions),
        patch_status_history=t["patch_status_history"].unionByName(got.history),
    )
    for rule in ("C1", "C2", "C4", "C6"):
        assert integrity.validate_rule(whole, rule).where("table_name like 'patch_%'").count() == 0


def test_update_numbers_its_history_on(spark, tmp_path):
    actions = [{"action_id": i, "finding_id_fk": finding(1, 11)["finding_id"], "action_type": "Patch", "status": "Pending",
                "priority": "Low", "created_at": T0} for i in range(1, 30)]
    history = {"history_id": 7, "action_id_fk": 1, "new_status": "Pending", "changed_at": T0, "automated": False}
    t = tracker(spark, scan_findings=[finding(1, 11)], patch_actions=actions, patch_status_history=[history])
    form = given.as_text(t["patch_actions"], "patch_actions", status=F.lit("Failed"))
    got = changes.update_batch(t, "patch_actions", form, NOW, str(tmp_path))
    assert rows(got.history, "history_id", "action_id_fk") == sorted([(7 + i, i) for i in range(1, 30)], key=repr)


def test_audit_only_for_changed_status(spark):
    before = frame(spark, "patch_actions", [{"action_id": 1, "status": None}, {"action_id": 2, "status": "Failed"},
                                            {"action_id": 3, "status": "Pending"}])
    after = spark.createDataFrame([(1, "Pending", 1), (2, "Failed", 1), (3, "Failed", None)],
                                  "action_id bigint, status string, assigned_to_fk bigint")
    got = audit.patch_status_audit(before, after, NOW)
    assert rows(got, "action_id_fk", "changed_by_fk", "change_reason", "automated") == [
        (1, 1, "Status changed from NULL to Pending", False), (3, None, "Status changed from Pending to Failed", False)]


def test_delete_leaves_no_dangling_reference(spark, tmp_path):
    t = tables(spark, SF)
    got = changes.delete_batch(t, given.deletions(t), str(tmp_path))
    after = t.with_tables(**got.after)
    for name in TABLES:
        if name == "patch_status_history":
            continue  # its action ids are the feed's own
        found = integrity.foreign_key_violations(after, name)
        assert found is None or found.count() == 0, name
    assert after["organizations"].where("org_id = 3").count() == 0
    assert after["assets"].count() == t["assets"].where("org_id_fk <> 3").count()
    nulled = got.effects.where("effect = 'set null'").select("table_name", "column_name").distinct().count()
    assert nulled >= 5


def test_upsert_keeps_other_columns(spark):
    day = date(2025, 3, 1)
    old = frame(spark, "risk_score_snapshots", [
        {"snapshot_id": 1, "asset_id_fk": 1, "snapshot_date": day, "composite_score": 1},
        {"snapshot_id": 2, "asset_id_fk": 2, "snapshot_date": day, "composite_score": 2}])
    new = frame(spark, "risk_score_snapshots", [
        {"snapshot_id": 8, "asset_id_fk": 1, "snapshot_date": day, "composite_score": 5},
        {"snapshot_id": 9, "asset_id_fk": 3, "snapshot_date": day, "composite_score": 6}])
    got = changes.upsert(old, new, ["asset_id_fk", "snapshot_date"], ["composite_score"])
    assert rows(got.after, "snapshot_id", "asset_id_fk", "composite_score") == [
        (1, 1, Decimal("5.00")), (2, 2, Decimal("2.00")), (9, 3, Decimal("6.00"))]
    assert got.rejected.count() == 0


def snapshot(number: int, asset: int | None, day: date | None, score: int) -> dict:
    counts = {m: score for m in snapshots.MEASURES}
    return {"snapshot_id": number, "asset_id_fk": asset, "snapshot_date": day, "composite_score": score, **counts}


def test_upsert_replaces_touched_dates_only(spark, tmp_path):
    """Keys given twice and absent keys are refused, other dates keep their files, all measures are overwritten."""
    path, (a, b) = str(tmp_path / "snapshots"), (date(2025, 3, 1), date(2025, 3, 2))
    replace_dates(frame(spark, "risk_score_snapshots", [snapshot(i, i, d, 1) for i in (1, 2, 3) for d in (a, b)]), path)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "snapshots" / f"snapshot_date={a}").iterdir()}
    given_rows = [snapshot(10, 1, b, 7), snapshot(11, 2, b, 8), snapshot(12, 2, b, 9), snapshot(13, 4, b, 5), snapshot(14, None, b, 5)]
    rejected = changes.upsert_snapshots(path, frame(spark, "risk_score_snapshots", given_rows))
    assert rows(rejected, "asset_id_fk", "snapshot_date", "n_rows") == sorted([(2, b, 2), (None, b, 1)], key=repr)
    got = stored_snapshots(spark, path)
    for m in ("composite_score", *snapshots.MEASURES):
        assert sorted(r[m] for r in got.where(F.col("snapshot_date") == F.lit(b)).collect()) == [1, 1, 5, 7], m
    assert rows(got.where("composite_score > 1"), "snapshot_id", "asset_id_fk") == [(1, 1), (13, 4)]
    assert files == {p: p.stat().st_mtime_ns for p in (tmp_path / "snapshots" / f"snapshot_date={a}").iterdir()}
    plan = stored_snapshots(spark, path, [b])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan and "2025-03-02" in plan


def test_a_subset_leaves_other_assets_and_a_huge_asset_is_refused_alone(spark, tmp_path):
    path, day = str(tmp_path / "snapshots"), date(2025, 3, 1)
    many = spark.range(40_000).selectExpr("id finding_id", "2 asset_id_fk", "11 sw_vuln_id_fk", "'Open' status")
    t = tracker(spark, scan_findings=[finding(1, 11), finding(3, 12)])
    write_snapshots(snapshots.refresh_risk_snapshots(t, day), path)
    huge = t.with_tables(scan_findings=t["scan_findings"].unionByName(conform(many, "scan_findings")))
    got = snapshots.judged_risk_snapshots(huge, day)
    assert rows(got.rejected, "asset_id_fk", "column_name", "value") == [
        (2, "critical_count", "40000"), (2, "exploit_active_count", "40000")]
    assert rows(got.snapshots, "asset_id_fk") == [(1,), (3,)]
    more = t.with_tables(scan_findings=t["scan_findings"].unionByName(frame(spark, "scan_findings", [finding(1, 13)])))
    chosen = spark.createDataFrame([(1,), (1,), (77,)], "asset_id bigint")
    write_snapshots(snapshots.refresh_risk_snapshots(more, day, chosen), path)
    assert rows(read_table(spark, path, "risk_score_snapshots"), "asset_id_fk", "open_findings_count") == [(1, 2), (2, 0), (3, 1)]


def test_advanced_measures_equal_a_recomputation(spark):
    """New, changed, deleted and moved findings, and due dates that pass in between."""
    first, second = date(2025, 3, 1), date(2025, 3, 20)
    due = lambda n: date(2025, 3, n)
    old = [finding(1, 11, sla_due_date=due(5)), finding(1, 12, sla_due_date=due(25)), finding(2, 13, sla_due_date=due(2)),
           finding(3, 14, "Accepted Risk", sla_due_date=due(3)), finding(3, 11)]
    new = [old[0], finding(1, 12, "Remediated", sla_due_date=due(25)), finding(3, 14, sla_due_date=due(3)), old[4],
           finding(2, 12, sla_due_date=due(19))]
    t = tracker(spark, scan_findings=new)
    before, after = frame(spark, "scan_findings", [old[1], old[2], old[3]]), frame(spark, "scan_findings", [new[1], new[2], new[4]])
    totals = snapshots.active_risk_by_asset(t.with_tables(scan_findings=frame(spark, "scan_findings", old)), first)
    moved = snapshots.advance_risk(totals, t, before, after, first, second)
    columns = ["asset_id_fk", "composite_score", *snapshots.MEASURES]
    got = snapshots.snapshots_of(moved, t["assets"], second).snapshots
    assert rows(got, *columns) == rows(snapshots.refresh_risk_snapshots(t, second), *columns)


def test_scores_rise_and_fall_over_days(spark):
    fixed = [finding(1, 11, "Remediated", first_fixed_at=datetime(2025, 3, 5, 23)), finding(1, 13, "Accepted Risk"),
             finding(1, 12, discovered_at=datetime(2025, 3, 3)), finding(3, 12, "Open", first_fixed_at=datetime(2025, 3, 2))]
    t = tracker(spark, scan_findings=fixed)
    days = [date(2025, 3, n) for n in (6, 1, 3, 5)] + [date(2025, 2, 1)]
    got = {(r.asset_id_fk, r.snapshot_date.day): r for r in snapshots.risk_trend(snapshots.risk_history(t, days)).collect()}
    scores = {r.asset_id_fk: r.composite_score for r in snapshots.refresh_risk_snapshots(t, days[0]).collect()}
    assert len(got) == 12  # three assets; the first of February and of March share a key
    assert got[1, 6].composite_score == scores[1] == got[1, 5].composite_score
    assert got[1, 3].composite_score - scores[1] == Decimal("57.74") and got[1, 5].score_change == Decimal("-57.74")
    assert got[1, 3].score_change == scores[1] and got[2, 6].composite_score == 0
    assert got[3, 6].composite_score == scores[3] and got[3, 6].score_change == 0


# --- storage ------------------------------------------------------------------------------------------
def test_snapshot_run_twice_equals_once(spark, tmp_path):
    t = tracker(spark, scan_findings=[finding(1, 11), finding(3, 12, "Accepted Risk")])
    path = str(tmp_path / "snapshots")
    for day in (date(2025, 3, 1), date(2025, 3, 2), date(2025, 3, 2)):
        write_snapshots(snapshots.refresh_risk_snapshots(t, day), path)
    got = read_table(spark, path, "risk_score_snapshots")
    assert got.count() == 6
    assert rows(got.where("snapshot_date = date'2025-03-02'"), "asset_id_fk", "composite_score") == [
        (1, Decimal("57.74")), (2, Decimal("0.00")), (3, Decimal("0.00"))]


def test_version_is_never_overwritten(spark, tmp_path):
    users = tracker(spark)["users"]
    path = write_version(users, str(tmp_path), "users", "1")
    assert rows(read_table(spark, path, "users"), "user_id") == [(1,), (2,)]
    assert rows(TableSet.stored(spark, {"users": path})["users"], "username") == [("ann",), ("bob",)]
    with pytest.raises(Exception):
        write_version(users, str(tmp_path), "users", "1")


def test_tables_are_published_together(spark, tmp_path):
    """A failed publication leaves the one before; tables that aren't given keep their version."""
    root, t = str(tmp_path), tracker(spark)
    assert published(spark, root) == {}
    publish({"users": t["users"], "assets": t["assets"]}, root, 1)
    broken = t["assets"].withColumn("hostname", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        publish({"users": t["users"].where("user_id = 1"), "assets": broken}, root, 2)
    seen = TableSet.stored(spark, published(spark, root))
    assert seen["users"].count() == 2 and seen["assets"].count() == 3
    publish({"users": t["users"].where("user_id = 1")}, root, 2)
    seen = TableSet.stored(spark, published(spark, root))
    assert seen["users"].count() == 1 and seen["assets"].count() == 3
    assert TableSet.stored(spark, published(spark, root, before=2))["users"].count() == 2
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        publish({"users": t["users"]}, root, 2)


# --- rules --------------------------------------------------------------------------------------------
def test_null_passes_checks_and_unique_keys(spark):
    policies = [{"policy_id": i, "org_id_fk": 1, "policy_name": "p", "severity": "High", "max_days_to_remediate": 5,
                 "is_active": True, "effective_date": date(2025, 1, 1), "escalation_days": e, "applies_to_env": env}
                for i, (e, env) in enumerate([(None, None), (None, None), (0, "Lab"), (1, "Lab")])]
    t = tracker(spark, remediation_sla_policies=policies)
    got = rows(integrity.validate(t, "remediation_sla_policies"), "rule_id", "key", "column_name", "value")
    assert got == [("C3", "1|High|Lab", "org_id_fk,severity,applies_to_env", "2"), ("C6", "2", "escalation_days", "0")]


def test_clean_small_tables_have_no_key_violations(spark):
    t = tracker(spark)
    for rule in ("C2", "C3", "C4", "C6"):
        assert integrity.validate_rule(t, rule).count() == 0
