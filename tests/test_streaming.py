"""Streams over several micro-batches against their batch twins."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mendgrid.operators import ingest
from mendgrid.operators.audit import status_changes
from mendgrid.streaming import audit, daily
from mendgrid.streaming import sightings as ingest_stream
from tests.small import rows
from trial import changesets as given
from trial.binding import raw, status_events, tables

SF = "/root/testdata/sf0.001"
# Without the ids, which depend on the batch that brings a finding.
OUT = ["asset_id_fk", "sw_vuln_id_fk", "outcome", "scan_source_id_fk", "status", "risk_score",
       "sla_due_date", "discovered_at", "last_seen_at", "evidence_snippet"]


def write_parts(df, folder: str, parts: list) -> None:
    """One file per condition, in order."""
    for condition in parts:
        df.where(condition).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture(scope="module")
def inputs(spark):
    return given.ingest_inputs(spark, SF, tables(spark, SF))


def one_by_one(spark, df, folder):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_ingest_does_not_depend_on_batches(spark, inputs, tmp_path):
    known, batch = inputs
    # Four unordered slices, one of them delivered twice.
    slices = [f"pmod(xxhash64(evidence_snippet, seen_at), 4) = {i}" for i in (2, 0, 3, 1, 0)]
    folder = str(tmp_path / "in")
    write_parts(batch, folder, slices)
    stream = one_by_one(spark, batch, folder)
    ingest_stream.start_ingest(stream, known, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    changes = ingest_stream.read_changes(spark, str(tmp_path / "log"))
    assert changes.select("batch_id").distinct().count() == 5
    folded = ingest_stream.fold_changes(changes)
    assert rows(folded, *OUT) == rows(ingest.record_scan_findings(known, batch), *OUT)


def test_repeated_micro_batch_changes_nothing(spark, inputs, tmp_path):
    known, batch = inputs
    log = str(tmp_path / "log")
    early, late = batch.where("seen_at < timestamp'1999-06-01'"), batch.where("seen_at >= timestamp'1999-06-01'")
    for part, number in ((early, 0), (late, 1), (late, 1)):
        ingest_stream.ingest_batch(known, part, log, number)
    folded = ingest_stream.fold_changes(ingest_stream.read_changes(spark, log))
    assert rows(folded, *OUT) == rows(ingest.record_scan_findings(known, batch), *OUT)


def test_redelivered_sightings_are_dropped_inside_the_window(spark, inputs, tmp_path):
    known, batch = inputs
    folder = str(tmp_path / "in")
    identified = batch.withColumn("sighting_id", F.concat_ws("-", *[F.col(c).cast("string") for c in batch.columns]))
    write_parts(identified, folder, ["true", "true"])
    stream = one_by_one(spark, identified, folder)
    ingest_stream.start_ingest(
        stream, known, str(tmp_path / "log"), str(tmp_path / "cp"), "3650 days", ["sighting_id"]
    ).awaitTermination()
    changes = ingest_stream.read_changes(spark, str(tmp_path / "log"))
    assert changes.where("batch_id = 1").count() == 0
    folded = ingest_stream.fold_changes(changes)
    assert rows(folded, *OUT) == rows(ingest.record_scan_findings(known, batch), *OUT)


def test_unknown_source_in_an_earlier_batch(spark, tmp_path):
    from tests.test_changes import sightings
    from tests.small import tracker

    t, log = tracker(spark), str(tmp_path)
    parts = [((1, 11, 1, 77, "bad"),), ((1, 11, 2, 1, "good"),), ((1, 11, 0, 78, "bad too"),)]
    for number, part in enumerate(parts):
        ingest_stream.ingest_batch(t, sightings(spark, *part), log, number)
    folded = ingest_stream.fold_changes(ingest_stream.read_changes(spark, log))
    whole = ingest.record_scan_findings(t, sightings(spark, *[r for p in parts for r in p]))
    assert rows(folded, *OUT) == rows(whole, *OUT)


def test_batch_reads_its_buckets_only(spark, inputs, tmp_path):
    """The findings and the log of a small batch are pruned to the buckets of its keys."""
    known, batch = inputs
    path, log = str(tmp_path / "findings"), str(tmp_path / "log")
    ingest_stream.store_findings(known["scan_findings"], path)
    held = ingest_stream.read_findings(spark, path)
    small = batch.where("asset_id_fk = 7 and sw_vuln_id_fk is not null").limit(1)
    touched = [r["b"] for r in small.select(ingest_stream.bucket_of().alias("b")).collect()]
    plan = ingest_stream.in_buckets(held, touched)._jdf.queryExecution().toString()
    assert f"PartitionFilters: [isnotnull(bucket" in plan and f"= {touched[0]})" in plan
    stored = known.with_tables(scan_findings=held)
    ingest_stream.ingest_batch(stored, batch, log, 0)
    ingest_stream.ingest_batch(stored, small, log, 1)
    plan = ingest_stream.in_buckets(ingest_stream._log(spark, log, 1), touched)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [isnotnull(batch_id" in plan
    assert rows(ingest_stream.read_outcomes(spark, log), *OUT) == rows(ingest.record_scan_findings(known, batch), *OUT)


def test_folding_in_the_middle_changes_nothing(spark, inputs, tmp_path):
    """One outcome per key with folds between batches, with a folded batch run again, and with the log's
    inserts already among the stored findings."""
    known, batch = inputs
    log = str(tmp_path / "log")
    part = [batch.where(f"pmod(xxhash64(evidence_snippet, seen_at), 3) = {i}") for i in range(3)]
    ingest_stream.ingest_batch(known, part[2], log, 0)
    ingest_stream.ingest_batch(known, part[0], log, 1)
    ingest_stream.fold_log(spark, log)
    ingest_stream.ingest_batch(known, part[0], log, 1)
    ingest_stream.ingest_batch(known, part[2], log, 2)
    ingest_stream.fold_log(spark, log)
    so_far = ingest_stream.read_outcomes(spark, log)
    later = known.with_tables(scan_findings=ingest.apply_outcomes(known["scan_findings"], so_far))
    ingest_stream.ingest_batch(later, part[1].unionByName(part[0]), log, 3)
    got = ingest_stream.read_outcomes(spark, log)
    assert got.count() == got.select("asset_id_fk", "sw_vuln_id_fk").distinct().count()
    wanted = ingest.record_scan_findings(known, batch)
    assert rows(got, *OUT) == rows(wanted, *OUT)
    new = [r["finding_id"] for r in got.where("outcome = 'inserted'").collect()]
    assert len(new) == len(set(new)) > 10 and min(new) > ingest.last_finding_id(known["scan_findings"])
    after = ingest.apply_outcomes(known["scan_findings"], got)
    assert after.count() == after.select("finding_id").distinct().count()


HISTORY = ["event_id", "action_id", "old_status", "new_status", "changed_at"]


def test_audit_over_time_slices_equals_batch(spark, tmp_path):
    events = status_events(raw(spark, SF, "events"))
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_parts(events, folder, [f"day(changed_at) div 11 = {i}" for i in range(3)])
    audit.start_audit(one_by_one(spark, events, folder), out, str(tmp_path / "cp")).awaitTermination()
    assert rows(audit.read_trail(spark, out), *HISTORY) == rows(status_changes(events), *HISTORY)
    assert audit.read_late(spark, out).count() == 0


EVENT = "event_id bigint, action_id bigint, status string, changed_at timestamp_ntz"
T0 = datetime(2025, 1, 1)


def audited(spark, root, parts, together=1):
    """Micro-batches given by hand; spans are joined after every ``together`` of them."""
    for number, part in parts:
        audit.audit_batch(spark.createDataFrame(part, EVENT), root, number)
        if number % together == together - 1:
            audit.start_joins(spark, root, f"{root}/cp").awaitTermination()
    audit.start_joins(spark, root, f"{root}/cp").awaitTermination()


def test_late_events_are_kept_apart(spark, tmp_path):
    root = str(tmp_path)
    first = [(1, 1, "Pending", T0 + timedelta(hours=5))]
    second = [(2, 1, "Failed", T0), (3, 1, "Pending", T0 + timedelta(hours=6)), (4, 1, "Failed", T0 + timedelta(hours=7)),
              (5, 2, "Pending", T0)]
    audited(spark, root, enumerate((first, second)))
    assert rows(audit.read_trail(spark, root), "event_id", "old_status", "new_status") == [
        (1, "Failed", "Pending"), (2, None, "Failed"), (4, "Pending", "Failed"), (5, None, "Pending")]
    assert rows(audit.read_late(spark, root), "event_id") == [(2,)]


@pytest.mark.parametrize("together", [1, 3])
def test_trail_with_late_and_redelivered_events(spark, tmp_path, together):
    root, rnd = str(tmp_path), random.Random(8)
    events = [
        (i, rnd.randrange(12), rnd.choice(["Pending", "Failed", "Completed", None]), T0 + timedelta(minutes=rnd.randrange(3000)))
        for i in range(400)
    ]
    # The third part repeats events; the second batch is run twice, as after a failure.
    parts = [(0, events[:100]), (1, events[200:]), (1, events[200:]), (2, events[:40]), (3, events[100:200])]
    audited(spark, root, parts, together)
    assert rows(audit.read_trail(spark, root), *HISTORY) == brute_force(events)


def test_redelivery_alone_derives_nothing_anew(spark, tmp_path):
    root = str(tmp_path)
    events = [(i, i % 3, ["Pending", "Failed"][i % 2], T0 + timedelta(minutes=i)) for i in range(30)]
    audited(spark, root, enumerate((events[:20], events[5:20], events[10:])))
    assert audit.read_late(spark, root).count() == 0
    assert rows(audit.read_trail(spark, root), *HISTORY) == brute_force(events)


def test_state_holds_one_event_an_action(spark, tmp_path):
    """The state store holds the last event of each action, and a batch reads no other batch's events."""
    root = str(tmp_path)
    events = [(i, i % 7, "Pending", T0 + timedelta(minutes=i)) for i in range(70)]
    audited(spark, root, enumerate((events[:35], events[35:])))
    held = spark.read.format("statestore").load(f"{root}/cp")
    assert held.count() == 7


def brute_force(events):
    by_action = defaultdict(list)
    for e in events:
        by_action[e[1]].append(e)
    out = []
    for action, mine in by_action.items():
        previous = None
        for event_id, _, status, at in sorted(mine, key=lambda e: (e[3], e[0])):
            if status != previous:
                out.append((event_id, action, previous, status, at))
            previous = status
    return sorted(out, key=repr)


def test_changes_of_a_hot_action(spark):
    """One action holds a third of the events, with ties in time and missing statuses."""
    rnd = random.Random(7)
    events = [
        (i, 1 if i % 3 == 0 else rnd.randrange(2, 40), rnd.choice(["Pending", "Failed", "Completed", None]),
         T0 + timedelta(seconds=rnd.randrange(0, 500_000, 50)))
        for i in range(6000)
    ]
    assert rows(status_changes(spark.createDataFrame(events, EVENT)), *HISTORY) == brute_force(events)


def test_burst_of_one_second_is_spread_over_tasks(spark, tmp_path):
    """All events of one action in one second, and an action that starts and ends with a slice."""
    rnd = random.Random(9)
    events = [(i, 5, rnd.choice(["Pending", "Failed", None]), T0) for i in range(20_000)]
    events += [(20_000 + i, 4 + 2 * (i % 2), "Pending", T0) for i in range(4)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows(status_changes(spark.createDataFrame(events, EVENT), str(tmp_path)), *HISTORY)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute_force(events)
    slices = spark.read.parquet(f"{tmp_path}/steps-*").where("action_id = 5").groupBy("slice").count().collect()
    assert len(slices) >= 6 and max(s["count"] for s in slices) < 8000


def test_numbers_go_on_in_order(spark, tmp_path):
    from mendgrid.operators.numbering import number_rows

    rnd = random.Random(2)
    values = [(rnd.randrange(500), i) for i in range(3000)] + [(7, -1)] * 900
    got = number_rows(spark.createDataFrame(values, "a bigint, b bigint").repartition(5), "n", ["a", "b"], 40, str(tmp_path))
    assert [r[:2] for r in sorted((tuple(r) for r in got.collect()), key=lambda r: r[2])] == sorted(values)
    assert sorted(r["n"] for r in got.collect()) == [41 + i for i in range(len(values))]
    none = number_rows(spark.createDataFrame([], "a bigint"), "n", ["a"], 3, str(tmp_path))
    assert none.columns == ["a", "n"] and none.count() == 0


def test_daily_counts_of_closed_days(spark, tmp_path):
    feed = spark.createDataFrame(
        [(T0 + timedelta(hours=h), k) for h, k in ((1, "a"), (2, "a"), (3, "b"), (30, "a"), (80, "b"))],
        "at timestamp_ntz, what string")
    folder = str(tmp_path / "in")
    write_parts(feed, folder, ["true"])
    counts = daily.daily_counts(one_by_one(spark, feed, folder), "at", "what", "1 day")
    daily.start_daily_counts(counts, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = rows(daily.read_daily_counts(spark, str(tmp_path / "out")), "day", "kind", "n")
    day = T0.date()
    # The watermark stands at hour 56: two days are closed, the third is not.
    assert got == [(day, "a", 2), (day, "b", 1), (day + timedelta(days=1), "a", 1)]
