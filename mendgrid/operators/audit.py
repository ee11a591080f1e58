"""Audit trail of patch-action status changes."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendgrid.operators.numbering import number_rows
from mendgrid.sources.storage import conform, settle, work_place


def change_reason(old: Column, new: Column) -> Column:
    return F.concat(F.lit("Status changed from "), F.coalesce(old, F.lit("NULL")), F.lit(" to "), new)


def last_history_id(history: DataFrame) -> int:
    """The largest stored id; new rows are numbered on from it."""
    return history.agg(F.max("history_id")).first()[0] or 0


def patch_status_audit(
    before: DataFrame, after: DataFrame, changed_at: datetime, after_id: int = 0, work: str | None = None
) -> DataFrame:
    """History rows for the updated actions in ``after`` whose status differs from ``before``.

    The person recorded is the assignee after the update. Ids go on from ``after_id`` in order of the action.
    """
    old = before.select(F.col("action_id").alias("old_id"), F.col("status").alias("old_status"))
    new = after.select("action_id", F.col("status").alias("new_status"), "assigned_to_fk")
    changed = new.join(old, F.col("action_id") == F.col("old_id")).where(
        ~F.col("old_status").eqNullSafe(F.col("new_status"))
    )
    rows = conform(
        changed.select(
            F.col("action_id").alias("action_id_fk"),
            "old_status",
            "new_status",
            F.col("assigned_to_fk").alias("changed_by_fk"),
            F.lit(changed_at).cast("timestamp_ntz").alias("changed_at"),
            change_reason(F.col("old_status"), F.col("new_status")).alias("change_reason"),
            F.lit(False).alias("automated"),
        ),
        "patch_status_history",
    )
    return conform(number_rows(rows, "history_id", ["action_id_fk"], after_id, work), "patch_status_history")


_STEPS = (
    "event_id bigint, action_id bigint, old_status string, new_status string, changed_at timestamp_ntz, "
    "is_first boolean, at_start boolean, slice int"
)


def _preceding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted events with the status before them in their slice; the slice's first row is marked."""
    last: tuple[object, object] | None = None
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        action, status = batch.column("action_id"), batch.column("status")
        held = last or (None, None)
        earlier = pa.concat_arrays([pa.array([held[0]], action.type), action.slice(0, n - 1)])
        before = pa.concat_arrays([pa.array([held[1]], status.type), status.slice(0, n - 1)])
        same = pc.or_(pc.fill_null(pc.equal(action, earlier), False), pc.and_(pc.is_null(action), pc.is_null(earlier)))
        start = pa.array([last is None] + [False] * (n - 1))
        same = pc.and_not(same, start)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("event_id"), action, pc.if_else(same, before, pa.scalar(None, status.type)), status,
                batch.column("changed_at"), pc.invert(same), start, batch.column("slice"),
            ],
            ["event_id", "action_id", "old_status", "new_status", "changed_at", "is_first", "at_start", "slice"],
        )
        last = (action[n - 1].as_py(), status[n - 1].as_py())


def status_steps(events: DataFrame, work: str | None = None) -> DataFrame:
    """Every event with ``old_status``, the status of the action's event before it, and ``is_first``.

    Events are dealt by ranges of (action, time, id), so one action, even one second of it, may hold any share of
    all events and lies in as many slices as it fills. Each slice is read once in order. Only its first row
    needs the slice before: one row a slice is carried over.
    """
    spark, order = events.sparkSession, ["action_id", "changed_at", "event_id"]
    sliced = (
        events.select("event_id", "action_id", "status", "changed_at")
        .repartitionByRange(*order, "status")
        .sortWithinPartitions(*order, "status")
        .withColumn("slice", F.spark_partition_id())
    )
    stored = settle(sliced.mapInArrow(_preceding, _STEPS), work_place(spark, "steps", work))
    last = F.max(F.struct("action_id", "changed_at", "event_id", "new_status")).alias("last")
    ends = sorted(stored.groupBy("slice").agg(last).collect(), key=lambda r: r["slice"])
    carried = spark.createDataFrame(
        [(b["slice"], a["last"]["action_id"], a["last"]["new_status"]) for a, b in zip(ends, ends[1:], strict=False)],
        "into int, carried_action bigint, carried_status string",
    )
    starts = stored.where("at_start").join(carried, F.col("slice") == F.col("into"), "left")
    goes_on = F.col("into").isNotNull() & F.col("action_id").eqNullSafe(F.col("carried_action"))
    mended = starts.withColumns(
        {"old_status": F.when(goes_on, F.col("carried_status")), "is_first": ~goes_on}
    ).select(*stored.columns)
    columns = ["event_id", "action_id", "old_status", "new_status", "changed_at", "is_first"]
    return stored.where("not at_start").unionByName(mended).select(*columns)


def changed_only(steps: DataFrame) -> DataFrame:
    """The steps whose status differs from the one before."""
    return steps.where(~F.col("old_status").eqNullSafe(F.col("new_status"))).select(
        "event_id", "action_id", "old_status", "new_status", "changed_at"
    )


def status_changes(events: DataFrame, work: str | None = None) -> DataFrame:
    """Events (action_id, status, changed_at, event_id) whose status differs from the previous one."""
    return changed_only(status_steps(events, work))
