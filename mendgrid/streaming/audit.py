"""Continuous audit trail of status events.

Micro-batches arrive in commit order; within a batch the events of an action are ordered by time and id. Two
streams make the trail. The first derives each batch by itself, as a stored feed is derived, so a hot action is
spread over tasks, and reduces every action of the batch to one span: its first and last event.
The second keeps the last event of each action in the state store and joins spans to it, one row per action and
batch; no earlier batch is read again. A span that begins before the held event has late or redelivered events:
it is only noted, and ``read_trail`` settles it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mendgrid.operators.audit import changed_only, status_changes, status_steps
from mendgrid.streaming.log import read_batches, write_batch

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("action_id", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("changed_at", T.TimestampNTZType()),
    ]
)
HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("action_id", T.LongType()),
        T.StructField("old_status", T.StringType()),
        T.StructField("new_status", T.StringType()),
        T.StructField("changed_at", T.TimestampNTZType()),
    ]
)
_HISTORY = [f.name for f in HISTORY_SCHEMA.fields]
_EVENT = [f.name for f in EVENT_SCHEMA.fields]

# Times are text here, of one width, so that they compare as they are in the state.
_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SPAN_SCHEMA = T.StructType(
    [
        T.StructField("action_id", T.LongType()),
        *[
            T.StructField(f"{end}_{c}", kind)
            for end in ("first", "last")
            for c, kind in (("at", T.StringType()), ("id", T.LongType()), ("status", T.StringType()))
        ],
    ]
)
_JOIN_SCHEMA = T.StructType(
    [
        T.StructField("span_batch", T.LongType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("action_id", T.LongType()),
        T.StructField("old_status", T.StringType()),
        T.StructField("new_status", T.StringType()),
        T.StructField("at", T.StringType()),
        # For a span that begins too early: the event that was held then; NULL for a change.
        T.StructField("held_at", T.StringType()),
        T.StructField("held_id", T.LongType()),
    ]
)
_STATE_SCHEMA = "at string, id long, status string"
_SPAN = ["batch_id", *[f.name for f in SPAN_SCHEMA.fields if f.name != "action_id"]]
_JOINED = [f.name for f in _JOIN_SCHEMA.fields]


def spans(events: DataFrame) -> DataFrame:
    """First and last event of each action, combined before the shuffle."""
    event = F.struct(F.date_format("changed_at", _TIME).alias("at"), F.col("event_id").alias("id"), "status")
    ends = events.groupBy("action_id").agg(F.min(event).alias("first"), F.max(event).alias("last"))
    return ends.select(
        "action_id", *[F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("first", "last") for c in ("at", "id", "status")]
    )


def audit_batch(batch: DataFrame, root: str, batch_id: int) -> None:
    """Write the events, the changes between them and the spans of one micro-batch."""
    events = batch.select(*_EVENT).persist()
    write_batch(events, f"{root}/events", batch_id)
    steps = status_steps(events, f"{root}/work")
    write_batch(changed_only(steps.where("not is_first")), f"{root}/inside", batch_id)
    write_batch(spans(events), f"{root}/spans", batch_id)
    events.unpersist()


def _order(at: str | None, number: int | None) -> tuple:
    return (at or "", number is not None, number or 0)


def _or_none(value):
    return None if value is None or value != value else value


def join_spans(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Join an action's new spans, batch by batch, to the last event held for it."""
    held = state.get if state.exists else None
    out = []
    # Plain tuples: there is a call for every action, and frames of a row or two cost far more than the rows.
    rows = sorted((row for f in frames for row in zip(*[f[c].tolist() for c in _SPAN], strict=True)), key=lambda r: r[0])
    for batch_id, *ends in rows:
        first, last = ([_or_none(v) for v in e] for e in (ends[:3], ends[3:]))
        first, last = (None if e[1] is None else (e[0], int(e[1]), e[2]) for e in (first, last))
        if held is not None and _order(*first[:2]) <= _order(*held[:2]):
            out.append((batch_id, None, key[0], None, None, None, held[0], held[1]))
        elif (old := held[2] if held is not None else None) != first[2]:
            out.append((batch_id, first[1], key[0], old, first[2], first[0], None, None))
        if held is None or _order(*last[:2]) > _order(*held[:2]):
            held = last
    state.update(held)
    if out:
        yield pd.DataFrame(out, columns=_JOINED, dtype=object)


def start_joins(spark: SparkSession, root: str, checkpoint_dir: str) -> StreamingQuery:
    """Join all spans written so far and stop."""
    dated = T.StructType([*SPAN_SCHEMA.fields, T.StructField("batch_id", T.LongType())])
    # A batch of the first stream that ran again has replaced its files.
    stream = spark.readStream.schema(dated).option("ignoreMissingFiles", "true").parquet(f"{root}/spans")
    joined = stream.groupBy("action_id").applyInPandasWithState(
        join_spans, _JOIN_SCHEMA, _STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )
    return (
        joined.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, f"{root}/joins", batch_id))
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def _joins(spark: SparkSession, root: str) -> DataFrame:
    return read_batches(spark, f"{root}/joins", _JOIN_SCHEMA).select(*[f.name for f in _JOIN_SCHEMA.fields])


def _early(spark: SparkSession, root: str) -> DataFrame:
    """Spans that began before the event held for their action."""
    early = _joins(spark, root).where("event_id is null")
    return early.groupBy(F.col("action_id").alias("early_action"), F.col("span_batch").alias("early_batch")).agg(
        F.max(F.struct("held_at", "held_id")).alias("held")
    )


def _late_events(spark: SparkSession, root: str) -> DataFrame:
    """Events first delivered in an early span and not newer than what was held; a redelivered one isn't late."""
    events = read_batches(spark, f"{root}/events", EVENT_SCHEMA)
    early = _early(spark, root)
    touched = early.select(F.col("early_action").alias("touched")).distinct()
    mine = events.join(touched, F.col("action_id").eqNullSafe(F.col("touched")), "left_semi")
    delivered = mine.groupBy(*_EVENT).agg(F.min("batch_id").alias("batch_id"))
    is_early = F.col("action_id").eqNullSafe(F.col("early_action")) & (F.col("batch_id") == F.col("early_batch"))
    place = F.struct(F.date_format("changed_at", _TIME).alias("held_at"), F.col("event_id").alias("held_id"))
    return delivered.join(early, is_early).withColumn("is_late", place <= F.col("held")).select(*_EVENT, "is_late")


def read_late(spark: SparkSession, root: str) -> DataFrame:
    """Events not newer than what their action already had; ``read_trail`` puts them in their places."""
    return _late_events(spark, root).where("is_late").select(*_EVENT)


def read_trail(spark: SparkSession, root: str) -> DataFrame:
    """The trail, equal to one batch derivation of all events.

    An action with events that came first in an early span is derived anew from all its events. An early span that
    only repeats events is left out: its changes are there already.
    """
    anew = _late_events(spark, root).select(F.col("action_id").alias("anew")).distinct()
    early = _early(spark, root)
    columns = [*_HISTORY, "batch_id"]
    inside = read_batches(spark, f"{root}/inside", HISTORY_SCHEMA).select(*columns)
    across = _joins(spark, root).where("event_id is not null").select(
        "event_id", "action_id", "old_status", "new_status",
        F.to_timestamp_ntz("at", F.lit(_TIME)).alias("changed_at"), F.col("span_batch").alias("batch_id"),
    )
    same_span = F.col("action_id").eqNullSafe(F.col("early_action")) & (F.col("batch_id") == F.col("early_batch"))
    same_action = F.col("action_id").eqNullSafe(F.col("anew"))
    kept = (
        inside.unionByName(across)
        .join(early, same_span, "left_anti")
        .join(anew, same_action, "left_anti")
        .select(*_HISTORY)
    )
    events = read_batches(spark, f"{root}/events", EVENT_SCHEMA).select(*_EVENT)
    return kept.unionByName(status_changes(events.join(anew, same_action, "left_semi"), f"{root}/work"))


def start_audit(events: DataFrame, root: str, checkpoint_dir: str) -> StreamingQuery:
    """Derive everything the stream holds now, then join it to what is held, and stop."""
    inside = (
        events.writeStream.foreachBatch(lambda batch, batch_id: audit_batch(batch, root, batch_id))
        .option("checkpointLocation", f"{checkpoint_dir}/inside")
        .trigger(availableNow=True)
        .start()
    )
    inside.awaitTermination()
    return start_joins(events.sparkSession, root, f"{checkpoint_dir}/joins")
