"""Opening patch actions for findings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendgrid.functions.vocabulary import CLOSED, IN_PROGRESS, PENDING, action_priority
from mendgrid.operators import integrity
from mendgrid.operators.audit import last_history_id
from mendgrid.operators.changes import judge_new
from mendgrid.operators.numbering import number_rows
from mendgrid.plans.facts import only_matching, with_vulnerability
from mendgrid.schemas import TABLES
from mendgrid.sources.storage import conform, settle, work_place

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Initiated:
    """Results that belong together: store all of them or none."""

    actions: DataFrame
    history: DataFrame
    findings: DataFrame
    rejected: DataFrame


def initiate_patch_actions(
    tables: Tables, requests: DataFrame, now: datetime, work: str | None = None
) -> Initiated:
    """Turn requests (action_id, finding_id, assigned_to, assigned_by, action_type, due_date, ticket)
    into pending actions.

    A request is refused when its finding is missing or closed, or when its action breaks a rule: an unknown
    assignee, a type that isn't allowed, an id that is absent, stored already or given twice. Each accepted
    request makes its own action and first history row; its finding goes to In Progress once, whatever it was.
    The caller chooses the new action ids; history ids go on from the largest stored one.
    ``rejected`` has a row for each reason. The judged requests are stored, so all four results agree.
    """
    spec = TABLES["patch_actions"]
    current = with_vulnerability(
        only_matching(tables["scan_findings"], ["finding_id"], requests, ["finding_id"]).select(
            F.col("finding_id").alias("have_finding"), "sw_vuln_id_fk", F.col("status").alias("finding_status")
        ),
        tables,
        "severity",
    )
    met = requests.join(current, F.col("finding_id") == F.col("have_finding"), "left")
    stamp = F.lit(now).cast("timestamp_ntz")
    given = {
        "action_id": F.col("action_id"),
        "finding_id_fk": F.col("finding_id"),
        "assigned_to_fk": F.col("assigned_to"),
        "assigned_by_fk": F.col("assigned_by"),
        "action_type": F.col("action_type"),
        "status": F.lit(PENDING),
        "priority": action_priority("severity"),
        "due_date": F.col("due_date"),
        "change_ticket_id": F.col("ticket"),
        "created_at": stamp,
    }
    rows = met.select(
        *[v.cast(spec.column(c).spark_type).alias(c) for c, v in given.items()],
        "finding_status",
        F.when(F.col("have_finding").isNull(), "rejected_missing")
        .when(F.col("finding_status").isin(*CLOSED), "rejected_closed")
        .alias("reason"),
    ).withColumn("findings", integrity.row_findings(spec, only=list(given)))
    judged = settle(judge_new(tables, spec, rows), work_place(requests.sparkSession, "requests", work))
    accepted = judged.where(F.col("reason").isNull() & (F.size("findings") == 0))
    actions = conform(accepted, "patch_actions")
    history = accepted.select(
        F.col("action_id").alias("action_id_fk"),
        F.lit(PENDING).alias("new_status"),
        F.col("assigned_by_fk").alias("changed_by_fk"),
        F.col("created_at").alias("changed_at"),
        F.concat(F.lit("Patch action initiated by "), F.col("assigned_by_fk").cast("string")).alias("change_reason"),
        F.lit(False).alias("automated"),
    )
    after = last_history_id(tables["patch_status_history"])
    history = conform(number_rows(history, "history_id", ["action_id_fk"], after, work), "patch_status_history")
    started = accepted.select(F.col("finding_id_fk").alias("started_id")).distinct()
    findings = (
        tables["scan_findings"]
        .join(started, F.col("finding_id") == F.col("started_id"), "left")
        .withColumn(
            "status", F.when(F.col("started_id").isNotNull(), F.lit(IN_PROGRESS)).otherwise(F.col("status"))
        )
        .drop("started_id")
    )
    refused = judged.withColumn(
        "findings",
        F.when(F.col("reason").isNotNull(), F.array(F.lit(None).cast(judged.schema["findings"].dataType.elementType)))
        .otherwise(F.col("findings")),
    )
    rejected = refused.select(
        "action_id", F.col("finding_id_fk").alias("finding_id"), F.coalesce("reason", F.lit("rejected_rule")).alias("reason"),
        "finding_status", F.explode("findings").alias("v"),
    ).select("action_id", "finding_id", "reason", "finding_status", "v.rule_id", "v.column_name", "v.value")
    return Initiated(actions, history, findings, rejected)
