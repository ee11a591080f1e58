"""Daily risk snapshots per asset and their trend."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendgrid.functions.scoring import finding_risk_score, overdue
from mendgrid.functions.vocabulary import not_settled
from mendgrid.plans.facts import only_matching, with_asset, with_vulnerability
from mendgrid.schemas import TABLES
from mendgrid.sources.storage import conform

Tables = Mapping[str, DataFrame]

_LEVELS = {"Critical": "critical_count", "High": "high_count", "Medium": "medium_count", "Low": "low_count"}


def scored_findings(tables: Tables, findings: DataFrame) -> DataFrame:
    """Findings with severity, exploit flag and a freshly computed score."""
    scored = with_vulnerability(
        with_asset(findings, tables, "criticality"),
        tables,
        "severity", "cvss_score", "epss_score", "exploit_available",
    )
    return scored.withColumn("fresh_score", _score())


def _score() -> Column:
    return finding_risk_score(
        F.col("cvss_score"), F.col("epss_score"), F.col("criticality"), F.col("exploit_available")
    )


_RATED = ["severity", "cvss_score", "epss_score", "exploit_available"]
MEASURES = ["open_findings_count", *_LEVELS.values(), "exploit_active_count", "sla_breached_count"]


def counted_by_rating(tables: Tables, findings: DataFrame, sums: Mapping[str, Column]) -> DataFrame:
    """``sums`` over findings per asset and rating of the vulnerability, with the asset's criticality.

    A score depends on no more than that, so findings are added up before they meet their asset: a hot asset
    arrives there as one row per rating, in any session and whatever the joins become.
    """
    rated = with_vulnerability(findings, tables, *_RATED)
    keys = [c for c in ("asset_id_fk", "turn") if c in findings.columns]
    counted = rated.groupBy(*keys, *_RATED).agg(*[F.sum(v).alias(c) for c, v in sums.items()])
    return with_asset(counted, tables, "criticality")


def risk_by_asset(tables: Tables, findings: DataFrame, as_of: date, sign: int = 1) -> DataFrame:
    """Wide sums of the measures per asset over ``findings`` (unsettled ones), each times ``sign``."""
    counted = counted_by_rating(
        tables,
        findings.select("asset_id_fk", "sw_vuln_id_fk", "sla_due_date"),
        {"n": F.lit(1), "late": F.when(overdue(F.col("sla_due_date"), as_of), 1).otherwise(0)},
    )
    n = F.col("n") * sign

    def among(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0))

    return counted.groupBy("asset_id_fk").agg(
        F.sum(_score() * n.cast("decimal(18,0)")).cast("decimal(28,2)").alias("composite_score"),
        F.sum(n).alias("open_findings_count"),
        *[among(F.col("severity") == level).alias(name) for level, name in _LEVELS.items()],
        among(F.col("exploit_available")).alias("exploit_active_count"),
        F.sum(F.col("late") * sign).alias("sla_breached_count"),
    )


def unsettled(findings: DataFrame) -> DataFrame:
    return findings.where(not_settled("status"))


def active_risk_by_asset(tables: Tables, as_of: date) -> DataFrame:
    """Measures of every asset with unsettled findings, as wide sums that can be corrected later."""
    return risk_by_asset(tables, unsettled(tables["scan_findings"]), as_of)


def advance_risk(
    totals: DataFrame, tables: Tables, before: DataFrame, after: DataFrame, previous: date, as_of: date
) -> DataFrame:
    """The measures on ``as_of`` from those on the day ``previous`` and the findings changed in between.

    ``before`` holds the changed findings as they stood in ``totals`` (none for a new one), ``after`` as they
    stand in ``tables`` (none for a deleted one). Of the unchanged findings only those are read whose due date
    has passed since, which the scan can skip by. Ratings and criticality have to be those that ``totals``
    used; assets whose own changed are refreshed whole instead, as ``chosen`` ones.
    """
    touched = before.select("finding_id").unionByName(after.select("finding_id")).distinct()
    passed = unsettled(tables["scan_findings"]).where(
        (F.col("sla_due_date") >= F.lit(previous)) & (F.col("sla_due_date") < F.lit(as_of))
    )
    lapsed = passed.join(touched, "finding_id", "left_anti").groupBy("asset_id_fk").agg(
        F.count(F.lit(1)).alias("sla_breached_count")
    )
    none = [F.lit(0).cast("decimal(28,2)").alias("composite_score")]
    none += [F.lit(0).cast("bigint").alias(m) for m in MEASURES if m != "sla_breached_count"]
    columns = ["asset_id_fk", "composite_score", *MEASURES]
    parts = [
        totals.select(*columns),
        risk_by_asset(tables, unsettled(before), previous, -1).select(*columns),
        risk_by_asset(tables, unsettled(after), as_of).select(*columns),
        lapsed.select("asset_id_fk", "sla_breached_count", *none).select(*columns),
    ]
    summed = reduce(DataFrame.unionByName, parts).groupBy("asset_id_fk").agg(
        F.sum("composite_score").cast("decimal(28,2)").alias("composite_score"),
        *[F.sum(m).alias(m) for m in MEASURES],
    )
    return summed


@dataclass(frozen=True)
class Refreshed:
    snapshots: DataFrame
    rejected: DataFrame


def snapshots_of(
    totals: DataFrame, assets: DataFrame, as_of: date, chosen: DataFrame | None = None
) -> Refreshed:
    """Snapshot rows of all assets, or of those in ``chosen`` (asset_id), from their measures.

    An asset without unsettled findings gets zeros. One with a measure out of its column's range is refused
    alone, with a row for each such measure. The id is arithmetic on (asset, day), so a second run
    yields the same rows.
    """
    day = F.datediff(F.lit(as_of), F.lit(date(1970, 1, 1)))
    wanted = assets.select("asset_id")
    if chosen is not None:
        wanted = wanted.join(chosen.select("asset_id").distinct(), "asset_id", "left_semi")
    spec = TABLES["risk_score_snapshots"]
    wide = wanted.join(totals, F.col("asset_id") == F.col("asset_id_fk"), "left").select(
        (F.col("asset_id") * 100000 + day).alias("snapshot_id"),
        F.col("asset_id").alias("asset_id_fk"),
        F.lit(as_of).alias("snapshot_date"),
        F.coalesce("composite_score", F.lit(Decimal("0.00"))).alias("composite_score"),
        *[F.coalesce(m, F.lit(0)).alias(m) for m in MEASURES],
    )
    beyond = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(m).try_cast(spec.column(m).spark_type).isNull(),
                    F.struct(F.lit(m).alias("column_name"), F.col(m).cast("string").alias("value")),
                )
                for m in ("composite_score", *MEASURES)
            ]
        )
    )
    judged = wide.withColumn("beyond", beyond)
    rejected = judged.select("asset_id_fk", "snapshot_date", F.explode("beyond").alias("b")).select(
        "asset_id_fk", "snapshot_date", "b.column_name", "b.value"
    )
    return Refreshed(conform(judged.where(F.size("beyond") == 0), "risk_score_snapshots"), rejected)


def judged_risk_snapshots(tables: Tables, as_of: date, chosen: DataFrame | None = None) -> Refreshed:
    """Snapshots of ``as_of`` computed from all unsettled findings, or from those of the ``chosen`` assets."""
    findings = unsettled(tables["scan_findings"])
    if chosen is not None:
        findings = only_matching(findings, ["asset_id_fk"], chosen, ["asset_id"])
    return snapshots_of(risk_by_asset(tables, findings, as_of), tables["assets"], as_of, chosen)


def refresh_risk_snapshots(tables: Tables, as_of: date, chosen: DataFrame | None = None) -> DataFrame:
    """One snapshot row per asset for ``as_of``, without the refused ones."""
    return judged_risk_snapshots(tables, as_of, chosen).snapshots


def asset_composite_risk(tables: Tables, as_of: date) -> DataFrame:
    """Summed fresh scores of unsettled findings per asset, 0 where there are none."""
    per_asset = active_risk_by_asset(tables, as_of).select("asset_id_fk", "composite_score")
    return (
        tables["assets"]
        .join(per_asset, F.col("asset_id") == F.col("asset_id_fk"), "left")
        .select(
            "asset_id",
            F.coalesce("composite_score", F.lit(Decimal("0.00"))).cast("decimal(18,2)").alias("composite_risk"),
        )
    )


def risk_history(tables: Tables, days: Sequence[date]) -> DataFrame:
    """The composite score of every asset on each of ``days``, by one scan of the findings.

    A finding adds its score on the first of the days at which it was discovered and takes it off on the
    first at which it was fixed; the score of a day is the sum of what came before. A settled finding counts until its
    fix, or not at all if none is recorded; any other counts from its discovery on. Ratings are today's.
    """
    ordered = sorted(set(days))
    given = F.array(*[F.lit(d) for d in ordered])

    def turn(at: Column) -> Column:
        """Place of the first day that isn't before ``at``."""
        return F.size(F.filter(given, lambda d: d < at.cast("date")))

    never = F.lit(len(ordered))
    closed = F.when(not_settled("status"), never).when(F.col("first_fixed_at").isNull(), 0).otherwise(turn(F.col("first_fixed_at")))
    seen = tables["scan_findings"].select(
        "asset_id_fk", "sw_vuln_id_fk", turn(F.col("discovered_at")).alias("opened"), closed.alias("closed")
    ).where("opened < closed")
    turns = F.array(
        F.struct(F.col("opened").alias("turn"), F.lit(1).alias("sign")), F.struct(F.col("closed").alias("turn"), F.lit(-1).alias("sign"))
    )
    steps = seen.select("asset_id_fk", "sw_vuln_id_fk", F.explode(turns).alias("t")).select(
        "asset_id_fk", "sw_vuln_id_fk", "t.turn", "t.sign"
    ).where(F.col("turn") < never)
    moved = (
        counted_by_rating(tables, steps, {"n": F.col("sign")})
        .groupBy(F.col("asset_id_fk").alias("moved_asset"), F.col("turn").alias("moved_turn"))
        .agg(F.sum(_score() * F.col("n").cast("decimal(18,0)")).cast("decimal(28,2)").alias("moved"))
    )
    grid = tables["assets"].select(F.col("asset_id").alias("asset_id_fk"), F.posexplode(given).alias("turn", "snapshot_date"))
    met = grid.join(moved, (F.col("asset_id_fk") == F.col("moved_asset")) & (F.col("turn") == F.col("moved_turn")), "left")
    # A group holds one row per day of one asset.
    so_far = Window.partitionBy("asset_id_fk").orderBy("snapshot_date").rowsBetween(Window.unboundedPreceding, 0)
    score = F.sum(F.coalesce("moved", F.lit(0).cast("decimal(28,2)"))).over(so_far)
    return met.select("asset_id_fk", "snapshot_date", score.cast("decimal(18,2)").alias("composite_score"))


def risk_trend(snapshots: DataFrame) -> DataFrame:
    """Change of the composite score since the asset's previous snapshot.

    A group holds one row per day of one asset, so its size is bounded by the days kept.
    """
    by_day = Window.partitionBy("asset_id_fk").orderBy("snapshot_date")
    before = F.lag("composite_score").over(by_day)
    return snapshots.select(
        "asset_id_fk", "snapshot_date", "composite_score",
        before.alias("previous_score"), (F.col("composite_score") - before).cast("decimal(18,2)").alias("score_change"),
    )
