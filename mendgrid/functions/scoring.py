"""Risk score, due-date states and exact rounding as column expressions."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed values of the risk formula.
DEFAULT_CVSS = Decimal("5.0")
BASE_WEIGHT = Decimal("0.4")
CRITICALITY_STEP = Decimal("0.32")
EPSS_FACTOR = Decimal("1.5")
EXPLOIT_FACTOR = Decimal("1.20")
# Fixed values of the urgency rules.
DUE_SOON_DAYS = 7
IMMINENT_EPSS = Decimal("0.5")
ELEVATED_EPSS = Decimal("0.2")


def finding_risk_score(cvss: Column, epss: Column, criticality: Column, exploit: Column) -> Column:
    """Severity x criticality x exploit likelihood, rounded to cents; NULL criticality gives NULL."""
    severity = F.coalesce(cvss.cast("decimal(3,1)"), F.lit(DEFAULT_CVSS))
    weight = F.lit(BASE_WEIGHT) + criticality.cast("decimal(5,0)") * F.lit(CRITICALITY_STEP)
    likelihood = F.lit(Decimal("1.0")) + F.coalesce(
        epss.cast("decimal(5,4)"), F.lit(Decimal("0")).cast("decimal(5,4)")
    ) * F.lit(EPSS_FACTOR)
    bonus = F.when(exploit, F.lit(EXPLOIT_FACTOR)).otherwise(F.lit(Decimal("1.00")))
    return F.round(severity * weight * likelihood * bonus, 2).cast("decimal(12,2)")


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier).cast("bigint")


def overdue(due: Column, as_of: date) -> Column:
    return due < F.lit(as_of)


def sla_days_remaining(due: Column, settled: Column, as_of: date) -> Column:
    """Days left; negative when late, NULL without a due date or once settled."""
    return F.when(due.isNull() | settled, F.lit(None).cast("bigint")).otherwise(days_between(due, F.lit(as_of)))


def sla_urgency(due: Column, as_of: date) -> Column:
    return (
        F.when(overdue(due, as_of), "OVERDUE")
        .when(due <= F.date_add(F.lit(as_of), DUE_SOON_DAYS), "DUE SOON")
        .otherwise("WITHIN SLA")
    )


def threat_level(epss: Column, exploit: Column) -> Column:
    return (
        F.when((epss >= F.lit(IMMINENT_EPSS)) & exploit, "IMMINENT")
        .when((epss >= F.lit(ELEVATED_EPSS)) | exploit, "ELEVATED")
        .otherwise("MONITORED")
    )


def compliance_state(action_status: Column, action_is_open: Column, sla_due: Column, as_of: date) -> Column:
    soon = sla_due.between(F.lit(as_of), F.date_add(F.lit(as_of), DUE_SOON_DAYS))
    return (
        F.when(action_status == "Completed", "Compliant")
        .when(overdue(sla_due, as_of) & action_is_open, "SLA Breached")
        .when(soon & action_is_open, "At Risk")
        .otherwise("On Track")
    )


def rounded_ratio(numerator: Column, denominator: Column, places: int) -> Column:
    """``numerator / denominator`` of two whole numbers, rounded half away from zero.

    Whole-number division keeps ties exact, which a double average would not.
    NULL when the denominator is 0 or NULL.
    """
    # Widths that hold sums of 10^18 rows times the shift, and leave no digit of a product to be dropped.
    n = numerator.cast("decimal(24,0)")
    d = F.nullif(denominator.cast("decimal(24,0)"), F.lit(Decimal(0)).cast("decimal(24,0)"))
    shift = F.lit(Decimal(2 * 10**places))
    shifted = F.call_function("div", F.abs(n) * shift + d, d * F.lit(Decimal(2)))
    signed = F.when(n < 0, -shifted).otherwise(shifted)
    return (signed.cast("decimal(18,0)") * F.lit(Decimal(1).scaleb(-places))).cast(f"decimal(18,{places})")


def compliance_pct(completed: Column, total: Column) -> Column:
    """Share of completed actions in percent with one decimal; 100.0 without any action."""
    return F.coalesce(rounded_ratio(completed * F.lit(100), total, 1), F.lit(Decimal("100.0")))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def register_sql_functions(spark: SparkSession) -> None:
    """The risk score for SQL users; Catalyst inlines the body into the query plan."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION fn_finding_risk_score("
        "cvss DECIMAL(3,1), epss DECIMAL(5,4), criticality INT, exploit BOOLEAN) RETURNS DECIMAL(12,2) "
        "RETURN CAST(round(coalesce(cvss, 5.0BD) * (0.4BD + CAST(criticality AS DECIMAL(5,0)) * 0.32BD) "
        "* (1.0BD + coalesce(epss, 0BD) * 1.5BD) * if(exploit, 1.20BD, 1.00BD), 2) AS DECIMAL(12,2))"
    )
