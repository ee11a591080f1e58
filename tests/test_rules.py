from __future__ import annotations

from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mendgrid.functions import scoring
from mendgrid.functions.vocabulary import action_open, action_priority, not_closed, not_settled, severity_rank
from mendgrid.operators.integrity import INET_PATTERN, MACADDR_PATTERN
from mendgrid.schemas import TABLES

DAY = date(2025, 3, 10)
SCORE_SCHEMA = "cvss decimal(3,1), epss decimal(5,4), criticality int, exploit boolean"


def score(spark, rows):
    df = spark.createDataFrame([tuple(Decimal(v) if isinstance(v, str) else v for v in r) for r in rows], SCORE_SCHEMA)
    s = scoring.finding_risk_score(F.col("cvss"), F.col("epss"), F.col("criticality"), F.col("exploit"))
    return [r[0] for r in df.select(s).collect()]


def test_registry_counts():
    assert len(TABLES) == 15
    assert sum(len(t.columns) for t in TABLES.values()) == 166
    assert sum(len(t.references) for t in TABLES.values()) == 24
    assert sum(r.on_delete == "cascade" for t in TABLES.values() for r in t.references) == 16
    assert sum(len(t.checks) for t in TABLES.values()) == 27
    assert sum(bool(t.unique) for t in TABLES.values()) == 13


def test_worked_scores(spark):
    got = score(
        spark,
        [("9.8", "0.97", 5, True), ("9.8", "0.97", 1, False), ("10.0", "0.975", 5, True), (None, None, 3, None),
         ("9.8", "0.97", None, True)],
    )
    assert got == [Decimal("57.74"), Decimal("17.32"), Decimal("59.10"), Decimal("6.80"), None]


def test_score_is_monotone(spark):
    base = [(c, e, k, x) for c in ("0.0", "4.9", "10.0") for e in ("0", "0.4999", "1") for k in (1, 3, 5)
            for x in (False, True)]
    values = dict(zip(base, score(spark, base)))
    for axis in range(4):
        for key, value in values.items():
            for other, more in values.items():
                same = all(key[i] == other[i] for i in range(4) if i != axis)
                if same and float(other[axis]) >= float(key[axis]):
                    assert more >= value


def test_sql_function_equals_column(spark):
    scoring.register_sql_functions(spark)
    df = spark.createDataFrame(
        [(Decimal("9.8"), Decimal("0.97"), 5, True), (None, None, 3, None), (Decimal("1.0"), None, None, False)],
        SCORE_SCHEMA,
    )
    s = scoring.finding_risk_score(F.col("cvss"), F.col("epss"), F.col("criticality"), F.col("exploit"))
    both = df.select(s.alias("a"), F.expr("fn_finding_risk_score(cvss, epss, criticality, exploit)").alias("b"))
    assert all(r.a == r.b for r in both.collect())


def test_statuses_with_null(spark):
    df = spark.createDataFrame([("Open",), ("Accepted Risk",), ("Remediated",), (None,)], "s string")
    got = df.select(not_closed("s"), not_settled("s")).collect()
    assert [tuple(r) for r in got] == [(True, True), (True, False), (False, False), (None, None)]
    done = spark.createDataFrame([("Failed",), ("Completed",), ("Cancelled",)], "s string")
    assert [r[0] for r in done.select(action_open("s")).collect()] == [True, False, False]


def test_ranks_and_priority(spark):
    df = spark.createDataFrame([("Critical",), ("High",), ("Medium",), ("Low",), ("Info",), (None,)], "s string")
    got = [tuple(r) for r in df.select(severity_rank("s"), severity_rank("s", 3), action_priority("s")).collect()]
    assert got == [(1, 1, "Critical"), (2, 2, "High"), (3, 3, "Medium"), (4, 4, "Low"), (5, 4, "Low"), (5, 4, "Low")]


@pytest.mark.parametrize(
    "offset, urgency, days",
    [(-1, "OVERDUE", -1), (0, "DUE SOON", 0), (7, "DUE SOON", 7), (8, "WITHIN SLA", 8), (None, "WITHIN SLA", None)],
)
def test_due_states(spark, offset, urgency, days):
    due = None if offset is None else DAY + timedelta(days=offset)
    df = spark.createDataFrame([(due,)], "due date")
    r = df.select(
        scoring.sla_urgency(F.col("due"), DAY),
        scoring.sla_days_remaining(F.col("due"), F.lit(False), DAY),
        scoring.sla_days_remaining(F.col("due"), F.lit(True), DAY),
    ).first()
    assert tuple(r) == (urgency, days, None)


def test_compliance_states(spark):
    cases = [
        ("Completed", -5, "Compliant"), ("Pending", -5, "SLA Breached"), ("Failed", -1, "SLA Breached"),
        ("Cancelled", -5, "On Track"), ("Pending", 0, "At Risk"), ("Pending", 7, "At Risk"),
        ("Pending", 8, "On Track"), ("Pending", None, "On Track"), ("Cancelled", 3, "On Track"),
    ]
    df = spark.createDataFrame(
        [(s, None if d is None else DAY + timedelta(days=d)) for s, d, _ in cases], "s string, due date"
    )
    state = scoring.compliance_state(F.col("s"), action_open("s"), F.col("due"), DAY)
    assert [r[0] for r in df.select(state).collect()] == [c[2] for c in cases]


def test_threat_levels(spark):
    cases = [("0.5", True, "IMMINENT"), ("0.5", False, "ELEVATED"), ("0.2", False, "ELEVATED"),
             ("0.1999", False, "MONITORED"), (None, True, "ELEVATED"), (None, False, "MONITORED")]
    df = spark.createDataFrame(
        [(None if e is None else Decimal(e), x) for e, x, _ in cases], "e decimal(5,4), x boolean"
    )
    got = [r[0] for r in df.select(scoring.threat_level(F.col("e"), F.col("x"))).collect()]
    assert got == [c[2] for c in cases]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-10**9, 10**9), st.integers(0, 10**6)), min_size=20, max_size=60))
def test_ratio_rounds_half_away_from_zero(spark, pairs):
    df = spark.createDataFrame(pairs, "n bigint, d bigint")
    got = [r[0] for r in df.select(scoring.rounded_ratio(F.col("n"), F.col("d"), 2)).collect()]
    for (n, d), value in zip(pairs, got):
        want = None if d == 0 else (Decimal(n) / Decimal(d)).quantize(Decimal("0.01"), ROUND_HALF_UP)
        assert value == want


def test_address_patterns(spark):
    good = ["10.0.0.1", "10.0.0.0/8", "255.255.255.255", "::", "::1", "2001:db8::8a2e:370:7334", "1:2:3:4:5:6:7:8",
            "1:2:3:4:5:6:7::", "::ffff:10.0.0.1", "fe80::1/64"]
    bad = ["300.1.1.1", "10.0.0", "10.0.0.1/33", "1:2:3:4:5:6:7:8:9", "1::2::3", "12345::1", "::1/129", "host", ""]
    mac_good = ["08:00:2b:01:02:03", "08-00-2B-01-02-03", "08002b:010203", "0800.2b01.0203", "08002b010203"]
    mac_bad = ["08:00:2b:01:02", "08:00:2b:01:02:0g", "08:00-2b:01:02:03", ""]
    for pattern, yes, no in ((INET_PATTERN, good, bad), (MACADDR_PATTERN, mac_good, mac_bad)):
        df = spark.createDataFrame([(v,) for v in yes + no], "v string")
        got = [r[0] for r in df.select(F.col("v").rlike(pattern)).collect()]
        assert got == [True] * len(yes) + [False] * len(no)
