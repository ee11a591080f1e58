"""Keys beyond the range of arithmetic ids: ids stay distinct, and every job that reads findings ends."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_plans import settings
from trial import binding
from trial.binding import AS_OF, RAW, tables
from trial.queries import QUERIES

CUSTOMERS = [*range(40), *range(2_000_000, 2_000_040)]
SUPPLIERS = [*range(6), *range(250_000, 250_006)]
PARTS = [*range(30), *range(3_000_000, 3_000_030)]
START = datetime(1997, 6, 1)
# Order, part, supplier: high and low keys meet each other.
LINES = [(o, PARTS[(o * 7 + n * 11) % 60], SUPPLIERS[(o * 5 + n) % 12]) for o in range(300) for n in range(4)]


def customer_of(order: int) -> int:
    return CUSTOMERS[order * 13 % 80]


def ordered_at(order: int) -> datetime:
    return START + timedelta(days=order * 2)


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("wide"))
    flags = ["NO", "NF", "AO", "AF", "RO", "RF"]
    rows = {
        "region": [(r, f"Region {r}") for r in range(5)],
        "nation": [(n, f"Nation {n}", n % 5) for n in range(25)],
        "customer": [(c, f"Customer {c}", c % 25, 1.0, "BUILDING") for c in CUSTOMERS],
        "supplier": [(s, f"Supplier {s}", s % 25, 1.0) for s in SUPPLIERS],
        "part": [(p, f"Part {p}", "B", "T", 1 + p % 50, 1.0) for p in PARTS],
        "orders": [(o, customer_of(o), "O", 1.0, ordered_at(o), "1") for o in range(300)],
        "lineitem": [
            (o, p, s, i % 4, 1.0, 1.0, 0.0, 0.0, *flags[i % 6], ordered_at(o)) for i, (o, p, s) in enumerate(LINES)
        ],
        "events": [(e, START + timedelta(hours=e), e % 9, "Pending" if e % 2 else "Failed", 1.0, "") for e in range(40)],
    }
    for name, given in rows.items():
        spark.createDataFrame(given, RAW[name]).write.parquet(f"{at}/{name}.parquet")
    return at


def found_keys(since: datetime | None = None) -> set:
    known = {c for c in CUSTOMERS if c % 25 != 24}
    kept = {o for o in range(300) if customer_of(o) % 50 != 49 and (since is None or ordered_at(o) >= since)}
    return {(customer_of(o), p, s) for o, p, s in LINES if o in kept and (since or customer_of(o) in known)}


def test_pairs_of_any_supplier(spark):
    keys = [(p, s) for p in (0, 1, 999, 7_199_999, 5_999_999_999) for s in (0, 199_999, 200_000, 359_999, 400_001, 200_199_999)]
    rows = spark.createDataFrame([*keys, (None, 250_000)], "l_partkey bigint, l_suppkey bigint")
    got = rows.selectExpr("l_partkey", "l_suppkey", f"{binding.with_any_supplier('l_partkey')} pair")
    got = got.withColumn("part", binding.part_of("pair")).collect()
    assert all(r["part"] == r["l_partkey"] for r in got)
    assert len({r["pair"] for r in got}) == len(keys) + 1
    assert all(r["pair"] == r["l_partkey"] * 200000 + r["l_suppkey"] for r in got if r["l_suppkey"] < 200000)
    for part, supplier in ((1, 200_200_000), (1, -1), (6_000_000_000, 200_000), (40_000_000_000_000, 5)):
        with pytest.raises(Exception, match="out of range"):
            one = spark.createDataFrame([(part, supplier)], "l_partkey bigint, l_suppkey bigint")
            one.selectExpr(binding.with_any_supplier("l_partkey")).collect()


def findings(spark, wide):
    def src(name):
        return binding.raw(spark, wide, name)

    assert binding.ids_run_out(src("lineitem"), src("orders"))
    return binding.scan_findings(
        binding.sightings(src("lineitem"), src("orders")), binding.assets(src("customer")),
        binding.vulnerabilities(src("part")), True,
    )


def test_findings_and_actions_have_ids_of_their_own(spark, wide):
    found = findings(spark, wide)
    rows = found.select("finding_id", "asset_id_fk", "sw_vuln_id_fk").collect()
    assert len({r["finding_id"] for r in rows}) == len(rows) == len(found_keys())
    for r in rows:
        held = r["sw_vuln_id_fk"] < binding.PAIRS and r["asset_id_fk"] <= binding.LAST_ASSET
        assert held == (r["finding_id"] == r["asset_id_fk"] * binding.PAIRS + r["sw_vuln_id_fk"])
        assert held == (r["finding_id"] >= binding.FIRST_ASSET * binding.PAIRS)
    actions = [r[0] for r in binding.patch_actions(found).select("action_id").collect()]
    assert len(set(actions)) == len(actions) > 0


def test_ids_do_not_depend_on_how_rows_are_dealt(spark, wide):
    def read():
        return {tuple(r) for r in findings(spark, wide).select("finding_id", "asset_id_fk", "sw_vuln_id_fk").collect()}

    with settings(spark, spark__sql__shuffle__partitions="3"):
        few = read()
    assert few == read()


def test_a_hot_asset_has_numbers_in_many_groups(spark):
    rows = spark.range(20_000).selectExpr("5000000L asset_id_fk", "id + 600000000000 sw_vuln_id_fk")
    rows = rows.withColumn("slot", binding.slot_of("sw_vuln_id_fk")).withColumn("number", binding.number_in_slot())
    made = binding.finding_id(*[F.col(c) for c in ("asset_id_fk", "sw_vuln_id_fk", "slot", "number")])
    counts = rows.agg(F.count_distinct(made), F.count_distinct("slot"), F.max("number")).first()
    assert counts[:2] == (20_000, binding.SLOTS) and counts[2] < 400


def test_ids_are_arithmetic_in_range(spark):
    lines = spark.createDataFrame([(2_499_999, 199_999), (None, 5), (0, 0)], "l_partkey bigint, l_suppkey bigint")
    orders = spark.createDataFrame([(0,), (binding.LAST_ASSET,), (None,)], "o_custkey bigint")
    assert not binding.ids_run_out(lines, orders)
    assert binding.ids_run_out(lines, spark.range(1).selectExpr(f"{binding.LAST_ASSET + 1}L o_custkey"))
    assert binding.ids_run_out(spark.range(1).selectExpr("2500000L l_partkey", "0L l_suppkey"), orders)


# F1 to F13. The number of rows, and a column that tells them apart.
JOBS = {
    "s1_stream_stored_findings": ("sighted", "asset_id_fk,sw_vuln_id_fk"),
    "a6_lookup_findings_of_breached_actions": ("breached", "finding_id"),
    "c2_primary_key": ("repeated", "key"),
    "m3_actions_after": (None, "action_id"),
    "r7_org_risk_posture": ("nations", "org_id"),
    "p3_advanced_risk_snapshots": ("assets", "asset_id_fk"),
    "c4_foreign_key": (None, None),
    "m2_updated_actions": ("actions", "action_id"),
    "t3_finding_remediated": ("findings", "finding_id"),
    "v2_patch_compliance_status": ("actions", "action_id"),
    "f2_sla_days_remaining": ("findings", "finding_id"),
    "c1_not_null": (None, None),
    "a5_labeled_risk_score_snapshots": ("assets", "asset_id_fk"),
    "t2_stored_pre_insert": ("sighted", "finding_id"),
    "t2_finding_pre_insert": (None, "finding_id"),
    "p1_findings_after": (None, "finding_id"),
    "p2_new_actions": (None, "action_id"),
}


@pytest.mark.parametrize("name", JOBS)
def test_jobs_end_with_whole_results(spark, wide, name):
    rows, key = JOBS[name]
    t = tables(spark, wide)
    actions, found = t["patch_actions"], t["scan_findings"]
    expected = {
        "findings": len(found_keys()),
        "sighted": len(found_keys(datetime(AS_OF.year, AS_OF.month, AS_OF.day))),
        "assets": len([c for c in CUSTOMERS if c % 25 != 24]),
        "nations": 25,
        "actions": actions.count(),
        "breached": actions.where(F.col("due_date") < F.lit(AS_OF)).select("finding_id_fk").distinct().count(),
        "repeated": found.where("(asset_id_fk + sw_vuln_id_fk) % 50 = 0").count(),
    }
    got = QUERIES[name](spark, wide).persist()
    assert got.count() == expected[rows] if rows else got.count() > 0
    if key:
        assert got.select(*key.split(",")).distinct().count() == got.count()
    if name == "c4_foreign_key":
        assert got.where("table_name = 'scan_findings'").isEmpty()
    if name == "m3_actions_after":
        left = QUERIES["m3_findings_after"](spark, wide).select("finding_id")
        assert got.join(left, got.finding_id_fk == left.finding_id, "left_anti").isEmpty()
    got.unpersist()
