"""What building the bound tables needs at scale, and that its rows stay the same."""

from __future__ import annotations

from datetime import datetime

from tests.test_plans import plan, settings
from trial import binding

LINES = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz"


def feed(spark):
    day = datetime(1998, 1, 1)
    flags = [("N", "O"), ("A", "F"), ("R", "O"), ("R", "F")]
    rows = [(o, p, 3, *flags[(o + p) % 4], day.replace(day=o + p)) for o in (1, 2, 3) for p in (5, 6)]
    lines = spark.createDataFrame(rows + rows[:2] + [(9, 5, 3, "N", "O", day), (None, 5, 3, "N", "O", day)], LINES)
    orders = spark.createDataFrame([(o, 7, day.replace(month=o)) for o in (1, 2, 3)] + [(None, 7, day)], ORDERS)
    return lines, orders


def test_feed_is_neither_sorted_nor_aggregated_by_sorting(spark):
    lines, orders = feed(spark)
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        sighted = binding.sightings(lines, orders)
        assert "ShuffledHashJoin" in plan(sighted) and "Sort" not in plan(sighted).replace("SortMergeJoin", "Sort")
        assets = spark.createDataFrame([(7, 1, 2)], "asset_id bigint, org_id_fk bigint, criticality smallint")
        vulns = spark.createDataFrame(
            [(p, None, None, True) for p in (5, 6)],
            "vuln_id bigint, cvss_score decimal(3,1), epss_score decimal(5,4), exploit_available boolean",
        )
        found = binding.scan_findings(sighted, assets, vulns)
        assert "SortAggregate" not in plan(found)
    rows = {r["sw_vuln_id_fk"]: r for r in found.collect()}
    # Accepted Risk, False Positive, Open for part 5; False Positive, Open, Remediated for part 6.
    assert {k: r["status"] for k, r in rows.items()} == {5 * 200000 + 3: "Accepted Risk", 6 * 200000 + 3: "False Positive"}
    one = rows[5 * 200000 + 3]
    assert (one["discovered_at"], one["last_seen_at"]) == (datetime(1998, 1, 1), datetime(1998, 3, 1))


def test_every_status_keeps_its_place(spark):
    flags = {"NO": "Open", "NF": "In Progress", "AO": "Pending Retest", "AF": "Remediated", "RO": "Accepted Risk", "RF": "False Positive"}
    day = datetime(1998, 1, 1)
    rows, expected = [], {}
    for i, a in enumerate(flags):
        for j, b in enumerate(flags):
            part = 10 * i + j + 1
            rows += [(1, part, 3, *a, day), (1, part, 3, *b, day)]
            expected[part * 200000 + 3] = min(flags[a], flags[b])
    orders = spark.createDataFrame([(1, 7, day)], ORDERS)
    assets = spark.createDataFrame([(7, 1, 2)], "asset_id bigint, org_id_fk bigint, criticality smallint")
    vulns = spark.range(100).selectExpr(
        "id vuln_id", "cast(1 as decimal(3,1)) cvss_score", "cast(0 as decimal(5,4)) epss_score", "true exploit_available"
    )
    found = binding.scan_findings(binding.sightings(spark.createDataFrame(rows, LINES), orders), assets, vulns)
    assert {r["sw_vuln_id_fk"]: r["status"] for r in found.collect()} == expected


def test_pairs_are_dealt_before_repeats_are_dropped(spark):
    lines, orders = feed(spark)
    pairs = binding.software_vulnerabilities(lines)
    text = plan(pairs)
    assert "Exchange" in text and "Aggregate" not in text[text.index("Exchange"):]
    assert sorted((r[0], r[1], r[2]) for r in pairs.collect()) == [(5 * 200000 + 3, 3, 5), (6 * 200000 + 3, 3, 6)]
    installs = binding.asset_software_installs(lines, orders, spark.range(10).withColumnRenamed("id", "asset_id"))
    assert [(r["asset_id_fk"], r["software_id_fk"]) for r in installs.collect()] == [(7, 3)]


def test_feed_is_dealt_before_it_is_grouped(spark):
    """A table of the whole feed, made before the shuffle, has to be spilled."""
    lines, orders = feed(spark)
    assets = spark.createDataFrame([(7, 1, 2)], "asset_id bigint, org_id_fk bigint, criticality smallint")
    vulns = spark.createDataFrame(
        [(p, None, None, True) for p in (5, 6)],
        "vuln_id bigint, cvss_score decimal(3,1), epss_score decimal(5,4), exploit_available boolean",
    )
    found = binding.scan_findings(binding.sightings(lines, orders), assets, vulns)
    text = plan(found)
    dealt = text[text.index("REPARTITION_BY_NUM"):]
    assert "Aggregate" not in dealt
    assert "l_returnflag" not in dealt[: dealt.index("Exchange")]
    assert {r["sw_vuln_id_fk"]: r["finding_id"] for r in found.collect()} == {
        p * 200000 + 3: 7 * binding.PAIRS + p * 200000 + 3 for p in (5, 6)
    }


def test_part_of_a_pair(spark):
    rows = spark.createDataFrame([(p, s) for p in (-7, 0, 5, 10**12) for s in (0, 3, 199999)] + [(None, 3)], "l_partkey bigint, l_suppkey bigint")
    got = rows.selectExpr("l_partkey", f"{binding.with_supplier('l_partkey')} pair").withColumn("part", binding.part_of("pair"))
    assert all(r["part"] == r["l_partkey"] for r in got.collect())


def test_flags_without_a_status_of_their_own(spark):
    day = datetime(1998, 1, 1)
    flags = [("R", "F"), ("X", "Y"), (None, "O"), ("N", None)]
    lines = spark.createDataFrame([(1, i, 3, *f, day) for i, f in enumerate(flags)] + [(1, 9, 3, "N", "O", None)], LINES)
    orders = spark.createDataFrame([(1, 7, day)], ORDERS)
    got = {r["l_partkey"]: (r["status"], r["ship"]) for r in binding.sightings(lines, orders).collect()}
    assert got == {**dict.fromkeys(range(4), ("False Positive", day.date())), 9: ("Open", None)}
