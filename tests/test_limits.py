"""Ids, sums and keys at the edge of their range."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from mendgrid.functions.scoring import rounded_ratio
from mendgrid.operators.changes import normalize
from mendgrid.schemas import TABLES
from trial.binding import PAIRS, finding_key, with_supplier


def test_ids_stay_distinct_at_a_hundred_times_the_test_data(spark):
    """All suppliers with the lowest and highest parts and assets: the places where digits could meet."""
    keys = (
        spark.range(1, 100_001).withColumnRenamed("id", "l_suppkey")
        .withColumn("l_partkey", F.explode(F.array(*[F.lit(p).cast("bigint") for p in (1, 2, 3, 1_999_999, 2_000_000)])))
        .withColumn("asset", F.explode(F.array(*[F.lit(a).cast("bigint") for a in (1, 2, 1_500_000)])))
        .selectExpr("asset", f"{with_supplier('l_partkey')} pair")
    )
    actions = keys.select((finding_key(F.col("asset"), F.col("pair")) * 10 + 7).alias("action_id"))
    assert actions.agg(F.count("*"), F.count_distinct("action_id")).first() == (1_500_000, 1_500_000)
    assert keys.agg(F.count_distinct("pair")).first()[0] == 500_000


@pytest.mark.parametrize("pair", [-1, PAIRS, PAIRS + 7])
def test_a_pair_beyond_the_range_stops_the_job(spark, pair):
    one = spark.range(1).select(finding_key(F.lit(1), F.lit(pair).cast("bigint")))
    with pytest.raises(Exception, match="out of range"):
        one.collect()
    assert spark.range(1).select(finding_key(F.lit(1), F.lit(None).cast("bigint"))).first()[0] is None


def test_a_supplier_beyond_the_range_stops_the_job(spark):
    with pytest.raises(Exception, match="out of range"):
        spark.sql("select 200000L l_suppkey, 1L l_partkey").selectExpr(with_supplier("l_partkey")).collect()


def test_ratios_of_very_large_sums(spark):
    got = spark.range(1).select(
        rounded_ratio(F.lit(10**17), F.lit(2 * 10**17), 4).alias("half"),
        rounded_ratio(F.lit(-1), F.lit(8), 2).alias("tie"),
        rounded_ratio(F.lit(1), F.lit(0), 2).alias("none"),
    )
    assert tuple(got.first()) == (Decimal("0.5000"), Decimal("-0.13"), None)


def test_a_malformed_key_is_a_finding_of_its_own_row(spark):
    rows = spark.createDataFrame([("abc", "Pending"), ("7", "Pending"), (None, "Pending")], "action_id string, status string")
    got = {r["action_id"]: r["found"] for r in normalize(TABLES["patch_actions"], rows.where("action_id is not null")).select(
        "action_id", F.filter("findings", lambda v: v["column_name"] == "action_id").alias("found")).collect()}
    assert [tuple(v) for v in got[None]] == [("C5", "action_id", "abc")]
    assert got[7] == []
