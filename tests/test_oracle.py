"""Every registered job against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tests.compare import differences, duck
from trial.oracle import SQL
from trial.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_job_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_job_equals_sql(spark, con, name):
    df = contract.queries()[name](spark, SF)
    assert differences(df, con, contract.oracle_sql()[name]) == []


def test_stored_ingest_meets_the_real_keys(spark):
    """The jobs on the stored findings see every key of the feed, not a folded part of them."""
    found = contract.queries()["p1_record_stored_findings"](spark, SF)
    n = {r["outcome"]: r["n"] for r in found.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    assert set(n) == {"touched", "rejected_closed", "rejected_fk", "inserted"}
    assert found.select("asset_id_fk").distinct().count() > 100


def test_entry(spark):
    assert contract.entry(spark).count() == 5
