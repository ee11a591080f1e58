"""Joins and pre-aggregations shared by the reports.

Rules followed throughout:

* pairs and vulnerabilities are joined first, so facts are shuffled once on the pair, not twice;
* no join carries a broadcast hint: Spark broadcasts a side only when its measured size is under
  ``spark.sql.autoBroadcastJoinThreshold`` and shuffles both sides otherwise;
* a fact is never joined on the key it is grouped by right afterwards. Either it is pre-aggregated on
  that key first (a hot asset shrinks to one row per map task) or another shuffle follows the join,
  which leaves adaptive execution free to split a hot key.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_vulnerabilities(tables: Mapping[str, DataFrame], *columns: str) -> DataFrame:
    """One row per software-vulnerability pair with the asked columns of either table."""
    pairs, vulns = tables["software_vulnerabilities"], tables["vulnerabilities"]
    own = [c for c in columns if c in pairs.columns]
    theirs = [c for c in columns if c not in own]
    return (
        pairs.select("sw_vuln_id", "vuln_id_fk", *[c for c in own if c not in ("sw_vuln_id", "vuln_id_fk")])
        .join(vulns.select("vuln_id", *theirs), F.col("vuln_id_fk") == F.col("vuln_id"))
        .select("sw_vuln_id", *columns)
    )


def with_vulnerability(facts: DataFrame, tables: Mapping[str, DataFrame], *columns: str) -> DataFrame:
    """Facts that point at a pair, with vulnerability columns added; facts without one are dropped."""
    return facts.join(
        pair_vulnerabilities(tables, *columns), F.col("sw_vuln_id_fk") == F.col("sw_vuln_id")
    ).drop("sw_vuln_id")


def with_asset(facts: DataFrame, tables: Mapping[str, DataFrame], *columns: str) -> DataFrame:
    """Facts that point at an asset, with asset columns added; facts without one are dropped."""
    assets = tables["assets"].select("asset_id", *[c for c in columns if c != "asset_id"])
    joined = facts.join(assets, F.col("asset_id_fk") == F.col("asset_id"))
    return joined if "asset_id" in columns else joined.drop("asset_id")


def with_organization(facts: DataFrame, tables: Mapping[str, DataFrame], *columns: str) -> DataFrame:
    orgs = tables["organizations"].select("org_id", *[c for c in columns if c != "org_id"])
    joined = facts.join(orgs, F.col("org_id_fk") == F.col("org_id"))
    return joined if "org_id" in columns else joined.drop("org_id")


def user_names(tables: Mapping[str, DataFrame], key: str, name: str) -> DataFrame:
    return tables["users"].select(F.col("user_id").alias(key), F.col("full_name").alias(name))


def actions_per_finding(actions: DataFrame) -> DataFrame:
    """Action totals per finding: the unit that replaces the action fan-out."""
    return actions.groupBy("finding_id_fk").agg(
        F.count(F.lit(1)).alias("n_actions"),
        F.count(F.when(F.col("status") == "Completed", 1)).alias("n_completed"),
    )


def fan_out(n: Column) -> Column:
    """How often a row appears after an outer join to ``n`` matches."""
    return F.greatest(F.coalesce(n, F.lit(0)), F.lit(1))


def cents(amount: Column) -> Column:
    return (amount * 100).cast("bigint")


def only_matching(table: DataFrame, columns: list[str], rows: DataFrame, row_columns: list[str]) -> DataFrame:
    """Rows of a large table whose key occurs in a smaller set of rows.

    The few distinct keys go to the table, which is then scanned and not shuffled; without this, an outer
    join from the small side would shuffle the large one.
    """
    names = [f"wanted_{i}" for i in range(len(columns))]
    wanted = rows.select(*[F.col(c).alias(n) for c, n in zip(row_columns, names)]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(n) for c, n in zip(columns, names)])
    return table.join(wanted, same, "left_semi")
