"""Table listings, option lists and lookups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendgrid.schemas import TABLES, Table

Tables = Mapping[str, DataFrame]

PAIR_SEPARATOR = " — "


def _order(spec: Table) -> list[Column]:
    return [
        F.desc_nulls_first(c) if direction == "desc" else F.asc_nulls_last(c) for c, direction in spec.order
    ]


def table_list(tables: Tables, table: str) -> DataFrame:
    """The listed columns of a table in its listing order."""
    spec = TABLES[table]
    return tables[table].select(*spec.flagged("list")).orderBy(*_order(spec))


def option_list(tables: Tables, parent: str, label: str) -> DataFrame:
    """Key and label of every row of a referenced table, in key order."""
    key = TABLES[parent].pk
    return (
        tables[parent]
        .select(F.col(key).alias("option_id"), F.col(label).cast("string").alias("option_label"))
        .orderBy("option_id")
    )


def pair_labels(tables: Tables) -> DataFrame:
    """Product and vulnerability name of every pair; NULL where the vulnerability has no public id."""
    products = tables["software_products"].select("software_id", "product_name")
    vulns = tables["vulnerabilities"].select("vuln_id", "cve_id")
    return (
        tables["software_vulnerabilities"]
        .select("sw_vuln_id", "software_id_fk", "vuln_id_fk")
        .join(products, F.col("software_id_fk") == F.col("software_id"))
        .join(vulns, F.col("vuln_id_fk") == F.col("vuln_id"))
        .select(
            F.col("sw_vuln_id").alias("option_id"),
            F.concat("product_name", F.lit(PAIR_SEPARATOR), "cve_id").alias("option_label"),
        )
        .orderBy("option_id")
    )


def _options(tables: Tables, parent: str, label: str) -> DataFrame:
    return option_list(tables, parent, label) if label else pair_labels(tables)


def reference_options(tables: Tables, table: str) -> DataFrame:
    """The options of all reference columns of a table in one list."""
    parts = [
        _options(tables, r.parent, r.label).select(F.lit(r.column).alias("fk_column"), "option_id", "option_label")
        for r in TABLES[table].references
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.orderBy("fk_column", "option_id")


def labeled_list(tables: Tables, table: str) -> DataFrame:
    """The listing of a table with every reference followed by its label."""
    spec = TABLES[table]
    listed = spec.flagged("list")
    rows = tables[table].select(*listed)
    labels = {}
    for r in spec.references:
        if r.label == TABLES[r.parent].pk:
            labels[r.column] = F.col(r.column).cast("string")  # the key is its own label, no join needed
            continue
        # sorting the options would be wasted work inside a join; Catalyst removes it
        options = _options(tables, r.parent, r.label).select(
            F.col("option_id").alias(f"{r.column}_key"), F.col("option_label").alias(f"{r.column}_text")
        )
        rows = rows.join(options, F.col(r.column) == F.col(f"{r.column}_key"), "left")
        labels[r.column] = F.col(f"{r.column}_text")
    shown = []
    for c in listed:
        shown.append(F.col(c))
        if c in labels:
            shown.append(labels[c].alias(c.removesuffix("_fk") + "_label"))
    return rows.select(*shown).orderBy(*_order(spec))


def lookup(tables: Tables, table: str, key: object) -> DataFrame:
    """All columns of the row with this primary key, or no row; the filter reaches the parquet scan."""
    return tables[table].where(F.col(TABLES[table].pk) == F.lit(key))


def lookup_many(tables: Tables, table: str, keys: DataFrame) -> DataFrame:
    """All columns of the rows whose primary key is among the first column of ``keys``."""
    wanted = keys.select(F.col(keys.columns[0]).alias("wanted_key"))
    return tables[table].join(wanted, F.col(TABLES[table].pk) == F.col("wanted_key"), "left_semi")
