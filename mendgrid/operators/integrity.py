"""Integrity rules as violation lists.

Every rule yields ``(table_name, rule_id, key, column_name, value)`` rows. The row rules of a table are
judged together in one scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendgrid.schemas import TABLES, Table

Tables = Mapping[str, DataFrame]

NOT_NULL, PRIMARY_KEY, UNIQUE, FOREIGN_KEY, DOMAIN, CHECK = "C1", "C2", "C3", "C4", "C5", "C6"
ROW_RULES = (NOT_NULL, DOMAIN, CHECK)

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H = r"[0-9A-Fa-f]{1,4}"
_RUN = rf"(?:{_H}(?::{_H})*)"
_TAIL = rf"(?:(?:{_H}:)*(?:{_IPV4}|{_H}))"
INET_PATTERN = (
    rf"^(?:{_IPV4}(?:/(?:3[0-2]|[12]?\d))?"
    rf"|(?:(?:{_H}:){{7}}{_H}|(?!:*(?:{_H}:+){{7}}{_H}){_RUN}?::{_TAIL}?)(?:/(?:12[0-8]|1[01]\d|\d?\d))?)$"
)
_X2 = r"[0-9A-Fa-f]{2}"
MACADDR_PATTERN = (
    rf"^(?:{_X2}(?::{_X2}){{5}}|{_X2}(?:-{_X2}){{5}}|(?:{_X2}){{3}}[:-](?:{_X2}){{3}}"
    rf"|(?:{_X2}){{2}}(?:\.(?:{_X2}){{2}}){{2}}|(?:{_X2}){{2}}(?:-(?:{_X2}){{2}}){{2}}|(?:{_X2}){{6}})$"
)


def _quoted(word: str) -> str:
    return "'" + word.replace("'", "\\'") + "'"


def check_condition(column: str, rule: object) -> str:
    """SQL that is TRUE, FALSE or NULL as the rule has it; only FALSE is a violation."""
    return rule if isinstance(rule, str) else f"{column} in ({', '.join(map(_quoted, rule))})"


def finding(rule: str, column: str, value: Column) -> Column:
    return F.struct(
        F.lit(rule).alias("rule_id"), F.lit(column).alias("column_name"), value.cast("string").alias("value")
    )


def row_findings(spec: Table, rules: Iterable[str] = ROW_RULES, only: Iterable[str] | None = None) -> Column | None:
    """The row rules a row breaks, as one array of findings; one SQL text keeps wide tables cheap to plan."""
    wanted = set(rules)
    names = set(spec.names if only is None else only)
    broken: list[tuple[str, str, str]] = []
    for c in spec.columns:
        if c.name not in names:
            continue
        if NOT_NULL in wanted and c.required:
            broken.append((NOT_NULL, c.name, f"{c.name} is null"))
        if DOMAIN in wanted:
            if c.max_length is not None:
                broken.append((DOMAIN, c.name, f"length({c.name}) > {c.max_length}"))
            elif c.sql_type == "inet":
                broken.append((DOMAIN, c.name, f"not {c.name} rlike r'{INET_PATTERN}'"))
            elif c.sql_type == "macaddr":
                broken.append((DOMAIN, c.name, f"not {c.name} rlike r'{MACADDR_PATTERN}'"))
        if CHECK in wanted and c.name in spec.checks:
            broken.append((CHECK, c.name, f"not coalesce({check_condition(c.name, spec.checks[c.name])}, true)"))
    if not broken:
        return None
    cases = [
        f"if({test}, named_struct('rule_id', '{rule}', 'column_name', '{name}', 'value', cast({name} as string)), null)"
        for rule, name, test in broken
    ]
    return F.expr(f"array_compact(array({', '.join(cases)}))")


def row_violations(df: DataFrame, table: str, rules: Iterable[str] = ROW_RULES) -> DataFrame | None:
    """Broken NOT NULL, domain and CHECK rules of all rows, found in one scan."""
    spec = TABLES[table]
    found = row_findings(spec, rules)
    if found is None:
        return None
    return df.select(F.col(spec.pk).cast("string").alias("key"), F.explode(found).alias("v")).select(
        F.lit(table).alias("table_name"), "v.rule_id", "key", "v.column_name", "v.value"
    )


def _duplicates(df: DataFrame, table: str, columns: tuple[str, ...], rule: str) -> DataFrame:
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return (
        df.where(present)
        .groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(
            F.lit(table).alias("table_name"),
            F.lit(rule).alias("rule_id"),
            F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("key"),
            F.lit(",".join(columns)).alias("column_name"),
            F.col("n").cast("string").alias("value"),
        )
    )


def primary_key_violations(df: DataFrame, table: str) -> DataFrame:
    """Keys held by several rows, with the number of rows, and rows without a key."""
    pk = TABLES[table].pk
    missing = df.where(F.col(pk).isNull()).select(
        F.lit(table).alias("table_name"),
        F.lit(PRIMARY_KEY).alias("rule_id"),
        F.lit(None).cast("string").alias("key"),
        F.lit(pk).alias("column_name"),
        F.lit(None).cast("string").alias("value"),
    )
    return _duplicates(df, table, (pk,), PRIMARY_KEY).unionByName(missing)


def unique_violations(df: DataFrame, table: str) -> DataFrame | None:
    """Unique keys held by several rows; a key with a NULL part never collides."""
    spec = TABLES[table]
    return _duplicates(df, table, spec.unique, UNIQUE) if spec.unique else None


def foreign_key_violations(tables: Tables, table: str) -> DataFrame | None:
    """Rows whose reference has no parent row; a NULL reference is exempt.

    One scan finds the distinct values of all references, combined before the shuffle; those without a
    parent are few, and a second scan finds the rows that hold them.
    """
    spec = TABLES[table]
    if not spec.references:
        return None
    each = [
        F.struct(F.lit(r.column).alias("column_name"), F.col(r.column).cast("bigint").alias("fk_value"))
        for r in spec.references
    ]
    rows = (
        tables[table]
        .select(F.col(spec.pk).alias("row_key"), F.explode(F.array(*each)).alias("held"))
        .select("row_key", "held.column_name", "held.fk_value")
        .where("fk_value is not null")
    )
    parents = union_all(
        [
            tables[r.parent].select(
                F.lit(r.column).alias("parent_column"), F.col(TABLES[r.parent].pk).cast("bigint").alias("parent_key")
            )
            for r in spec.references
        ]
    )
    known = (F.col("column_name") == F.col("parent_column")) & (F.col("fk_value") == F.col("parent_key"))
    missing = (
        rows.select("column_name", "fk_value")
        .distinct()
        .join(parents, known, "left_anti")
        .select(F.col("column_name").alias("missing_column"), F.col("fk_value").alias("missing_value"))
    )
    lost = (F.col("column_name") == F.col("missing_column")) & (F.col("fk_value") == F.col("missing_value"))
    return rows.join(missing, lost, "left_semi").select(
        F.lit(table).alias("table_name"),
        F.lit(FOREIGN_KEY).alias("rule_id"),
        F.col("row_key").cast("string").alias("key"),
        "column_name",
        F.col("fk_value").cast("string").alias("value"),
    )


def validate(tables: Tables, table: str) -> DataFrame:
    """All violations of one table."""
    parts = [
        row_violations(tables[table], table),
        primary_key_violations(tables[table], table),
        unique_violations(tables[table], table),
        foreign_key_violations(tables, table),
    ]
    return union_all([p for p in parts if p is not None])


def validate_rule(tables: Tables, rule: str) -> DataFrame:
    """All violations of one rule kind over all tables."""
    parts = []
    for table in TABLES:
        if rule in ROW_RULES:
            parts.append(row_violations(tables[table], table, (rule,)))
        elif rule == PRIMARY_KEY:
            parts.append(primary_key_violations(tables[table], table))
        elif rule == UNIQUE:
            parts.append(unique_violations(tables[table], table))
        elif rule == FOREIGN_KEY:
            parts.append(foreign_key_violations(tables, table))
    return union_all([p for p in parts if p is not None])


def union_all(parts: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, parts) if parts else None
