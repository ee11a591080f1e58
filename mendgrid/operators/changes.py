"""Batch inserts, updates, deletes and upserts as table versions.

A change set is a DataFrame of text columns named like the table's editable columns plus the primary
key; ids of new rows are chosen by the caller, since no sequence exists. Every function returns the next
version of a table and the rows it refused; storing them is the caller's step.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendgrid.functions.vocabulary import REMEDIATED
from mendgrid.operators import integrity
from mendgrid.operators.audit import last_history_id, patch_status_audit
from mendgrid.operators.ingest import finding_pre_insert
from mendgrid.plans.facts import only_matching
from mendgrid.schemas import TABLES, Table
from mendgrid.sources.storage import SNAPSHOT_KEY, dates_of, replace_dates, settle, stored_snapshots, work_place

Tables = Mapping[str, DataFrame]

# Surrounding white space of any kind.
_EDGES = r"^[\s\u0085\p{Z}]+|[\s\u0085\p{Z}]+$"


def normalize(spec: Table, rows: DataFrame) -> DataFrame:
    """Trim every editable column, blanks to NULL, and cast it; text that does not fit is a finding.

    Columns that the change set lacks count as blank.
    """
    text = {}
    for c in spec.flagged("edit"):
        given = F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
        text[c] = F.nullif(F.regexp_replace(given, _EDGES, ""), F.lit(""))
    given_key = F.col(spec.pk).cast("string")
    raw = rows.select(
        given_key.try_cast("bigint").alias(spec.pk), given_key.alias("raw_key"),
        *[v.alias(f"raw_{c}") for c, v in text.items()],
    )
    misfits = [
        F.when(
            F.col("raw_key").isNotNull() & F.col(spec.pk).isNull(),
            integrity.finding(integrity.DOMAIN, spec.pk, F.col("raw_key")),
        )
    ]
    misfits += [
        F.when(
            F.col(f"raw_{c}").isNotNull() & F.col(f"raw_{c}").try_cast(spec.column(c).spark_type).isNull(),
            integrity.finding(integrity.DOMAIN, c, F.col(f"raw_{c}")),
        )
        for c in text
    ]
    typed = raw.select(
        spec.pk,
        F.array_compact(F.array(*misfits)).alias("misfits"),
        *[F.col(f"raw_{c}").try_cast(spec.column(c).spark_type).alias(c) for c in text],
    )
    found = integrity.row_findings(spec, only=[spec.pk, *text])
    # A value that failed its cast is reported once, as a domain finding, not again as a missing value.
    own = F.filter(
        found,
        lambda v: ~F.exists("misfits", lambda m: m["column_name"] == v["column_name"]),
    )
    return typed.withColumn("findings", F.concat("misfits", own)).drop("misfits")


def _with_finding(rows: DataFrame, condition: Column, rule: str, column: str, value: Column) -> DataFrame:
    # Refers to the earlier findings once: a second use would double the expression with every rule.
    broken = F.array_compact(F.array(F.when(condition, integrity.finding(rule, column, value))))
    return rows.withColumn("findings", F.concat("findings", broken))


def _judge_references(tables: Tables, spec: Table, rows: DataFrame) -> DataFrame:
    for r in spec.references:
        if r.column not in rows.columns:
            continue
        parents = tables[r.parent].select(F.col(TABLES[r.parent].pk).alias("parent_key"))
        parents = only_matching(parents, ["parent_key"], rows, [r.column])
        rows = rows.join(parents, F.col(r.column) == F.col("parent_key"), "left")
        missing = F.col(r.column).isNotNull() & F.col("parent_key").isNull()
        rows = _with_finding(rows, missing, integrity.FOREIGN_KEY, r.column, F.col(r.column)).drop("parent_key")
    return rows


def _judge_repeated_ids(spec: Table, rows: DataFrame) -> DataFrame:
    """Several change rows for one primary key are all refused: a set has no order to decide by."""
    repeated = rows.groupBy(F.col(spec.pk).alias("repeated_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(repeated, F.col(spec.pk) == F.col("repeated_key"), "left")
    return _with_finding(
        rows, F.col("repeated_key").isNotNull(), integrity.PRIMARY_KEY, spec.pk, F.col(spec.pk)
    ).drop("repeated_key", "n")


def _same_key(spec: Table) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c) == F.col(f"held_{c}") for c in spec.unique])


def _key_finding(spec: Table, rows: DataFrame, condition: Column) -> DataFrame:
    shown = F.concat_ws("|", *[F.col(c).cast("string") for c in spec.unique])
    return _with_finding(rows, condition, integrity.UNIQUE, ",".join(spec.unique), shown)


def _judge_held_keys(tables: Tables, spec: Table, rows: DataFrame) -> DataFrame:
    """Refuse a row whose unique key another stored row holds."""
    if not spec.unique:
        return rows
    names = [f"held_{c}" for c in spec.unique]
    stored = only_matching(tables[spec.name].select(spec.pk, *spec.unique), list(spec.unique), rows, list(spec.unique))
    held = stored.groupBy(*[F.col(c).alias(f"held_{c}") for c in spec.unique]).agg(
        F.min(spec.pk).alias("held_low"), F.max(spec.pk).alias("held_high")
    )
    by_other = F.col("held_low").isNotNull() & (
        (F.col("held_low") != F.col(spec.pk)) | (F.col("held_high") != F.col(spec.pk))
    )
    return _key_finding(spec, rows.join(held, _same_key(spec), "left"), by_other).drop(
        "held_low", "held_high", *names
    )


def _judge_rivals(spec: Table, rows: DataFrame) -> DataFrame:
    """Of rows that bring the same unique key and keep all other rules, the lowest id stays."""
    if not spec.unique:
        return rows
    names = [f"held_{c}" for c in spec.unique]
    first = rows.where(F.size("findings") == 0).groupBy(*[F.col(c).alias(f"held_{c}") for c in spec.unique]).agg(
        F.min(spec.pk).alias("first_id")
    )
    beaten = (F.size("findings") == 0) & F.col("first_id").isNotNull() & (F.col("first_id") != F.col(spec.pk))
    return _key_finding(spec, rows.join(first, _same_key(spec), "left"), beaten).drop("first_id", *names)


def _rejected(spec: Table, judged: DataFrame) -> DataFrame:
    return judged.select(
        F.lit(spec.name).alias("table_name"), F.col(spec.pk).cast("string").alias("key"),
        F.explode("findings").alias("v"),
    ).select("table_name", "v.rule_id", "key", "v.column_name", "v.value")


def judge_new(tables: Tables, spec: Table, rows: DataFrame) -> DataFrame:
    """Typed new rows with ``findings``, to which repeated and stored ids and unknown parents are added."""
    judged = _judge_references(tables, spec, _judge_repeated_ids(spec, rows))
    present = tables[spec.name].select(F.col(spec.pk).alias("present_key"))
    present = only_matching(present, ["present_key"], judged, [spec.pk])
    judged = judged.join(present, F.col(spec.pk) == F.col("present_key"), "left")
    return _with_finding(
        judged, F.col("present_key").isNotNull(), integrity.PRIMARY_KEY, spec.pk, F.col(spec.pk)
    ).drop("present_key")


@dataclass(frozen=True)
class Inserted:
    accepted: DataFrame
    rejected: DataFrame
    after: DataFrame


def insert_batch(tables: Tables, table: str, rows: DataFrame, now: datetime, work_dir: str) -> Inserted:
    """Append the rows that keep every rule. Only editable columns are taken; an empty value stays NULL
    even where the column has a default. Load-time columns get ``now``; findings are completed.

    The judged rows are written to ``work_dir``, so accepted and rejected rows stem from one reading.
    """
    spec = TABLES[table]
    judged = judge_new(tables, spec, settle(normalize(spec, rows), f"{work_dir}/typed"))
    judged = settle(_judge_held_keys(tables, spec, judged), f"{work_dir}/judged")
    judged = _judge_rivals(spec, judged)
    good = judged.where(F.size("findings") == 0)
    if table == "scan_findings":
        accepted = finding_pre_insert(tables, good, now)
    else:
        stamped = set(spec.flagged("now"))
        stamp = F.lit(now).cast("timestamp_ntz")
        accepted = good.select(
            *[
                (F.col(c.name) if c.name in good.columns else stamp if c.name in stamped else F.lit(None))
                .cast(c.spark_type)
                .alias(c.name)
                for c in spec.columns
            ]
        )
    return Inserted(accepted, _rejected(spec, judged), tables[table].unionByName(accepted))


@dataclass(frozen=True)
class Updated:
    after: DataFrame
    rejected: DataFrame
    missing: DataFrame
    history: DataFrame | None


def update_batch(tables: Tables, table: str, rows: DataFrame, now: datetime, work_dir: str) -> Updated:
    """Overwrite every editable column of the rows named by primary key; other columns stay.

    Findings that become remediated get their fix time, organisations their update time, and patch
    actions whose status changes yield history rows. The judged rows are written to ``work_dir``.
    """
    spec = TABLES[table]
    old = tables[table]
    typed = settle(_judge_repeated_ids(spec, normalize(spec, rows)), f"{work_dir}/typed")
    judged = _judge_references(tables, spec, typed)
    known = only_matching(old.select(F.col(spec.pk).alias("known_key")), ["known_key"], judged, [spec.pk])
    judged = judged.join(known, F.col(spec.pk) == F.col("known_key"), "left")
    judged = settle(_judge_held_keys(tables, spec, judged), f"{work_dir}/judged")
    # A row whose key is no whole number, or that has none, is refused; it isn't a missing row.
    missing = judged.where(F.col("known_key").isNull() & F.col(spec.pk).isNotNull()).select(spec.pk)
    judged = _judge_rivals(
        spec, judged.where(F.col("known_key").isNotNull() | F.col(spec.pk).isNull()).drop("known_key")
    )
    good = judged.where(F.size("findings") == 0)
    editable = spec.flagged("edit")
    changed = good.select(F.col(spec.pk).alias("changed_key"), *[F.col(c).alias(f"new_{c}") for c in editable])
    joined = old.join(changed, F.col(spec.pk) == F.col("changed_key"), "left")
    hit = F.col("changed_key").isNotNull()
    values = {c: F.when(hit, F.col(f"new_{c}")).otherwise(F.col(c)) for c in editable}
    stamp = F.lit(now).cast("timestamp_ntz")
    if table == "scan_findings":
        values["first_fixed_at"] = F.when(
            hit & became_remediated(F.col("status"), F.col("new_status")), F.coalesce("first_fixed_at", stamp)
        ).otherwise(F.col("first_fixed_at"))
    if table == "organizations":
        values["updated_at"] = F.when(hit, stamp).otherwise(F.col("updated_at"))
    after = joined.select(*[values.get(c, F.col(c)).alias(c) for c in spec.names])
    history = None
    if table == "patch_actions":
        history = patch_status_audit(old, good, now, last_history_id(tables["patch_status_history"]), work_dir)
    return Updated(after, _rejected(spec, judged), missing, history)


def became_remediated(old: Column, new: Column) -> Column:
    return ~old.eqNullSafe(new) & (new == REMEDIATED)


@dataclass(frozen=True)
class Deleted:
    after: dict[str, DataFrame]
    effects: DataFrame


def delete_batch(tables: Tables, keys: Mapping[str, DataFrame], work_dir: str) -> Deleted:
    """Delete rows by primary key and follow every reference to them.

    ``keys`` maps a table to a DataFrame whose first column holds the keys. Children of a cascading
    reference go too, all the way down; other references to a deleted row become NULL. ``effects``
    lists each deleted row and each blanked reference.

    Parents come before children, and each table is judged in one pass: its rows meet the deleted keys
    of their parents once, which tells deleted, blanked and untouched rows apart. The deleted keys of a
    referenced table are written to ``work_dir``, since several tables below read them and their measured
    size decides how they are joined.
    """
    parents = {r.parent for spec in TABLES.values() for r in spec.references}
    gone: dict[str, DataFrame] = {}
    after: dict[str, DataFrame] = {}
    effects: list[DataFrame] = []
    for table, spec in TABLES.items():
        touching = [r for r in spec.references if r.parent in gone]
        if table not in keys and not touching:
            continue
        rows = tables[table]
        deleted = F.lit(False)
        if table in keys:
            wanted = keys[table].select(F.col(keys[table].columns[0]).alias("wanted_key")).distinct()
            rows = rows.join(wanted, F.col(spec.pk) == F.col("wanted_key"), "left")
            deleted = F.col("wanted_key").isNotNull()
        for r in touching:
            met = gone[r.parent].select(F.col("gone_key").alias(f"gone_{r.column}"))
            rows = rows.join(met, F.col(r.column) == F.col(f"gone_{r.column}"), "left")
            if r.on_delete == "cascade":
                deleted = deleted | F.col(f"gone_{r.column}").isNotNull()
        judged = rows.withColumn("deleted", deleted)
        blanked = {r.column: F.col(f"gone_{r.column}").isNotNull() for r in touching if r.on_delete == "set null"}
        dead = judged.where("deleted").select(F.col(spec.pk).alias("gone_key"))
        if table in parents:
            gone[table] = settle(dead, f"{work_dir}/{table}")
        after[table] = judged.where("not deleted").select(
            *[(F.when(~blanked[c], F.col(c)) if c in blanked else F.col(c)).alias(c) for c in spec.names]
        )
        happened = [F.when(F.col("deleted"), _effect("deleted", ""))]
        happened += [F.when(~F.col("deleted") & hit, _effect("set null", c)) for c, hit in blanked.items()]
        effects.append(
            judged.select(F.col(spec.pk).alias("key"), F.explode(F.array_compact(F.array(*happened))).alias("e")).select(
                F.lit(table).alias("table_name"), "key", "e.effect", "e.column_name"
            )
        )
    return Deleted(after, reduce(DataFrame.unionByName, effects))


def _effect(effect: str, column: str) -> Column:
    return F.struct(F.lit(effect).alias("effect"), F.lit(column).alias("column_name"))


@dataclass(frozen=True)
class Upserted:
    after: DataFrame
    rejected: DataFrame


def upsert(target: DataFrame, rows: DataFrame, key: list[str], measures: list[str]) -> Upserted:
    """Rows of ``target`` with ``measures`` overwritten where ``rows`` has the key, plus the new keys.

    Columns of the target outside key and measures keep their old value; new rows bring their own. Rows that
    share their key, and rows without one, have no defined outcome and are all refused; ``rejected`` names each such key
    once with its number of rows.
    """
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    doubtful = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where((F.col("n_rows") > 1) | ~whole)
    single = rows.where(whole).join(doubtful.select(*key), key, "left_anti")
    new = single.select(F.lit(True).alias("given"), *[F.col(c).alias(f"new_{c}") for c in target.columns])
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"new_{c}") for c in key])
    old = target.withColumn("held", F.lit(True))
    joined = old.join(new, same, "full")
    take = {
        c: F.when(F.col("given"), F.col(f"new_{c}")).otherwise(F.col(c))
        if c in measures
        else F.when(F.col("held"), F.col(c)).otherwise(F.col(f"new_{c}"))
        for c in target.columns
    }
    return Upserted(joined.select(*[v.alias(c) for c, v in take.items()]), doubtful)


def upsert_snapshots(path: str, rows: DataFrame) -> DataFrame:
    """Upsert snapshots into the stored ones and return what was refused.

    Only the dates of ``rows`` are read, merged and replaced. Stored rows keep their id.
    """
    spark = rows.sparkSession
    given = settle(rows, work_place(spark, "given"))
    dates = dates_of(given)
    measures = [c for c in given.columns if c not in ("snapshot_id", *SNAPSHOT_KEY)]
    merged = upsert(stored_snapshots(spark, path, dates), given, SNAPSHOT_KEY, measures)
    if dates:
        replace_dates(settle(merged.after, work_place(spark, "merged")), path)
    return merged.rejected
