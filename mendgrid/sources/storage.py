"""Typed table reads, versioned table writes and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mendgrid.schemas import TABLES


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Read a stored table with its declared schema; nothing is inferred."""
    return spark.read.schema(TABLES[table].struct).parquet(path)


def write_version(df: DataFrame, root: str, table: str, version: str) -> str:
    """Store the next version of a table beside the earlier ones and return its path."""
    path = f"{root}/{table}/version={version}"
    df.select(*TABLES[table].names).write.mode("errorifexists").parquet(path)
    return path


SNAPSHOT_KEY = ["asset_id_fk", "snapshot_date"]


def stored_snapshots(spark: SparkSession, path: str, dates: list[date] | None = None) -> DataFrame:
    """The stored snapshots, or those of some dates; other dates' folders are not read."""
    struct = TABLES["risk_score_snapshots"].struct
    found = _read_if_there(spark, path, struct)
    found = spark.createDataFrame([], struct) if found is None else found
    return found if dates is None else found.where(F.col("snapshot_date").isin(dates))


def dates_of(df: DataFrame) -> list[date]:
    """The snapshot dates of ``df``; a run refreshes one or a few."""
    return [r[0] for r in df.select("snapshot_date").where("snapshot_date is not null").distinct().collect()]


def replace_dates(df: DataFrame, path: str) -> None:
    """Replace exactly the snapshot dates present in ``df``."""
    (
        df.select(*TABLES["risk_score_snapshots"].names)
        .repartition("snapshot_date", "asset_id_fk")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_date")
        .parquet(path)
    )


def write_snapshots(df: DataFrame, path: str) -> None:
    """Store snapshots in place of those of the same asset and date; a repeated run changes nothing.

    Other assets of the date stay, so a run may refresh a few assets. The new content of the dates
    is written aside first, since it is read from the folders that it replaces.
    """
    spark = df.sparkSession
    new = settle(df.select(*TABLES["risk_score_snapshots"].names), work_place(spark, "snapshots"))
    kept = stored_snapshots(spark, path, dates_of(new)).join(new.select(*SNAPSHOT_KEY), SNAPSHOT_KEY, "left_anti")
    merged = kept.select(*new.columns).unionByName(new)
    replace_dates(settle(merged, work_place(spark, "snapshots")), path)


def write_by(df: DataFrame, path: str, column: str | None, mode: str) -> None:
    """Write with one folder per value of ``column``, each by as few tasks as possible; without it, plainly."""
    if column:
        df.repartition(column).write.mode(mode).partitionBy(column).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


_POINTERS = "number bigint, name string, path string"


def publish(
    tables: Mapping[str, DataFrame], root: str, number: int, by: Mapping[str, str] | None = None
) -> None:
    """Store several tables and make them visible together, as publication ``number``; ``by`` names the partition
    column of a table.

    The tables go to folders of their own; a small table of pointers is written last and names the folder of each,
    those of earlier publications that aren't replaced included. Readers follow the highest number, so
    they see all of it or none: a run that fails on the way leaves only folders nobody points to. A number is
    published once; a second writer of the same number fails.
    """
    spark = next(iter(tables.values())).sparkSession
    paths = published(spark, root, before=number)
    for name, df in tables.items():
        paths[name] = f"{root}/data/{name}/{uuid.uuid4().hex}"
        write_by(df, paths[name], (by or {}).get(name), "errorifexists")
    rows = [(name, path) for name, path in sorted(paths.items())]
    spark.createDataFrame(rows, "name string, path string").coalesce(1).write.mode("errorifexists").parquet(
        f"{root}/pointers/number={number}"
    )


def published(spark: SparkSession, root: str, before: int | None = None) -> dict[str, str]:
    """Paths by table of the latest publication, or of the latest below ``before``; empty when there is none."""
    pointers = _read_if_there(spark, f"{root}/pointers", _POINTERS)
    if pointers is None:
        return {}
    if before is not None:
        pointers = pointers.where(F.col("number") < before)
    latest = pointers.agg(F.max("number")).first()[0]
    return {r["name"]: r["path"] for r in pointers.where(F.col("number") == latest).collect()} if latest is not None else {}


def published_number(spark: SparkSession, root: str, before: int | None = None) -> int | None:
    """The number that ``published`` follows."""
    pointers = _read_if_there(spark, f"{root}/pointers", _POINTERS)
    if pointers is None:
        return None
    return (pointers if before is None else pointers.where(F.col("number") < before)).agg(F.max("number")).first()[0]


def _read_if_there(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def conform(df: DataFrame, table: str) -> DataFrame:
    """Give ``df`` the declared columns and types; columns it lacks become typed NULLs."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(c.name) if c.name in have else F.lit(None)).cast(c.spark_type).alias(c.name)
            for c in TABLES[table].columns
        ]
    )


def work_place(spark: SparkSession, name: str, work: str | None = None) -> str:
    """A new path for an intermediate table, under ``work`` or the shared folder."""
    root = work or f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    return f"{root}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, path: str) -> DataFrame:
    """Write an intermediate result to a shared path and go on from there.

    Cuts the lineage in a way that survives lost executors, and gives later joins a measured size.
    """
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local session without the setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="mendgrid-")
    spark.sparkContext.setCheckpointDir(own)
    return own


class TableSet(Mapping[str, DataFrame]):
    """Tracker tables by name, each built or read when first asked for."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        self._makers = dict(makers)
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def with_tables(self, **changed: DataFrame) -> TableSet:
        """The same tables with some of them replaced by a newer version."""
        makers = dict(self._makers)
        makers.update({name: (lambda df=df: df) for name, df in changed.items()})
        return TableSet(makers)

    @classmethod
    def stored(cls, spark: SparkSession, paths: Mapping[str, str]) -> TableSet:
        return cls({t: (lambda t=t, p=p: read_table(spark, p, t)) for t, p in paths.items()})
