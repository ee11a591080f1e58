"""Helpers shared by the corpus operators: shared tables, clean input columns, scaling of partitions."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a maximal run of anything but these six characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. A local session
    without that setting gets a folder of its own; any other is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: evaluated once, no lineage, and whole
    when executors are lost."""
    path = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) and the named extra columns; all others are left unread."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), *extra)


def word_count(text: Column) -> Column:
    """Number of words, counted without building them; null counts none."""
    separators = "\x20\x09\x0a\x0b\x0c\x0d"
    flat = F.translate(F.coalesce(text, F.lit("")), separators[1:], " " * 5)
    # A word starts where a non-space follows a space or the start.
    return F.coalesce(F.regexp_count(flat, F.lit("[^ ]+")), F.lit(0)).cast("long")
