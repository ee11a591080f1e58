"""Numbers and neighbours in a total order, without ordering anything in one task.

Rows are dealt by ranges of their order and sorted inside each range; what passes from one range to the next is
one small row a range.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendgrid.sources.storage import settle, work_place

_IN_SLICE = 33  # bits of a place that count inside its range


def number_rows(df: DataFrame, name: str, order: list[str], after: int, work: str | None = None) -> DataFrame:
    """``df`` with the column ``name``: ``after`` + 1, + 2, ... by ``order``.

    The ranges are sampled, so the placed rows are stored once and both the range sizes and the rows are
    read from there. Rows equal in all of ``order`` get their numbers in any order.
    """
    spark = df.sparkSession
    placed = settle(
        df.drop(name).repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id()),
        work_place(spark, "numbered", work),
    )
    part = F.shiftright("place", _IN_SLICE)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())
    starts = accumulate((s["count"] for s in sizes), initial=after)
    offsets = spark.createDataFrame(
        [(s["part"], start) for s, start in zip(sizes, starts, strict=False)], "part bigint, start bigint"
    )
    return (
        placed.withColumn("row_part", part)
        .join(offsets, F.col("row_part") == F.col("part"))
        .withColumn(name, F.col("start") + F.col("place").bitwiseAND((1 << _IN_SLICE) - 1) + 1)
        .drop("place", "row_part", "part", "start")
    )
