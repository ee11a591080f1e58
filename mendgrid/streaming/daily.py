"""Daily counts of a feed per kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from mendgrid.functions.clock import wall_day, wall_instant

DAILY_SCHEMA = T.StructType(
    [
        T.StructField("day", T.DateType()),
        T.StructField("kind", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)


def daily_counts(feed: DataFrame, time: str, kind: str, allowed_delay: str) -> DataFrame:
    """Rows per day and kind; a day is final once the watermark has passed its end."""
    timed = feed.select(wall_instant(F.col(time)).alias("event_time"), F.col(kind).alias("kind"))
    return (
        timed.withWatermark("event_time", allowed_delay)
        .groupBy(F.window("event_time", "1 day"), "kind")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(wall_day(F.col("window.start")).alias("day"), "kind", "n")
    )


def start_daily_counts(counts: DataFrame, out_dir: str, checkpoint_dir: str) -> StreamingQuery:
    """Append every finished day to ``out_dir`` for all the stream holds now, and stop."""
    return (
        counts.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )


def read_daily_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema(DAILY_SCHEMA).parquet(out_dir)
