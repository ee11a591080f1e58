"""Session settings for local runs and for submitting to a cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app_name: str = "mendgrid", master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution on, which sizes shuffles, splits skewed keys and switches
    to a broadcast join only below the size threshold. ``settings`` override or add to that."""
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a hot key even where that costs another shuffle for the grouping that follows.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **settings,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: int | str = "*", **settings: str) -> SparkSession:
    """For tests and measurements on one machine."""
    shuffles = "8" if cores == "*" else str(cores)
    return session(
        "mendgrid-local",
        f"local[{cores}]",
        **{
            "spark.sql.shuffle.partitions": shuffles,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.host": "127.0.0.1",
            "spark.driver.bindAddress": "127.0.0.1",
            **settings,
        },
    )
