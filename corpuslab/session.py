"""Spark sessions with the settings the engine assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "corpuslab", master: str | None = None, shuffle_partitions: int | None = None, memory: str | None = None) -> SparkSession:
    """A session: UTC, ANSI mode, adaptive execution with skew joins, Arrow. Sizes are set only if given, so a cluster's own stay."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if memory:
        settings["spark.driver.memory"] = memory
    return b.config(map=settings).getOrCreate()
