"""Session settings shared by tests, bench and scripts."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "tideline", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter's own session is used as it is."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIDELINE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    return builder.master(master or os.environ.get("TIDELINE_MASTER", "local[8]")).getOrCreate()
