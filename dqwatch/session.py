"""Session defaults that the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def pin_utc(spark: SparkSession) -> SparkSession:
    """Upload times are compared with UTC windows, so the session clock has to be UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cpus: int | str = 8, app: str = "dqwatch", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster bring your own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # recording the call site of every column function doubles the time to build a plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
