"""Sessions for tests and benchmarks; on a cluster pass your own session."""

import os

from pyspark.sql import SparkSession


def local_session(cpus: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the queries are tested under."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (SparkSession.builder.master(f"local[{cpus}]").appName("paperloom")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", os.environ.get("PAPERLOOM_DRIVER_MEMORY", "8g"))
            .config("spark.ui.enabled", "false")
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .getOrCreate())
