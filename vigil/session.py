"""Session factory and table access shared by tests, bench and the driver entry point."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution and UTC time, for tests and bench only."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vigil")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data set; the scan stays lazy, so filters and columns are pushed into it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
