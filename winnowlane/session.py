"""Session defaults and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "winnowlane", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for one machine. On a cluster, build your own: the library only needs a session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    fixed = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (fixed | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
