"""Sinks: partitioned tables, idempotent micro-batches, retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, time_column: str) -> None:
    """Parquet by tenant and day, so that scans and retention prune whole folders."""
    df.withColumn("date", F.to_date(time_column)).write.mode("append").partitionBy("tenant_id", "date").parquet(path)


def write_batch(path: str, time_column: str):
    """A foreachBatch function that may run again for a batch without doubling it: each batch has its own folder."""

    def sink(df: DataFrame, batch: int) -> None:
        df.withColumn("date", F.to_date(time_column)).write.mode("overwrite").partitionBy("tenant_id", "date").parquet(f"{path}/batch={batch}")

    return sink


def retained(df: DataFrame, time_column: str, now, days: int = 7) -> DataFrame:
    """Rows that a purge of all older than ``days`` leaves."""
    return df.where(F.col(time_column) >= F.lit(now) - F.expr(f"INTERVAL {days} DAYS"))


def write_together(path: str, parts: dict[str, tuple[Callable[[DataFrame], DataFrame], str]]):
    """A foreachBatch function that writes several tables of a batch, or, for readers of ``read_committed``, none of them.

    ``parts`` gives each table's rows from the batch and its time column. A batch counts once its mark
    is written, which comes last; a batch that runs again overwrites its own folders.
    """

    def sink(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            for name, (make, time_column) in parts.items():
                make(df).withColumn("date", F.to_date(time_column)).write.mode("overwrite").partitionBy("tenant_id", "date").parquet(f"{path}/{name}/batch={batch}")
            df.sparkSession.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}/committed/batch={batch}")
        finally:
            df.unpersist()

    return sink


def read_committed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of a table's batches whose mark stands."""
    done = spark.read.parquet(f"{path}/committed").select("batch").distinct()
    return spark.read.parquet(f"{path}/{name}").join(done, "batch", "left_semi").drop("batch")
