"""Results worked out once and kept, so that rounds and repeated uses don't work them out again."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset and the master is local, as in tests, a temporary folder takes its place; on a
    cluster executors would not see each other's files there, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lumenspan-")
        atexit.register(shutil.rmtree, folder, True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below ``scratch`` and read again, which cuts its lineage; worked out once. The tables go when Python ends."""
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = f"{scratch(spark)}/settled/{sc.applicationId}"
    if not getattr(sc, "_lumenspan_settled", False):
        sc._lumenspan_settled = True
        atexit.register(_sweep, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _sweep(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
