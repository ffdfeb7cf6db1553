"""What the operators of this subpackage share: scratch tables, words, components."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --------------------------------------------------------------------------- session

#: Bytes that one Arrow batch holds, or a single row's: a count of rows alone bounds nothing where texts are long.
BATCH_BYTES = 4 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where that is unset and the master is local, as in tests, a temporary folder takes its place; on
    a cluster executors would not see each other's files there, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lumenspan-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; what is left there goes when Python ends."""
    sc = spark.sparkContext
    path = f"{scratch_dir(spark)}/lumenspan/{sc.applicationId}"
    if not getattr(sc, "_lumenspan_swept", False):
        sc._lumenspan_swept = True
        atexit.register(_sweep, spark, path)
    return path


def _sweep(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumenspan_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``, once no result needs it any more."""
    _delete(df.sparkSession, df._lumenspan_path)


def fresh(name: str, taken) -> str:
    """``name``, with underscores before it until it clashes with no column."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once for each application, and bound their batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_lumenspan_shipped", False):
        return
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="lumenspan-zip-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "lumenspan_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    sc._lumenspan_shipped = True


_HELD: dict = {}


def held(key, make):
    """This worker's one large model: a call with another key lets go of the last."""
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Work that holds much itself and needs no model makes room first."""
    _HELD.clear()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of the rows that have an id; other columns are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("doc_id").isNotNull())


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def long_array(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64))


# --------------------------------------------------------------------------- components inside one task


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node number of each node's component, for nodes 0..n-1 and edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, nxt := new[new]):
            new = nxt
        label = new[label]
        live = label[a] != label[b]
        a, b = a[live], b[live]
    return label


# --------------------------------------------------------------------------- components on the cluster


def connected_components(edges: DataFrame, name: str = "cc", max_rounds: int = 40) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b): the smallest node that it reaches.

    Alternates large-star and small-star steps, each one grouping and one join, until the set
    of edges stands still. Only a count and a checksum of the edges come to the driver; each
    round is written to the shared folder, so that a lost executor costs one round at most, and
    is deleted once the next one stands.
    Self loops and null ends are dropped. No edges: no rows.
    """
    star = edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").select("a", "b").distinct()
    star = materialize(star, f"{name}-edges")
    seen = _edge_mark(star)
    for k in range(max_rounds):
        if seen[0] == 0:
            break
        both = star.select("a", "b").unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(down, "a")
        small = (
            joined.where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(joined.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        last, star = star, materialize(small, f"{name}-round{k}")
        release(last)
        now = _edge_mark(star)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return star.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _edge_mark(star: DataFrame) -> tuple:
    row = star.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("a", "b").bitwiseAND(0xFFFFFFFF)).alias("low"),
        F.sum(F.shiftrightunsigned(F.xxhash64("a", "b"), 32)).alias("high"),
    ).first()
    return (row["n"], row["low"], row["high"])
