"""Session-level helpers: lineage cuts on shared storage and distributed row numbering."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent (tests on one machine) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return _with_slashes(configured)
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="profloom-"))
    return _with_slashes(sc.getCheckpointDir())


def _with_slashes(path: str) -> str:
    """``file:/folder``, as Hadoop writes it, in the form that other libraries read too."""
    return "file:///" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there, so lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def slices(batch: pa.RecordBatch, rows: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows and ``size`` bytes (a larger row is alone), so that few very long values don't fill the memory."""
    if batch.num_rows > 1 and (batch.num_rows > rows or batch.nbytes > size):
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half), rows, size)
        yield from slices(batch.slice(half), rows, size)
    elif batch.num_rows:
        yield batch


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_sequence(df: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """Number the rows 0, 1, 2, … by ``order`` without one task ever seeing a whole group.

    Rows are range-partitioned and sorted, the sorted rows are written to the shared folder as a table (so
    that range bounds cannot differ between the two passes), and each partition's start is the sum of the
    counts before it. Only one row per partition reaches the driver. ``order`` should end in a unique
    column; rows equal in all of ``order`` get their numbers in any order. Nulls come first.
    """
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    ordered = materialize(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__mid", F.monotonically_increasing_id()), "ordered"
    )
    part = F.shiftright("__mid", 33).alias("__part")
    counts = sorted((r["__part"], r["n"]) for r in ordered.groupBy(part).agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for p, c in counts:
        starts.append((p, at))
        at += c
    if not starts:
        return ordered.drop("__mid").withColumn(name, F.lit(0).cast("bigint"))
    offsets = spark.createDataFrame(starts, "__part int, __start bigint")  # one row per partition
    return (
        ordered.withColumn("__part", part.cast("int"))
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__start") + F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__part", "__start", "__mid")
    )


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back; columns stay prunable."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, unless they find it by themselves through PYTHONPATH or the working directory.

    A zip of the package goes to the shared folder, once per application.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root == os.getcwd() or root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or spark.sparkContext.applicationId in _SHIPPED:
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(root, "profloom")):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
    target = shared_path(spark, "profloom") + ".zip"
    filesystem, path = fs.FileSystem.from_uri(target if "://" in target else f"file://{target}")
    filesystem.create_dir(os.path.dirname(path), recursive=True)
    with filesystem.open_output_stream(path) as f:
        f.write(held.getvalue())
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(spark.sparkContext.applicationId)
