"""Session-level helpers shared by every operator."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, once per application.

    Workers on this machine get its place on their path; on a cluster the
    package also travels as a zip through Spark's own file server.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    home = Path(__file__).resolve().parent
    paths = [str(home.parent), *filter(None, [sc.environment.get("PYTHONPATH")])]
    sc.environment["PYTHONPATH"] = os.pathsep.join(paths)
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f.relative_to(home.parent))
        sc.addPyFile(_store(spark, packed.getvalue(), f"{home.name}-{sc.applicationId}.zip"))


def _store(spark: SparkSession, data: bytes, name: str) -> str:
    """``data`` as a file of the shared folder, whatever file system that is on; its path."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path.toString()


def share_file(spark: SparkSession, data: bytes, name: str) -> str:
    """Put ``data`` beside every executor, through the shared folder and Spark's own file distribution; ``SparkFiles.get`` of the result is its place there."""
    unique = f"{uuid.uuid4().hex}-{name}"
    spark.sparkContext.addFile(_store(spark, data, unique))
    return unique


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory as a stream, be it a file or a folder of files."""
    schema = table(spark, sf_dir, name).schema
    # a pattern: a plain path may name no file, and a filter on file names reaches no folder
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    and all runs on one machine (tests) a private folder is made.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="jangbu-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back: lineage ends here.

    A plain checkpoint keeps the planner's estimates.  Those of a join multiply,
    so that in an iterative operator their digits double every round until
    planning takes all the driver's memory; a written table has its real size.
    The folder is the cluster's to empty, as with checkpoints.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most: int) -> DataFrame:
    """Broadcast hint for ``df`` only while it has at most ``most`` rows, which is counted; else the join is left to the planner."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
