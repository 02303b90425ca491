"""Where intermediate results go: the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset a temporary folder is set, if the master is local; else this fails."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        base = sc.getCheckpointDir()
        if not base:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            base = tempfile.mkdtemp(prefix="cardloom-")
            sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/cardloom-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends, and lost executors cost nothing done."""
    path = path or shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spool(spark: SparkSession, parts: Iterable[bytes]) -> str:
    """The path of a new file in the shared folder that holds ``parts``, written by the driver through Spark's own file systems."""
    jvm, sc = spark._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark) + ".txt")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    try:
        for b in parts:
            out.write(bytearray(b))
    finally:
        out.close()
    return path.toString()
