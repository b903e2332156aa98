"""Shared folders and sizing that several operators need."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local master (tests) gets one of its own: executors elsewhere could not read it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="peakloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh, not yet existing folder below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/peakloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def remove(df_or_path) -> None:
    """Delete a materialized intermediate that no later plan reads."""
    if isinstance(df_or_path, DataFrame):
        spark, paths = df_or_path.sparkSession, {f.rpartition("/")[0] for f in df_or_path.inputFiles()}
    else:
        spark, paths = SparkSession.active(), {df_or_path}
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def size_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of df; for a file scan, the bytes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partition_count(df: DataFrame, target_bytes: int = 16 << 20) -> int:
    """Enough partitions that each holds about target_bytes of df's files, never under the session's count."""
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = size_bytes(df)
    if size > 1 << 50:  # no statistics (Spark's default for an unknown source)
        return floor
    return max(floor, math.ceil(size / target_bytes))
