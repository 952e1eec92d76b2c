"""Places for tables between jobs.

Everything that outlives a job goes to the folder named by
``spark.checkpoint.dir``, which all machines of a cluster share.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one where none is set and all
    runs in one machine (tests).  On a cluster that is an error, as each machine
    would write a folder of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if configured is None and current.isDefined():
        configured = current.get()
    if configured is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if configured is None:
        configured = "file://" + tempfile.mkdtemp(prefix="riskloom-")
    if not current.isDefined():
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs at most the running stage.
    """
    return written(df, fresh_path(df.sparkSession, name), *partition_by)


def written(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
