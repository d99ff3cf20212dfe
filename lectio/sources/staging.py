"""Tables between the steps of a flow, in the cluster's shared checkpoint folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no spark.checkpoint.dir (tests, notebooks).
LOCAL = "file:///tmp/checkpoints"

#: Bytes of an Arrow batch, where the session doesn't say: a worker and its JVM hold a few at a time.
ARROW_BATCH = "8m"


def bounded_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, ARROW_BATCH)


def stage(df: DataFrame, label: str = "step") -> DataFrame:
    """df written as Parquet and read again: later steps read one result instead of running its
    plan once for each use, and a lost executor costs unfinished tasks only."""
    spark, schema = df.sparkSession, df.schema
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = LOCAL
    root = root.rstrip("/")
    path = f"{root}/lectio/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(schema).parquet(path)
