"""Tables between the steps of iterations, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-lodestar-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only where that is unset and Spark is a single process (tests), one of our own; on a cluster it must be set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    return (path or _own_dir()).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table that nothing else uses, read back: lineage ends there, and a lost executor costs a re-read."""
    path = f"{shared_dir(df.sparkSession)}/lodestar/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
