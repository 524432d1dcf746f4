"""Tables that are read more than once, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, an own one on a local master and an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="epistrata-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(d: DataFrame, name: str) -> DataFrame:
    """``d`` as a Parquet table in the shared folder, so it is computed once; deleted when the driver's interpreter ends."""
    spark = d.sparkSession
    path = f"{shared_dir(spark)}/epistrata/{name}-{uuid.uuid4().hex}"

    def drop():
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone by then
            pass

    atexit.register(drop)
    d.write.parquet(path)
    return spark.read.schema(d.schema).parquet(path)
