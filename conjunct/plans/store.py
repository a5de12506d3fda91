"""Tables that are written once to the folder that the driver and all executors share, and read from there."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="conjunct-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def forget(spark: SparkSession, where: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session is gone: the folder's owner clears it
        pass


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table of the shared folder: a lost executor costs no recomputation. It is removed at exit."""
    spark = df.sparkSession
    where = f"{shared_dir(spark).rstrip('/')}/conjunct-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    atexit.register(forget, spark, where)
    return spark.read.schema(df.schema).parquet(where)
