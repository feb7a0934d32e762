"""Written intermediate tables: stages that several others read are computed once, and outlive executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_local: dict[str, str] = {}


def folder(spark) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="veilspark-")
        atexit.register(shutil.rmtree, _local[app], True)
    return _local[app]


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, deleted when the session ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/veilspark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)
