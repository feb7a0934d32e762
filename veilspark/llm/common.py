"""What the corpus operators share: the shared folder, written intermediate tables, Arrow helpers.

Nothing here holds corpus data on the driver. Intermediate tables are Parquet in the folder that the
session names in ``spark.checkpoint.dir``, so an executor that is lost takes nothing with it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes in one Arrow batch, for all operators alike (a longer text is a batch of its own).
BATCH_BYTES = "4m"

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a one-machine session may do without the setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="veilspark-")
        atexit.register(shutil.rmtree, _local_dirs[app], True)
    return _local_dirs[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the folder goes when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veilspark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    for name in df.inputFiles():
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(name)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, False)


def without(docs: DataFrame, gone: DataFrame, max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``gone`` (doc_id, each once); null ids stay. Up to
    ``max_broadcast_rows`` ids go to all executors, so that the texts stay where they lie; more of them
    meet the texts in a shuffle."""
    gone = materialize(gone, "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= max_broadcast_rows else gone, "doc_id", "left_anti").select(docs.columns)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES. One value for the whole session, whoever asks and whenever plans run."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def map_text(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches small enough for long texts."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    large = pa.types.is_large_string(col.type)
    return [t or b"" for t in col.cast(pa.large_binary() if large else pa.binary()).to_pylist()]


def values_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def record(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def id_crc32(name: str = "doc_id"):
    """crc32 of the id as text, the hash that the folds are made by; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))
