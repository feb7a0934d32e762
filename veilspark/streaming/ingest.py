"""Documents that arrive as files: each micro-batch goes through the whole engine. A document is atomic,
so no state passes between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..plans.engine import run


def redact_stream(spark: SparkSession, source: str, target: str, checkpoint: str, settings: Settings | None = None, schema: str = "doc_id long, text string") -> StreamingQuery:
    """Reads Parquet documents as they come and appends rewritten pages and mentions, a folder a batch, so
    that a batch that is repeated after a failure overwrites its own output. Documents that leak are left out."""

    def batch(docs: DataFrame, number: int) -> None:
        result = run(docs, settings)
        result.safe_pages().write.mode("overwrite").parquet(f"{target}/pages/batch={number}")
        result.mentions.write.mode("overwrite").parquet(f"{target}/mentions/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
