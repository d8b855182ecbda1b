"""Incremental ingestion: every arriving file of page texts is processed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema: str, process: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Processes what has arrived under source (Parquet) and appends the result to target; restarts resume."""

    def step(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
