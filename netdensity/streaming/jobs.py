"""Jobs as a stream of files: what has arrived is scored, and a restart goes on where the last one ended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def available(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> int:
    """Run ``work`` over the Parquet files of ``source`` that are new since the last call; returns the rows that came in.

    Each batch goes to a folder of its own number, so a batch that is run again replaces itself."""
    seen = [0]

    def batch(df: DataFrame, number: int) -> None:
        rows = df.cache()
        seen[0] += rows.count()
        work(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")
        rows.unpersist()

    stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return seen[0]
