"""An index that grows with a stream of values: each micro-batch adds its counts, readers sum them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def grow_index(values: DataFrame, build, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs build, one of the index functions, on every micro-batch and keeps its entries under path by batch.

    A batch that is run again after a failure overwrites its own folder, so nothing counts twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    writer = values.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The whole index: scores of equal entries, and in a gram index weights and times, summed over batches."""
    rows = spark.read.parquet(path).drop("batch")
    summed = [c for c in ("times", "weight", "score") if c in rows.columns]
    return rows.groupBy(*[c for c in rows.columns if c not in summed]).agg(*[F.sum(c).alias(c) for c in summed])
