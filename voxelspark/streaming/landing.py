"""An extension: counts over files that arrive in a landing folder, kept by Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_dir


def arrivals(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str, lateness: str) -> DataFrame:
    """Rows per window and key. In append and update mode, state of windows older than ``lateness`` is dropped, as are rows that late; complete mode keeps all."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    counts = timed.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").cast(stream.schema[time].dataType).alias("start"), key, "n")


def drain(counts: DataFrame, folder: str | None = None) -> DataFrame:
    """Processes all that has arrived and returns the aggregate's whole state. Each batch replaces the result, so that a repeated batch changes nothing."""
    spark = counts.sparkSession
    folder = folder or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result")

    counts.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{folder}/result")
