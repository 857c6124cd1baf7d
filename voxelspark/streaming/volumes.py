"""Volumes as they arrive: each is taken once, late repetitions within a bound are dropped, and results are stored batch by batch, so that a batch done again replaces itself.

State is bounded: ids older than the watermark are forgotten, as are windows; rows that are later than that are dropped. Checkpoints and results lie in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir


def once(stream: DataFrame, time: str, lateness: str, *ids: str) -> DataFrame:
    """The first row of each ``ids`` among those that arrive within ``lateness`` of each other; ``time`` is when a row was made."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness).dropDuplicatesWithinWatermark([*ids])


def closed_counts(rows: DataFrame, time: str, key: str, width: str) -> DataFrame:
    """start, ``key`` and n of each window, once the watermark has passed its end. ``rows`` has a watermark."""
    counts = rows.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), key, "n")


def drain(stream: DataFrame, handle: Callable[[DataFrame], DataFrame] | None = None, folder: str | None = None) -> tuple[DataFrame, list[dict]]:
    """Processes what has arrived since the last time and returns all results so far, with the progress of each batch. ``handle`` makes a batch's result of its rows; only new rows reach it (append mode).

    A batch's result lies in a folder of its number, which a repeated batch overwrites.
    """
    spark = stream.sparkSession
    folder = folder or f"{shared_dir(spark)}/volumes-{uuid.uuid4().hex}"
    schemas = []

    def keep(batch: DataFrame, number: int) -> None:
        out = batch if handle is None else handle(batch)
        schemas.append(out.schema)
        out.write.mode("overwrite").parquet(f"{folder}/results/batch={number}")

    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    progress = list(query.recentProgress)
    schema = schemas[0] if schemas else spark.read.parquet(f"{folder}/results").drop("batch").schema
    return spark.read.schema(schema).parquet(f"{folder}/results/batch=*"), progress


def state_rows(progress: list) -> int:
    """Rows of state that all operators held at the end."""
    return sum(s["numRowsTotal"] for s in progress[-1]["stateOperators"]) if progress else 0
