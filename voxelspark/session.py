"""Makes this package importable on the executors, and keeps intermediate tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package to Python workers, once per context; nothing is sent where PYTHONPATH has it."""
    sc = spark.sparkContext
    if getattr(sc, "_voxelspark_shipped", False):
        return
    sc._voxelspark_shipped = True
    if str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    path = Path(tempfile.mkdtemp()) / "voxelspark.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    sc.addPyFile(str(path))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a local one is made only where it is unset, as in tests."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="voxelspark-"))
    return sc.getCheckpointDir()


#: Drops an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Narrow rows of a file of a small table.
FILE_ROWS = 250_000


def few(df: DataFrame, rows: int, each: int = FILE_ROWS) -> DataFrame:
    """``df`` in as many partitions as ``rows`` need with ``each`` of them in one, if it has more: small tables are not strewn over many files. A large table stays as it is."""
    return df.coalesce(max(1, -(-rows // each)))


def dealt(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``df`` dealt out by ``keys`` to as many tasks as shuffles have. Packed rows are few bytes for much work, so they are not brought together in fewer tasks for their size; without keys there is one task."""
    if not keys:
        return df.coalesce(1)
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[F.col(k) for k in keys])


def materialize(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors. The write's own shuffle files go with it.

    ``rows``: a bound of its narrow rows, if known; a small table is written by few tasks.
    """
    spark = df.sparkSession
    if rows is not None:
        df = few(df, rows)
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._voxelspark_table = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` made and nothing reads any more; other data frames are left alone."""
    for df in tables:
        if path := getattr(df, "_voxelspark_table", None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
