"""Tables that are written to the folder all executors share, and read back: that cuts the lineage and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="prosemill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/prosemill/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_staged(*tables: DataFrame) -> None:
    """Deletes staged tables that no later plan reads."""
    for df in tables:
        drop_path(df.sparkSession, df._staged_path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own beside all columns that a table has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def exploded(df: DataFrame, array: Column, position: str, value: str) -> DataFrame:
    """A row with position (from 0) and value for each element.

    An outer explode whose empty rows are dropped after it: for an inner one the optimiser would filter by the array's size first, and so build the array twice.
    """
    return df.select("*", F.posexplode_outer(array).alias(position, value)).where(F.col(position).isNotNull())


#: Workers give freed memory back, and batches are small: texts may be long.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1"}
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 16_000_000}


def small_batches(spark: SparkSession | None = None) -> None:
    """Bounds the memory of Python workers. The session keeps the smaller Arrow batches: its plans are lazy, so they can't be set back before a result is written."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    for name, value in WORKER_ENV.items():
        spark.sparkContext.environment.setdefault(name, value)
    for name, value in BATCHES.items():
        now = spark.conf.get(name, None) or "none"
        if not now.isdigit() or int(now) > value:
            spark.conf.set(name, str(value))


def one_thread(spark: SparkSession) -> None:
    """Python workers use one thread each, as there is one for each core."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        spark.sparkContext.environment.setdefault(name, "1")
