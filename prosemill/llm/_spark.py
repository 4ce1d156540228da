"""What several operators need from the session: the shared folder, staged tables and fixed-size filters."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.sources.staging import drop_path, drop_staged, shared_folder, small_batches, stage_path, staged

__all__ = ["HashFilter", "drop_path", "drop_staged", "filter_capacity", "fresh", "hash_filter", "held", "shared_folder", "ship", "stage_path", "staged"]

#: A filter of 2**MAX_FILTER_BITS bits is 32 MB: the bound of every filter that is sent to the executors.
MAX_FILTER_BITS = 28


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, and bounds their memory.

    The session keeps the smaller Arrow batches: its plans are lazy, so they can't be set back before a result is written.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    small_batches(spark)
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


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


def held(df: DataFrame) -> tuple[DataFrame, int]:
    """The table, kept as blocks on the executors' own disks until unpersist(), and its rows.

    For tables that are dropped before a result is handed out and aren't the smaller side of a join: they keep their partitions, so Spark
    would not split a skewed one. Blocks of a lost executor are made again. `staged` writes files, and for each the JVM forks
    processes that set permissions where Hadoop's native library is missing.
    """
    out = df.persist(StorageLevel.DISK_ONLY)
    return out, out.count()


class HashFilter:
    """A bit for each value of the leading bits of a 64-bit hash: no false negatives, false positives are verified later."""

    def __init__(self, bits: int, shared):
        self.bits, self.shared = bits, shared

    def __contains__(self, _):
        raise TypeError("use test()")

    def table(self) -> np.ndarray:
        return np.frombuffer(self.shared.value, np.uint8)

    def test(self, hashes: np.ndarray) -> np.ndarray:
        table = self.table()
        slot = hashes.astype(np.uint64, copy=False) >> np.uint64(64 - self.bits)
        return (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def filter_capacity() -> int:
    """Keys up to which a filter has 16 bits or more for each, so that one in sixteen or less passes by chance."""
    return (1 << MAX_FILTER_BITS) // 16


def hash_filter(df: DataFrame, column: str, rows: int) -> HashFilter:
    """A filter with 16 bits or more per row, up to 2**MAX_FILTER_BITS bits in all whatever the table's size.

    The bits are gathered by a native bitmap aggregate, so the driver gets at most 32 MB.
    """
    spark = df.sparkSession
    bits = min(MAX_FILTER_BITS, max(15, int(16 * max(rows, 1)).bit_length()))
    slot = F.shiftrightunsigned(F.col(column), 64 - bits) + F.lit(1)
    blocks = df.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    table = np.zeros(1 << (bits - 3), np.uint8)
    for row in blocks.collect():  # 32 MB at most
        part = np.frombuffer(bytes(row["bits"]), np.uint8)
        table[(row["block"] - 1) * 4096 : (row["block"] - 1) * 4096 + len(part)] = part
    return HashFilter(bits, spark.sparkContext.broadcast(table.tobytes()))
