"""Row numbers in groups of any size: numbered in buckets of the order, after the counts of the buckets before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.sources.staging import fresh


def md5_bucket(digest: Column) -> Column:
    """4,096 buckets in the order of an MD5 in hex, each with a like share of the rows."""
    return F.substring(digest, 1, 3)


def range_bucket(number: Column, bits: int = 16) -> Column:
    """Buckets of 2**bits consecutive numbers, which hold so many rows at most if the numbers are unique."""
    return F.shiftright(number.cast("long"), bits)


def ranked(rows: DataFrame, by: list[str], bucket: Column, order: list[Column | str], output: str = "nth", total: str | None = None) -> DataFrame:
    """The rows with output, from 1 in each group, and the group's size if `total` names a column for it.

    bucket: a coarser key of the same order. Only a bucket's rows of a group stand in one window; buckets are counted first.
    """
    within, base, size = fresh(rows, "_bucket", "_base", "_size")
    keyed = rows.withColumn(within, bucket)
    counts = keyed.groupBy(*by, within).agg(F.count("*").alias(size))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row per bucket of the group
    before = F.coalesce(F.sum(size).over(group.orderBy(within).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select(*by, within, before.alias(base), *([F.sum(size).over(group).alias(total)] if total else []))
    nth = F.row_number().over(Window.partitionBy(*by, within).orderBy(*order))
    return keyed.withColumn(output, nth).join(bases, [*by, within]).withColumn(output, F.col(output) + F.col(base)).drop(within, base)
