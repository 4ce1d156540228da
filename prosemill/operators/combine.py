"""Sources brought to one schema, united in a fixed order, and texts kept once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.operators.chunking import chunk_passages, target_quantiles
from prosemill.operators.ranking import range_bucket, ranked
from prosemill.sources.staging import fresh, staged

#: Sources in the order of the union, with their labels.
SOURCES = (("bawe", 0), ("mgtbench_human", 0), ("mgtbench", 1), ("claude", 1), ("gemini", 1))
COLUMNS = ("text", "label", "source", "subject", "group_id")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """row_id from 0 in the given order; rows that are equal in it are numbered by a hash of the whole row.

    The rows are range-partitioned, sorted and written once, as a second run of the sampled ranges could cut them elsewhere.
    Each partition's rows are numbered after those of the partitions before; a partition has one row in the table of offsets.
    """
    keys = [*map(F.col, order), F.xxhash64(*rows.columns)]
    nth = F.monotonically_increasing_id()  # the partition's number in the upper bits, the row's in the lower 33
    placed = staged(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", nth), "numbered")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))  # a row per partition
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn("row_id", F.col("_offset") + F.col("_at").bitwiseAND((1 << 33) - 1)).select(*rows.columns, "row_id")


def group_ids(source: str, row: Column, file: Column | None = None, key: Column | None = None) -> Column:
    """<source>:<file>:<id> if both are there, else <source>:<row>."""
    parts = [file, key] if file is not None and key is not None else [row]
    return F.concat_ws(":", F.lit(source), *(p.cast("string") for p in parts))


def normalised(rows: DataFrame, source: str, label: int, text: str = "text", subject: Column | None = None, group: Column | None = None) -> DataFrame:
    """text, label, source, subject, group_id and the order of the rows (row)."""
    return rows.select(
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.lit(label).alias("label"),
        F.lit(source).alias("source"),
        F.coalesce(subject.cast("string") if subject is not None else F.lit(""), F.lit("")).alias("subject"),
        (group if group is not None else group_ids(source, F.col("row"))).alias("group_id"),
        F.col("row").cast("long").alias("row"),
    )


def first_of_each_text(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per text, the first in the order: by an aggregate, so a text that fills a third of the rows is reduced where it is read."""
    others = [c for c in rows.columns if c != "text"]
    first = F.min_by(F.struct(*others), F.struct(*order))
    return rows.groupBy("text").agg(first.alias("_row")).select("text", "_row.*")


def combine(tables: dict[str, DataFrame], chunk_human: bool = True, min_words: int = 75, max_words: int = 520, seed: int = 42) -> DataFrame | None:
    """text, label, source, subject, group_id of all sources that are there: blanks dropped, the first of equal texts kept.

    tables: normalised rows by source. Human essays (the first source) are cut into passages as long as the AI texts, other
    human texts keep their first passage; without AI rows they stay whole. None if no table is given.
    """
    if not tables:
        return None
    ai = [tables[s] for s, label in SOURCES if label and s in tables]
    targets = target_quantiles(reduce(DataFrame.unionByName, ai)) if ai and chunk_human else []
    parts = []
    for ordinal, (source, label) in enumerate(SOURCES):
        if source not in tables:
            continue
        rows = tables[source]
        if not label and targets:
            if source != SOURCES[0][0]:
                rows = first_of_each_text(rows, ["row"])
            keyed = rows.withColumn("id", F.col("row"))
            cut = chunk_passages(keyed.select("id", "text", "subject"), targets, seed, min_words, max_words)
            if source != SOURCES[0][0]:
                cut = cut.where("chunk_idx = 0")
            rows = cut.join(keyed.select("id", "label", "source", "group_id", "row"), "id").drop("id")
        else:
            rows = rows.withColumn("chunk_idx", F.lit(0))
        parts.append(rows.select(*COLUMNS, "row", "chunk_idx").withColumn("ordinal", F.lit(ordinal)))
    united = reduce(DataFrame.unionByName, parts).where(F.length(T.strip(F.col("text"))) > 0)
    return first_of_each_text(united, ["ordinal", "row", "chunk_idx"]).select(*COLUMNS, "ordinal", "row", "chunk_idx")


def file_row_id(rows: DataFrame, order: str = "row_id") -> DataFrame:
    """id: the number of a row in its file, from 0. order: a column of unique numbers."""
    (nth,) = fresh(rows, "_nth")
    return ranked(rows, ["file"], range_bucket(F.col(order)), [order], nth).withColumn("id", F.col(nth) - 1).drop(nth)


def head_per_subject(rows: DataFrame, n: int, order: str = "row_id") -> DataFrame:
    """The first n rows of each subject; each task keeps n of a subject at most before they meet."""
    nth = F.row_number().over(Window.partitionBy("subject").orderBy(order))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")
