"""Grouped and stratified splits, and the tables that check them.

Random order is the order of an MD5 of key and seed, so a split is the same on any number of partitions. Cuts are by
quota in each stratum. Rows carry row_id, group_id, label, subject and source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.operators.ranking import md5_bucket, ranked
from prosemill.sources.staging import fresh

SEED = 42


def order_of(key: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def strat_keys(rows: DataFrame) -> DataFrame:
    """strat = label__subject; a subject with one row borrows the smallest subject of its label with two or more."""
    subject = F.coalesce(F.col("subject").cast("string"), F.lit(""))
    rows = rows.withColumn("subject", subject)
    sizes = rows.groupBy("label", "subject").agg(F.count("*").alias("n"), F.min("row_id").alias("first"))
    donors = sizes.where("n >= 2").groupBy("label").agg(F.min_by("subject", F.struct("n", "first")).alias("donor"))
    # a row per label and subject
    lent = sizes.join(donors, "label", "left").select("label", "subject", F.when(F.col("n") == 1, F.coalesce("donor", "subject")).otherwise(F.col("subject")).alias("key"))
    return rows.join(lent, ["label", "subject"]).withColumn("strat", F.concat_ws("__", F.col("label").cast("string"), "key")).drop("key")


def stratified_split(rows: DataFrame, train: float = 0.7, val: float = 0.15, test: float = 0.15, seed: int = SEED) -> DataFrame:
    """Adds split (train, val, test): in each stratum the first share by MD5 order is the test, the next the validation."""
    if abs(train + val + test - 1) > 1e-6:
        raise ValueError("the shares must sum to 1")
    keyed = strat_keys(rows)
    order = order_of(F.col("row_id"), seed)
    numbered = ranked(keyed, ["strat"], md5_bucket(order), [order, "row_id"], "nth", "n")
    n_test, n_val = F.bround(F.col("n") * test), F.bround(F.col("n") * val)
    split = F.when(F.col("nth") <= n_test, "test").when(F.col("nth") <= n_test + n_val, "val").otherwise("train")
    return numbered.withColumn("split", split).drop("nth", "n", "strat")


def group_rows(rows: DataFrame) -> DataFrame:
    """One row per group, the first seen; label 2 where a group has both classes."""
    return rows.groupBy("group_id").agg(
        F.min("row_id").alias("row_id"),
        F.when(F.min("label") == F.max("label"), F.min("label")).otherwise(F.lit(2)).alias("label"),
        F.min_by(F.coalesce("subject", F.lit("")), "row_id").alias("subject"),
    )


def group_split(rows: DataFrame, train: float = 0.7, val: float = 0.15, test: float = 0.15, seed: int = SEED) -> DataFrame:
    """Adds split to all rows; rows of a group stay together."""
    groups = stratified_split(group_rows(rows), train, val, test, seed).select("group_id", "split")
    return rows.join(groups, "group_id")


def leaks(assigned: DataFrame, key: str | Column) -> DataFrame:
    """Keys that stand in more than one split: an empty table if the split is clean. key: a column, or an expression such as text_key()."""
    named = F.col(key) if isinstance(key, str) else key.alias("key")
    return assigned.groupBy(named).agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def text_key(text: Column) -> Column:
    """A digest by which equal texts are found, nulls as empty."""
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def downsample_ai(rows: DataFrame, per_human: int = 10, seed: int = SEED) -> DataFrame:
    """All human rows, and at most per_human AI rows for each, by MD5 order."""
    n_human = rows.where("label = 0").count()
    if not n_human:
        raise ValueError("no human rows")
    order = order_of(F.col("row_id"), seed)
    (nth,) = fresh(rows, "nth")
    ai = ranked(rows.where("label = 1"), [], md5_bucket(order), [order, "row_id"], nth).where(F.col(nth) <= per_human * n_human).drop(nth)
    return rows.where("label = 0").unionByName(ai)


def group_folds(rows: DataFrame, folds: int = 5, seed: int = SEED) -> DataFrame:
    """Adds fold: groups of each label are dealt in MD5 order, so classes are spread evenly and groups stay whole."""
    order = order_of(F.col("group_id"), seed)
    groups = ranked(group_rows(rows).select("group_id", "label"), ["label"], md5_bucket(order), [order, "group_id"])
    return rows.join(groups.select("group_id", ((F.col("nth") - 1) % folds).cast("int").alias("fold")), "group_id")


def balance_table(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("split", "label", "subject").agg(F.count("*").alias("count"))


def corpus_summary(assigned: DataFrame) -> DataFrame:
    """Rows by source and class with a column per split, human first, and a total."""
    counts = assigned.groupBy("source", "label").agg(F.count("*").alias("n"), *(F.count(F.when(F.col("split") == s, 1)).alias(s) for s in ("train", "val", "test")))
    named = counts.select("source", F.when(F.col("label") == 0, "human").otherwise("AI").alias("class"), "n", "train", "val", "test")
    total = named.agg(F.lit("total").alias("source"), F.lit("").alias("class"), *(F.sum(c).alias(c) for c in ("n", "train", "val", "test")))
    return named.unionByName(total)


def label_proportions(assigned: DataFrame) -> DataFrame:
    counts = assigned.groupBy("split", "label").agg(F.count("*").alias("count"))
    return counts.withColumn("proportion", F.col("count") / F.sum("count").over(Window.partitionBy("split")))


def median_words(assigned: DataFrame) -> DataFrame:
    """Median word count by source and split. assigned: words."""
    return assigned.groupBy("source").pivot("split", ["train", "val", "test"]).agg(F.percentile("words", 0.5))


def split_sizes(n: Column, train: float = 0.7, val: float = 0.15) -> dict[str, Column]:
    return {"train": F.bround(n * train).cast("long"), "val": F.bround(n * val).cast("long"), "test": F.bround(n * (1 - train - val)).cast("long")}
