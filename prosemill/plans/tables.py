"""The test tables in the roles of the engine's own, with the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.functions.rewrite import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Snippets that are added to the documents, as they hardly have anything to clean.
SNIPPETS = (
    " See https://ex.org/a1 and www.ex.org.", " Run `x = f(y)` now.", " It is O(n log n) here.", " Play C-G-D-A slowly.", " As shown [1, 2] and [3-5].",
    " (Smith, 2020) agrees.", " Then $E=mc^2$ holds.", " References: Smith 2020.", "\n# Title **bold** text", "",
)


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with a snippet chosen by doc_id % 10, lang, source; dealt to all cores, as one small file is one task."""
    docs = spread(table(spark, sf_dir, "documents"))
    snippet = F.element_at(F.array(*map(F.lit, SNIPPETS)), (F.col("doc_id") % 10 + 1).cast("int"))
    return docs.select("doc_id", F.concat("text", snippet).alias("text"), "lang", "source")


def _quoted(text: str) -> str:
    parts = ["'" + p.replace("'", "''") + "'" for p in text.split("\n")]
    return " || chr(10) || ".join(parts)


_CASES = " ".join(f"WHEN {i} THEN {_quoted(s)}" for i, s in enumerate(SNIPPETS))
ENRICHED = f"enriched AS (SELECT doc_id, text || (CASE doc_id % 10 {_CASES} END) AS text, lang, source FROM documents)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, y_true, y_prob, source, group_id: a fixed pseudo-random score of the labelled documents."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select(
        F.col("doc_id").alias("row_id"), F.col("quality").alias("y_true"), ((F.col("doc_id") * 7919 % 1000).cast("double") / 1000).alias("y_prob"),
        "source", F.concat_ws(":", "source", (F.col("doc_id") % 7).cast("string")).alias("group_id"),
    )


SCORES = "scores AS (SELECT doc_id AS row_id, quality AS y_true, CAST((doc_id * 7919) % 1000 AS DOUBLE) / 1000 AS y_prob, source, source || ':' || CAST(doc_id % 7 AS VARCHAR) AS group_id FROM documents JOIN labels USING (doc_id))"


def tied_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineitems' discounts as scores of returns: few distinct values, so many ties."""
    items = table(spark, sf_dir, "lineitem")
    return items.select((F.col("l_returnflag") == "R").cast("int").alias("y_true"), (F.col("l_discount") * 10).alias("y_prob"), F.col("l_linestatus").alias("source"))


TIED = "tied AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y_true, l_discount * 10 AS y_prob, l_linestatus AS source FROM lineitem)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, text, label, subject, source, group_id."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select(F.col("doc_id").alias("row_id"), "text", F.col("quality").alias("label"), F.col("lang").alias("subject"), "source", F.concat_ws(":", "source", (F.col("doc_id") % 50).cast("string")).alias("group_id"))


LABELLED = "labelled AS (SELECT doc_id AS row_id, text, quality AS label, lang AS subject, source, source || ':' || CAST(doc_id % 50 AS VARCHAR) AS group_id FROM documents JOIN labels USING (doc_id))"
