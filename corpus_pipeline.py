"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes what its predecessor kept, as Parquet, and its decisions take effect: toxic documents go, one document of
each class of near-duplicates stays, documents that hold a benchmark item go, personal data is replaced by its kind, and
what is left is packed. All stages but the last return the columns of documents, whatever else these are and however they are
named. A null or empty text is a clean document, which is packed as its end id; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm._spark import drop_staged, staged
from prosemill.llm.decontamination import without_contaminated
from prosemill.llm.near_dedup import without_near_duplicates
from prosemill.llm.packing import pack
from prosemill.llm.pii import redacted
from prosemill.llm.queries import table
from prosemill.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5. Repeated rows are scored one by one, so all stay or go; a null text stays."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of near-duplicates, one row of it where rows repeat; null texts stay."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no benchmark item is covered by half; null and empty texts stay, and every row of repeated ones does or doesn't."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, and n_chars counted anew; a null text stays null."""
    out = redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in the packed sequences."""
    return pack(docs, added_tokens=True)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: SQL can't express the learned, sketching and tokenising stages; tests/llm compare the run with plain Python on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_staged(before)
        before = docs
    return docs
