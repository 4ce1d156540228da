"""From a raw source to its cleaned table: read, clean, filter, count, write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.operators import cleaning, combine
from prosemill.sources import readers, sinks


@dataclass(frozen=True)
class Source:
    """How a source is read and what its cleaned table holds.

    output: columns; `cleaned` names the one that takes the cleaned text. sample: the first rows of the file, or of each subject.
    """

    schema: str
    output: tuple[str, ...]
    cleaned: str = "text"
    prompt: bool = False
    markdown: bool = False
    check_empty: bool = True
    sample: str = "subject"


SOURCES = {
    "claude": Source("raw_conversations", ("prompt", "cleaned_text"), "cleaned_text", prompt=True, check_empty=False, sample="file"),
    "mgtbench": Source("raw_ai", ("id", "text", "file", "subject")),
    "mgtbench_human": Source("raw_human", ("id", "text", "file", "subject")),
    "gemini": Source("raw_labelled", ("text", "label", "prompt_name", "source", "RDizzl3_seven"), markdown=True, sample="file"),
    "bawe": Source("raw_essays", ("id", "text", "file", "subject", "course")),
}


def prepared(raw: DataFrame, name: str, order: str = "row_id", sample_size: int | None = None) -> DataFrame:
    """The raw rows with text, and prompt, subject or id where the source has them in another form. raw: the source's columns and `order`, unique numbers."""
    source = SOURCES[name]
    rows = readers.require_columns(raw, [c.name for c in readers.schema(readers.SCHEMAS[source.schema])])
    if name == "claude":
        rows = rows.withColumn("_parts", readers.conversation_parts(F.col("conversations"))).select("*", F.col("_parts.prompt").alias("prompt"), F.col("_parts.response").alias("text")).drop("_parts")
    elif name == "mgtbench":
        rows = rows.withColumn("subject", readers.subject_from_file(F.col("file")))
    elif name == "mgtbench_human":
        rows = combine.file_row_id(rows, order)
    if sample_size:
        rows = readers.first_rows(rows, sample_size, order) if source.sample == "file" else combine.head_per_subject(rows, sample_size, order)
    return rows


def cleaned(raw: DataFrame, name: str, cleaner=None, order: str = "row_id", sample_size: int | None = None, detector=None) -> DataFrame:
    """The prepared rows with cleaned_text and drop_reason."""
    source = SOURCES[name]
    rows = prepared(raw, name, order, sample_size)
    if source.check_empty:
        rows = rows.withColumn("text", T.strip(F.coalesce("text", F.lit(""))))
    return cleaning.clean_rows(rows, cleaner, "prompt" if source.prompt else None, source.markdown, source.check_empty, detector)


def table_of(rows: DataFrame, name: str) -> DataFrame:
    """The kept rows in the columns of the source's cleaned table."""
    source = SOURCES[name]

    def column(out: str) -> Column:
        if out == source.cleaned:
            return F.col("cleaned_text").alias(out)
        return F.coalesce(F.col(out), F.lit("")).alias(out) if name == "gemini" and out != "label" else F.col(out)

    return cleaning.kept(rows).select(*map(column, source.output))


def build(spark: SparkSession, name: str, path: str, folder: str, sample_size: int | None = None, cleaner=None) -> tuple[DataFrame, DataFrame]:
    """Reads the source's CSV, writes its cleaned table and summary below folder, and returns both as written."""
    raw = readers.read_csv(spark, path, readers.SCHEMAS[SOURCES[name].schema]).withColumn("row_id", F.monotonically_increasing_id())
    rows = sinks.staged(cleaned(raw, name, cleaner, sample_size=sample_size), f"cleaned-{name}")
    out = sinks.output_path(folder, f"{name}_cleaned", sample_size)
    kept = table_of(rows, name)
    sinks.write_csv(kept, out)
    sinks.write_csv(cleaning.funnel_summary(rows).coalesce(1), f"{out}_summary")
    sinks.drop_staged(rows)
    return readers.read_csv(spark, out, sinks.ddl(kept)), readers.read_csv(spark, f"{out}_summary", "Metric string, Count long")


def ingest_essays(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Parses the XML files below path into one CSV of essays, and returns the summary with the files that couldn't be read."""
    parsed = sinks.staged(readers.tei_parsed(readers.tei_files(spark, path), path), "essays")
    sinks.write_csv(readers.readable(parsed), out)
    summary = spark.createDataFrame(readers.tei_summary(parsed).collect(), "Metric string, Count long")  # four rows
    sinks.drop_staged(parsed)
    return summary
