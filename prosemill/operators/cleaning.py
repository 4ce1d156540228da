"""Cleaning funnels: filters in a fixed order, the first that a row fails counted as its drop reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.functions import rewrite
from prosemill.functions import text as T
from prosemill.functions.rules import TAGS

DENSITY, LOCAL_DENSITY = 0.4, 0.5
REASONS = ("empty", "non_academic", "foreign", "empty_after", "dense", "locally_dense")


def reasons_after(cleaned: Column) -> Column:
    """Reasons that need the cleaned text."""
    return (
        F.when(F.length(T.strip(cleaned)) == 0, "empty_after")
        .when(T.placeholder_density(cleaned) >= DENSITY, "dense")
        .when(T.placeholder_density_windowed(cleaned, threshold=LOCAL_DENSITY), "locally_dense")
    )


def clean_rows(rows: DataFrame, cleaner=None, prompt: str | None = None, markdown: bool = False, check_empty: bool = True, detector=None) -> DataFrame:
    """The rows with cleaned_text and drop_reason (null: kept).

    rows: text, and a prompt column if `prompt` names one. cleaner: a function Column -> Column; the whole rewrite program
    if none is given. Cheap native filters come first; the program runs only on rows that they keep, and once.
    """
    before = F.when(F.lit(check_empty) & (F.length(T.strip(F.coalesce("text", F.lit("")))) == 0), "empty")
    if prompt:
        before = before.when(~T.is_academic_content(F.col(prompt), F.col("text")), "non_academic")
    before = before.when(T.contains_foreign_language(F.col("text"), detector), "foreign")
    marked = rewrite.spread(rows).withColumn("early", before)
    source = T.clean_markdown_formatting(F.col("text")) if markdown else F.col("text")
    source = F.when(F.col("early").isNull(), F.coalesce(source, F.lit("")))
    cleaned = cleaner(source) if cleaner else rewrite.column(rewrite.clean_pipeline, source)
    after = reasons_after(F.col("cleaned_text"))
    if not check_empty:
        after = F.when(T.placeholder_density(F.col("cleaned_text")) >= DENSITY, "dense").when(T.placeholder_density_windowed(F.col("cleaned_text")), "locally_dense")
    return marked.withColumn("cleaned_text", cleaned).withColumn("drop_reason", F.coalesce("early", after)).drop("early")


def kept(cleaned: DataFrame) -> DataFrame:
    return cleaned.where("drop_reason is null").drop("drop_reason")


def drop_reasons(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def funnel_summary(cleaned: DataFrame) -> DataFrame:
    """Metric, Count: rows loaded, dropped for each reason and kept, and tags in the kept texts."""
    is_kept = F.col("drop_reason").isNull()
    metrics = {"Total Rows Loaded": F.count("*")}
    metrics |= {f"Dropped ({r})": F.count(F.when(F.col("drop_reason") == r, 1)) for r in REASONS}
    metrics["Rows Kept"] = F.count(F.when(is_kept, 1))
    metrics |= {f"[[{t}]] Tags Inserted": F.coalesce(F.sum(F.when(is_kept, T.tag_count(F.col("cleaned_text"), t))), F.lit(0)) for t in TAGS}
    metrics["Sentences Skipped (Too Short to Detect Language)"] = F.lit(0)  # reported, never counted
    one = cleaned.agg(*(v.cast("long").alias(f"m{i}") for i, v in enumerate(metrics.values())))
    pairs = F.array(*(F.struct(F.lit(k).alias("Metric"), F.col(f"m{i}").alias("Count")) for i, k in enumerate(metrics)))
    return one.select(F.inline(pairs))


def short_texts(rows: DataFrame, least: int = 30) -> DataFrame:
    """Texts of fewer than `least` words once tags are gone, by source."""
    return rows.where(T.count_words(F.col("text")) < least).groupBy("source").agg(F.count("*").alias("n"))


def input_guard(text: Column) -> Column:
    """ok, or why a submitted text is refused: 50 to 5,000 words, 60,000 characters at most."""
    n = F.regexp_count(text, F.lit(r"(?U)\S+"))
    return F.when(F.length(text) > 60_000, "too_many_characters").when(n < 50, "too_few_words").when(n > 5_000, "too_many_words").otherwise("ok")
