"""Scores of submitted texts: the same stateless plan for a table or a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.functions import rewrite
from prosemill.functions import text as T
from prosemill.operators.chunking import split_passages
from prosemill.operators.cleaning import input_guard

THRESHOLD = 0.55
MIN_PROSE = 50


def weighted_score(passages: Column) -> Column:
    """Word-weighted mean of array<struct<..., word_count, ai_probability>>."""
    words = F.aggregate(passages, F.lit(0.0), lambda s, p: s + p["word_count"])
    return F.aggregate(passages, F.lit(0.0), lambda s, p: s + p["word_count"] * p["ai_probability"]) / F.when(words > 0, words)


def lexical_probability(text: Column) -> Column:
    """A stand-in score from lexical features, for use without a trained model. It is no detector."""
    return T.let(T.lexical_struct(text), lambda f: 1 / (1 + F.exp(-(4 * f["function_word_ratio"] - 3 * f["ttr"] + 0.2 * f["avg_word_length"]))))


def verdict(p: Column, label: str, percent: str, band: str) -> list[Column]:
    """Label, percent to one decimal and band of a probability; nulls for a null."""
    return [
        F.when(p.isNotNull(), F.when(p >= THRESHOLD, "ai").otherwise("human")).alias(label),
        F.round(p * 100, 1).alias(percent),
        F.when(p.isNotNull(), T.score_band(F.bround(p * 100))).alias(band),
    ]


def detect(submissions: DataFrame, probability: Callable[[Column], Column] = lexical_probability, cleaner: Callable[[str], str] | None = None) -> DataFrame:
    """id, status, ai_probability (0 to 100, one decimal), label, band, threshold, word_count, passages. submissions: id, text.

    Texts are cleaned, cut into passages, freed of tags and scored; refused ones have a status other than ok and no score.
    """
    guarded = rewrite.spread(submissions).withColumn("status", F.coalesce(input_guard(F.col("text")), F.lit("too_few_words")))
    accepted = F.when(F.col("status") == "ok", F.col("text"))
    program = cleaner or (lambda text: rewrite.clean_pipeline(rewrite.clean_markdown_formatting(text)))
    cleaned = guarded.withColumn("cleaned_text", rewrite.column(program, accepted))
    cut = split_passages(cleaned)
    stripped = F.filter(F.transform("passages", lambda p: T.strip_placeholders(p["text"])), lambda p: F.length(p) > 0)
    scored = F.transform(stripped, lambda p: F.struct(p.alias("text"), T.count_words(p).alias("word_count"), probability(p).alias("ai_probability")))
    rows = cut.withColumn("passages", F.when(F.col("status") == "ok", scored))
    words = F.aggregate("passages", F.lit(0), lambda s, p: s + p["word_count"])
    rows = rows.withColumn("word_count", words)
    rows = rows.withColumn("status", F.when((F.col("status") == "ok") & (F.col("word_count") < MIN_PROSE), "too_little_prose").otherwise(F.col("status")))
    ok = F.col("status") == "ok"
    rows = rows.withColumn("p", F.when(ok, weighted_score(F.col("passages"))))
    each = F.transform("passages", lambda p: F.struct(p["text"].alias("text"), p["word_count"].alias("word_count"), F.round(p["ai_probability"] * 100, 1).alias("ai_probability")))
    label, percent, band = verdict(F.col("p"), "label", "ai_probability", "band")
    return rows.select("id", "status", percent, label, band, F.lit(THRESHOLD).alias("threshold"), F.when(ok, F.col("word_count")).alias("word_count"), F.when(ok, each).alias("passages"))
