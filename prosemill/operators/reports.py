"""The result set of an experiment: every report table by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.operators import evaluation as E

THRESHOLDS = (0.45, 0.50, 0.55)


def wilson_rates(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """FPR of all human rows with its Wilson interval."""
    counts = E.confusion(scores, threshold).select("fp", (F.col("tn") + F.col("fp")).alias("n_human"))
    low, high = E.wilson(F.col("fp"), F.col("n_human"))
    return counts.select("fp", "n_human", E.ratio(F.col("fp"), F.col("n_human").cast("double")).alias("fpr"), low.alias("low"), high.alias("high"))


def confusion_layout(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A row per true class with the columns called human and called AI."""
    counts = E.confusion(scores, threshold)
    human = F.struct(F.lit("human").alias("true_class"), F.col("tn").alias("called_human"), F.col("fp").alias("called_ai"))
    ai = F.struct(F.lit("AI").alias("true_class"), F.col("fn").alias("called_human"), F.col("tp").alias("called_ai"))
    return counts.select(F.inline(F.array(human, ai)))


def report_set(test: DataFrame, models: list[str], hybrid: str, train_words: DataFrame | None = None, importances: DataFrame | None = None, n_first: int = 0, folds: int = 10) -> dict[str, DataFrame]:
    """Tables by name. test: y_true, source, group_id, a column of probabilities for each model, and words for the length baseline; train_words: words, y_true; importances: idx, feature, gain."""
    of = {m: test.withColumn("y_prob", F.col(m)) for m in models}
    both = [E.at_thresholds(of[m], list(THRESHOLDS)).withColumn("model", F.lit(m)) for m in models]
    compared = both[0]
    for rows in both[1:]:
        compared = compared.unionByName(rows)
    headline = [E.classification_report(of[m]).withColumn("model", F.lit(m)) for m in models]
    table = headline[0]
    for rows in headline[1:]:
        table = table.unionByName(rows)
    fold_table = E.fold_fpr(test, models, folds)
    out = {
        "headline": table,
        "thresholds": compared,
        "confusion": confusion_layout(of[hybrid]),
        "per_source": E.per_source(of[hybrid]),
        "wilson": wilson_rates(of[hybrid]),
        "fold_fpr": fold_table,
        "paired_ttest": E.paired_ttest(fold_table, hybrid, [m for m in models if m != hybrid]),
        "baselines": E.always_ai(test),
    }
    if train_words is not None:
        out["length"] = E.length_baseline(train_words, test)
    if importances is not None:
        out["gain_shares"], out["top_features"] = E.gain_shares(importances, n_first), E.top_features(importances)
    return out
