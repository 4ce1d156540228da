"""Error rates and reports over scored rows.

Scores are DataFrames with y_true (0 human, 1 AI), y_prob, and where needed source and group_id. Everything is a
conditional aggregate; ranks are built in two levels (buckets of the score, then scores in a bucket), so no window holds all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.operators.ranking import md5_bucket, ranked

BUCKETS = 1024


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def roc_auc(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """`by` columns and roc_auc (Mann-Whitney, ties count half; 0 with one class)."""
    by = by or []
    bucket = F.least(F.greatest(F.floor(F.col("y_prob") * BUCKETS), F.lit(0)), F.lit(BUCKETS)).cast("int")
    hist = scores.withColumn("bucket", bucket).groupBy(*by, "bucket", "y_prob").agg(_count(F.col("y_true") == 1).alias("pos"), _count(F.col("y_true") == 0).alias("neg"))
    below = Window.partitionBy(*by, "bucket").orderBy("y_prob").rowsBetween(Window.unboundedPreceding, -1)
    inner = hist.withColumn("under", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    per_bucket = inner.groupBy(*by, "bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)).alias("won"))
    earlier = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    summed = per_bucket.withColumn("under", F.coalesce(F.sum("neg").over(earlier), F.lit(0)))
    total = summed.groupBy(*by).agg(F.sum(F.col("won") + F.col("pos") * F.col("under")).alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return total.select(*by, ratio(F.col("won"), (F.col("p") * F.col("n")).cast("double")).alias("roc_auc"))


def against_humans(scores: DataFrame, group: str) -> DataFrame:
    """ROC-AUC of each group's AI rows against all human rows, which are ranked once: group, roc_auc."""
    bucket = F.least(F.greatest(F.floor(F.col("y_prob") * BUCKETS), F.lit(0)), F.lit(BUCKETS)).cast("int")
    hist = scores.withColumn("bucket", bucket).groupBy("bucket", "y_prob").agg(_count(F.col("y_true") == 0).alias("neg"))
    below = Window.partitionBy("bucket").orderBy("y_prob").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = hist.groupBy("bucket").agg(F.sum("neg").alias("n")).select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("humans"))
    # a row per bucket, BUCKETS + 1 at most
    ranked = hist.withColumn("under", F.coalesce(F.sum("neg").over(below), F.lit(0))).join(F.broadcast(bases), "bucket")
    ai = scores.where("y_true = 1").groupBy(group, "y_prob").agg(F.count("*").alias("pos"))
    won = ai.join(ranked, "y_prob").groupBy(group).agg(F.sum(F.col("pos") * (F.col("base") + F.col("under") + F.col("neg") / 2)).alias("won"), F.sum("pos").alias("p"), F.max("humans").alias("n"))
    return won.select(group, ratio(F.col("won"), (F.col("p") * F.col("n")).cast("double")).alias("roc_auc"))


def confusion(scores: DataFrame, threshold: Column | float = 0.5, by: list[str] | None = None) -> DataFrame:
    """`by` columns, tn, fp, fn, tp."""
    called = F.col("y_prob") >= threshold
    human = F.col("y_true") == 0
    return scores.groupBy(*(by or [])).agg(_count(human & ~called).alias("tn"), _count(human & called).alias("fp"), _count(~human & ~called).alias("fn"), _count(~human & called).alias("tp"))


def rates(counts: DataFrame) -> DataFrame:
    """The metrics that follow from tn, fp, fn and tp; divisions by nothing give 0."""
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    recall, fpr, precision = ratio(tp, tp + fn), ratio(fp, fp + tn), ratio(tp, tp + fp)
    return counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tn + fp + fn + tp),
            "balanced_accuracy": (recall + 1 - fpr) / 2,
            "precision": precision,
            "recall": recall,
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "fpr": fpr,
        }
    )


def classification_report(scores: DataFrame, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    by = by or []
    report, auc = rates(confusion(scores, threshold, by)), roc_auc(scores, by)
    return report.join(auc, by) if by else report.crossJoin(F.broadcast(auc))  # one row each


def at_thresholds(scores: DataFrame, thresholds: list[float], by: list[str] | None = None) -> DataFrame:
    """Metrics at each threshold, from one pass over the scores."""
    spark = scores.sparkSession
    cuts = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    return rates(confusion(scores.crossJoin(F.broadcast(cuts)), F.col("threshold"), [*(by or []), "threshold"]))


def hybrid_score(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ROC-AUC minus FPR at 0.5."""
    return classification_report(scores, 0.5, by).select(*(by or []), (F.col("roc_auc") - F.col("fpr")).alias("auc_minus_fpr"))


def wilson(fp: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of fp / n, cut to [0, 1]; (0, 0) without rows."""
    p, z2 = fp / n, z * z
    denominator = 1 + z2 / n
    center = (p + z2 / (2 * n)) / denominator
    margin = (z / denominator) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    zero = F.lit(0.0)
    return F.when(n > 0, F.greatest(zero, center - margin)).otherwise(zero), F.when(n > 0, F.least(F.lit(1.0), center + margin)).otherwise(zero)


def cluster_counts(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """False positives and rows of each group of human rows."""
    human = scores.where("y_true = 0")
    return human.groupBy("group_id").agg(_count(F.col("y_prob") >= threshold).alias("fp"), F.count("*").alias("n"))


def cluster_interval(scores: DataFrame, threshold: float = 0.5, draws: int = 2000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """FPR range from redrawing whole groups: Poisson weights by hash, so each draw is one more aggregate and nothing is gathered."""
    u = (F.pmod(F.xxhash64("group_id", "draw", F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    cumulative, term, weight = 0.0, 0.36787944117144233, F.lit(0)
    for k in range(12):
        cumulative += term
        weight = weight + F.when(u > cumulative, 1).otherwise(0)
        term /= k + 1
    drawn = cluster_counts(scores, threshold).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", weight)
    rate = drawn.groupBy("draw").agg(ratio(F.sum(F.col("w") * F.col("fp")), F.sum(F.col("w") * F.col("n")).cast("double")).alias("rate"))
    ends = rate.agg(F.percentile("rate", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("ends"))
    return ends.select(F.coalesce(F.col("ends")[0], F.lit(0.0)).alias("low"), F.coalesce(F.col("ends")[1], F.lit(0.0)).alias("high"))


def per_source(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """FPR of human sources; recall of AI sources and their ROC-AUC against all human rows."""
    called = F.col("y_prob") >= threshold
    grouped = scores.groupBy("source").agg(_count(F.col("y_true") == 1).alias("ai"), F.count("*").alias("rows"), _count(called).alias("called"), _count(called & (F.col("y_true") == 1)).alias("caught"))
    is_human = F.col("ai") == 0
    return grouped.join(against_humans(scores, "source"), "source", "left").select(
        "source",
        F.when(is_human, "human").otherwise("AI").alias("class"),
        F.when(is_human, F.col("rows")).otherwise(F.col("ai")).alias("n"),
        F.when(is_human, F.col("called") / F.col("rows")).alias("fpr"),
        F.when(~is_human, F.col("caught") / F.col("ai")).alias("recall"),
        F.when(~is_human, F.col("roc_auc")).alias("roc_auc"),
    )


def length_baseline(train: DataFrame, test: DataFrame) -> DataFrame:
    """How far the word count alone gets. train, test: words, y_true (and source in test): one row per scope."""
    spark = train.sparkSession
    direction = roc_auc(train.select("y_true", (1 / (1 + F.col("words"))).alias("y_prob"))).first()["roc_auc"]
    sign = -1.0 if direction >= 0.5 else 1.0
    scored = train.select("y_true", (sign * F.col("words").cast("double")).alias("score"))
    steps = [i / 200 for i in range(201)]
    cuts = scored.agg(F.percentile("score", F.array(*map(F.lit, steps))).alias("cuts")).select(F.explode(F.array_distinct("cuts")).alias("cut"))
    # the scores' own histogram is as small as the number of distinct lengths
    hist = scored.groupBy("score").agg(_count(F.col("y_true") == 1).alias("ai"), _count(F.col("y_true") == 0).alias("human"))
    tried = hist.crossJoin(F.broadcast(cuts)).groupBy("cut").agg(
        ratio(F.sum(F.when(F.col("score") >= F.col("cut"), F.col("ai")).otherwise(0)), F.sum("ai")).alias("recall"),
        ratio(F.sum(F.when(F.col("score") >= F.col("cut"), F.col("human")).otherwise(0)), F.sum("human")).alias("fpr"),
    )
    best = tried.orderBy(F.desc(F.round((F.col("recall") + 1 - F.col("fpr")) / 2, 12)), "cut").limit(1).first()
    cut = best["cut"]
    rule = f"AI if words <= {-cut:.0f}" if sign < 0 else f"AI if words >= {cut:.0f}"
    rows = test.select("y_true", "source", (sign * F.col("words").cast("double")).alias("score"))
    # a monotone image in (0, 1), so that ranks are those of the score
    probability = (0.5 + F.col("score") / (2 * (1 + F.abs("score")))).alias("y_prob")
    whole = "all AI sources"
    auc = against_humans(rows.select("y_true", probability, F.col("source").alias("scope")), "scope").unionByName(against_humans(rows.select("y_true", probability, F.lit(whole).alias("scope")), "scope"))
    called = F.col("score") >= cut
    human = rows.where("y_true = 0").agg(F.count("*").alias("n_human"), _count(called).alias("fp"))
    counts = [F.count("*").alias("n_ai"), _count(called).alias("tp")]
    ai = rows.where("y_true = 1")
    scopes = ai.groupBy(F.col("source").alias("scope")).agg(*counts).unionByName(ai.agg(*counts).select(F.lit(whole).alias("scope"), "n_ai", "tp"))
    grouped = scopes.crossJoin(F.broadcast(human))  # one row
    recall, fpr = ratio(F.col("tp"), F.col("n_ai")), ratio(F.col("fp"), F.col("n_human"))
    return grouped.join(auc, "scope", "left").select("scope", F.lit(rule).alias("rule"), F.coalesce("roc_auc", F.lit(0.0)).alias("roc_auc"), ((recall + 1 - fpr) / 2).alias("balanced_accuracy"), fpr.alias("fpr"), recall.alias("recall"), "n_human", "n_ai")


def fold_of(groups: DataFrame, folds: int, seed: int) -> DataFrame:
    """group_id and fold: groups in the order of an MD5, dealt round robin."""
    order = F.md5(F.concat_ws(":", F.col("group_id"), F.lit(str(seed))))
    numbered = ranked(groups.select("group_id").distinct(), [], md5_bucket(order), [order, "group_id"])
    return numbered.select("group_id", ((F.col("nth") - 1) % folds + 1).cast("int").alias("fold"))


def fold_fpr(scores: DataFrame, models: list[str], folds: int = 10, threshold: float = 0.5, seed: int = 42) -> DataFrame:
    """FPR of each model (a column of probabilities) on the same folds of human groups, and n_human."""
    human = scores.where("y_true = 0")
    n_groups = human.select("group_id").distinct().count()
    if n_groups < folds:
        raise ValueError(f"{n_groups} human groups are too few for {folds} folds")
    placed = human.join(fold_of(human, folds, seed), "group_id")
    return placed.groupBy("fold").agg(*(F.avg(F.when(F.col(m) >= threshold, 1.0).otherwise(0.0)).alias(m) for m in models), F.count("*").alias("n_human"))


def paired_t(table: DataFrame, hybrid: str, baselines: list[str]) -> DataFrame:
    """t of the fold differences of the hybrid to each baseline; 0 where none differs. table: one row per fold."""
    parts = []
    for name in baselines:
        difference = F.col(hybrid) - F.col(name)
        spread = F.coalesce(F.stddev_samp(difference), F.lit(0.0))
        parts.append(
            table.agg(
                F.lit(name).alias("baseline"), F.avg(hybrid).alias("hybrid_mean_fpr"), F.avg(name).alias("baseline_mean_fpr"), F.avg(difference).alias("mean_diff"),
                F.when(F.max(F.abs(difference)) <= 1e-8, 0.0).otherwise(F.avg(difference) / (spread / F.sqrt(F.count("*")))).alias("t"), F.count("*").alias("n_folds"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def paired_ttest(table: DataFrame, hybrid: str, baselines: list[str], alpha: float = 0.05) -> DataFrame:
    """paired_t with p-values from the JVM's Student distribution; one row per baseline."""
    spark = table.sparkSession
    rows = []
    for r in paired_t(table, hybrid, baselines).collect():
        t, n = r["t"], r["n_folds"]
        lower = 1.0 if t == 0 else float(spark._jvm.org.apache.commons.math3.distribution.TDistribution(float(n - 1)).cumulativeProbability(float(t)))
        two = 1.0 if t == 0 else 2 * min(lower, 1 - lower)
        rows.append((*r, two, lower, two < alpha))
    return spark.createDataFrame(rows, "baseline string, hybrid_mean_fpr double, baseline_mean_fpr double, mean_diff double, t double, n_folds long, p_two_sided double, p_hybrid_lower double, reject_h0 boolean")


def fit_verdict(train_auc: Column, train_fpr: Column, val_auc: Column, val_fpr: Column, test_fpr: Column) -> Column:
    """underfit, overfit, noisy or right."""
    return F.when((train_auc < 0.90) & (val_auc < 0.90), "underfit").when((val_fpr - train_fpr >= 0.03) | (train_auc - val_auc >= 0.02), "overfit").when(F.abs(test_fpr - val_fpr) >= 0.03, "noisy").otherwise("right")


def stump_rule(candidates: DataFrame, slack: float = 0.005) -> DataFrame:
    """The chosen row of (idx, depth, fpr, score): the best depth-1 row if its FPR is within slack of the best row's, else the best."""
    best = candidates.orderBy(F.desc("score"), "idx").limit(1).select(F.col("fpr").alias("best_fpr"))
    allowed = candidates.crossJoin(F.broadcast(best)).withColumn("stump", (F.col("depth") == 1) & (F.col("fpr") <= F.col("best_fpr") + slack))
    return allowed.orderBy(F.desc("stump"), F.desc("score"), "idx").limit(1).select("idx", "depth", "fpr", "score")


def always_ai(scores: DataFrame) -> DataFrame:
    """The report of calling every row AI."""
    return rates(confusion(scores.withColumn("y_prob", F.lit(1.0)), 0.5)).withColumn("model", F.lit("always AI"))


def gain_shares(importances: DataFrame, n_first: int) -> DataFrame:
    """Share of gain of the first n_first features and of the others. importances: idx, feature, gain."""
    total = importances.agg(F.sum(F.when(F.col("idx") < n_first, F.col("gain")).otherwise(0.0)).alias("first_gain"), F.sum(F.when(F.col("idx") >= n_first, F.col("gain")).otherwise(0.0)).alias("second_gain"))
    whole = F.col("first_gain") + F.col("second_gain")
    return total.select("first_gain", "second_gain", ratio(F.col("first_gain"), whole).alias("first_share"), ratio(F.col("second_gain"), whole).alias("second_share"))


def top_features(importances: DataFrame, k: int = 10) -> DataFrame:
    return importances.orderBy(F.desc("gain"), "idx").limit(k).select("feature", "gain")
