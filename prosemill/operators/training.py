"""Boosted trees: grid search with grouped folds, early stopping, selection on validation, leave-one-source-out.

The learner is Spark's GBTClassifier; minInstancesPerNode stands for the minimal child weight, and default_grid says what stands for L2 and gamma.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.operators.evaluation import hybrid_score, per_source
from prosemill.operators.splitting import group_folds
from prosemill.sources.staging import drop_staged, staged


@dataclass
class Search:
    """Configurations with their scores, best first, and the model that was kept."""

    rows: list[dict] = field(default_factory=list)
    model: GBTClassificationModel | None = None
    chosen: dict | None = None


def default_grid(rounds: int = 400) -> list[dict]:
    """32 combinations: depth, learning rate, least rows of a node, and two that stand for what Spark's trees lack.

    minWeightFractionPerNode stands for an L2 penalty, as both keep leaves of little weight from large values, and minInfoGain
    for a penalty on each split. Rows are drawn at a share of 0.8.
    """
    options = {"maxDepth": (1, 2), "stepSize": (0.05, 0.1), "minInstancesPerNode": (10, 50), "minWeightFractionPerNode": (0.0, 0.01), "minInfoGain": (0.0, 0.001)}
    return [dict(zip(options, x, strict=True)) | {"subsamplingRate": 0.8, "maxIter": rounds} for x in product(*options.values())]


def learner(params: dict, label: str = "label", features: str = "features", seed: int = 42) -> GBTClassifier:
    return GBTClassifier(labelCol=label, featuresCol=features, seed=seed, **params)


def scored(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    """The rows with y_true and y_prob."""
    return model.transform(rows).withColumns({"y_true": F.col("label").cast("int"), "y_prob": vector_to_array("probability")[1]})


def cross_validated(rows: DataFrame, grid: list[dict], folds: int = 5, seed: int = 42) -> list[dict]:
    """The grid with its mean ROC-AUC minus FPR over grouped, stratified folds, best first, ties in grid order. rows: row_id, group_id, label, subject, features."""
    if "group_id" not in rows.columns:
        raise ValueError("grouped folds need group_id")
    placed = staged(group_folds(rows, folds, seed), "folds")
    out = []
    for idx, params in enumerate(grid):
        held = [scored(learner(params, seed=seed).fit(placed.where(F.col("fold") != k)), placed.where(F.col("fold") == k)).select("y_true", "y_prob", "fold") for k in range(folds)]
        score = hybrid_score(reduce(DataFrame.unionByName, held), ["fold"]).agg(F.avg("auc_minus_fpr")).first()[0]
        out.append({"idx": idx, "params": params, "score": score})
    drop_staged(placed)
    return sorted(out, key=lambda r: (-r["score"], r["idx"]))


def select_on_validation(search: list[dict], train: DataFrame, val: DataFrame, top_k: int = 3, seed: int = 42) -> Search:
    """The best of the top_k configurations, each fitted on train, by its score on val; the first of equal ones."""
    result = Search()
    for rank, row in enumerate(search[:top_k]):
        model = learner(row["params"], seed=seed).fit(train)
        score = hybrid_score(scored(model, val)).first()[0]
        result.rows.append({**row, "cv_rank": rank, "val_score": score})
        if result.chosen is None or score > result.chosen["val_score"]:
            result.chosen, result.model = result.rows[-1], model
    return result


def train_with_validation(train: DataFrame, val: DataFrame, grid: list[dict], slack: float = 0.005, tolerance: float = 0.001, seed: int = 42) -> Search:
    """Early stopping on val; a model of depth 1 is preferred if its FPR is within slack of the best one's."""
    marked = train.withColumn("is_val", F.lit(False)).unionByName(val.withColumn("is_val", F.lit(True)))
    result, models = Search(), {}
    for idx, params in enumerate(grid):
        model = learner({**params, "validationIndicatorCol": "is_val", "validationTol": tolerance}, seed=seed).fit(marked)
        rates = scored(model, val)
        fpr = rates.where("y_true = 0").agg(F.coalesce(F.avg(F.when(F.col("y_prob") >= 0.5, 1.0).otherwise(0.0)), F.lit(0.0))).first()[0]
        models[idx] = model
        result.rows.append({"idx": idx, "params": params, "depth": params.get("maxDepth", 5), "fpr": fpr, "score": hybrid_score(rates).first()[0], "stopped_at": model.getNumTrees})
    result.rows.sort(key=lambda r: (-r["score"], r["idx"]))
    best = result.rows[0]
    stumps = [r for r in result.rows if r["depth"] == 1 and r["fpr"] <= best["fpr"] + slack]
    result.chosen = stumps[0] if stumps else best
    result.model = models[result.chosen["idx"]]
    return result


def train_booster(train: DataFrame, val: DataFrame | None = None, grid: list[dict] | None = None, folds: int = 5, seed: int = 42) -> Search:
    """Cross-validation and a refit of the best without validation rows, early stopping with them."""
    grid = grid or default_grid()
    if val is not None:
        return train_with_validation(train, val, grid, seed=seed)
    rows = cross_validated(train, grid, folds, seed)
    return Search(rows, learner(rows[0]["params"], seed=seed).fit(train), rows[0])


def leave_one_source_out(rows: DataFrame, ai_sources: list[str], params: dict, seed: int = 42) -> DataFrame:
    """For each AI source: a model that never saw it, its recall on it and its ROC-AUC against the human rows."""
    parts = []
    for source in ai_sources:
        model = learner(params, seed=seed).fit(rows.where(F.col("source") != source))
        held = scored(model, rows.where((F.col("label") == 0) | (F.col("source") == source)))
        parts.append(per_source(held).where(F.col("source") == source).select("source", "n", "recall", "roc_auc"))
    return reduce(DataFrame.unionByName, parts)


def importances(model: GBTClassificationModel, names: list[str]) -> DataFrame:
    """idx, feature, gain."""
    from pyspark.sql import SparkSession

    rows = [(i, n, float(model.featureImportances[i])) for i, n in enumerate(names)]
    return SparkSession.active().createDataFrame(rows, "idx int, feature string, gain double")
