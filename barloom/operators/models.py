"""Boosted cross-sectional rankers through Spark's own distributed trainers.

The loss is the squared error of the target's percentile rank inside its date: a pointwise ranker,
not a pairwise one. Explanations are those of the linear ranker (`scoring.add_reasons`).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.config import MODEL_FEATURES, Boosting
from barloom.operators import splits


def best_rounds(losses: list[float], patience: int) -> tuple[int, bool]:
    """Trees with the lowest loss before `patience` rounds passed without a lower one.

    Also tells whether the patience ran out, that is, whether more trees cannot change the answer.
    """
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def fit_ranker(
    rows: DataFrame, config: Boosting = Boosting(), features: list[str] = MODEL_FEATURES
) -> PipelineModel:
    """Fit on rows with split `train`; rows with split `validation` choose the number of trees.

    Spark's own early stop has no patience. So trees are grown in doubling numbers until the
    validation loss has not fallen for `early_stopping_rounds` trees or all are grown, and the model
    of the best number is fitted. With one seed the first trees are the same in every fit. Without
    validation rows all trees stay.
    """
    if not features:
        raise ValueError("At least one model feature is required")
    assemble = VectorAssembler(inputCols=features, outputCol="features")
    used = rows.where(F.col("split").isin("train", "validation"))
    used = assemble.transform(used).select("split", "features", "target_rank").persist()
    try:
        train, held_out = (used.where(F.col("split") == s) for s in ("train", "validation"))

        def grown(trees: int):
            return GBTRegressor(
                featuresCol="features", labelCol="target_rank", predictionCol="prediction",
                maxIter=trees, maxDepth=config.max_depth, stepSize=config.learning_rate,
                subsamplingRate=config.subsample,
                featureSubsetStrategy=str(config.colsample_bytree), seed=config.random_state,
            ).fit(train)

        trees = config.n_estimators
        if held_out.isEmpty():
            return PipelineModel([assemble, grown(trees)])
        size = min(trees, 2 * config.early_stopping_rounds)
        while True:
            model = grown(size)
            losses = model.evaluateEachIteration(held_out, "squared")
            best, settled = best_rounds(losses, config.early_stopping_rounds)
            if settled or size == trees:
                break
            size = min(trees, 2 * size)
        return PipelineModel([assemble, model if best == size else grown(best)])
    finally:
        used.unpersist()


def score(model: PipelineModel, rows: DataFrame, name: str = "boosted_score") -> DataFrame:
    """Add the model's score; the assembled vector does not stay."""
    return model.transform(rows).withColumnRenamed("prediction", name).drop("features")


def walk_forward_scores(
    dataset: DataFrame, config: Boosting = Boosting(), features: list[str] = MODEL_FEATURES,
    *, cut: Callable[[DataFrame], DataFrame] = lambda df: df, **months,
) -> DataFrame:
    """Fit once per fold and stitch the scored test rows; folds are few, each fit is distributed."""
    folds = cut(splits.walk_forward_folds(dataset, **months))
    ids = [r.fold_id for r in folds.select("fold_id").distinct().orderBy("fold_id").collect()]
    parts = []
    for fold in ids:
        rows = folds.where(F.col("fold_id") == fold)
        model = fit_ranker(rows, config, features)
        parts.append(score(model, rows.where(F.col("split") == "test")))
    return reduce(lambda a, b: a.unionByName(b), parts)
