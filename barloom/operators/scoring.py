"""Linear ranking, contributions, reasons and the latest scoring table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import BASELINE_WEIGHTS, FACTOR_GROUPS, MODEL_FEATURES, RAW_FEATURES
from barloom.functions import cross
from barloom.schemas import require_columns


def linear_score(weights: dict[str, float] = BASELINE_WEIGHTS) -> Column:
    """Weighted sum of standardised features; weights are scaled to an absolute sum of one."""
    scale = sum(abs(w) for w in weights.values())
    if scale <= 0:
        raise ValueError("At least one non-zero weight is required")
    terms = [F.col(f) * F.lit(w / scale) for f, w in weights.items()]
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def add_score(
    df: DataFrame, name: str = "baseline_score", weights: dict[str, float] = BASELINE_WEIGHTS
) -> DataFrame:
    require_columns(df, weights, "Scoring table")
    return df.withColumn(name, linear_score(weights))


def add_reasons(
    df: DataFrame, prefix: str = "baseline", weights: dict[str, float] = BASELINE_WEIGHTS
) -> DataFrame:
    """Add the two features with the largest contribution; equal ones in feature order."""
    parts = [
        F.struct(
            (-(F.col(f) * w)).alias("order"), F.lit(i).alias("place"),
            F.lit(f.removesuffix("_z")).alias("label"),
        )
        for i, (f, w) in enumerate(weights.items())
    ]
    ranked = F.array_sort(F.array(*parts))
    return df.withColumns(
        {
            f"{prefix}_reason_1": ranked[0]["label"],
            f"{prefix}_reason_2": ranked[1]["label"],
        }
    )


def contributions(df: DataFrame, weights: dict[str, float] = BASELINE_WEIGHTS) -> DataFrame:
    return df.withColumns({f"{f}_contribution": F.col(f) * w for f, w in weights.items()})


def add_rank(
    df: DataFrame, score: str, out: str, *, keys: list[str] | None = None
) -> DataFrame:
    """Ordinal rank of the score inside each date, highest first, ties by code."""
    return cross.ordinal_rank(df, keys or ["date"], score, "code", out)


def latest_scores(latest: DataFrame) -> DataFrame:
    """Scores, ranks and reasons of a standardised cross-section of the latest date."""
    scored = add_reasons(add_score(latest.dropna(subset=MODEL_FEATURES)))
    ranked = add_rank(scored, "baseline_score", "baseline_rank")
    identity = [c for c in ("security_name", "size_bucket") if c in latest.columns]
    return ranked.select(
        "date", "code", *identity, "industry", *RAW_FEATURES, "baseline_score",
        "baseline_rank", "baseline_reason_1", "baseline_reason_2",
    )


def ablation_weights(
    weights: dict[str, float] = BASELINE_WEIGHTS,
) -> dict[str, dict[str, float]]:
    """Weights of the full model and of each model with one factor group removed."""
    scenarios = {"full_model": dict(weights)}
    for group, removed in FACTOR_GROUPS.items():
        scenarios[f"remove_{group}"] = {f: w for f, w in weights.items() if f not in removed}
    return scenarios
