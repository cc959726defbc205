"""Reports on the quality of scores and factors.

Several score columns are stacked into (model, score) rows, so every report is one aggregation for
all models. Reports first reduce to one row per date and only then summarise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import asof, cross
from barloom.functions.scalars import ratio
from barloom.operators import splits

TARGET = "target_excess_return"


def by_model(df: DataFrame, scores: list[str], keep: list[str]) -> DataFrame:
    """Stack score columns: `keep` columns, model (name without `_score`) and score."""
    slim = df.select(*keep, *[F.col(s).cast("double").alias(s) for s in scores])
    return slim.unpivot(keep, scores, "model", "score").withColumn(
        "model", F.regexp_replace("model", "_score$", "")
    )


def rate(test: Column) -> Column:
    """Share of rows passing a test; rows where it is null count as failing."""
    return F.avg(F.when(test, 1.0).otherwise(0.0))


def period_sets(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Aggregate over all dates (period ALL) and per calendar year."""
    dated = df.withColumn("_year", F.year("date").cast("string"))
    every, yearly = [F.col(k) for k in keys], [F.col(k) for k in [*keys, "_year"]]
    out = dated.groupingSets([every, yearly], *yearly).agg(*aggs)
    return out.withColumn("period", F.coalesce("_year", F.lit("ALL"))).drop("_year")


def rank_ic_daily(
    predictions: DataFrame, scores: list[str], *, keys: list[str] | None = None,
) -> DataFrame:
    """Rank correlation of score and target per model and date; undefined dates are left out."""
    keys = keys or []
    stacked = by_model(predictions, scores, [*keys, "date", "code", TARGET])
    ic = cross.rank_correlation(
        stacked, [*keys, "model", "date"], "score", TARGET
    )
    return ic.where(F.col("rank_ic").isNotNull())


def ic_summary(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, stability and hit rate of daily rank correlations."""
    return daily.groupBy(*keys).agg(
        F.avg("rank_ic").alias("mean_rank_ic"),
        ratio(F.avg("rank_ic"), F.stddev_samp("rank_ic")).alias("rank_ic_ir"),
        rate(F.col("rank_ic") > 0).alias("positive_rank_ic_rate"),
        F.count("rank_ic").alias("rebalance_dates"),
    )


def rank_ic_summary(
    predictions: DataFrame, scores: list[str], *, keys: list[str] | None = None,
) -> DataFrame:
    daily = rank_ic_daily(predictions, scores, keys=keys)
    return ic_summary(daily, [*(keys or []), "model"])


def _stack_features(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    present = [f for f in features if f in df.columns]
    slim = df.select(*keep, *[F.col(f).cast("double").alias(f) for f in present])
    return slim.unpivot(keep, present, "feature", "value")


def factor_report(df: DataFrame, features: list[str]) -> DataFrame:
    """Rank correlation of every feature with the target, annualised by twelve rebalances."""
    long = _stack_features(df, features, ["date", "code", TARGET])
    daily = cross.rank_correlation(long, ["feature", "date"], "value", TARGET)
    seen = long.groupBy("feature").agg(F.count("value").alias("observations"))
    summary = daily.where(F.col("rank_ic").isNotNull()).groupBy("feature").agg(
        F.avg("rank_ic").alias("mean_rank_ic"),
        F.stddev_samp("rank_ic").alias("rank_ic_std"),
        (ratio(F.avg("rank_ic"), F.stddev_samp("rank_ic")) * F.sqrt(F.lit(12.0)))
        .alias("rank_ic_ir_annualized"),
        rate(F.col("rank_ic") > 0).alias("positive_ic_rate"),
    )
    return seen.join(summary, "feature", "left")


def factor_year_report(df: DataFrame, features: list[str]) -> DataFrame:
    """Rank correlation of every feature by calendar year."""
    long = _stack_features(df, features, ["date", "code", TARGET]).withColumn(
        "feature", F.regexp_replace("feature", "_z$", "")
    )
    year = F.year("date").alias("year")
    daily = cross.rank_correlation(long, ["feature", "date"], "value", TARGET)
    summary = daily.where(F.col("rank_ic").isNotNull()).groupBy(year, "feature").agg(
        F.avg("rank_ic").alias("mean_rank_ic"),
        rate(F.col("rank_ic") > 0).alias("positive_ic_rate"),
        F.count("rank_ic").alias("rebalance_dates"),
    )
    seen = long.groupBy(year, "feature").agg(F.count("value").alias("observations"))
    return seen.join(summary, ["year", "feature"], "left").withColumn(
        "rebalance_dates", F.coalesce("rebalance_dates", F.lit(0))
    )


def segment_model_report(
    predictions: DataFrame, scores: list[str]
) -> DataFrame:
    """Score quality inside the LARGE and MID sub-universes, and of their top quintile."""
    named = predictions.withColumn("size_bucket", F.upper("size_bucket")).where(
        F.col("size_bucket").isin("LARGE", "MID")
    )
    stacked = by_model(named, scores, ["size_bucket", "date", "code", TARGET])
    cell = ["size_bucket", "model", "date"]
    ic = cross.rank_correlation(stacked, cell, "score", TARGET).drop("n")
    cut = cross.with_quantiles(stacked, cell, ["score"], [0.8])
    days = cut.groupBy(*cell).agg(
        F.avg(F.when(F.col("score") >= F.col("score__q0"), F.col(TARGET))).alias("top"),
        F.count(F.lit(1)).alias("rows"),
    )
    ratio_ic = ratio(F.avg("rank_ic"), F.stddev_samp("rank_ic"))
    return days.join(ic, cell, "left").groupBy("size_bucket", "model").agg(
        F.avg("rank_ic").alias("mean_rank_ic"),
        (ratio_ic * F.sqrt(F.lit(12.0))).alias("rank_ic_ir_annualized"),
        F.avg(F.when(F.col("rank_ic").isNotNull(), (F.col("rank_ic") > 0).cast("double")))
        .alias("positive_ic_rate"),
        F.avg("top").alias("mean_top_quintile_excess_return"),
        F.avg((F.col("top") > 0).cast("double")).alias("top_quintile_positive_rate"),
        F.count(F.lit(1)).alias("rebalance_dates"),
        F.sum("rows").alias("observations"),
    )


def select_top(
    predictions: DataFrame, scores: list[str], k: int, keep: list[str]
) -> DataFrame:
    """Stacked rows with `selected` for the top `k` of each model and date."""
    stacked = by_model(predictions, scores, ["date", "code", *keep])
    return cross.flag_top_k(stacked, "score", k, keys=("model", "date"))


def selection_report(predictions: DataFrame, scores: list[str], *, top_k: int) -> DataFrame:
    """Selected names against all others, over all dates and per year."""
    rows = select_top(predictions, scores, top_k, ["forward_return", TARGET])
    group = F.when(F.col("selected"), F.lit("selected")).otherwise(F.lit("not_selected"))
    daily = rows.groupBy("model", group.alias("group"), "date").agg(
        F.sum("forward_return").alias("fs"), F.count("forward_return").alias("fn"),
        F.sum(TARGET).alias("ts"), F.count(TARGET).alias("tn"),
        F.count_if(F.col(TARGET) > 0).alias("wins"), F.count(F.lit(1)).alias("n"),
    )
    return period_sets(
        daily, ["model", "group"],
        [
            ratio(F.sum("fs"), F.sum("fn")).alias("mean_forward_return"),
            ratio(F.sum("ts"), F.sum("tn")).alias("mean_excess_return"),
            ratio(F.sum("wins"), F.sum("n")).alias("positive_excess_rate"),
            F.sum("n").alias("observations"),
            F.count(F.lit(1)).alias("rebalance_dates"),
        ],
    )


def segment_attribution(predictions: DataFrame, scores: list[str], *, top_k: int) -> DataFrame:
    """Split the selected return over size buckets: share times mean, averaged over dates."""
    rows = select_top(predictions, scores, top_k, ["size_bucket", "forward_return", TARGET])
    daily = rows.where(F.col("selected") & F.col("size_bucket").isNotNull()).groupBy(
        "model", "date", "size_bucket"
    ).agg(
        F.count(F.lit(1)).alias("cnt"), F.avg("forward_return").alias("fwd"),
        F.avg(TARGET).alias("exc"),
    )
    # Selected names per date number at most top_k.
    whole = rows.where("selected").groupBy("model", "date").agg(F.count(F.lit(1)).alias("whole"))
    daily = daily.join(whole, ["model", "date"]).withColumn("share", F.col("cnt") / F.col("whole"))
    return period_sets(
        daily, ["model", "size_bucket"],
        [
            F.avg("cnt").alias("average_selected_count"),
            F.avg("share").alias("average_selected_share"),
            F.avg("fwd").alias("mean_forward_return"),
            F.avg("exc").alias("mean_excess_return"),
            F.avg(F.col("share") * F.col("fwd")).alias("average_forward_return_contribution"),
            F.avg(F.col("share") * F.col("exc")).alias("average_excess_return_contribution"),
            F.count(F.lit(1)).alias("rebalance_dates"),
        ],
    )


def market_regimes(
    benchmarks: DataFrame, key: str, *, lookback: int = 120, threshold: float = 0.10
) -> DataFrame:
    """Causal regime per date of one index: trailing return above, below or inside +-threshold.

    A null trailing return counts as SIDEWAYS. The last close of a date is kept when `_seq` tells
    the order; otherwise dates must be unique.
    """
    index = benchmarks.where(F.col("benchmark_key") == key)
    if "_seq" in index.columns:
        index = index.groupBy("benchmark_key", "date").agg(F.max_by("close", "_seq").alias("close"))
    w = Window.partitionBy("benchmark_key").orderBy("date")
    trailing = ratio("close", F.lag("close", lookback).over(w)) - 1.0
    return index.select("benchmark_key", "date", "close").withColumn(
        "trailing_return", trailing
    ).withColumn(
        "regime",
        F.when(F.col("trailing_return") > threshold, F.lit("BULL"))
        .when(F.col("trailing_return") < -threshold, F.lit("BEAR"))
        .otherwise(F.lit("SIDEWAYS")),
    )


def attach_regime(dates: DataFrame, regimes: DataFrame, key: str) -> DataFrame:
    """(date, trailing_return, regime) for each distinct date, as of the latest index date."""
    days = dates.select("date").distinct().withColumn("benchmark_key", F.lit(key))
    placed = asof.asof_backward(days, regimes, ["benchmark_key"], ["trailing_return", "regime"])
    return placed.where(F.col("regime").isNotNull()).drop("benchmark_key")


def market_regime_report(
    predictions: DataFrame, regimes: DataFrame, key: str, scores: list[str], *, top_k: int,
) -> DataFrame:
    """Rank correlation and top-k excess return of each model per market regime."""
    day = attach_regime(predictions, regimes, key)
    ic = rank_ic_daily(predictions, scores).select("model", "date", "rank_ic")
    picks = select_top(predictions, scores, top_k, [TARGET])
    daily = picks.groupBy("model", "date").agg(
        F.avg(F.when(F.col("selected"), F.col(TARGET))).alias("top"),
        F.count(F.lit(1)).alias("rows"),
    )
    # One row per date.
    joined = daily.join(F.broadcast(day), "date").join(ic, ["model", "date"], "left")
    weight = F.when(F.col("trailing_return").isNotNull(), F.col("rows"))
    return joined.groupBy("model", "regime").agg(
        ratio(F.sum(F.col("trailing_return") * F.col("rows")), F.sum(weight))
        .alias("mean_trailing_return"),
        F.avg("rank_ic").alias("mean_rank_ic"),
        F.avg((F.col("rank_ic") > 0).cast("double")).alias("positive_ic_rate"),
        F.avg("top").alias("selected_mean_excess_return"),
        rate(F.col("top") > 0).alias("selected_positive_rate"),
        F.count(F.lit(1)).alias("rebalance_dates"),
    )


def replacement_report(predictions: DataFrame, scores: list[str], *, top_k: int) -> DataFrame:
    """Mean excess return of names entering the top-k against names leaving it, per date."""
    places = splits.numbered_dates(predictions).select("date", "i")
    rows = select_top(predictions, scores, top_k, [TARGET]).join(F.broadcast(places), "date")
    before = rows.where("selected").select(
        "model", "code", (F.col("i") + 1).alias("i"), F.lit(True).alias("was")
    )
    moved = rows.join(before, ["model", "i", "code"], "left").where(F.col("i") > 0)
    was, now = F.coalesce("was", F.lit(False)), F.col("selected")
    entered, left = now & ~was, ~now & was
    report = moved.groupBy("date", "model").agg(
        F.count_if(entered).alias("entrants"),
        F.count_if(left).alias("observable_exits"),
        F.avg(F.when(entered, F.col(TARGET))).alias("entrant_mean_excess_return"),
        F.avg(F.when(left, F.col(TARGET))).alias("exit_mean_excess_return"),
    )
    return report.withColumn(
        "replacement_spread",
        F.col("entrant_mean_excess_return") - F.col("exit_mean_excess_return"),
    )


def selected_return_summary(
    predictions: DataFrame, scores: list[str], *, top_k: int
) -> DataFrame:
    """Mean excess return of selected names and of the remainder, per model."""
    rows = select_top(predictions, scores, top_k, [TARGET])
    picked = F.when(F.col("selected"), F.col(TARGET))
    rest = F.when(~F.col("selected"), F.col(TARGET))
    out = rows.groupBy("model").agg(
        F.avg(picked).alias("selected_mean_excess_return"),
        F.avg(rest).alias("remainder_mean_excess_return"),
        ratio(F.count_if(picked > 0), F.count_if(F.col("selected"))).alias(
            "selected_positive_rate"
        ),
    )
    return out.withColumn(
        "selection_spread",
        F.col("selected_mean_excess_return") - F.col("remainder_mean_excess_return"),
    )


def factor_ablation(
    test_rows: DataFrame, scenarios: dict[str, Column], sizes: dict[str, int],
    features: dict[str, int]
) -> DataFrame:
    """Compare the full model with models lacking one factor group.

    `scenarios` maps a name to its score, `sizes` a profile to its top-k, `features` a scenario to
    its number of features.
    """
    names = list(scenarios)
    columns = {f"{n}_score": expr for n, expr in scenarios.items()}
    scored = test_rows.select("date", "code", TARGET, *[e.alias(n) for n, e in columns.items()])
    out = rank_ic_summary(scored, list(columns))
    for profile, k in sizes.items():
        picked = selected_return_summary(scored, list(columns), top_k=k)
        out = out.join(
            picked.select(
                "model", *[F.col(c).alias(f"{profile}_{c}") for c in picked.columns if c != "model"]
            ),
            "model",
        )
    count = F.create_map(*[F.lit(x) for n in names for x in (n, features[n])])
    group = F.when(F.col("model") == "full_model", F.lit("none")).otherwise(
        F.regexp_replace("model", "^remove_", "")
    )
    return out.withColumns(
        {"removed_group": group, "remaining_features": count[F.col("model")]}
    ).withColumnRenamed("model", "scenario")
