"""Registered queries: factors, labels, standardisation, splits and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.config import MODEL_FEATURES, RAW_FEATURES
from barloom.functions import cross
from barloom.operators import factors, labels, preprocess, scoring, splits
from barloom.plans import research
from barloom.plans.market import Market
from barloom.registry import query
from barloom.session import durable

FOLDS = {"train_months": 24, "validation_months": 6, "test_months": 6}
TOP_K = 5
Z = " ".join(MODEL_FEATURES)


@query("daily_returns", "date code", "return_1 market_return residual_return")
def daily_returns(m: Market):
    return factors.daily_returns(m.bars)


@query("momentum_factors", "date code", "momentum_20_5 momentum_60_5")
def momentum_factors(m: Market):
    return factors.add_momentum(m.bars)


@query("trend_quality", "date code", "trend_quality_60", 5)
def trend_quality(m: Market):
    return factors.add_trend_quality(m.bars)


@query("reversal_factor", "date code", "reversal_5")
def reversal_factor(m: Market):
    return factors.add_reversal(factors.daily_returns(m.bars))


@query("high_position", "date code", "high_position_120")
def high_position(m: Market):
    return factors.add_high_position(m.bars)


@query("risk_factors", "date code", "idio_vol_60 downside_vol_60")
def risk_factors(m: Market):
    return factors.add_risk(factors.daily_returns(m.bars))


@query("activity_factors", "date code", "volume_z20 price_volume_confirmation_5")
def activity_factors(m: Market):
    return factors.add_activity(factors.daily_returns(m.bars))


@query("clv_factor", "date code", "clv_5")
def clv_factor(m: Market):
    return factors.add_clv(m.bars)


@query("liquidity_factors", "date code", "median_amount_20 liquidity_percentile amihud_20", 4)
def liquidity_factors(m: Market):
    returns = m.bars.withColumn("return_1", factors.rolling.change("close"))
    return cross.percent_rank_average(
        factors.add_liquidity(returns), ["date"], "median_amount_20", "liquidity_percentile",
    )


@query("tradable_universe", "date code listing_days tradable")
def tradable_universe(m: Market):
    returns = m.panel.withColumn("return_1", factors.rolling.change("close"))
    listed = factors.add_listing_days(factors.add_liquidity(returns))
    return factors.add_tradable(listed)


@query("raw_factors", "date code listing_days tradable", " ".join(RAW_FEATURES), 5)
def raw_factors(m: Market):
    return factors.raw_factors(m.panel)


@query(
    "forward_labels", "date code label_end_date relevance",
    "forward_return benchmark_forward_return target_excess_return target_rank",
)
def forward_labels(m: Market):
    return labels.forward_labels(m.bars, 20)


@query("month_end_sample", "date code", "open high low close volume amount", 8)
def month_end_sample(m: Market):
    return labels.sample_month_ends(m.bars)


def _z_columns(m: Market):
    df = m.month_end.where("tradable")
    return df.withColumns({f"{f}_z": F.col(f) for f in RAW_FEATURES})


@query("winsorize", "date code", Z, 5)
def winsorize(m: Market):
    return preprocess.winsorize(_z_columns(m), MODEL_FEATURES, 0.01, 0.99)


@query("neutralize", "date code", Z, 5)
def neutralize(m: Market):
    df = preprocess.winsorize(_z_columns(m), MODEL_FEATURES, 0.01, 0.99)
    gate = preprocess.industry_gate(m.month_end.where("tradable"))
    df = preprocess.demean_industry(df, MODEL_FEATURES, gate)
    return preprocess.neutralize_size(df, MODEL_FEATURES)


@query("robust_zscore", "date code", "z")
def robust_zscore(m: Market):
    df = m.month_end.select("date", "code", F.col("momentum_60_5").alias("z"))
    return preprocess.robust_zscore(df, ["z"])


@query("standardized_factors", "date code", Z, 5)
def standardized_factors(m: Market):
    return preprocess.standardize(m.month_end.where("tradable"), cut=durable)


@query(
    "research_dataset", "date code industry size_bucket label_end_date relevance",
    f"forward_return target_excess_return target_rank {Z}", 5,
)
def research_dataset(m: Market):
    return research.research_dataset(m.month_end)


@query("purged_split", "date code split")
def purged_split(m: Market):
    return splits.purged_split(m.predictions, keep_purged=True)


@query("walk_forward_folds", "fold_id split date code")
def walk_forward_folds(m: Market):
    return splits.walk_forward_folds(m.predictions, **FOLDS)


@query(
    "fold_summary",
    "fold_id train_start train_end effective_train_end_after_purge validation_start validation_end "
    "effective_validation_end_after_purge test_start test_end train_rows validation_rows test_rows",
)
def fold_summary(m: Market):
    return splits.fold_summary(m.predictions, **FOLDS)


def test_rows(m: Market):
    """Out-of-sample predictions of all folds."""
    return splits.walk_forward_folds(m.predictions, **FOLDS).where(F.col("split") == "test")


@query("fold_overlap", "predictions keys overlapping")
def fold_overlap(m: Market):
    return splits.fold_overlap(test_rows(m))


@query("baseline_scores", "date code", "baseline_score momentum_score", 5)
def baseline_scores(m: Market):
    return m.predictions


@query("walk_forward_scores", "fold_id date code", "baseline_score", 5)
def walk_forward_scores(m: Market):
    return test_rows(m)


@query("score_ranks", "date code baseline_rank momentum_rank")
def score_ranks(m: Market):
    slim = m.predictions.select("date", "code", "baseline_score", "momentum_score")
    first = scoring.add_rank(slim, "baseline_score", "baseline_rank")
    return scoring.add_rank(first, "momentum_score", "momentum_rank")


@query("top_k_per_date", "date code rank", "baseline_score", 5)
def top_k_per_date(m: Market):
    slim = m.predictions.select("date", "code", "baseline_score")
    return cross.top_k(slim, ["date"], [F.col("baseline_score").desc(), F.col("code")], TOP_K)


@query(
    "score_reasons", "date code baseline_reason_1 baseline_reason_2",
    " ".join(f"{f}_contribution" for f in MODEL_FEATURES), 5,
)
def score_reasons(m: Market):
    return scoring.contributions(scoring.add_reasons(m.predictions))


@query(
    "latest_scores",
    "date code security_name size_bucket industry baseline_rank baseline_reason_1 "
    "baseline_reason_2",
    "baseline_score " + " ".join(RAW_FEATURES), 5,
)
def latest_scores(m: Market):
    last = research.latest_cross_section(m.panel)
    return scoring.latest_scores(last)
