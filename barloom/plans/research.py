"""The research pipeline: bars to labelled, standardised and scored month-end cross-sections."""

from __future__ import annotations

from pyspark.sql import DataFrame

from barloom.config import MODEL_FEATURES, Research
from barloom.operators import factors, labels, preprocess
from barloom.session import durable


def month_end_frame(
    panel: DataFrame, config: Research = Research()
) -> DataFrame:
    """Factors, labels and the tradable flag on the last date of each month.

    Look-aheads, returns and short look-backs run over all bars in one partitioning by code. Only the
    month-end rows, a few percent, get the long look-backs and go through the per-date ranks, which read
    nothing but their own date.
    """
    ahead = labels.forward_prices(panel, config.horizon_days)
    sampled = factors.factors_on(ahead, labels.month_ends(panel))
    flagged = factors.add_tradable(
        sampled,
        min_history_days=config.min_history_days,
        min_liquidity_percentile=config.min_liquidity_percentile,
    )
    # The ranks of liquidity were written, and nothing has moved rows since.
    return labels.rank_targets(flagged, written=True)


def research_dataset(
    frame: DataFrame, config: Research = Research()
) -> DataFrame:
    """Tradable month-end rows with complete standardised features and labels.

    `frame` is the materialised result of `month_end_frame`; it is read once per statistics pass.
    """
    ready = preprocess.standardize(
        frame.where("tradable"), lower=config.winsor_lower, upper=config.winsor_upper, cut=durable,
    )
    return ready.dropna(subset=[*MODEL_FEATURES, "target_rank", "label_end_date"])


def latest_cross_section(
    panel: DataFrame, config: Research = Research()
) -> DataFrame:
    """Standardised tradable rows of the latest date of all bars, labels not needed."""
    flagged = factors.add_tradable(
        factors.latest_factors(panel), min_history_days=config.min_history_days,
        min_liquidity_percentile=config.min_liquidity_percentile,
    )
    return preprocess.standardize(
        durable(flagged.where("tradable")),
        lower=config.winsor_lower, upper=config.winsor_upper, cut=durable,
    )
