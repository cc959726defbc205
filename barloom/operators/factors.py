"""Causal per-security factors and the tradable universe.

Everything that looks back along one security uses a single (code, date) partitioning: per-date
medians come back as a broadcast table with one row per date, so the second round of windows finds
the rows still partitioned and sorted. Per-date ranks come last.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import RAW_FEATURES, Research
from barloom.functions import asof, cross, rolling
from barloom.functions.scalars import finite, ratio
from barloom.schemas import BAR_REQUIRED, require_columns


def daily_returns(bars: DataFrame) -> DataFrame:
    """Add return_1, the median return of all securities on the date, and the residual."""
    slim = bars.select("code", "date", "close").withColumn("return_1", rolling.change("close"))
    market = cross.group_quantiles(slim, ["date"], ["return_1"], [0.5])
    market = market.withColumnRenamed("return_1__q0", "market_return")
    return (
        bars.withColumn("return_1", rolling.change("close"))
        .join(F.broadcast(market), "date", "left")
        .withColumn("residual_return", F.col("return_1") - F.col("market_return"))
    )


class Step(NamedTuple):
    """One factor family: row inputs, trailing-window aggregates of them, and the result."""

    inputs: dict[str, Column]
    frames: dict[str, rolling.Frame]
    result: dict[str, Column]


def _merged(layers) -> dict:
    return {name: value for part in layers for name, value in part.items()}


def apply(df: DataFrame, steps: list[Step]) -> DataFrame:
    """Add the results of several families with a single window pass for all their frames."""
    inputs, frames, result = (_merged(layer) for layer in zip(*steps))
    for merged in (inputs, {name: frame.over() for name, frame in frames.items()}, result):
        if merged:
            df = df.withColumns(merged)
    return df.drop(*inputs, *frames)


def apply_at(df: DataFrame, steps: list[Step], wanted: str) -> DataFrame:
    """`apply`, but only the rows where `wanted` holds come back, and frames are computed for these alone.

    `df` is as `rolling.frames_at` takes it, and so is the result, but for the rows left out.
    """
    inputs, frames, result = (_merged(layer) for layer in zip(*steps))
    framed = rolling.frames_at(df.withColumns(inputs), frames, wanted)
    return framed.withColumns(result).drop(*inputs, *frames)


def _momentum() -> Step:
    return Step(
        {},
        {},
        {
            "momentum_20_5": rolling.change("close", 5, 20),
            "momentum_60_5": rolling.change("close", 5, 60),
        },
    )


def _trend_quality(rows: int = 60) -> Step:
    """t-statistic of the slope of log price, 0 for a perfect fit.

    The regressor is the row number, so its centred sum of squares is a constant.
    """
    sxx = rows * (rows * rows - 1) / 12.0
    # On a full frame these are the centred sums; cheaper per row than the regr_ family.
    sxy, syy = F.col("_sxy") * rows, F.col("_syy") * rows
    rss = F.greatest(syy - sxy * sxy / sxx, F.lit(0.0))
    error = F.sqrt(rss / (rows - 2) / sxx)
    t = F.when(error == 0, F.lit(0.0)).otherwise(sxy / sxx / F.nullif(error, F.lit(0.0)))
    return Step(
        {
            "_x": F.row_number().over(rolling.by_code()).cast("double"),
            "_y": F.when(F.col("close") > 0, F.ln("close")),
        },
        {
            "_sxy": rolling.Frame(F.covar_pop, ("_y", "_x"), rows),
            "_syy": rolling.Frame(F.var_pop, ("_y",), rows),
            "_points": rolling.Frame(F.count, ("_y",), rows),
        },
        {f"trend_quality_{rows}": F.when(F.col("_points") == rows, t)},
    )


def _high_position(rows: int = 120) -> Step:
    """Distance of the close from its highest close."""
    return Step(
        {},
        {"_peak": rolling.gated(F.max, "close", rows, rows)},
        {f"high_position_{rows}": F.col("close") / F.col("_peak") - 1.0},
    )


def _reversal() -> Step:
    return Step(
        {},
        {"_drift": rolling.gated(F.sum, "residual_return", 5, 5)},
        {"reversal_5": -F.col("_drift")},
    )


def _risk() -> Step:
    """Volatility of the residual return, and of its negative part around zero."""
    loss = F.when(F.col("residual_return").isNotNull(), F.least("residual_return", F.lit(0.0)))
    return Step(
        {"_loss2": loss * loss},
        {
            "_vol": rolling.gated(F.stddev_samp, "residual_return", 60, 40),
            "_down": rolling.gated(F.avg, "_loss2", 60, 40),
        },
        {"idio_vol_60": F.col("_vol"), "downside_vol_60": F.sqrt("_down")},
    )


def _activity(source: str) -> Step:
    """Abnormal log activity."""
    floor = F.when(F.col(source).isNotNull(), F.greatest(F.col(source), F.lit(0.0)))
    return Step(
        {"_act": F.log1p(floor)},
        {
            "_act_mean": rolling.gated(F.avg, "_act", 20, 15),
            "_act_std": rolling.gated(F.stddev_samp, "_act", 20, 15),
        },
        {"volume_z20": ratio(F.col("_act") - F.col("_act_mean"), "_act_std")},
    )


def _confirmation() -> Step:
    """Agreement of abnormal activity with the direction of the residual return."""
    return Step(
        {"_signed": F.signum("residual_return") * F.col("volume_z20")},
        {"_agree": rolling.gated(F.avg, "_signed", 5, 3)},
        {"price_volume_confirmation_5": F.col("_agree")},
    )


def _clv() -> Step:
    """Mean position of the close inside the daily range, from -1 to 1."""
    place = ratio(2.0 * F.col("close") - F.col("high") - F.col("low"), F.col("high") - F.col("low"))
    return Step(
        {"_clv": place},
        {"_clv_mean": rolling.gated(F.avg, "_clv", 5, 3)},
        {"clv_5": F.col("_clv_mean")},
    )


def _median_amount() -> Step:
    """Median traded amount of the last 20 rows."""
    return Step(
        {},
        {"_amounts": rolling.Frame(rolling.last_values, ("amount",), 20)},
        {"median_amount_20": rolling.median_of("_amounts", 15)},
    )


def _liquidity() -> Step:
    """Median traded amount and mean price impact of the last 20 rows."""
    median = _median_amount()
    return Step(
        {
            "_impact": ratio(F.abs("return_1"), "amount") * 1_000_000.0,
        },
        {"_amihud": rolling.gated(F.avg, "_impact", 20, 15), **median.frames},
        {**median.result, "amihud_20": F.col("_amihud")},
    )


def add_momentum(df: DataFrame) -> DataFrame:
    """Price change from 20 (60) rows back to 5 rows back."""
    return apply(df, [_momentum()])


def add_trend_quality(df: DataFrame) -> DataFrame:
    return apply(df, [_trend_quality()])


def add_high_position(df: DataFrame) -> DataFrame:
    return apply(df, [_high_position()])


def add_reversal(df: DataFrame) -> DataFrame:
    return apply(df, [_reversal()])


def add_risk(df: DataFrame) -> DataFrame:
    return apply(df, [_risk()])


def add_activity(df: DataFrame) -> DataFrame:
    """Abnormal activity of turnover, else of volume, and its confirmation of the price."""
    source = "turnover" if "turnover" in df.columns else "volume"
    return apply(apply(df, [_activity(source)]), [_confirmation()])


def add_clv(df: DataFrame) -> DataFrame:
    return apply(df, [_clv()])


def add_liquidity(df: DataFrame) -> DataFrame:
    return apply(df, [_liquidity()])


def add_listing_days(df: DataFrame) -> DataFrame:
    return df.withColumn("listing_days", F.row_number().over(rolling.by_code()))


def time_series_factors(bars: DataFrame) -> DataFrame:
    """All look-back factors; the input rows with the factor columns added."""
    require_columns(bars, BAR_REQUIRED, "Bar table")
    return _look_back(add_listing_days(daily_returns(bars)))


def factors_on(bars: DataFrame, days: DataFrame) -> DataFrame:
    """`time_series_factors` on the dates of `days` alone.

    Their trailing frames are computed for these dates only, and for the rows just before, whose abnormal
    activity they need; returns, listing days and steps back by a number of rows run over all rows.
    """
    require_columns(bars, BAR_REQUIRED, "Bar table")
    df = add_listing_days(daily_returns(bars))
    # One row per date: bounded by sizing.MAX_DATES.
    flagged = df.join(F.broadcast(days.select("date").distinct().withColumn("_asks", F.lit(True))), "date", "left")
    numbered = flagged.withColumns({"_n": F.col("listing_days"), "_asks": F.coalesce("_asks", F.lit(False))})
    confirmation = _confirmation()
    reach = max(f.rows for f in confirmation.frames.values())
    near = F.bool_or("_asks").over(rolling.by_code().rowsBetween(0, reach - 1))
    ready = rolling.in_order(add_momentum(numbered.withColumn("_near", near)))
    active = apply_at(ready, [*_families(), _activity(_source(bars))], "_near")
    return _finite(apply_at(active, [confirmation], "_asks")).select(*_look_back(df).columns)


def latest_factors(bars: DataFrame) -> DataFrame:
    """`time_series_factors` on the latest date alone."""
    return factors_on(bars, bars.agg(F.max("date").alias("date")))


def _source(bars: DataFrame) -> str:
    return "turnover" if "turnover" in bars.columns else "volume"


def _families() -> list[Step]:
    return [_trend_quality(), _high_position(), _reversal(), _risk(), _clv(), _liquidity()]


def _finite(df: DataFrame) -> DataFrame:
    return df.withColumns({name: finite(name) for name in RAW_FEATURES})


def _look_back(df: DataFrame) -> DataFrame:
    return _finite(apply(apply(add_momentum(df), [*_families(), _activity(_source(df))]), [_confirmation()]))


def add_tradable(
    df: DataFrame,
    *,
    min_history_days: int = 120,
    min_liquidity_percentile: float = 0.20,
) -> DataFrame:
    """Add liquidity_percentile within the date, over all securities, and the tradable flag."""
    if not 0 <= min_liquidity_percentile < 1:
        raise ValueError("min_liquidity_percentile must be in [0, 1)")
    df = cross.percent_rank_average(
        df, ["date"], "median_amount_20", "liquidity_percentile"
    )
    return _flag_tradable(df, min_history_days, min_liquidity_percentile)


def _flag_tradable(df: DataFrame, min_history_days: int, min_liquidity_percentile: float) -> DataFrame:
    member = (
        F.coalesce(F.col("is_universe_member"), F.lit(False))
        if "is_universe_member" in df.columns
        else F.lit(True)
    )
    return df.withColumn(
        "tradable",
        F.coalesce(
            F.col("is_trading") & ~F.col("is_st") & member
            & (F.col("listing_days") >= min_history_days)
            & (F.col("median_amount_20") > 0)
            & (F.col("liquidity_percentile") > min_liquidity_percentile),
            F.lit(False),
        ),
    )


def raw_factors(
    bars: DataFrame, config: Research = Research()
) -> DataFrame:
    """Bars with every raw factor, the liquidity percentile and the tradable flag.

    As `add_tradable`, but only the traded amounts go through the ranks of a date: their percentiles come
    back to the bars by code and place, where the factors lie already, and no factor is moved.
    """
    placed = liquidity_percentiles(bars)
    met = asof.lists_beside(time_series_factors(bars), placed, ["code", "listing_days"], "_placed")
    percentile = F.get("_placed", F.lit(0))["liquidity_percentile"]
    return _flag_tradable(
        met.withColumn("liquidity_percentile", percentile).drop("_placed"),
        config.min_history_days, config.min_liquidity_percentile,
    )


def liquidity_percentiles(bars: DataFrame) -> DataFrame:
    """(code, listing_days, liquidity_percentile) of every bar, from its traded amounts alone."""
    slim = apply(add_listing_days(bars.select("code", "date", "amount")), [_median_amount()])
    ranked = cross.percent_rank_average(
        slim.select("code", "date", "listing_days", "median_amount_20"), ["date"], "median_amount_20",
        "liquidity_percentile",
    )
    return ranked.select("code", "listing_days", "liquidity_percentile")
