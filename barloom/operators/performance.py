"""NAV analytics of many portfolios at once.

NAV tables hold one row per (portfolio_id, date), so per-portfolio windows are bounded by the
calendar. Benchmarks stay long: one row per portfolio, benchmark and date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import cross
from barloom.functions.scalars import ratio, slug
from barloom.operators.evaluate import rate
from barloom.schemas import require_columns

YEAR_DAYS = 252.0


def _by_date(*keys: str):
    return Window.partitionBy(*keys).orderBy("date")


def _change(value: str, keys: list[str], start: Column) -> Column:
    """Return against the previous row, the first row against `start`."""
    return ratio(F.col(value), F.coalesce(F.lag(value).over(_by_date(*keys)), start)) - 1.0


def _drawdown(value: str, keys: list[str], start: Column) -> Column:
    """Distance from the running peak, the start value counting as a peak."""
    so_far = _by_date(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return F.col(value) / F.greatest(F.max(value).over(so_far), start) - 1.0


def filled_calendar(
    prices: DataFrame, keys: list[str], value: str, last_day: Column
) -> DataFrame:
    """One row per key and calendar day from the first price on, carrying the last price forward.

    Turns an as-of lookup into an equality join on (keys, date), which has no hot key even when
    very many rows ask for the same security.
    """
    following = F.lead("date").over(Window.partitionBy(*keys).orderBy("date"))
    until = F.coalesce(F.date_sub(following, 1), F.greatest(F.col("date"), last_day))
    return (
        prices.select(*keys, "date", value)
        .where(F.col(value).isNotNull())
        .withColumn("_until", until)
        .select(*keys, F.explode(F.sequence("date", "_until")).alias("date"), value)
    )


def add_returns(nav: DataFrame, initial: float) -> DataFrame:
    """Add `strategy_return`, `strategy_start` (the value it is measured from) and `drawdown`."""
    require_columns(nav, ["portfolio_id", "date", "nav"], "NAV table")
    start = F.coalesce(F.lag("nav").over(_by_date("portfolio_id")), F.lit(float(initial)))
    return nav.withColumn("strategy_start", start).withColumns(
        {
            "strategy_return": ratio("nav", "strategy_start") - 1.0,
            "drawdown": _drawdown("nav", ["portfolio_id"], F.lit(float(initial))),
        }
    )


def benchmark_nav(nav: DataFrame, benchmarks: DataFrame, initial: float) -> DataFrame:
    """Benchmarks on the portfolio's dates, scaled to its initial value.

    Each date takes the latest close not after it. The base is the last close before the first
    portfolio date, else the first aligned close. Dates before a benchmark starts are left out.
    """
    require_columns(benchmarks, ["date", "benchmark_key", "close"], "Benchmark data")
    last = nav.agg(F.max("date")).scalar()
    closes = filled_calendar(benchmarks, ["benchmark_key"], "close", last).withColumn(
        "benchmark", slug("benchmark_key")
    ).drop("benchmark_key")
    first = nav.groupBy("portfolio_id").agg(F.date_sub(F.min("date"), 1).alias("date"))
    base = first.join(closes, "date").select(
        "portfolio_id", "benchmark", F.col("close").alias("_prior")
    )
    aligned = add_returns(nav, initial).join(closes, "date").join(
        base, ["portfolio_id", "benchmark"], "left"
    )
    opening = F.first("close").over(_by_date("portfolio_id", "benchmark"))
    return aligned.withColumn(
        "benchmark_nav", ratio("close", F.coalesce("_prior", opening)) * float(initial)
    ).select(
        *nav.columns, "strategy_start", "strategy_return", "benchmark", "close", "benchmark_nav"
    )


def _sharpe(x: str) -> Column:
    mean, std = F.avg(x), F.stddev_samp(x)
    return F.coalesce(ratio(mean, std) * F.sqrt(F.lit(YEAR_DAYS)), F.lit(0.0))


def performance_metrics(nav: DataFrame, initial: float) -> DataFrame:
    """Return, risk and drawdown of each portfolio."""
    start = float(initial)
    base = add_returns(nav, initial).groupBy("portfolio_id").agg(
        F.max_by("nav", "date").alias("end_nav"),
        F.count(F.lit(1)).alias("trading_days"),
        F.coalesce(F.stddev_samp("strategy_return"), F.lit(0.0)).alias("_std"),
        _sharpe("strategy_return").alias("sharpe_ratio"),
        F.least(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"),
        rate(F.col("strategy_return") > 0).alias("positive_day_rate"),
    )
    growth = F.col("end_nav") / start
    out = base.withColumns(
        {
            "start_nav": F.lit(start),
            "total_return": growth - 1.0,
            "annualized_return": F.pow(growth, F.lit(YEAR_DAYS) / F.col("trading_days")) - 1.0,
            "annualized_volatility": F.col("_std") * F.sqrt(F.lit(YEAR_DAYS)),
        }
    )
    calmar = F.when(
        F.col("max_drawdown") < 0, F.col("annualized_return") / F.abs("max_drawdown")
    ).otherwise(F.lit(0.0))
    return out.withColumn("calmar_ratio", calmar).drop("_std")


def benchmark_metrics(aligned: DataFrame, initial: float) -> DataFrame:
    """Relative performance of each portfolio against each benchmark."""
    start, keys = F.lit(float(initial)), ["portfolio_id", "benchmark"]
    rows = aligned.withColumns(
        {
            "_b": _change("benchmark_nav", keys, start),
            "_dd": _drawdown("benchmark_nav", keys, start),
        }
    ).withColumn("_a", F.col("strategy_return") - F.col("_b"))
    s, b = F.col("strategy_return"), F.col("_b")
    year = F.sqrt(F.lit(YEAR_DAYS))
    stats = rows.groupBy(*keys).agg(
        F.min("date").alias("start_date"), F.count(F.lit(1)).alias("observations"),
        (F.max_by("benchmark_nav", "date") / start - 1.0).alias("total_return"),
        (F.max_by("nav", "date") / F.min_by("strategy_start", "date") - 1.0).alias("_strategy"),
        F.least(F.min("_dd"), F.lit(0.0)).alias("max_drawdown"),
        (F.stddev_samp("_a") * year).alias("tracking_error"),
        _sharpe("_a").alias("information_ratio"),
        F.covar_samp(s, b).alias("_cov"), F.var_samp(b).alias("_var"),
        F.avg(s).alias("_ms"), F.avg(b).alias("_mb"),
        ratio(F.regr_sxy(s, b), F.sqrt(F.regr_sxx(s, b) * F.regr_syy(s, b))).alias("_corr"),
    )
    beta = F.when(F.col("_var") > 1e-12, F.col("_cov") / F.nullif(F.col("_var"), F.lit(0.0)))
    out = stats.withColumn("beta", F.coalesce(beta, F.lit(0.0))).withColumns(
        {
            "annualized_return": F.pow(
                1.0 + F.col("total_return"), F.lit(YEAR_DAYS) / F.col("observations")
            ) - 1.0,
            "excess_total_return": F.col("_strategy") - F.col("total_return"),
            "alpha_annualized": (F.col("_ms") - F.col("beta") * F.col("_mb")) * YEAR_DAYS,
            "correlation": F.when(F.col("observations") > 1, F.col("_corr"))
            .otherwise(F.lit(0.0)),
        }
    )
    return out.drop("_cov", "_var", "_ms", "_mb", "_corr", "_strategy")


def series(nav: DataFrame, aligned: DataFrame) -> DataFrame:
    """Portfolio and benchmark values stacked as (portfolio_id, series, date, value)."""
    own = nav.select("portfolio_id", F.lit("nav").alias("series"), "date",
                     F.col("nav").alias("value"))
    return own.unionByName(
        aligned.select("portfolio_id", F.col("benchmark").alias("series"), "date",
                       F.col("benchmark_nav").alias("value"))
    )


def annual_returns(stacked: DataFrame, initial: float) -> DataFrame:
    """Compounded return per portfolio, series and calendar year."""
    keys = ["portfolio_id", "series"]
    r = _change("value", keys, F.lit(float(initial)))
    return stacked.withColumn("_r", r).groupBy(*keys, F.year("date").alias("year")).agg(
        (F.product(1.0 + F.col("_r")) - 1.0).alias("annual_return")
    )


def annual_return_table(annual: DataFrame, names: list[str]) -> DataFrame:
    """One column per series; `names` lists them so no extra job looks them up."""
    return annual.groupBy("portfolio_id", "year").pivot("series", names).agg(
        F.first("annual_return")
    )


def annual_excess(annual: DataFrame) -> DataFrame:
    """Annual return against each benchmark."""
    own = annual.where(F.col("series") == "nav").select(
        "portfolio_id", "year", F.col("annual_return").alias("strategy_return")
    )
    other = annual.where(F.col("series") != "nav").select(
        "portfolio_id", "year", F.col("series").alias("benchmark"),
        F.col("annual_return").alias("benchmark_return"),
    )
    return own.join(other, ["portfolio_id", "year"]).withColumn(
        "excess_return", F.col("strategy_return") - F.col("benchmark_return")
    )


def execution_diagnostics(
    nav: DataFrame, orders: DataFrame, rebalances: DataFrame, initial: float
) -> DataFrame:
    """Fees, fills, cash share and turnover of each portfolio."""
    money = nav.withColumn("_w", ratio("cash", "nav")).groupBy("portfolio_id").agg(
        F.avg("_w").alias("average_cash_weight"), F.max("_w").alias("maximum_cash_weight")
    )
    traded = orders.groupBy("portfolio_id").agg(
        F.sum("fees").alias("total_fees"),
        F.count_if(F.col("filled_quantity") > 0).alias("filled_orders"),
        F.count_if(F.col("filled_quantity") == 0).alias("rejected_orders"),
    )
    turns = rebalances.withColumn(
        "_i", F.row_number().over(Window.partitionBy("portfolio_id").orderBy("execution_date"))
    ).groupBy("portfolio_id").agg(
        F.avg("turnover").alias("average_turnover"),
        F.percentile("turnover", F.lit(0.5)).alias("median_turnover"),
        F.avg("entered_count").alias("average_entries"),
        F.avg("exited_count").alias("average_exits"),
        F.avg(F.when(F.col("_i") > 1, F.col("entered_count")))
        .alias("average_entries_after_initial"),
        F.avg(F.when(F.col("_i") > 1, F.col("exited_count"))).alias("average_exits_after_initial"),
    )
    out = money.join(traded, "portfolio_id", "left").join(turns, "portfolio_id", "left")
    return out.withColumns(
        {
            "total_fees": F.coalesce("total_fees", F.lit(0.0)),
            "filled_orders": F.coalesce("filled_orders", F.lit(0)),
            "rejected_orders": F.coalesce("rejected_orders", F.lit(0)),
        }
    ).withColumn("fees_as_initial_cash", F.col("total_fees") / float(initial))


def rejection_report(orders: DataFrame) -> DataFrame:
    """Rejected orders by reason."""
    reason = F.coalesce("reason", F.lit("UNKNOWN"))
    return orders.where(F.col("filled_quantity") == 0).groupBy(
        "portfolio_id", reason.alias("reason")
    ).agg(F.count(F.lit(1)).alias("rejected_orders"))


WIDE = ["total_return", "excess_total_return", "alpha_annualized", "beta"]


def backtest_summary(
    metrics: DataFrame, relative: DataFrame, execution: DataFrame, benchmarks: list[str]
) -> DataFrame:
    """Metrics, execution and, per benchmark, its main relative figures as columns."""
    wide = relative.groupBy("portfolio_id").agg(
        *[
            F.max(F.when(F.col("benchmark") == b, F.col(c))).alias(f"{b}_{c}")
            for b in benchmarks for c in WIDE
        ]
    )
    return metrics.join(execution, "portfolio_id", "left").join(wide, "portfolio_id", "left")


# Outcomes whose distribution the robustness table describes.
ROBUST_METRICS = [
    "total_return", "annualized_return", "sharpe_ratio", "max_drawdown", "average_turnover",
    "fees_as_initial_cash",
]


def robustness_summary(
    results: DataFrame, benchmarks: list[str]
) -> DataFrame:
    """Lowest, median and highest outcome over the scenarios of each profile, and beat rates."""
    medians = cross.group_quantiles(results, ["profile"], ROBUST_METRICS, [0.5])
    aggs = [F.count(F.lit(1)).alias("scenarios")]
    for m in ROBUST_METRICS:
        aggs += [F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    aggs.append(rate(F.col("total_return") > 0).alias("positive_return_rate"))
    aggs += [
        rate(F.col(f"{b}_excess_total_return") > 0).alias(f"beat_{b}_rate") for b in benchmarks
    ]
    return results.groupBy("profile").agg(*aggs).join(
        medians.withColumnsRenamed({f"{m}__q0": f"{m}_median" for m in ROBUST_METRICS}), "profile"
    )


def drawdown_series(nav: DataFrame, initial: float) -> DataFrame:
    return add_returns(nav, initial).select("portfolio_id", "date", "nav", "drawdown")


def drawdown_episode(nav: DataFrame, initial: float) -> DataFrame:
    """Peak, trough and recovery of the deepest drawdown.

    The initial value counts as a peak on the day before the first date. Peak and trough are the
    earliest dates with their value.
    """
    slim = nav.select("portfolio_id", "date", "nav")
    first = slim.groupBy("portfolio_id").agg(F.date_sub(F.min("date"), 1).alias("date"))
    rows = slim.unionByName(first.withColumn("nav", F.lit(float(initial))))
    so_far = _by_date("portfolio_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_peak", F.max("nav").over(so_far)).withColumn(
        "_dd", F.col("nav") / F.col("_peak") - 1.0
    )
    whole = Window.partitionBy("portfolio_id")
    worst = F.min_by(F.struct("date", "nav", "_peak", "_dd"), F.struct("_dd", "date")).over(whole)
    rows = rows.withColumn("_worst", worst)
    at = F.col("_worst.date")
    on_peak = (F.col("date") <= at) & (F.col("nav") == F.col("_worst._peak"))
    back = (F.col("date") > at) & (F.col("nav") >= F.col("_worst._peak"))
    out = rows.groupBy("portfolio_id").agg(
        F.min(F.when(on_peak, F.col("date"))).alias("peak_date"),
        F.first("_worst").alias("_worst"),
        F.min(F.when(back, F.col("date"))).alias("recovery_date"),
    )
    return out.select(
        "portfolio_id", "peak_date", F.col("_worst._peak").alias("peak_nav"),
        F.col("_worst.date").alias("trough_date"), F.col("_worst.nav").alias("trough_nav"),
        F.col("_worst._dd").alias("max_drawdown"), "recovery_date",
        F.col("recovery_date").isNotNull().alias("recovered"),
    )


def regime_attribution(nav: DataFrame, days: DataFrame, initial: float) -> DataFrame:
    """Split each portfolio's return over market regimes; `days` holds one regime per date."""
    # One row per date.
    rows = add_returns(nav, initial).join(F.broadcast(days), "date")
    rows = rows.where(F.col("strategy_return").isNotNull())
    w = Window.partitionBy("portfolio_id", "regime").orderBy("date").rowsBetween(
        Window.unboundedPreceding, 0
    )
    rows = rows.withColumn("_c", F.product(1.0 + F.col("strategy_return")).over(w))
    rows = rows.withColumn("_dd", F.col("_c") / F.max("_c").over(w) - 1.0)
    r = F.col("strategy_return")
    parts = rows.groupBy("portfolio_id", "regime").agg(
        F.count(F.lit(1)).alias("trading_days"),
        F.avg("trailing_return").alias("mean_trailing_return"),
        F.avg(r).alias("mean_daily_return"),
        rate(r > 0).alias("positive_day_rate"),
        (F.max_by("_c", "date") - 1.0).alias("compounded_return_on_regime_days"),
        F.sum(F.log1p(r)).alias("log_return_contribution"),
        F.min("_dd").alias("conditional_max_drawdown"),
    )
    # The whole-period log return uses every date, with or without a regime.
    total = add_returns(nav, initial).groupBy("portfolio_id").agg(
        F.sum(F.log1p("strategy_return")).alias("_total")
    )
    share = F.when(
        F.abs("_total") > 1e-12, F.col("log_return_contribution") / F.nullif("_total", F.lit(0.0))
    )
    return parts.join(total, "portfolio_id").withColumns(
        {
            "conditional_annualized_return": F.pow(
                1.0 + F.col("mean_daily_return"), F.lit(YEAR_DAYS)
            ) - 1.0,
            "share_of_total_log_return": share,
        }
    ).drop("_total")


def size_exposure(positions: DataFrame, nav: DataFrame) -> DataFrame:
    """Weight of each size bucket over time, per portfolio."""
    daily = positions.groupBy("portfolio_id", "date", "size_bucket").agg(
        F.sum("market_value").alias("market_value")
    )
    weighted = daily.join(nav.select("portfolio_id", "date", "nav"), ["portfolio_id", "date"],
                          "left").withColumn("_w", ratio("market_value", "nav"))
    return weighted.groupBy("portfolio_id", "size_bucket").agg(
        F.avg("_w").alias("average_weight"), F.min("_w").alias("minimum_weight"),
        F.max("_w").alias("maximum_weight"), F.avg("market_value").alias("average_market_value"),
        F.count(F.lit(1)).alias("observations"),
    )


def equal_weight_nav(bars: DataFrame, initial: float) -> DataFrame:
    """Compounded mean return of member securities per date."""
    w = Window.partitionBy("code").orderBy("date")
    rows = bars.withColumn("_r", ratio("close", F.lag("close").over(w)) - 1.0)
    if "is_universe_member" in bars.columns:
        rows = rows.where(F.coalesce("is_universe_member", F.lit(False)))
    daily = rows.groupBy("date").agg(F.coalesce(F.avg("_r"), F.lit(0.0)).alias("benchmark_return"))
    # One row per date: bounded by sizing.MAX_DATES.
    so_far = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(
        Window.unboundedPreceding, 0
    )
    growth = F.product(1.0 + F.col("benchmark_return")).over(so_far)
    return daily.withColumn("universe_equal_weight_nav", growth * float(initial))


def monthly_nav(nav: DataFrame, initial: float) -> DataFrame:
    """Last NAV of each month, rebased to 100 and dated to the calendar month end."""
    return nav.groupBy("portfolio_id", F.last_day("date").alias("date")).agg(
        (F.max_by("nav", "date") / float(initial) * 100.0).alias("normalized")
    )


def merge_monthly(months: DataFrame, against: str) -> DataFrame:
    """Months that a portfolio shares with the portfolio `against`, side by side."""
    other = months.where(F.col("portfolio_id") == against).select(
        "date", F.col("normalized").alias("reference_normalized")
    )
    # One row per month.
    return months.join(F.broadcast(other), "date")


def scenario_pivot(
    results: DataFrame, index: str, profiles: list[str], value: str
) -> DataFrame:
    """Scenarios as rows, profiles as columns, mean of `value`."""
    return results.groupBy(index).agg(
        *[F.avg(F.when(F.col("profile") == p, F.col(value))).alias(p) for p in profiles]
    )
