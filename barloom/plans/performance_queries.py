"""Registered queries: NAV analytics and scenario tables."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from barloom.operators import evaluate, performance, pit, portfolio, scenarios
from barloom.plans import order_queries
from barloom.plans.data_queries import membership
from barloom.plans.market import SCORES, Market
from barloom.plans.report_queries import REGIME_INDEX, TOP_K
from barloom.registry import query
from barloom.session import durable

INITIAL = 1_000_000.0
KEYS = ["africa", "america", "asia", "europe", "middle_east"]


def aligned(m: Market):
    nav = m.view("navs").select("portfolio_id", "date", "nav")
    return performance.benchmark_nav(nav, m.view("benchmarks"), INITIAL)


def metrics(m: Market):
    return performance.performance_metrics(m.view("navs"), INITIAL)


def relative(m: Market):
    return performance.benchmark_metrics(aligned(m), INITIAL)


def annual(m: Market):
    return performance.annual_returns(performance.series(m.view("navs"), aligned(m)), INITIAL)


def execution(m: Market):
    return performance.execution_diagnostics(
        m.view("navs"), order_queries.executed(m), order_queries.rebalances(m), INITIAL
    )


def summary(m: Market):
    return performance.backtest_summary(metrics(m), relative(m), execution(m), KEYS)


@query("benchmark_nav", "portfolio_id date benchmark", "close benchmark_nav", 4)
def benchmark_nav(m: Market):
    return aligned(m)


METRICS = (
    "start_nav end_nav total_return annualized_return annualized_volatility sharpe_ratio "
    "max_drawdown calmar_ratio positive_day_rate"
)


@query("performance_metrics", "portfolio_id trading_days", METRICS, 5)
def performance_metrics(m: Market):
    return metrics(m)


@query(
    "benchmark_metrics", "portfolio_id benchmark start_date observations",
    "total_return annualized_return max_drawdown excess_total_return tracking_error "
    "information_ratio alpha_annualized beta correlation", 5,
)
def benchmark_metrics(m: Market):
    return relative(m)


@query("annual_returns", "portfolio_id year", "nav " + " ".join(KEYS), 5)
def annual_returns(m: Market):
    return performance.annual_return_table(annual(m), ["nav", *KEYS])


@query(
    "annual_excess", "portfolio_id year benchmark",
    "strategy_return benchmark_return excess_return", 5,
)
def annual_excess(m: Market):
    return performance.annual_excess(annual(m))


@query("drawdown_series", "portfolio_id date", "nav drawdown", 5)
def drawdown_series(m: Market):
    return performance.drawdown_series(m.view("navs"), INITIAL)


@query(
    "drawdown_episode", "portfolio_id peak_date trough_date recovery_date recovered",
    "peak_nav trough_nav max_drawdown", 5,
)
def drawdown_episode(m: Market):
    return performance.drawdown_episode(m.view("navs"), INITIAL)


@query(
    "regime_attribution", "portfolio_id regime trading_days",
    "mean_trailing_return mean_daily_return conditional_annualized_return positive_day_rate "
    "compounded_return_on_regime_days log_return_contribution share_of_total_log_return "
    "conditional_max_drawdown", 5,
)
def regime_attribution(m: Market):
    nav = m.view("navs")
    regimes = evaluate.market_regimes(m.view("benchmarks"), REGIME_INDEX)
    days = evaluate.attach_regime(nav, regimes, REGIME_INDEX)
    return performance.regime_attribution(nav, days, INITIAL)


@query("equal_weight_nav", "date", "benchmark_return universe_equal_weight_nav", 4)
def equal_weight_nav(m: Market):
    # The test prices jump by orders of magnitude; roots keep years of compounding finite.
    bars = m.bars.withColumn("close", 1000.0 + F.sqrt("close"))
    return performance.equal_weight_nav(
        pit.point_in_time_membership(bars, membership(m)), INITIAL
    )


@query("monthly_nav", "portfolio_id date", "normalized reference_normalized", 5)
def monthly_nav(m: Market):
    months = performance.monthly_nav(m.view("navs"), INITIAL)
    return performance.merge_monthly(months, "NATION_2")


@query(
    "execution_diagnostics", "portfolio_id filled_orders rejected_orders",
    "total_fees fees_as_initial_cash average_cash_weight maximum_cash_weight average_turnover "
    "average_entries average_exits", 5,
)
def execution_diagnostics(m: Market):
    return execution(m)


@query("rejection_report", "portfolio_id reason rejected_orders")
def rejection_report(m: Market):
    return performance.rejection_report(order_queries.executed(m))


@query(
    "backtest_summary", "portfolio_id trading_days filled_orders rejected_orders",
    METRICS + " total_fees median_turnover average_entries_after_initial "
    "average_exits_after_initial "
    + " ".join(f"{k}_{c}" for k in KEYS for c in performance.WIDE), 5,
)
def backtest_summary(m: Market):
    return summary(m)


# Every ranker with several book sizes, under several cost schedules.
RANKERS = {"baseline": "baseline_score", "momentum": "momentum_score"}
SIZES, COST_MULTIPLES, INVESTED = [3, 5, 8], [0.0, 1.0, 2.0], 0.98


def scenario_prices(m: Market):
    # The test prices jump by orders of magnitude; roots keep years of compounding finite.
    return m.bars.select("code", "date", (1000.0 + F.sqrt("close")).alias("close"))


def ranked_targets(m: Market):
    """Equal weights of the best names of each ranker, book size and cost multiple."""
    rankers = F.array(*[
        F.struct(F.lit(n).alias("model"), F.col(c).alias("score")) for n, c in RANKERS.items()
    ])
    stacked = m.predictions.select("date", "code", "industry", "tradable", F.inline(rankers))
    # A date's best names of each ranker; smaller books take the first of them.
    best = portfolio.top_k_quota(
        stacked.withColumn("date", F.struct("model", "date")), max(SIZES), 2
    ).select("date.model", "date.date", "code", "place")
    sized = best.withColumn("size", F.explode(F.array(*[F.lit(k) for k in SIZES]))).where(
        F.col("place") <= F.col("size")
    )
    chosen = sized.groupBy("model", "size", "date").agg(F.count(F.lit(1)).alias("chosen"))
    targets = sized.join(chosen, ["model", "size", "date"]).select(
        F.format_string("%s_top%d", "model", "size").alias("scenario"), "date", "code",
        (INVESTED / F.col("chosen")).alias("target_weight"),
    )
    return scenarios.with_rates(targets, order_queries.COSTS, COST_MULTIPLES)


def scenario_tables(m: Market):
    return m.fitted("scenario_runs", lambda: {
        name: durable(df) for name, df in
        scenarios.run(ranked_targets(m), scenario_prices(m), INITIAL, durable).items()
    })


def compared(m: Market, runs):
    """Headline figures of scenario runs, one row a scenario."""
    nav = runs["nav"]
    against = performance.benchmark_metrics(
        performance.benchmark_nav(nav.drop("cash"), m.view("benchmarks"), INITIAL), INITIAL
    )
    return performance.backtest_summary(
        performance.performance_metrics(nav, INITIAL), against,
        performance.execution_diagnostics(nav, runs["orders"], runs["rebalances"], INITIAL), KEYS,
    ).withColumnRenamed("portfolio_id", "scenario")


def results(m: Market):
    """Scenario runs by ranker; `setting` is what differs inside a ranker."""
    parts = F.split("scenario", "_", 2)
    return m.keep("scenario_results", lambda: compared(m, scenario_tables(m)).withColumns(
        {"profile": parts[0], "setting": parts[1]}
    ))


@query("scenario_nav", "portfolio_id date", "nav cash", 2)
def scenario_nav(m: Market):
    return scenario_tables(m)["nav"]


@query("scenario_turnover", "portfolio_id execution_date entered_count exited_count", "turnover", 6)
def scenario_turnover(m: Market):
    return scenario_tables(m)["rebalances"]


@query(
    "scenario_comparison", "scenario trading_days filled_orders rejected_orders",
    "end_nav:2 total_return annualized_return annualized_volatility sharpe_ratio max_drawdown "
    "average_turnover median_turnover total_fees:2 fees_as_initial_cash average_cash_weight "
    "average_entries average_exits asia_total_return "
    "asia_excess_total_return europe_total_return europe_excess_total_return", 5,
)
def scenario_comparison(m: Market):
    return results(m)


ROBUST = (
    " ".join(f"{c}_{s}" for c in performance.ROBUST_METRICS for s in ("min", "median", "max"))
    + " positive_return_rate " + " ".join(f"beat_{k}_rate" for k in KEYS)
)


@query("robustness_summary", "profile scenarios", ROBUST, 5)
def robustness_summary(m: Market):
    return performance.robustness_summary(results(m), KEYS)


@query("scenario_pivot", "setting", "baseline momentum", 5)
def scenario_pivot(m: Market):
    return performance.scenario_pivot(results(m), "setting", list(RANKERS), "total_return")


@query("sweep_robustness", "profile scenarios", ROBUST, 5)
def sweep_robustness(m: Market):
    """Every desk's outcomes over the parameter sweep: its monthly selections held and traded."""
    pairs = itertools.product(order_queries.GRID["exit_ranks"], order_queries.GRID["replacements"])
    grid = F.array(*[
        F.struct(F.lit(e).alias("exit_rank"), F.lit(r).alias("max_replacements")) for e, r in pairs
    ])
    held = m.desk_holdings
    chosen = portfolio.select_portfolios(
        order_queries.candidates(m),
        order_queries.books(m).select("portfolio_id", "date", F.inline(grid)),
        held, order_queries.POLICY, strict=False,
    ).where(F.col("status") == portfolio.SELECTED)
    named = chosen.withColumn(
        "scenario", F.format_string("exit%d_replace%d", "exit_rank", "max_replacements")
    ).select("scenario", "portfolio_id", "date", "code", "target_weight")
    targets = scenarios.banded(
        durable(named), held.select("portfolio_id", "date", "code", "weight"),
        order_queries.GRID["bands"], INVESTED,
    )
    rated = scenarios.with_rates(targets.drop("portfolio_id"), order_queries.COSTS, [1.0])
    runs = scenarios.run(rated, scenario_prices(m), INITIAL, durable)
    runs = {name: durable(df) for name, df in runs.items()}
    desk = F.substring_index("scenario", "/", 1)
    return performance.robustness_summary(
        durable(compared(m, runs).withColumn("profile", desk)), KEYS
    )


@query(
    "size_exposure", "portfolio_id size_bucket observations",
    "average_weight minimum_weight maximum_weight average_market_value", 4,
)
def size_exposure(m: Market):
    holdings = order_queries.customer_buckets(m)
    return performance.size_exposure(holdings, order_queries.customer_nav(m, holdings))


@query(
    "diagnostic_summary", "portfolio_id model filled_orders",
    "total_fees average_cash_weight selected_mean_excess_return mean_replacement_spread "
    "positive_replacement_rate", 5,
)
def diagnostic_summary(m: Market):
    selected = evaluate.selection_report(m.predictions, SCORES, top_k=TOP_K).where(
        (F.col("period") == "ALL") & (F.col("group") == "selected")
    ).select("model", F.col("mean_excess_return").alias("selected_mean_excess_return"))
    moves = evaluate.replacement_report(m.predictions, SCORES, top_k=TOP_K).groupBy("model").agg(
        F.avg("replacement_spread").alias("mean_replacement_spread"),
        evaluate.rate(F.col("replacement_spread") > 0).alias("positive_replacement_rate"),
    )
    # Each desk follows one of the two models, told by the parity of its name's length.
    model = F.when(F.length("portfolio_id") == 8, F.lit("baseline")).otherwise(F.lit("momentum"))
    return execution(m).withColumn("model", model).join(selected, "model", "left").join(
        moves, "model", "left"
    )
