"""Registered queries: selection, orders, fills and ledgers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from barloom.config import Costs, Portfolio
from barloom.functions import rolling
from barloom.functions.scalars import with_venue
from barloom.operators import assemble, models, orders, portfolio, scoring, splits
from barloom.plans import research
from barloom.plans.data_queries import actions
from barloom.plans.market import Market
from barloom.plans.research_queries import FOLDS, TOP_K
from barloom.registry import query
from barloom.session import durable

COSTS = Costs()
# Small lots and a wide cap, because the test securities trade some 25 units a day.
EXECUTION = Portfolio(default_lot_size=1, max_participation_rate=0.5)
POLICY = Portfolio(
    top_k=TOP_K, entry_rank=5, exit_rank=8, max_stock_weight=0.30, max_industry_weight=0.40,
    max_replacements_per_rebalance=2, min_replacement_rank_improvement=1,
    weighting_method="inverse_volatility",
)
INITIAL = 1_000_000.0
GRID = {"exit_ranks": [6, 8, 10], "replacements": [1, 2], "bands": [0.05, 0.10, 0.20]}


def limited_bars(m: Market):
    """Bars with daily price limits."""
    bars = with_venue(m.panel).withColumns(
        {
            "preclose": F.lag("close").over(rolling.by_code()),
            "status_is_point_in_time": F.lit(True), "lot_size": F.lit(1),
        }
    )
    return assemble.add_price_limits(bars)


# What the ledger keeps of an order: the market fields it was checked against stay in the bars.
LEDGER = [
    "portfolio_id", "date", "code", "side", "quantity", "filled_quantity", "price", "notional", "fees",
    "status", "reason",
]


def execute(m: Market):
    return orders.order_feasibility(m.view("desk_requests"), limited_bars(m), EXECUTION, COSTS)


def executed(m: Market):
    """The order ledger as landed in storage."""
    return m.keep("executed", lambda: execute(m).select(*LEDGER), by="code")


def desk_fills(m: Market):
    return executed(m).where(F.col("filled_quantity") > 0).select(
        "portfolio_id", "date", "code", "side", F.col("filled_quantity").alias("quantity"), "price"
    )


def buckets(m: Market):
    return m.view("master").select("code", "size_bucket")


def rebalances(m: Market):
    spans = orders.position_spans(orders.daily_flows(desk_fills(m), COSTS))
    opening = m.view("navs").select("portfolio_id", "date", F.col("nav").alias("open_value"))
    return orders.rebalance_summary(
        executed(m), orders.membership_changes(spans), opening, buckets(m)
    )


def customer_flows(m: Market):
    return m.keep("flows", lambda: orders.daily_flows(m.view("fills"), COSTS))


def customer_positions(m: Market):
    """The position ledger, a row per portfolio, trading date and security held; never written whole."""
    flows = customer_flows(m)
    valuation = flows.select("portfolio_id", "date")
    return orders.positions(orders.position_spans(flows), valuation, m.bars, buckets(m))


def customer_buckets(m: Market):
    """The ledger's value per portfolio, date and size bucket, as landed in storage."""
    return m.keep("bucket_values", lambda: customer_positions(m).groupBy("portfolio_id", "date", "size_bucket").agg(
        F.sum("market_value").alias("market_value")
    ))


def customer_nav(m: Market, holdings):
    return orders.ledger_nav(customer_flows(m), holdings, INITIAL)


def candidates(m: Market):
    return m.predictions.select(
        "date", "code", F.col("baseline_score").alias("score"), "industry", "size_bucket",
        "tradable", "idio_vol_60",
    )


def universe(m: Market):
    """All month-end securities ranked by momentum, tradable or not."""
    return m.month_end.where(F.col("momentum_60_5").isNotNull()).select(
        "date", "code", F.col("momentum_60_5").alias("score"), "industry", "size_bucket",
        "tradable", "idio_vol_60",
    )


@query("order_fees", "portfolio_id side fills", "notional fees", 2)
def order_fees(m: Market):
    notional = F.col("quantity") * F.col("price")
    priced = m.view("fills").withColumns(
        {"notional": notional, "fees": orders.fee(notional, F.col("side"), COSTS)}
    )
    return priced.groupBy("portfolio_id", "side").agg(
        F.count(F.lit(1)).alias("fills"), F.sum("notional").alias("notional"),
        F.sum("fees").alias("fees"),
    )


@query(
    "order_feasibility", "portfolio_id date code side quantity filled_quantity status reason",
    "price notional fees", 5,
)
def order_feasibility(m: Market):
    return execute(m)


@query("order_priority", "portfolio_id date code side priority")
def order_priority(m: Market):
    return orders.order_priority(m.view("desk_requests"))


@query("signal_schedule", "signal_date execution_date code", "score", 5)
def signal_schedule(m: Market):
    return orders.schedule_signals(candidates(m), m.bars)


@query("execution_candidates", "signal_date execution_date code tradable", "score", 5)
def execution_candidates(m: Market):
    return orders.execution_candidates(orders.schedule_signals(candidates(m), m.bars), m.panel)


@query(
    "rebalance_summary", "portfolio_id execution_date filled_orders rejected_orders "
    "large_selected_count mid_selected_count entered_count exited_count",
    "traded_notional:1 fees:1 turnover large_target_weight mid_target_weight",
)
def rebalance_summary(m: Market):
    return rebalances(m)


@query("ledger_nav", "portfolio_id date holdings", "cash market_value nav", 0)
def ledger_nav(m: Market):
    return customer_nav(m, customer_positions(m))


@query(
    "action_bookings", "portfolio_id code bookings bonus_quantity rights_eligible_quantity",
    "cash_dividend", 4,
)
def action_bookings(m: Market):
    spans = orders.position_spans(orders.daily_flows(desk_fills(m), COSTS))
    rows = orders.action_bookings(actions(m), spans)
    return rows.groupBy("portfolio_id", "code").agg(
        F.count(F.lit(1)).alias("bookings"), F.sum("cash_dividend").alias("cash_dividend"),
        F.sum("bonus_quantity").alias("bonus_quantity"),
        F.sum("rights_eligible_quantity").alias("rights_eligible_quantity"),
    )


@query(
    "cost_sensitivity", "portfolio_id cost_multiplier fills",
    "traded_notional total_fees slippage_cost", 2,
)
def cost_sensitivity(m: Market):
    return orders.cost_sensitivity(
        m.view("fills"), COSTS, [0.0, 1.0, 2.0, 3.0], ["portfolio_id"]
    )


@query("candidate_ranks", "date code rank industry", "score", 5)
def candidate_ranks(m: Market):
    return portfolio.candidate_ranks(universe(m))


@query("top_k_quota", "date code industry industry_rank place", "score", 5)
def top_k_quota(m: Market):
    return portfolio.top_k_quota(candidates(m), TOP_K, 2)


@query("desired_weights", "date code place", "equal inverse_volatility score_tilt", 5)
def desired_weights(m: Market):
    picked = portfolio.top_k_quota(candidates(m), TOP_K, 2)
    return portfolio.desired_weights(picked, ["date"])


@query(
    "portfolio_preflight", "date eligible large_count unknown_count industry_capacity size_active "
    "industry_active violation smallest sufficient",
)
def portfolio_preflight(m: Market):
    low = portfolio.smallest_cross_section(universe(m), 10)
    return portfolio.preflight(universe(m), POLICY).withColumns(
        {"smallest": low.select("smallest").scalar(), "sufficient": low.select("sufficient").scalar()}
    )


def books(m: Market):
    """Every desk on every rebalance date; those that cannot be filled come back with a status."""
    return m.desk_holdings.select("portfolio_id", "date").distinct()


@query(
    "select_portfolio", "portfolio_id date code rank industry size_bucket held status",
    "score target_weight", 5,
)
def select_portfolio(m: Market):
    return portfolio.select_portfolios(
        candidates(m), books(m), m.desk_holdings, POLICY, strict=False
    )


@query(
    "parameter_sweep", "scenario exit_rank max_replacements books infeasible positions retained "
    "entered within_band", "band",
)
def parameter_sweep(m: Market):
    return portfolio.parameter_sweep(
        candidates(m), books(m), m.desk_holdings, POLICY, **GRID
    )


@query(
    "scenario_grid", "scenario exit_rank max_replacements date inside_buffer may_replace", "band",
)
def scenario_grid(m: Market):
    ranked = portfolio.candidate_ranks(candidates(m))
    return portfolio.scenario_grid(ranked, **GRID)


@query("holdings_retained", "portfolio_id date holdings retained all_retained")
def holdings_retained(m: Market):
    return portfolio.holdings_retained(m.desk_holdings, candidates(m))


@query(
    "target_quantities", "portfolio_id date code quantity target_quantity change side band_reason",
    "target_weight price", 6,
)
def target_quantities(m: Market):
    """Move each desk's monthly holdings to equal weights of the date's best names."""
    held = m.desk_holdings.select("portfolio_id", "date", "code", "quantity")
    picked = portfolio.top_k_quota(candidates(m), TOP_K, 2)
    share = (1 - POLICY.cash_buffer) / TOP_K
    wanted = held.select("portfolio_id", "date").distinct().join(
        picked.select("date", "code", F.lit(share).alias("target_weight")), "date"
    )
    # Prices of the books' dates are all that is asked for; one row per date.
    prices = m.bars.join(F.broadcast(held.select("date").distinct()), "date", "left_semi").select(
        "date", "code", F.col("close").alias("price"), F.lit(1).alias("lot_size")
    )
    worth = held.join(prices, ["date", "code"]).groupBy("portfolio_id", "date").agg(
        (F.sum(F.col("quantity") * F.col("price")) + INITIAL).alias("equity")
    )
    equity = held.select("portfolio_id", "date").distinct().join(
        worth, ["portfolio_id", "date"], "left"
    ).fillna(INITIAL, ["equity"])
    policy = Portfolio(rebalance_weight_tolerance=0.02)
    return portfolio.target_quantities(
        held, wanted, prices, equity, policy, ["portfolio_id", "date"]
    )


PLAN = Portfolio(default_lot_size=10, min_trade_value=20_000.0, rebalance_weight_tolerance=0.02)


def plan_inputs(m: Market):
    """Latest scores, bars, each desk's holdings and its cash."""
    last = m.keep(
        "latest_scores",
        lambda: scoring.latest_scores(
            research.latest_cross_section(m.panel)
        ),
    )
    signal = last.agg(F.max("date")).scalar()
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    held = m.keep("plan_holdings", lambda: m.view("desk_requests").where(F.col("date") <= signal).groupBy(
        "portfolio_id", "code"
    ).agg(F.sum(signed).alias("quantity")).where(F.col("quantity") > 0))
    cash = held.select("portfolio_id").distinct().withColumn("cash", F.lit(INITIAL))
    return last, m.panel.withColumn("lot_size", F.lit(10)), held, cash


def plan(m: Market):
    last, bars, held, cash = plan_inputs(m)
    best = last.where(F.col("baseline_rank") <= TOP_K).select(
        "code", F.lit((1 - PLAN.cash_buffer) / TOP_K).alias("target_weight")
    )
    # At most top-k names, the same for every desk.
    names = best.groupBy().agg(F.collect_list(F.struct("code", "target_weight")).alias("n"))
    targets = cash.select("portfolio_id", F.inline(names.scalar()))
    return portfolio.order_plan(last, bars, held, targets, cash, PLAN, COSTS, "baseline_score")


@query(
    "selected_order_plan", "portfolio_id signal_date code action reason priority "
    "current_quantity target_quantity order_quantity baseline_reason_1 baseline_reason_2",
    "reference_price estimated_notional estimated_fees target_weight model_score", 4,
)
def selected_order_plan(m: Market):
    """Every desk moves to its own holdings-aware selection."""
    # Small, because the last month of the test data has few tradable members.
    policy = replace(
        POLICY, top_k=3, entry_rank=3, exit_rank=4, max_stock_weight=0.5, max_industry_weight=0.7,
        default_lot_size=10, min_trade_value=20_000.0, rebalance_weight_tolerance=0.02,
    )
    return portfolio.selected_order_plan(*plan_inputs(m), policy, COSTS, "baseline_score")


@query(
    "order_plan", "portfolio_id signal_date code action reason priority industry size_bucket "
    "security_name current_quantity target_quantity order_quantity baseline_reason_1 "
    "baseline_reason_2",
    "reference_price estimated_notional estimated_fees target_weight model_score", 4,
)
def order_plan(m: Market):
    return plan(m)


@query(
    "order_plan_summary", "portfolio_id signal_date target_positions",
    "estimated_equity target_exposure estimated_buy_notional estimated_sell_notional "
    "estimated_fees", 2,
)
def order_plan_summary(m: Market):
    return portfolio.order_plan_summary(plan(m))


@query("gbt_scores", "date code", "boosted_score")
def gbt_scores(m: Market):
    rows = durable(splits.purged_split(m.predictions))
    model = models.fit_ranker(rows)
    return models.score(model, rows.where(F.col("split") == "test"))


@query("walk_forward_gbt_scores", "fold_id date code", "boosted_score")
def walk_forward_gbt_scores(m: Market):
    return models.walk_forward_scores(m.predictions, cut=durable, **FOLDS)
