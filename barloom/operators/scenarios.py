"""Portfolios of many scenarios over time, from the weights that each scenario asks for.

A scenario names target weights per signal date; they are traded at the close of the next market date
and drift with prices until the scenario's next trade. No order is simulated, so all scenarios and
periods are computed at once. A period's value is one plus the running sum of what its holdings gained,
so a holding adds only the days on which it has a price; periods are chained by running products of
their growth and of what trading left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import Costs
from barloom.functions.asof import asof_backward, span_join
from barloom.operators.orders import schedule_signals

PERIOD = ["scenario", "start"]
HOLDING = [*PERIOD, "code"]


def cost_rates(costs: Costs) -> tuple[float, float]:
    """Costs of buying and of selling as a share of the traded value; no least commission, as
    scenarios have weights and not orders."""
    buy = (costs.commission_bps + costs.transfer_bps + costs.slippage_bps) / 1e4
    return buy, buy + costs.sell_tax_bps / 1e4


def with_rates(targets: DataFrame, costs: Costs, multipliers: list[float]) -> DataFrame:
    """Every scenario under each multiple of the costs, as `<scenario>_cost<n>x`."""
    rates = F.array(*[
        F.struct(
            F.lit(f"{k:g}").alias("_times"), *[
                F.lit(r).alias(n) for n, r in zip(("buy_rate", "sell_rate"), cost_rates(costs.scaled(k)))
            ],
        ) for k in multipliers
    ])
    name = F.concat("scenario", F.lit("_cost"), "_times", F.lit("x"))
    return targets.select("*", F.inline(rates)).withColumn("scenario", name).drop("_times")


def holdings(targets: DataFrame, prices: DataFrame) -> DataFrame:
    """Holding periods: `start` is the date of the trade, `stop` that of the next (null: none), `base`
    the last price at the start.

    Signals without a later market date are not traded; of several signals before one market date the
    last is. A holding without any price by its start has a null base and keeps its value.
    """
    dated = schedule_signals(targets, prices.select("date").distinct()).withColumnRenamed(
        "execution_date", "start"
    )
    starts = dated.groupBy(*PERIOD).agg(F.max("signal_date").alias("signal_date")).withColumn(
        "stop", F.lead("start").over(Window.partitionBy("scenario").orderBy("start"))
    )
    held = dated.join(starts, [*PERIOD, "signal_date"]).withColumn("date", F.col("start"))
    positive = prices.where(F.col("close") > 0).select("code", "date", F.col("close").alias("base"))
    return asof_backward(held, positive, ["code"], ["base"]).drop("date", "signal_date")


def _gains(held: DataFrame, prices: DataFrame) -> DataFrame:
    """What each holding's price did to a unit of its period, on the days with a price: `relative` is
    the price over the base, `gain` the change of weight times relative. The stop date is included."""
    points = prices.where(F.col("close") > 0).select("code", "date", "close")
    spans = held.where(F.col("base").isNotNull()).select(
        *HOLDING, "stop", "target_weight", "base",
        F.date_add("start", 1).alias("_from"), F.date_add("stop", 1).alias("_to"),
    )
    met = span_join(spans, points, ["code"], start="_from", stop="_to", date="date")
    own = Window.partitionBy(*HOLDING).orderBy("date")
    relative = F.col("close") / F.col("base")
    return met.withColumn("relative", relative).withColumn(
        "gain", F.col("target_weight") * (F.col("relative") - F.lag("relative", 1, 1.0).over(own))
    ).select(*HOLDING, "stop", "date", "relative", "gain")


def _trades(held: DataFrame, ends: DataFrame) -> DataFrame:
    """Weights before and after each trade; a holding drifts to its share of the period's end."""
    drifted = ends.where(F.col("stop").isNotNull()).select(
        "scenario", F.col("stop").alias("start"), "code", F.col("drifted").alias("_old")
    )
    wanted = held.select(*HOLDING, F.col("target_weight").alias("_new"))
    return wanted.join(drifted, HOLDING, "full").select(
        *HOLDING, "_old", "_new",
        (F.coalesce("_new", F.lit(0.0)) - F.coalesce("_old", F.lit(0.0))).alias("traded"),
    )


def run(targets: DataFrame, prices: DataFrame, initial: float, cut) -> dict[str, DataFrame]:
    """`nav`, `orders` and `rebalances` of every scenario, as the NAV analytics take them.

    `targets` holds scenario, date, code (unique), target_weight (adding up to one at most, the rest
    is cash), buy_rate and sell_rate (the same in a scenario). `prices` holds code, date and close. A
    scenario's first value is after the costs of its first trade; turnover is bought plus sold value
    over the value before the trade. `cut` writes the tables that are read several times.
    """
    held = cut(holdings(targets, prices))
    gains = cut(_gains(held, prices))
    last = gains.groupBy(*HOLDING).agg(F.max_by("relative", "date").alias("_last"))
    value = F.col("target_weight") * F.coalesce("_last", F.lit(1.0))
    ends = held.join(last, HOLDING, "left").withColumn("_value", value)
    growth = ends.groupBy(*PERIOD).agg(
        (1.0 + F.sum(F.col("_value") - F.col("target_weight"))).alias("growth")
    )
    ends = cut(ends.join(growth, PERIOD).withColumn("drifted", F.col("_value") / F.col("growth")))
    trades = cut(_trades(held, ends))
    periods = cut(_periods(ends, trades, initial))
    return {
        "nav": _daily(periods, gains, prices), "orders": _orders(periods, trades),
        "rebalances": periods.select(
            F.col("scenario").alias("portfolio_id"), F.col("start").alias("execution_date"), "turnover",
            "entered_count", "exited_count",
        ),
    }


def _periods(ends: DataFrame, trades: DataFrame, initial: float) -> DataFrame:
    """One row per scenario and trade: the value before it and after its costs."""
    facts = ends.groupBy(*PERIOD).agg(
        F.first("stop").alias("stop"), F.first("growth").alias("growth"),
        F.first("buy_rate").alias("buy_rate"), F.first("sell_rate").alias("sell_rate"),
        (1.0 - F.sum("target_weight")).alias("cash_weight"),
    )
    traded = F.col("traded")
    moved = trades.groupBy(*PERIOD).agg(
        F.sum(F.greatest(traded, F.lit(0.0))).alias("_bought"),
        F.sum(F.greatest(-traded, F.lit(0.0))).alias("_sold"),
        F.count_if(F.col("_old").isNull()).alias("entered_count"),
        F.count_if(F.col("_new").isNull()).alias("exited_count"),
    )
    rows = facts.join(moved, PERIOD).withColumns({
        "turnover": F.col("_bought") + F.col("_sold"),
        "_cost": F.col("_bought") * F.col("buy_rate") + F.col("_sold") * F.col("sell_rate"),
    })
    # A scenario has a row per trade, at most the calendar.
    order = Window.partitionBy("scenario").orderBy("start")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(
        F.product(F.col("growth") * (1.0 - F.col("_cost"))).over(earlier), F.lit(1.0)
    ) * float(initial)
    return rows.withColumn("value_before", before).withColumn(
        "value", F.col("value_before") * (1.0 - F.col("_cost"))
    ).drop("_bought", "_sold", "_cost")


def _daily(periods: DataFrame, gains: DataFrame, prices: DataFrame) -> DataFrame:
    """One row per scenario and market date from its first trade on."""
    # Every market date of every period, whether or not a holding has a price on it. One row per date.
    calendar = F.broadcast(prices.select("date").distinct())
    days = span_join(
        periods.select(*PERIOD, "stop", F.lit(0).alias("_all")), calendar.withColumn("_all", F.lit(0)),
        ["_all"], start="start", stop="stop", date="date",
    ).select(*PERIOD, "date", F.lit(0.0).alias("gain"))
    inside = gains.where(F.col("stop").isNull() | (F.col("date") < F.col("stop")))
    daily = days.unionByName(inside.select(*PERIOD, "date", "gain")).groupBy(*PERIOD, "date").agg(
        F.sum("gain").alias("gain")
    )
    so_far = Window.partitionBy(*PERIOD).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("_growth", 1.0 + F.sum("gain").over(so_far)).join(
        periods.select(*PERIOD, "value", "cash_weight"), PERIOD
    ).select(
        F.col("scenario").alias("portfolio_id"), "date",
        (F.col("value") * F.col("_growth")).alias("nav"),
        (F.col("value") * F.col("cash_weight")).alias("cash"),
    )


def _orders(periods: DataFrame, trades: DataFrame) -> DataFrame:
    """One row per security whose weight changes, the traded value as its quantity."""
    value = F.col("value_before") * F.abs("traded")
    rate = F.when(F.col("traded") > 0, F.col("buy_rate")).otherwise(F.col("sell_rate"))
    priced = trades.where(F.col("traded") != 0).join(
        periods.select(*PERIOD, "value_before", "buy_rate", "sell_rate"), PERIOD
    )
    return priced.select(
        F.col("scenario").alias("portfolio_id"), F.col("start").alias("date"), "code",
        value.alias("filled_quantity"), (value * rate).alias("fees"),
    )


def banded(selected: DataFrame, weights: DataFrame, bands: list[float], invested: float) -> DataFrame:
    """Targets of every band: a holding within the band of its target keeps its weight.

    `selected` holds scenario, portfolio_id, date, code, target_weight and `weights` the shares before
    the trade. Kept weights may push a book over `invested`; it is then scaled down to it.
    """
    joined = selected.join(weights, ["portfolio_id", "date", "code"], "left")
    per_band = F.array(*[F.struct(
        F.format_string("%s_band%.3f", "scenario", F.lit(b)).alias("_name"),
        F.when(F.abs(F.col("weight") - F.col("target_weight")) <= b, F.col("weight"))
        .otherwise(F.col("target_weight")).alias("_weight"),
    ) for b in bands])
    rows = joined.select("portfolio_id", "date", "code", F.inline(per_band))
    whole = F.sum("_weight").over(Window.partitionBy("portfolio_id", "_name", "date"))
    scale = F.least(F.lit(1.0), F.lit(invested) / whole)
    return rows.select(
        "portfolio_id", F.concat_ws("/", "portfolio_id", "_name").alias("scenario"), "date", "code",
        (F.col("_weight") * scale).alias("target_weight"),
    )
