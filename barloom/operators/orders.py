"""Orders, fills and ledgers of many portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import Costs, Portfolio
from barloom.functions import cross
from barloom.functions.asof import lists_beside, span_join
from barloom.functions.scalars import pad_code, ratio


def fee(notional: Column, side: Column, costs: Costs) -> Column:
    """Commission with a minimum, transfer fee, and tax on sales."""
    commission = F.greatest(
        F.lit(float(costs.minimum_commission)), notional * costs.commission_bps / 10_000.0
    )
    tax = F.when(side == "SELL", notional * costs.sell_tax_bps / 10_000.0).otherwise(F.lit(0.0))
    return commission + notional * costs.transfer_bps / 10_000.0 + tax


def slipped(price: Column, side: Column, costs: Costs) -> Column:
    """Execution price after slippage against the order."""
    step = costs.slippage_bps / 10_000.0
    return price * F.when(side == "BUY", 1.0 + step).otherwise(1.0 - step)


def either(df: DataFrame, raw: str, adjusted: str) -> Column:
    """Raw price where known, else the adjusted one."""
    return F.coalesce(raw, adjusted) if raw in df.columns else F.col(adjusted)


def next_trading_dates(calendar: DataFrame) -> DataFrame:
    """(date, execution_date) for the distinct dates of a calendar; one row per date."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    return calendar.select("date").distinct().withColumn("execution_date", F.lead("date").over(w))


def schedule_signals(signals: DataFrame, calendar: DataFrame) -> DataFrame:
    """Signals with the first trading date strictly after their date; none means no execution.

    Signal dates need not be trading dates, so both kinds are put on one line of dates.
    """
    days = calendar.select("date").distinct().withColumn("trading", F.col("date"))
    asked = signals.select("date").distinct()
    line = days.join(asked.withColumn("_asked", F.lit(True)), "date", "full_outer")
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    placed = line.withColumn("execution_date", F.first("trading", ignorenulls=True).over(w))
    lookup = placed.where("_asked").select("date", "execution_date")
    # One row per signal date.
    out = signals.join(F.broadcast(lookup), "date")
    return out.where(F.col("execution_date").isNotNull()).withColumnRenamed("date", "signal_date")


def execution_candidates(scheduled: DataFrame, bars: DataFrame) -> DataFrame:
    """Scheduled signals, tradable only if the security still trades and is no ST on execution."""
    day = bars.select(
        F.col("date").alias("execution_date"), "code",
        (F.coalesce("is_trading", F.lit(False)) & ~F.coalesce("is_st", F.lit(False)))
        .alias("_open"),
    )
    rows = scheduled.join(day, ["execution_date", "code"], "left")
    return rows.withColumn(
        "tradable", F.col("tradable") & F.coalesce("_open", F.lit(False))
    ).drop("_open")


MARKET_COLUMNS = [
    "open", "raw_open", "volume", "is_trading", "is_st", "lot_size", "limit_up", "limit_down",
]


def attach_market(rows: DataFrame, bars: DataFrame) -> DataFrame:
    """Same-day market fields, replacing any the rows carry; rows without a bar are dropped.

    Rows and bars meet by code, so bars that lie so already, after windows over them, are not moved.
    """
    present = [c for c in MARKET_COLUMNS if c in bars.columns]
    dated = F.col("date").isNotNull() & F.col("code").isNotNull()
    own = rows.drop(*present).where(dated)
    met = lists_beside(own, bars.where(dated).select("code", "date", *present), ["code", "date"], "_market")
    rest = [c for c in own.columns if c not in ("date", "code")]
    return met.withColumn("_market", F.explode("_market")).select("date", "code", *rest, "_market.*")


def order_feasibility(requests: DataFrame, bars: DataFrame, policy: Portfolio, costs: Costs):
    """Fill requested orders against the day's market.

    An order fails when it is too small (full exits excepted), the security is suspended or locked
    at its limit, or the participation cap leaves no whole lot. Cash is not modelled here.
    """
    df = attach_market(requests, bars)
    base, side = either(df, "raw_open", "open"), F.col("side")
    idle = ~F.coalesce("is_trading", F.lit(True)) | (F.coalesce("volume", F.lit(0.0)) <= 0)

    def limit(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("double")

    locked = (
        idle
        | ((side == "BUY") & F.coalesce(base >= limit("limit_up") * (1 - 1e-6), F.lit(False)))
        | ((side == "SELL") & F.coalesce(base <= limit("limit_down") * (1 + 1e-6), F.lit(False)))
    )
    lot = F.coalesce("lot_size", F.lit(policy.default_lot_size))
    cap = F.floor(F.col("volume") * policy.max_participation_rate)
    whole = F.floor(F.least(F.col("quantity"), cap) / lot) * lot
    small = (F.col("quantity") * base < policy.min_trade_value) & ~F.col("is_full_exit")
    reason = (
        F.when(small, F.lit("BELOW_MIN_TRADE_VALUE"))
        .when(locked, F.lit("SUSPENDED_OR_LIMIT_LOCKED"))
        .when(whole <= 0, F.lit("CAPACITY_OR_CASH_LIMIT"))
        .otherwise(F.lit(""))
    )
    out = df.withColumn("reason", reason)
    done = F.col("reason") == ""
    out = out.withColumns(
        {
            "filled_quantity": F.when(done, whole).otherwise(F.lit(0)).cast("long"),
            "price": F.when(done, slipped(base, side, costs)),
        }
    ).withColumn("notional", F.coalesce(F.col("filled_quantity") * F.col("price"), F.lit(0.0)))
    status = (
        F.when(~done, F.lit("REJECTED"))
        .when(F.col("filled_quantity") == F.col("quantity"), F.lit("FILLED"))
        .otherwise(F.lit("PARTIALLY_FILLED"))
    )
    return out.withColumns(
        {
            "fees": F.when(done, fee(F.col("notional"), side, costs)).otherwise(F.lit(0.0)),
            "status": status,
        }
    )


def order_priority(requests: DataFrame) -> DataFrame:
    """Add `priority` per portfolio and date: sales by low score first, then buys by high score."""
    keys, side = ["portfolio_id", "date"], F.col("side")
    df = requests.withColumn(
        "_s", F.when(side == "SELL", -F.col("score")).otherwise(F.col("score"))
    )
    df = cross.ordinal_rank(df, [*keys, "side"], "_s", "code", "_place")
    df = cross.with_aggregates(df, keys, {"_sales": F.count_if(side == "SELL")})
    place = F.col("_place") + F.when(side == "BUY", F.col("_sales")).otherwise(F.lit(0))
    return df.withColumn("priority", place.cast("int")).drop("_s", "_place", "_sales")


def daily_flows(fills: DataFrame, costs: Costs) -> DataFrame:
    """Signed quantity and cash per (portfolio_id, code, date).

    Fills are combined before any window, so no ledger group exceeds the number of dates.
    """
    side = F.col("side")
    notional = F.col("quantity") * F.col("price")
    sign = F.when(side == "BUY", 1).otherwise(-1)
    return fills.groupBy("portfolio_id", "code", "date").agg(
        F.sum(F.col("quantity") * sign).alias("change"),
        F.sum(-notional * sign - fee(notional, side, costs)).alias("cash_flow"),
        F.sum(notional).alias("traded_notional"),
        F.sum(fee(notional, side, costs)).alias("fees"),
    )


def position_spans(flows: DataFrame) -> DataFrame:
    """Quantity held after each trading day until the day before the next one."""
    w = Window.partitionBy("portfolio_id", "code").orderBy("date")
    total = F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return flows.select(
        "portfolio_id", "code", F.col("date").alias("held_from"),
        F.lead("date").over(w).alias("changed_on"), total.alias("quantity"),
        (total - F.col("change")).alias("quantity_before"),
    )


def positions(
    spans: DataFrame, valuation: DataFrame, bars: DataFrame, buckets: DataFrame | None = None
) -> DataFrame:
    """Holdings and market value on each (portfolio_id, date) of `valuation`.

    A day takes the last close not after it; a security never priced is worth 0. A span travels as one row
    with its days, then with their closes, and becomes a row a day after the last shuffle. The lists are of
    calendar length at most: a portfolio's days, a span's days, a code's closes by day.
    """
    days = valuation.where(F.col("date").isNotNull()).groupBy("portfolio_id").agg(
        F.array_sort(F.collect_set("date")).alias("_days")
    )
    start, stop = F.col("held_from"), F.col("changed_on")
    inside = F.filter("_days", lambda d: (d >= start) & (stop.isNull() | (d < stop)))
    held = spans.where((F.col("quantity") != 0) & start.isNotNull()).join(days, "portfolio_id").select(
        "portfolio_id", "code", "quantity", inside.alias("_on")
    ).where(F.size("_on") > 0)
    by_code = held.join(_daily_closes(bars), "code", "left")
    if buckets is not None:
        by_code = by_code.join(buckets, "code", "left").withColumn(
            "size_bucket", F.coalesce("size_bucket", F.lit("UNKNOWN"))
        )
    own = [] if buckets is None else ["size_bucket"]
    step = lambda d: F.least(F.datediff(d, F.col("_first")), F.size("_closes") - 1)
    priced = by_code.select(
        "portfolio_id", "code", "quantity", *own, "_on",
        F.transform("_on", lambda d: F.get(F.col("_closes"), step(d))).alias("_prices"),
    ).repartition("portfolio_id")
    daily = priced.withColumn("_day", F.explode(F.arrays_zip("_on", "_prices")))
    close = F.col("_day._prices")
    return daily.select(
        "portfolio_id", F.col("_day._on").alias("date"), "code", "quantity", close.alias("close"),
        (F.col("quantity") * F.coalesce(close, F.lit(0.0))).alias("market_value"), *own,
    )


def _daily_closes(bars: DataFrame) -> DataFrame:
    """A row per code: its first priced day and the closes of all days from there to the last priced one."""
    price = either(bars, "raw_close", "close").alias("price")
    known = bars.select("code", "date", price).where(F.col("price").isNotNull() & F.col("date").isNotNull())
    listed = known.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("date", "price"))).alias("_list"))

    def filled(x: Column, i: Column) -> Column:
        following = F.get(F.col("_list"), i + 1)["date"]
        return F.array_repeat(x["price"], F.coalesce(F.datediff(following, x["date"]), F.lit(1)))

    return listed.select(
        "code", F.col("_list")[0]["date"].alias("_first"), F.flatten(F.transform("_list", filled)).alias("_closes")
    )


def ledger_nav(flows: DataFrame, holdings: DataFrame, initial: float) -> DataFrame:
    """Cash, market value and NAV of each portfolio on its trading dates."""
    daily = flows.groupBy("portfolio_id", "date").agg(F.sum("cash_flow").alias("cash_flow"))
    w = Window.partitionBy("portfolio_id").orderBy("date").rowsBetween(
        Window.unboundedPreceding, 0
    )
    cash = daily.withColumn("cash", F.sum("cash_flow").over(w) + float(initial))
    worth = holdings.groupBy("portfolio_id", "date").agg(
        F.sum("market_value").alias("market_value"), F.count(F.lit(1)).alias("holdings")
    )
    out = cash.join(worth, ["portfolio_id", "date"], "left").withColumns(
        {
            "market_value": F.coalesce("market_value", F.lit(0.0)),
            "holdings": F.coalesce("holdings", F.lit(0)),
        }
    )
    return out.withColumn("nav", F.col("cash") + F.col("market_value")).drop("cash_flow")


def membership_changes(spans: DataFrame) -> DataFrame:
    """Securities entered and left per portfolio and trading date."""
    before, after = F.col("quantity_before") > 0, F.col("quantity") > 0
    return spans.groupBy("portfolio_id", F.col("held_from").alias("execution_date")).agg(
        F.count_if(after & ~before).alias("entered_count"),
        F.count_if(before & ~after).alias("exited_count"),
    )


def rebalance_summary(
    executed: DataFrame, changes: DataFrame, open_values: DataFrame, buckets: DataFrame
) -> DataFrame:
    """Traded value, fees, turnover and size mix of each portfolio and execution date.

    `open_values` holds (portfolio_id, date, open_value); the mix counts securities bought.
    """
    bought = (F.col("side") == "BUY") & (F.col("filled_quantity") > 0)
    sized = executed.join(buckets, "code", "left")

    def mix(bucket: str) -> Column:
        return bought & (F.col("size_bucket") == bucket)

    daily = sized.groupBy("portfolio_id", F.col("date").alias("execution_date")).agg(
        F.sum("notional").alias("traded_notional"), F.sum("fees").alias("fees"),
        F.count_if(F.col("filled_quantity") > 0).alias("filled_orders"),
        F.count_if(F.col("filled_quantity") == 0).alias("rejected_orders"),
        F.count_if(mix("LARGE")).alias("large_selected_count"),
        F.count_if(mix("MID")).alias("mid_selected_count"),
        F.sum(F.when(mix("LARGE"), F.col("notional"))).alias("large_notional"),
        F.sum(F.when(mix("MID"), F.col("notional"))).alias("mid_notional"),
    )
    key = ["portfolio_id", "execution_date"]
    values = open_values.withColumnRenamed("date", "execution_date")
    out = daily.join(changes, key, "left").join(values, key, "left")
    return out.withColumns(
        {
            "entered_count": F.coalesce("entered_count", F.lit(0)),
            "exited_count": F.coalesce("exited_count", F.lit(0)),
            "turnover": F.coalesce(ratio("traded_notional", "open_value"), F.lit(0.0)),
            "large_target_weight": F.coalesce(ratio("large_notional", "open_value"), F.lit(0.0)),
            "mid_target_weight": F.coalesce(ratio("mid_notional", "open_value"), F.lit(0.0)),
        }
    ).drop("large_notional", "mid_notional")


def action_bookings(actions: DataFrame, spans: DataFrame) -> DataFrame:
    """Dividends, bonus shares and unsubscribed rights of securities held into the ex-date.

    Actions are merged to one per code and ex-date first; spans meet them year by year.
    """
    fields = [
        "ex_date", "cash_dividend_per_share", "bonus_share_ratio", "rights_share_ratio",
        "rights_price",
    ]
    merged = actions.groupBy(pad_code("code").alias("code"), "ex_date").agg(
        *[F.sum(c).alias(c) for c in fields[1:4]], F.max("rights_price").alias("rights_price")
    )
    # Held into the ex-date: bought before it, and not changed before it.
    eve = merged.withColumn("_eve", F.date_sub("ex_date", 1))
    rows = span_join(
        spans.where(F.col("quantity") > 0).select("portfolio_id", "code", "quantity", "held_from", "changed_on"),
        eve, ["code"], start="held_from", stop="changed_on", date="_eve", unit="year",
    )
    q = F.col("quantity")
    bonus = F.floor(q * F.col("bonus_share_ratio"))
    return rows.select(
        "portfolio_id", F.col("ex_date").alias("date"), "code",
        q.alias("quantity_before"), (q * F.col("cash_dividend_per_share")).alias("cash_dividend"),
        bonus.alias("bonus_quantity"), (q + bonus).alias("quantity_after"),
        F.floor(q * F.col("rights_share_ratio")).alias("rights_eligible_quantity"),
        "rights_price", F.lit("NOT_SUBSCRIBED").alias("rights_policy"),
    )


def cost_sensitivity(
    fills: DataFrame, costs: Costs, multipliers: list[float], keys: list[str]
) -> DataFrame:
    """Fees and slippage of fixed fills under scaled costs, all multipliers in one pass."""
    side = F.col("side")
    aggs, parts = [], []
    for i, m in enumerate(multipliers):
        scaled = costs.scaled(m)
        price = slipped(F.col("price"), side, scaled)
        notional = F.col("quantity") * price
        aggs += [
            F.sum(fee(notional, side, scaled)).alias(f"_fees{i}"),
            F.sum(F.abs(notional - F.col("quantity") * F.col("price"))).alias(f"_slip{i}"),
        ]
        parts.append(
            F.struct(
                F.lit(float(m)).alias("cost_multiplier"), F.col(f"_fees{i}").alias("total_fees"),
                F.col(f"_slip{i}").alias("slippage_cost"),
            )
        )
    base = fills.groupBy(*keys).agg(
        *aggs, F.sum(F.col("quantity") * F.col("price")).alias("traded_notional"),
        F.count(F.lit(1)).alias("fills"),
    )
    return base.select(*keys, "fills", "traded_notional", F.inline(F.array(*parts)))
