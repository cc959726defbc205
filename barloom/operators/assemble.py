"""Build canonical bars from raw, adjusted and status feeds, and the derived market fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import rolling
from barloom.functions.asof import feeds_by_day
from barloom.functions.scalars import cents, normalize_symbol, st_name, with_venue
from barloom.operators.clean import keep_last, number
from barloom.schemas import ACTION, require_columns


def security_master(raw: DataFrame, *, source: str, order: str = "_seq") -> DataFrame:
    """Equities of a raw listing: canonical code, exchange, board and special-treatment mark."""
    require_columns(raw, ["code", "security_name"], "Security master")
    df = raw.withColumns(
        {"code": normalize_symbol("code"), "security_name": F.trim("security_name")}
    )
    # The code alone decides exchange and kind, so filtering before removing copies is the same.
    df = with_venue(df.where(F.col("code").rlike(r"^\d{6}$")))
    df = df.where(F.col("exchange") != "UNKNOWN")
    # Without an ingest order the greatest name is kept, so the result does not depend on the run.
    last = order if order in df.columns else "security_name"
    kept = dict.fromkeys(["code", "security_name", "exchange", "board", last])
    df = keep_last(df.select(*kept), ["code"], [last])
    return df.select(
        "code", "security_name", "exchange", "board", F.lit("STOCK").alias("instrument_type"),
        F.coalesce(st_name("security_name"), F.lit(False)).alias("is_st_current"),
        F.lit(source).alias("source"),
    )


def complete_master(master: DataFrame, membership: DataFrame, order: str) -> DataFrame:
    """Add members the listing lacks, named after their membership row."""
    absent = membership.join(master.select("code"), "code", "left_anti")
    name = F.coalesce("security_name", "code") if "security_name" in membership.columns else (
        F.col("code")
    )
    extra = security_master(
        absent.select("code", name.alias("security_name"), F.col(order).alias("_seq")),
        source="membership_fallback",
    )
    return master.unionByName(extra)


def add_market_cap(df: DataFrame) -> DataFrame:
    """Float shares implied by turnover, and the market cap they give at the raw close."""
    absent = F.lit(None).cast("double")
    turnover = number("turnover") if "turnover" in df.columns else absent
    volume, close = number("volume"), number("raw_close")
    valid = F.coalesce((turnover > 0) & (volume > 0) & (close > 0), F.lit(False))
    shares = F.when(valid, volume / turnover)
    return df.withColumns(
        {
            "float_shares_estimate": shares,
            "market_cap": shares * close,
            "market_cap_source": F.when(valid, F.lit("turnover_implied_float_market_cap"))
            .otherwise(F.lit("UNAVAILABLE")),
        }
    )


# Daily price-limit rates.
ST_RATE, MAIN_RATE, STAR_RATE, CHINEXT_RATE, BSE_RATE = 0.05, 0.10, 0.20, 0.20, 0.30
CHINEXT_FROM = "2020-08-24"


def add_price_limits(df: DataFrame) -> DataFrame:
    """Daily limits from the previous close by board, special treatment and rule date."""
    st = F.coalesce("is_st", F.lit(False))
    board = F.col("board")
    rate = (
        F.when(st, ST_RATE).when(board == "STAR", STAR_RATE)
        .when((board == "CHINEXT") & (F.col("date") >= F.lit(CHINEXT_FROM).cast("date")),
              CHINEXT_RATE)
        .when(board == "BSE", BSE_RATE).otherwise(MAIN_RATE)
    )
    preclose = number("preclose")
    return df.withColumn("limit_rate", rate).withColumns(
        {
            "limit_up": cents(preclose * (1.0 + F.col("limit_rate"))),
            "limit_down": cents(preclose * (1.0 - F.col("limit_rate"))),
            "limit_rule_is_point_in_time": preclose.isNotNull()
            & F.coalesce("status_is_point_in_time", F.lit(False)),
        }
    )


def normalize_status(raw: DataFrame) -> DataFrame:
    """Daily trading status feed with provenance."""
    return raw.select(
        normalize_symbol("code").alias("code"), F.col("date").try_cast("date").alias("date"),
        number("preclose").alias("preclose"),
        (F.col("tradestatus").cast("string") == "1").alias("is_trading"),
        (F.col("isST").cast("string") == "1").alias("is_st"),
        F.lit(True).alias("status_is_point_in_time"),
        F.lit("history_k_data").alias("status_source"),
    )


def _with_status_fallbacks(df: DataFrame) -> DataFrame:
    """Fill status fields of one security's rows; `df` carries st_* columns from the feed.

    A security without any status rows trades when it has volume and keeps its current mark.
    """
    code = Window.partitionBy("code")
    traded = (F.col("volume") > 0) & (F.col("amount") > 0)
    has_feed = F.bool_or(F.col("st_source").isNotNull()).over(code)
    return df.withColumn("_feed", has_feed).withColumns(
        {
            "status_is_point_in_time": F.coalesce("st_pit", F.lit(False)),
            "is_st": F.coalesce("st_is_st", "is_st_current"),
            "is_trading": F.coalesce(
                F.when(F.col("_feed"), F.coalesce("st_is_trading", F.lit(False)) & traded)
                .otherwise(traded), F.lit(False)
            ),
            "preclose": F.coalesce("st_preclose", F.lag("raw_close").over(rolling.by_code())),
            "status_source": F.when(F.col("_feed"), F.col("st_source"))
            .otherwise(F.lit("current_master_fallback")),
        }
    ).drop("_feed", "st_pit", "st_is_st", "st_is_trading", "st_preclose", "st_source")


def _status_columns(status: DataFrame) -> DataFrame:
    return status.select(
        "code", "date", F.col("status_is_point_in_time").alias("st_pit"),
        F.col("is_st").alias("st_is_st"), F.col("is_trading").alias("st_is_trading"),
        F.col("preclose").alias("st_preclose"), F.col("status_source").alias("st_source"),
    )


def enrich_status(bars: DataFrame, status: DataFrame, master: DataFrame) -> DataFrame:
    """Attach the daily status, falling back to volume and the current listing."""
    joined = bars.join(_status_columns(status), ["code", "date"], "left").join(
        master.select("code", "is_st_current"), "code", "left"
    )
    return _with_status_fallbacks(joined).drop("is_st_current")


def match_calendars(
    raw: DataFrame, adjusted: DataFrame, start: str, end: str, tolerance: int = 1,
    beside: DataFrame | None = None,
) -> DataFrame:
    """Join raw and adjusted prices by day inside the request window.

    A security with more than `tolerance` unmatched days is rejected as a whole. Matched days get the
    columns of `beside`, null where it has no row.
    """
    window = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    renamed = raw.where(window).withColumnsRenamed(
        {c: f"raw_{c}" for c in ("open", "high", "low", "close")}
    )
    prices = adjusted.where(window).select("code", "date", "open", "high", "low", "close")
    code = Window.partitionBy("code")
    both = F.col("close").isNotNull() & F.col("raw_close").isNotNull()
    feeds = {"_raw": renamed, "_adjusted": prices}
    if beside is not None:
        feeds["_beside"] = beside.where(window)
    keys = ["code", "date"]

    def fields(*names: str) -> list[Column]:
        return [F.col(n)[c].alias(c) for n in names for c in feeds[n].columns if c not in keys]

    # A day without rows of a feed keeps one empty row of it, as in a full join.
    rest = ["_beside"] if beside is not None else []
    days = feeds_by_day(feeds).where((F.size("_raw") > 0) | (F.size("_adjusted") > 0))
    days = days.withColumn("_raw", F.explode_outer("_raw")).withColumn("_adjusted", F.explode_outer("_adjusted"))
    matched = (
        days.select(*keys, *fields("_raw", "_adjusted"), *rest)
        .withColumn("_both", both)
        .withColumn("unmatched", F.count_if(~F.col("_both")).over(code))
        .where(F.col("_both") & (F.col("unmatched") <= tolerance))
        .drop("_both")
    )
    if beside is None:
        return matched
    own = [c for c in matched.columns if c != "_beside"]
    return matched.withColumn("_beside", F.explode_outer("_beside")).select(*own, *fields("_beside"))


def assemble_bars(
    raw: DataFrame, adjusted: DataFrame, status: DataFrame, master: DataFrame, *,
    start: str, end: str, lot_size: int = 100,
) -> DataFrame:
    """Canonical bars of all securities at once from three feeds and the listing."""
    df = match_calendars(raw, adjusted, start, end, beside=_status_columns(status))
    listed = master.select(
        "code", "security_name", "exchange", "board", "instrument_type", "is_st_current"
    )
    df = _with_status_fallbacks(df.join(listed, "code"))
    df = df.withColumns(
        {
            "adjustment_factor": F.col("close") / F.nullif(F.col("raw_close"), F.lit(0.0)),
            "lot_size": F.lit(lot_size),
        }
    )
    return add_market_cap(add_price_limits(df)).drop("is_st_current", "unmatched")


# Vendor headers of the action feeds.
DIVIDEND_ALIASES = {
    "除权除息日": "ex_date",
    "送股": "bonus_per_10",
    "转增": "transfer_per_10",
    "派息": "cash_per_10",
}
RIGHTS_ALIASES = {"除权日": "ex_date", "配股方案": "rights_per_10", "配股价格": "rights_price"}


def _action_rows(df: DataFrame, source: str, **measures) -> DataFrame:
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    fill = {
        "cash_dividend_per_share": zero, "bonus_share_ratio": zero, "rights_share_ratio": zero,
        "rights_price": none, **measures,
    }
    out = df.select(
        normalize_symbol("code").alias("code"), F.col("ex_date").try_cast("date").alias("ex_date"),
        *[v.alias(k) for k, v in fill.items()], F.lit(source).alias("source"),
    )
    return out.where(F.col("ex_date").isNotNull())


def normalize_dividends(raw: DataFrame) -> DataFrame:
    """Dividends quoted per ten shares as per-share actions."""
    df = raw.withColumnsRenamed(DIVIDEND_ALIASES)
    require_columns(df, ["code", *DIVIDEND_ALIASES.values()], "Dividend feed")

    def amount(c: str):
        return F.coalesce(number(c), F.lit(0.0))

    return _action_rows(
        df, "dividend_feed",
        cash_dividend_per_share=amount("cash_per_10") / 10.0,
        bonus_share_ratio=(amount("bonus_per_10") + amount("transfer_per_10")) / 10.0,
    )


def normalize_rights(raw: DataFrame) -> DataFrame:
    """Rights issues quoted per ten shares as per-share actions."""
    df = raw.withColumnsRenamed(RIGHTS_ALIASES)
    require_columns(df, ["code", *RIGHTS_ALIASES.values()], "Rights feed")
    return _action_rows(
        df, "rights_feed",
        rights_share_ratio=F.coalesce(number("rights_per_10"), F.lit(0.0)) / 10.0,
        rights_price=number("rights_price"),
    )


def merge_actions(*frames: DataFrame) -> DataFrame:
    """One row per security and ex-date; the few source names are joined in order.

    Sums are cut to ten decimals: the order of rows in a distributed sum is not fixed, and share
    counts are later rounded down from these ratios.
    """
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame, allowMissingColumns=True)
    merged = rows.groupBy("code", "ex_date").agg(
        F.round(F.sum("cash_dividend_per_share"), 10).alias("cash_dividend_per_share"),
        F.round(F.sum("bonus_share_ratio"), 10).alias("bonus_share_ratio"),
        F.round(F.sum("rights_share_ratio"), 10).alias("rights_share_ratio"),
        F.max("rights_price").alias("rights_price"),
        F.array_join(F.array_sort(F.collect_set("source")), "+").alias("source"),
    )
    return merged.select(*ACTION.names)
