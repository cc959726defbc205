"""Market tables derived from the star-schema test tables.

One supplier is one security, one order line one trade, one customer (or nation) one portfolio.
Views read whole tables but for four, which leave rows out to make gaps: `adjusted_feed` (days of large
volume), `status_feed` (insolvent suppliers and closed days), `raw_dividends` and `raw_rights` (one kind
of order line each). `daily` is the bar table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import pad_code
from barloom.operators import labels

# Account-balance levels that split suppliers into size buckets.
LARGE_FROM, MID_FROM = 6300.0, 2600.0
# Monthly volume levels of the membership snapshots.
MEMBER_VOLUME, MID_VOLUME, LARGE_VOLUME = 62.0, 140.0, 230.0
INITIAL_CASH = 1_000_000.0
BAR = ["code", "date", "open", "high", "low", "close", "volume", "amount"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _priced(lines: DataFrame) -> DataFrame:
    """Lines with their price and their place in the sequence of trades."""
    return lines.withColumns(
        {
            "price": F.col("l_extendedprice") / F.col("l_quantity"),
            "seq": F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"),
        }
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as trades."""
    return _priced(
        table(spark, sf_dir, "lineitem").select(
            pad_code("l_suppkey").alias("code"),
            F.to_date("l_shipdate").alias("date"),
            "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        )
    )


def to_bars(trades: DataFrame, **also: Column) -> DataFrame:
    """Daily bars, with further aggregates; open and close are the first and last trade in sequence order.

    A security has few trades a day, so combining them before the shuffle hardly makes them fewer, but
    sorts them once more. They are dealt by code, as all that follows reads bars by code: the bars of a
    security are not moved again. A group holds the trades of one security on one day only. Prices and
    sequence are derived after the shuffle, so their parts travel once.
    """
    dealt = _priced(trades.drop("price", "seq").repartition("code"))
    by_day = dealt.groupBy("code", "date").agg(
        F.min("seq").alias("_first"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max("seq").alias("_last"),
        F.sum("l_quantity").alias("volume"),
        F.round(F.sum("l_extendedprice"), 2).alias("amount"),
        *[agg.alias(name) for name, agg in also.items()],
    )

    def price(seq: str) -> Column:
        return F.col(seq)["l_extendedprice"] / F.col(seq)["l_quantity"]

    return by_day.withColumns({"open": price("_first"), "close": price("_last")}).select(*BAR, *also)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_bars(trades(spark, sf_dir))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with what the raw and the status feed read besides, in one pass over the trades."""
    return to_bars(
        trades(spark, sf_dir),
        turnover=F.round(F.avg("l_discount"), 8), state=F.max("l_linestatus"),
        tax=F.max("l_tax"), flag=F.min("l_returnflag"),
    )


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as securities; the region is the industry."""
    place = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    balance = F.col("s_acctbal")
    return (
        table(spark, sf_dir, "supplier")
        .join(place, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .select(
            pad_code("s_suppkey").alias("code"),
            F.col("s_name").alias("security_name"),
            F.col("r_name").alias("industry"),
            F.col("n_name").alias("nation"),
            F.when(balance >= LARGE_FROM, F.lit("LARGE")).when(balance >= MID_FROM, F.lit("MID"))
            .otherwise(F.lit("SMALL")).alias("size_bucket"),
            (balance < 0).alias("is_st"),
            (F.abs(balance) + 1.0).alias("shares"),
        )
    )


def panel(spark: SparkSession, sf_dir: str, daily: DataFrame) -> DataFrame:
    """Bars with the attributes the research operators read; a bucket that bars have stays."""
    own = ["size_bucket"] if "size_bucket" in daily.columns else []
    return (
        daily.join(master(spark, sf_dir).drop("nation", *own), "code", "left")
        .withColumns(
            {
                "is_trading": (F.col("volume") > 0) & (F.col("amount") > 0),
                "market_cap": F.col("shares") * F.col("close"),
                "lot_size": F.lit(100),
            }
        )
        .drop("shares")
    )


def dirty_bars(spark: SparkSession, sf_dir: str, daily: DataFrame) -> DataFrame:
    """Bars as text with a second batch: repeats of returned lines, some of them broken.

    `_seq` is the ingest order; the second batch is later.
    """
    first = daily
    lines = trades(spark, sf_dir).where(F.col("l_returnflag") == "R")
    again = to_bars(lines).withColumns(
        {
            # Days of small volume come back with the low above the high.
            "low": F.when(F.col("volume") < 4, F.col("high") * 2).otherwise(F.col("low")),
            "volume": F.when(F.col("volume") > 45, -F.col("volume")).otherwise(F.col("volume")),
        }
    )
    both = first.withColumn("batch", F.lit(0)).unionByName(again.withColumn("batch", F.lit(1)))
    code = F.regexp_replace("code", "^0+(?=.)", "")
    mark = F.when(F.col("batch") == 1, F.concat(F.lit("sh."), F.col("code"))).otherwise(code)
    return both.select(
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        mark.alias("code"),
        *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close")],
        F.when(F.col("amount") > 250000, F.lit("--")).otherwise(F.col("amount").cast("string"))
        .alias("amount"),
        F.col("volume").cast("string").alias("volume"),
        F.when(F.col("batch") == 1, F.col("volume") > 20).alias("is_trading"),
        F.when(F.col("batch") == 0, F.lit(100)).alias("lot_size"),
        F.col("batch").alias("_seq"),
    )


def _traded_price() -> Column:
    """Money over quantity; both sums are exact at cents, so the order of rows cannot matter."""
    return F.round(F.sum("l_extendedprice"), 2) / F.sum("l_quantity")


def benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average traded price per region and date."""
    where = master(spark, sf_dir).select("code", F.col("industry").alias("benchmark_key"))
    return trades(spark, sf_dir).join(where, "code").groupBy("date", "benchmark_key").agg(
        _traded_price().alias("close")
    )


def navs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One portfolio per nation: a value moving with its traded price, with a cash share."""
    where = master(spark, sf_dir).select(
        "code", F.col("nation").alias("portfolio_id"), F.col("industry").alias("profile")
    )
    return trades(spark, sf_dir).join(where, "code").groupBy(
        "portfolio_id", "profile", "date"
    ).agg(
        (900000.0 + 1000.0 * F.sqrt(_traded_price())).alias("nav"),
        F.round(F.avg("l_discount"), 8).alias("share"),
    ).withColumn("cash", F.col("nav") * F.col("share")).drop("share")


def membership_snapshots(spark: SparkSession, sf_dir: str, daily: DataFrame) -> DataFrame:
    """Securities with enough volume in a month, stamped with the month's last trading date."""
    daily = daily.select("code", "date", "volume")
    ends = labels.month_ends(daily).select(
        F.trunc("date", "month").alias("month"), F.col("date").alias("snapshot_date")
    )
    volume = F.col("volume")
    return (
        daily.groupBy("code", F.trunc("date", "month").alias("month"))
        .agg(F.sum("volume").alias("volume"))
        .where(volume >= MEMBER_VOLUME)
        .join(F.broadcast(ends), "month")
        .select(
            "snapshot_date", "code", F.concat(F.lit("S"), F.col("code")).alias("security_name"),
            F.when(volume >= LARGE_VOLUME, F.lit("large")).when(volume >= MID_VOLUME, F.lit("MID"))
            .otherwise(F.lit("SMALL")).alias("size_bucket"),
        )
    )


def raw_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First brand shipped per supplier and year, under vendor headers."""
    brand = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return (
        trades(spark, sf_dir).select("code", "date", "l_partkey").join(brand, "l_partkey")
        .groupBy(F.col("code").alias("股票代码"), F.trunc("date", "year").alias("纳入时间"))
        .agg(F.min("p_brand").alias("行业代码"), F.max("p_brand").alias("行业名称"),
             F.max(F.when(F.col("p_brand") == "Brand#9", F.lit("no"))).alias("flag"))
        .withColumn("is_point_in_time", F.coalesce(F.col("flag"), F.lit(" Yes ")))
        .drop("flag")
    )


def raw_dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted lines as dividends per ten shares."""
    return trades(spark, sf_dir).where(F.col("l_returnflag") == "A").select(
        "code",
        F.date_format("date", "yyyy-MM-dd").alias("除权除息日"),
        F.round(F.col("l_discount") * 10, 4).alias("送股"),
        F.when(F.col("l_linenumber") > 3, F.lit(0.5)).alias("转增"),
        F.round(F.col("l_tax") * 10, 4).cast("string").alias("派息"),
    )


def raw_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines as rights issues."""
    return trades(spark, sf_dir).where(F.col("l_returnflag") == "R").select(
        "code",
        F.when(F.col("l_quantity") > 1, F.date_format("date", "yyyy-MM-dd"))
        .otherwise(F.lit("pending")).alias("除权日"),
        F.round(F.col("l_discount") * 10, 4).alias("配股方案"),
        F.col("price").alias("配股价格"),
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer trades: returned lines are sales."""
    who = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("portfolio_id")
    )
    return _with_portfolio(trades(spark, sf_dir), who)


def _with_portfolio(trades: DataFrame, who: DataFrame) -> DataFrame:
    """Trades as fills of the portfolio that placed the order."""
    return trades.join(who, "l_orderkey").select(
        "portfolio_id", "date", "code",
        F.when(F.col("l_returnflag") == "R", F.lit("SELL")).otherwise(F.lit("BUY")).alias("side"),
        F.col("l_quantity").cast("long").alias("quantity"), "price",
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a raw security list with decorated codes; later `_seq` wins."""
    region = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    head = F.element_at(
        F.array(*[F.lit(p) for p in ("600", "300", "688", "830", "510")]),
        F.col("n_regionkey") + 1,
    )
    tail = F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0")
    plain = F.concat(head, tail)
    segment = F.col("c_mktsegment")
    code = (
        F.when(segment == "BUILDING", F.concat(F.lit("sh."), plain))
        .when(segment == "AUTOMOBILE", F.concat(plain, F.lit(".SZ")))
        .when(segment == "MACHINERY", F.concat(plain, F.lit(".0")))
        .when(segment == "HOUSEHOLD", F.concat(F.lit("  "), F.col("c_custkey"), F.lit(" ")))
        .otherwise(F.concat(F.lit("X"), plain))
    )
    name = (
        F.when(F.col("c_acctbal") < 0, F.concat(F.lit(" *st "), F.col("c_name")))
        .when(F.col("c_acctbal") > 9000, F.concat(F.lit("SST"), F.col("c_name")))
        .otherwise(F.col("c_name"))
    )
    return (
        table(spark, sf_dir, "customer")
        .join(F.broadcast(region), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(code.alias("代码"), name.alias("名称"), F.col("c_custkey").alias("_seq"))
    )


def vendor_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as a vendor would land them: native headers, text, turnover in percent."""
    return trades(spark, sf_dir).groupBy("code", "date").agg(
        F.min_by("price", "seq").alias("开盘"), F.max_by("price", "seq").alias("收盘"),
        F.max("price").alias("最高"), F.min("price").alias("最低"),
        F.sum("l_quantity").alias("成交量"),
        F.round(F.sum("l_extendedprice"), 2).alias("成交额"),
        F.round(F.avg("l_discount") * 100, 6).alias("换手率"),
    ).select(
        "code", F.date_format("date", "yyyy-MM-dd").alias("日期"),
        *[F.col(c).cast("string").alias(c) for c in ("开盘", "收盘", "最高", "最低", "成交量")],
        F.when(F.col("成交量") > 60, F.lit("-")).otherwise(F.col("成交额").cast("string"))
        .alias("成交额"),
        "换手率",
    )


def raw_feed(spark: SparkSession, sf_dir: str, daily: DataFrame) -> DataFrame:
    """Unadjusted bars of known securities and days with turnover as a fraction."""
    return daily.dropna(subset=["code", "date"]).select(*BAR, "turnover")


def adjusted_feed(spark: SparkSession, sf_dir: str, daily: DataFrame) -> DataFrame:
    """Prices adjusted by a tenth before 1998; the busiest days are missing."""
    factor = F.when(F.col("date") < F.lit("1998-01-01").cast("date"), 0.9).otherwise(1.0)
    return daily.where(F.col("volume") < 128).withColumns(
        {c: F.col(c) * factor for c in ("open", "high", "low", "close")}
    )


def status_feed(spark: SparkSession, sf_dir: str, daily: DataFrame) -> DataFrame:
    """Daily status of solvent suppliers, on days with an open line."""
    solvent = table(spark, sf_dir, "supplier").where(F.col("s_acctbal") >= 1000).select(
        pad_code("s_suppkey").alias("code")
    )
    return daily.where(F.col("state") == "O").join(solvent, "code", "left_semi").select(
        "code", F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.when(F.col("tax") >= 0.02, F.col("open") * 0.98).cast("string").alias("preclose"),
        F.when(F.col("tax") < 0.07, F.lit("1")).otherwise(F.lit("0")).alias("tradestatus"),
        F.when((F.col("flag") == "R") & (F.col("tax") == 0.03), F.lit("1")).otherwise(F.lit("0"))
        .alias("isST"),
    )


def rival_feeds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three feeds of bars per security and month, each built from one return flag."""
    lines = trades(spark, sf_dir)
    out = {}
    for name, flag in (("eastmoney", "R"), ("sina", "A"), ("tencent", "N")):
        feed = to_bars(lines.where(F.col("l_returnflag") == flag))
        out[name] = feed.withColumn("month", F.trunc("date", "month"))
    return out


def industry_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change log of industries: one entry per trade's part brand and type."""
    kind = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"
    )
    return trades(spark, sf_dir).join(kind, "l_partkey").select(
        "code", F.col("date").alias("change_date"), F.col("p_brand").alias("industry_code"),
        F.concat(F.lit(" "), "p_type").alias("industry_name"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("_seq"),
    )


def desk_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of one desk per customer nation. Orders get their desk first, so lines move once to meet it."""
    desk = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", F.col("n_name").alias("portfolio_id"))
    )
    who = table(spark, sf_dir, "orders").join(desk, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("l_orderkey"), "portfolio_id"
    )
    return _with_portfolio(trades(spark, sf_dir), who)


def desk_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one desk per customer nation, one row per day, security and side.

    A desk has few trades in a security a day, so they are dealt out before they are combined, and by code,
    as requests meet the bars.
    """
    rows = desk_fills(spark, sf_dir).repartition("code")
    return rows.groupBy("portfolio_id", "date", "code", "side").agg(
        F.sum("quantity").alias("quantity"), F.max("price").alias("score"),
    ).withColumn("is_full_exit", (F.col("side") == "SELL") & (F.col("quantity") >= 45))


def desk_holdings(spark: SparkSession, sf_dir: str, daily: DataFrame) -> DataFrame:
    """Securities a desk bought net in a month, dated to the month's last trading date."""
    rows = desk_fills(spark, sf_dir)
    ends = labels.month_ends(daily.select("date")).select(
        F.trunc("date", "month").alias("month"), F.col("date").alias("rebalance")
    )
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    # Dealt by desk and month: both the groups and the window below find their rows together.
    monthly = rows.select(
        "portfolio_id", "code", F.trunc("date", "month").alias("month"), "side", "quantity"
    ).repartition("portfolio_id", "month")
    net = monthly.groupBy("portfolio_id", "code", "month").agg(
        F.sum(signed).alias("quantity")
    ).where(F.col("quantity") > 0)
    total = F.sum("quantity").over(Window.partitionBy("portfolio_id", "month"))
    return net.withColumn("weight", F.col("quantity") / total).join(
        F.broadcast(ends), "month"
    ).select("portfolio_id", F.col("rebalance").alias("date"), "code", "quantity", "weight")
