"""Bar validation: coercion, duplicate removal, price rules, defaults and the quality report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import finite, normalize_symbol
from barloom.schemas import BAR_REQUIRED, require_columns

NUMERIC = [
    "open", "high", "low", "close", "volume", "amount", "turnover", "market_cap",
    "raw_open", "raw_close", "limit_up", "limit_down",
]


def number(x: Column | str) -> Column:
    """Double from any representation; text that is no number, NaN and infinities become null."""
    x = F.col(x) if isinstance(x, str) else x
    return finite(x.try_cast("double"))


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key in ingest order, with `_copies`, the number of rows it stands for.

    Aggregation combines copies before the shuffle, so a key repeated very often stays cheap.
    """
    rest = [c for c in df.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), F.struct(*order)) if rest else F.lit(None)
    packed = df.groupBy(*keys).agg(latest.alias("_row"), F.count(F.lit(1)).alias("_copies"))
    return packed.select(*keys, *[F.col("_row")[c].alias(c) for c in rest], "_copies")


def coerce(raw: DataFrame) -> DataFrame:
    """Canonical code, day, and doubles."""
    typed = {"code": normalize_symbol("code"), "date": F.col("date").try_cast("date")}
    typed.update({c: number(c) for c in NUMERIC if c in raw.columns})
    return raw.withColumns(typed)


def price_rules() -> Column:
    """Every rule a bar must pass; a missing value fails."""
    prices = ["open", "high", "low", "close"]
    tests = [F.col("date").isNotNull(), F.col("code").rlike(r"^\d{6}$")]
    tests += [F.col(c) > 0 for c in prices]
    tests += [F.col(c) >= 0 for c in ("volume", "amount")]
    tests += [F.col("high") >= F.greatest("open", "close", "low")]
    tests += [F.col("low") <= F.least("open", "close", "high")]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def checked_bars(
    raw: DataFrame, *, default_lot_size: int = 100, order: str = "_seq"
) -> DataFrame:
    """Last row per (date, code) with defaults filled, `_copies` and `_valid`.

    Duplicates go first: an invalid later row removes a valid earlier one. Without an ingest order
    column the rows must be unique already.
    """
    require_columns(raw, BAR_REQUIRED, "Market data")
    df = coerce(raw)
    if order in df.columns:
        df = keep_last(df, ["date", "code"], [order])
    else:
        df = df.withColumn("_copies", F.lit(1).cast("long"))
    traded = (F.col("volume") > 0) & (F.col("amount") > 0)
    known = set(df.columns)

    def flag(name: str, missing: Column) -> Column:
        return F.coalesce(F.col(name).cast("boolean"), F.lit(False)) if name in known else missing

    lot = number("lot_size") if "lot_size" in known else F.lit(None).cast("double")
    return df.withColumns(
        {
            "_valid": price_rules(),
            "is_trading": flag("is_trading", traded),
            "is_st": flag("is_st", F.lit(False)),
            "industry": F.coalesce(F.col("industry").cast("string"), F.lit("UNKNOWN"))
            if "industry" in known else F.lit("UNKNOWN"),
            "lot_size": F.greatest(F.coalesce(lot, F.lit(float(default_lot_size))), F.lit(1.0))
            .cast("int"),
        }
    )


def clean_bars(raw: DataFrame, *, default_lot_size: int = 100, order: str = "_seq") -> DataFrame:
    """Valid bars, unique on (date, code)."""
    checked = checked_bars(raw, default_lot_size=default_lot_size, order=order)
    return checked.where("_valid").drop("_valid", "_copies", order)


def data_quality(checked: DataFrame) -> DataFrame:
    """One-row report over `checked_bars`; distinct codes are counted in two stages."""
    valid = F.col("_valid")
    per_code = checked.groupBy("code").agg(
        F.count_if(valid).alias("rows"),
        F.min(F.when(valid, F.col("date"))).alias("first"),
        F.max(F.when(valid, F.col("date"))).alias("last"),
        F.sum(F.col("_copies") - 1).alias("dups"),
        F.count_if(~valid).alias("bad"),
        F.count_if(valid & ~F.col("is_trading")).alias("idle"),
    )
    return per_code.agg(
        F.sum("rows").alias("rows"),
        F.count_if(F.col("rows") > 0).alias("symbols"),
        F.min("first").alias("start_date"),
        F.max("last").alias("end_date"),
        F.sum("dups").alias("duplicate_rows_removed"),
        F.sum("bad").alias("invalid_rows_removed"),
        F.sum("idle").alias("non_trading_rows"),
    )
