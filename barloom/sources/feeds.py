"""Landed vendor tables to canonical columns, and the choice between rival feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import normalize_symbol
from barloom.operators.clean import number
from barloom.schemas import require_columns
from barloom.sources.writers import upsert

# Vendor headers of daily history, listings and index constituents.
HISTORY_ALIASES = {
    "日期": "date",
    "开盘": "open",
    "收盘": "close",
    "最高": "high",
    "最低": "low",
    "成交量": "volume",
    "成交额": "amount",
    "振幅": "amplitude",
    "涨跌幅": "pct_change",
    "涨跌额": "price_change",
    "换手率": "turnover",
}
LISTING_ALIASES = {
    "code": ["code", "代码", "证券代码"],
    "security_name": ["name", "名称", "证券简称"],
}
CONSTITUENT_ALIASES = {
    "日期": "snapshot_date",
    "指数代码": "index_code",
    "指数名称": "index_name",
    "成分券代码": "code",
    "成分券名称": "security_name",
    "交易所": "exchange_name",
}
MEASURES = [
    "open", "high", "low", "close", "volume", "amount", "turnover", "amplitude", "pct_change",
    "price_change",
]
# Order in which rival feeds are trusted.
FEED_PRIORITY = ["eastmoney", "sina", "tencent"]


def normalize_history(
    raw: DataFrame, *, turnover_is_percent: bool = False, index: bool = False
) -> DataFrame:
    """Vendor history as dates and doubles.

    Index feeds without volume report it as amount: it moves to volume and amount becomes 0.
    """
    df = raw.withColumnsRenamed(HISTORY_ALIASES)
    if index and "volume" not in df.columns and "amount" in df.columns:
        df = df.withColumnRenamed("amount", "volume").withColumn("amount", F.lit(0.0))
    require_columns(
        df, ["date", "open", "high", "low", "close", "volume", "amount"], "Vendor history"
    )
    typed = {c: number(c) for c in MEASURES if c in df.columns}
    if turnover_is_percent and "turnover" in typed:
        typed["turnover"] = typed["turnover"] / 100.0
    return df.withColumns({"date": F.col("date").try_cast("date"), **typed})


def resolve_listing(raw: DataFrame) -> DataFrame:
    """Code and name from whichever of the known headers the listing uses."""
    chosen = {}
    for target, names in LISTING_ALIASES.items():
        present = [n for n in names if n in raw.columns]
        if not present:
            raise ValueError(f"Unrecognized security-master columns: {raw.columns}")
        chosen[target] = F.col(present[0])
    extra = ["_seq"] if "_seq" in raw.columns else []
    return raw.select(
        normalize_symbol(chosen["code"]).alias("code"),
        F.trim(chosen["security_name"]).alias("security_name"), *extra,
    )


def resolve_constituents(raw: DataFrame, index_code: str) -> DataFrame:
    """Index constituents with canonical codes; the snapshot defaults to today."""
    df = raw.withColumnsRenamed(CONSTITUENT_ALIASES)
    require_columns(df, ["code", "security_name"], "Constituents")
    index = F.col("index_code") if "index_code" in df.columns else F.lit(index_code)
    day = (
        F.col("snapshot_date").try_cast("date")
        if "snapshot_date" in df.columns else F.current_date()
    )
    return df.withColumns(
        {"code": normalize_symbol("code"), "index_code": normalize_symbol(index),
         "snapshot_date": day}
    )


def resolve_sources(feeds: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """For each request take all rows of the first feed, in dict order, that has any."""
    rows = None
    for place, (name, feed) in enumerate(feeds.items()):
        tagged = feed.withColumns({"_place": F.lit(place), "source_endpoint": F.lit(name)})
        rows = tagged if rows is None else rows.unionByName(tagged, allowMissingColumns=True)
    best = F.min("_place").over(Window.partitionBy(*keys))
    return rows.withColumn("_best", best).where(F.col("_place") == F.col("_best")).drop(
        "_place", "_best"
    )


def assemble_benchmarks(
    feeds: dict[str, DataFrame], existing: DataFrame | None = None, *, source: str = "landed"
) -> DataFrame:
    """Tag and stack index histories and lay them over the stored table."""
    rows = None
    for key, feed in feeds.items():
        tagged = feed.withColumn("benchmark_key", F.lit(key))
        rows = tagged if rows is None else rows.unionByName(tagged, allowMissingColumns=True)
    return lay_benchmarks(rows, existing, source=source)


def lay_benchmarks(
    feed: DataFrame, existing: DataFrame | None = None, *, source: str = "landed"
) -> DataFrame:
    """Index histories that carry their key, laid over the stored table in one step."""
    tagged = feed.withColumn("source", F.lit(source))
    return tagged if existing is None else upsert(existing, tagged, ["date", "benchmark_key"])


def common_window(benchmarks: DataFrame, start: str, end: str) -> DataFrame:
    """Requested window limited to the dates the benchmarks cover."""
    return benchmarks.agg(
        F.greatest(F.lit(start).cast("date"), F.min("date")).alias("expected_start"),
        F.least(F.lit(end).cast("date"), F.max("date")).alias("expected_end"),
    )
