"""Forward labels and month-end sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import cross, rolling
from barloom.functions.scalars import ratio


def month_ends(df: DataFrame, date: str = "date") -> DataFrame:
    """Last observed date of each month; at most one row per month, found by partial aggregation."""
    return df.groupBy(F.trunc(F.col(date), "month").alias("_month")).agg(
        F.max(date).alias(date)
    ).select(date)


def sample_month_ends(df: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Keep the rows of the last date of each month; the calendar is at most one row per month."""
    days = month_ends(df if calendar is None else calendar)
    return df.join(F.broadcast(days), "date", "left_semi")


def forward_prices(df: DataFrame, horizon_days: int) -> DataFrame:
    """Entry at the next open, exit at the close `horizon_days` rows ahead."""
    w = rolling.by_code()
    return df.withColumns(
        {
            "entry_open": F.lead("open", 1).over(w),
            "exit_close": F.lead("close", horizon_days).over(w),
            "label_end_date": F.lead("date", horizon_days).over(w),
        }
    ).withColumn("forward_return", ratio("exit_close", "entry_open") - 1.0)


def rank_targets(df: DataFrame, written: bool = False) -> DataFrame:
    """Excess over the median forward return of the date, its percentile and a 0..4 grade.

    `written` as in `cross.average_rank`.
    """
    df = cross.with_quantiles(df, ["date"], ["forward_return"], [0.5])
    df = df.withColumnRenamed("forward_return__q0", "benchmark_forward_return").withColumn(
        "target_excess_return", F.col("forward_return") - F.col("benchmark_forward_return")
    )
    df = cross.percent_rank_average(
        df, ["date"], "target_excess_return", "target_rank", written
    )
    grade = F.least(F.floor(F.col("target_rank") * 5), F.lit(4)).cast("int")
    return df.withColumn("relevance", F.when(F.col("target_rank").isNotNull(), grade))


def forward_labels(bars: DataFrame, horizon_days: int) -> DataFrame:
    """Labels for every row."""
    return rank_targets(forward_prices(bars, horizon_days))
