"""All registered queries; importing the modules fills the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import cross
from barloom.operators import factors, labels
from barloom.plans import (  # noqa: F401
    boosting_queries, data_queries, order_queries, performance_queries, report_queries, research_queries,
    storage_queries,
)
from barloom.plans.market import market
from barloom.registry import QUERIES  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """The `k` strongest momentum names among the securities of each month end."""
    m = market(spark, sf_dir)
    ranked = labels.sample_month_ends(factors.add_momentum(m.bars), m.bars)
    return cross.top_k(
        ranked.where(F.col("momentum_60_5").isNotNull()), ["date"],
        [F.col("momentum_60_5").desc(), F.col("code")], k,
    ).select("date", "code", "rank", F.round("momentum_60_5", 6).alias("momentum_60_5"))
