"""Named queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.plans.market import Market, market


@dataclass(frozen=True)
class Query:
    build: Callable[[Market], DataFrame]
    plain: list[str]
    measures: dict[str, int]

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(market(spark, sf_dir))
        return df.select(
            *self.plain, *[_rounded(name, digits) for name, digits in self.measures.items()]
        )


def _rounded(name: str, digits: int) -> Column:
    """Half-even on the scaled double, which every IEEE engine computes alike; -0.0 becomes 0.0."""
    scale = F.lit(float(10**digits))
    return (F.rint(F.col(name).cast("double") * scale) / scale + F.lit(0.0)).alias(name)


QUERIES: dict[str, Query] = {}


def query(name: str, plain: str, measures: str = "", digits: int = 6):
    """Register a query: plain columns, and measures rounded to `digits` or their own `name:n`."""
    parts = [m.partition(":") for m in measures.split()]
    shape = {name: int(own) if own else digits for name, _, own in parts}

    def add(build: Callable[[Market], DataFrame]):
        QUERIES[name] = Query(build, plain.split(), shape)
        return build

    return add
