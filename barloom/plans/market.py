"""Lazily built tables shared by the registered queries of one session and data folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from barloom.operators import pit, scoring
from barloom.plans import research
from barloom.session import durable, durable_by
from barloom.sources import fixtures

# The second ranker of the reports.
MOMENTUM_WEIGHTS = {"momentum_20_5_z": 0.5, "momentum_60_5_z": 0.5}
SCORES = ["baseline_score", "momentum_score"]
# Fixture views built on the bar table, and those that read more of a day.
FROM_BARS = {"dirty_bars", "membership_snapshots", "adjusted_feed", "desk_holdings"}
FROM_DAYS = {"raw_feed", "status_feed"}


class Market:
    """Derived tables of one data folder; those that many queries read are written once."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._kept: dict[str, DataFrame] = {}
        self._fitted: dict[str, object] = {}

    def table(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)

    def view(self, name: str) -> DataFrame:
        if name in FROM_BARS:
            return getattr(fixtures, name)(self.spark, self.sf_dir, self.bars)
        if name in FROM_DAYS:
            return getattr(fixtures, name)(self.spark, self.sf_dir, self.days)
        return getattr(fixtures, name)(self.spark, self.sf_dir)

    @property
    def bars(self) -> DataFrame:
        """Daily bars as landed in storage."""
        if "days" in self._kept:
            return self.days.select(*fixtures.BAR)
        return self.keep("bars", lambda: fixtures.bars(self.spark, self.sf_dir), by="code")

    @property
    def days(self) -> DataFrame:
        """Daily bars with what the other feeds of a day read."""
        return self.keep("days", lambda: fixtures.days(self.spark, self.sf_dir), by="code")

    @property
    def panel(self) -> DataFrame:
        """Landed bars with the attributes of their securities and their membership on the day."""
        def build() -> DataFrame:
            # Membership first: bars lie by code and stay so for the attributes.
            members = pit.point_in_time_membership(self.bars, self.membership, padded=True)
            return fixtures.panel(self.spark, self.sf_dir, members)

        return self.keep("panel", build, by="code")

    @property
    def membership(self) -> DataFrame:
        """Membership intervals as landed in storage."""
        return self.keep(
            "membership", lambda: pit.compress_snapshots(self.view("membership_snapshots"))
        )

    def keep(self, name: str, build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        """A table that several queries read, written to the shared folder on first use, in buckets of `by`."""
        if name not in self._kept:
            self._kept[name] = durable_by(build(), by) if by else durable(build())
        return self._kept[name]

    @property
    def desk_holdings(self) -> DataFrame:
        """Monthly holdings of the desks as landed in storage."""
        return self.keep("desk_holdings", lambda: self.view("desk_holdings"))

    def fitted(self, name: str, build: Callable):
        """A model that several queries use, fitted on first use."""
        if name not in self._fitted:
            self._fitted[name] = build()
        return self._fitted[name]

    def forget(self, landed: tuple[str, ...] = ()) -> None:
        """Build the written tables and models anew on next use, all but the landed ones named."""
        self._fitted = {}
        self._kept = {k: v for k, v in self._kept.items() if k in landed}

    @property
    def month_end(self) -> DataFrame:
        return self.keep(
            "month_end", lambda: research.month_end_frame(self.panel)
        )

    @property
    def predictions(self) -> DataFrame:
        def build() -> DataFrame:
            scored = scoring.add_score(
                research.research_dataset(self.month_end)
            )
            return scoring.add_score(scored, "momentum_score", MOMENTUM_WEIGHTS)

        return self.keep("predictions", build)


_OPEN: dict[tuple[str, str], Market] = {}


def market(spark: SparkSession, sf_dir: str) -> Market:
    key = (spark.sparkContext.applicationId, str(sf_dir).rstrip("/"))
    if key not in _OPEN:
        _OPEN[key] = Market(spark, key[1])
    return _OPEN[key]
