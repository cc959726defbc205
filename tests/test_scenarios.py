"""Scenario portfolios against a day-by-day account."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.config import Costs
from barloom.operators import scenarios
from barloom.session import durable
from tests.helpers import day

INITIAL = 1000.0


def by_day(targets, prices, buy, sell):
    """Shares and cash of one scenario, valued at the last known price every market date."""
    dates = sorted(prices["date"].unique())
    trades = {}
    for signal in sorted(targets["date"].unique()):
        later = [d for d in dates if d > signal]
        if later:
            trades[later[0]] = dict(targets[targets["date"] == signal][["code", "target_weight"]].values)
    last, shares, cash, out, fees, turnover = {}, {}, INITIAL, [], 0.0, []
    started = False
    for d in dates:
        last.update(prices[prices["date"] == d][["code", "close"]].values)
        value = cash + sum(q * last[c] for c, q in shares.items())
        if d in trades:
            started = True
            want = {c: w * value for c, w in trades[d].items()}
            have = {c: q * last[c] for c, q in shares.items()}
            moved = {c: want.get(c, 0.0) - have.get(c, 0.0) for c in {*want, *have}}
            paid = sum(x * buy if x > 0 else -x * sell for x in moved.values())
            turnover.append(sum(map(abs, moved.values())) / value)
            fees += paid
            after = value - paid
            shares = {c: w * after / last[c] for c, w in trades[d].items()}
            cash = after - sum(shares[c] * last[c] for c in shares)
            value = after
        if started:
            out.append((d, value, cash))
    return out, fees, turnover


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(4)
    days = pd.bdate_range("2024-01-02", periods=75).date
    prices = pd.DataFrame(
        [(f"{c:06d}", d, float(10 * np.exp(rng.normal(0, 0.1)))) for c in range(6) for i, d in enumerate(days)
         if i == 0 or rng.random() < 0.6], columns=["code", "date", "close"])
    rows = []
    for s in range(4):
        for i in range(0, 70, 15 + s):
            picked = rng.choice(6, 3, replace=False)
            rows += [(f"s{s}", days[i], f"{c:06d}", 0.98 / 3) for c in picked]
    # A signal on a Sunday, and one of the last market date, which is never traded.
    rows += [("s0", day("2024-03-31"), "000001", 0.5), ("s1", days[-1], "000002", 0.5)]
    targets = pd.DataFrame(rows, columns=["scenario", "date", "code", "target_weight"])
    return targets, prices


def test_runs_equal_a_daily_account(spark, market):
    targets, prices = market
    frame = scenarios.with_rates(
        spark.createDataFrame(targets), Costs(commission_bps=30.0, sell_tax_bps=50.0), [0.0, 2.0]
    )
    got = {k: v.toPandas() for k, v in scenarios.run(
        frame, spark.createDataFrame(prices), INITIAL, durable).items()}
    buy, sell = scenarios.cost_rates(Costs(commission_bps=30.0, sell_tax_bps=50.0))
    for s, own in targets.groupby("scenario"):
        for k in (0, 2):
            name = f"{s}_cost{k}x"
            rows, fees, turnover = by_day(own, prices, k * buy, k * sell)
            nav = got["nav"][got["nav"]["portfolio_id"] == name].sort_values("date")
            assert nav["date"].tolist() == [r[0] for r in rows]
            np.testing.assert_allclose(nav["nav"], [r[1] for r in rows], rtol=1e-12)
            orders = got["orders"][got["orders"]["portfolio_id"] == name]
            assert orders["fees"].sum() == pytest.approx(fees)
            turns = got["rebalances"][got["rebalances"]["portfolio_id"] == name].sort_values("execution_date")
            np.testing.assert_allclose(turns["turnover"], turnover, rtol=1e-10)
            # The cash of a period is what trading left over at its start.
            starts = nav[nav["date"].isin(set(turns["execution_date"]))]
            np.testing.assert_allclose(
                starts["cash"], [r[2] for r in rows if r[0] in set(turns["execution_date"])], rtol=1e-10)


def test_entries_and_exits(spark, market):
    targets, prices = market
    frame = scenarios.with_rates(spark.createDataFrame(targets), Costs(), [1.0]).where("scenario = 's3_cost1x'")
    turns = scenarios.run(frame, spark.createDataFrame(prices), INITIAL, durable)["rebalances"].toPandas()
    sets = [set(g["code"]) for _, g in sorted(targets[targets["scenario"] == "s3"].groupby("date"))]
    want = [(len(b - a), len(a - b)) for a, b in zip([set(), *sets], sets)]
    turns = turns.sort_values("execution_date")
    assert list(zip(turns["entered_count"], turns["exited_count"])) == want


def test_unpriced_holdings_keep_their_value_and_no_targets_give_no_rows(spark):
    prices = spark.createDataFrame(
        [("000001", day("2024-01-02"), 10.0), ("000001", day("2024-01-03"), 10.0),
         ("000001", day("2024-01-04"), 20.0), ("000002", day("2024-01-04"), 5.0)],
        "code string, date date, close double")
    targets = spark.createDataFrame(
        [("a", day("2024-01-02"), "000001", 0.5), ("a", day("2024-01-02"), "000002", 0.5)],
        "scenario string, date date, code string, target_weight double")
    frame = scenarios.with_rates(targets, Costs(), [0.0])
    nav = scenarios.run(frame, prices, INITIAL, durable)["nav"].orderBy("date").collect()
    assert [r["nav"] for r in nav] == pytest.approx([1000.0, 1500.0])
    empty = scenarios.run(frame.where(F.lit(False)), prices, INITIAL, durable)
    assert all(df.count() == 0 for df in empty.values())


def test_holdings_inside_the_band_keep_their_weight(spark):
    selected = spark.createDataFrame(
        [("x", "p", day("2024-01-02"), c, 0.5) for c in ("000001", "000002")],
        "scenario string, portfolio_id string, date date, code string, target_weight double")
    weights = spark.createDataFrame(
        [("p", day("2024-01-02"), "000001", 0.54), ("p", day("2024-01-02"), "000003", 0.3)],
        "portfolio_id string, date date, code string, weight double")
    out = scenarios.banded(selected, weights, [0.01, 0.1], 1.0).toPandas().set_index(["scenario", "code"])
    assert out.loc[("p/x_band0.010", "000001"), "target_weight"] == 0.5
    assert out.loc[("p/x_band0.100", "000001"), "target_weight"] == pytest.approx(0.54 / 1.04)
    assert len(out) == 4
