"""Selection, weights, orders and ledgers."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.config import Costs, Portfolio
from barloom.operators import orders, portfolio
from barloom.session import durable_by
from tests.helpers import day, plan, rows

FREE = Costs(commission_bps=0, minimum_commission=0, sell_tax_bps=0, transfer_bps=0, slippage_bps=0)


def ranked(spark, industry, bucket=None):
    n = len(industry)
    pdf = pd.DataFrame(
        {"date": day("2024-01-31"), "code": [f"{i:06d}" for i in range(n)],
         "score": [float(n - i) for i in range(n)], "industry": industry, "tradable": True})
    if bucket:
        pdf["size_bucket"] = bucket
    return spark.createDataFrame(pdf)


def select(spark, table, held, policy, **more):
    books = spark.createDataFrame([("p", day("2024-01-31"))], "portfolio_id string, date date")
    holdings = spark.createDataFrame(
        [("p", day("2024-01-31"), c) for c in held],
        "portfolio_id string, date date, code string")
    return portfolio.select_portfolios(table, books, holdings, policy, **more).toPandas()


def test_industry_cap(spark):
    policy = Portfolio(top_k=8, entry_rank=12, exit_rank=12, max_stock_weight=0.2,
                       max_industry_weight=0.5)
    out = select(spark, ranked(spark, ["BANK"] * 8 + ["TECH"] * 4), [], policy)
    assert len(out) == 8 and out["industry"].value_counts().max() == 4


def test_undersized_universe_fails_or_is_skipped(spark):
    policy = Portfolio(top_k=3, entry_rank=3, exit_rank=4, max_stock_weight=0.5)
    table = ranked(spark, ["BANK", "PROPERTY"])
    with pytest.raises(Exception, match="TOO_FEW_CANDIDATES"):
        select(spark, table, [], policy)
    out = select(spark, table, [], policy, strict=False)
    assert out["status"].tolist() == ["TOO_FEW_CANDIDATES"] and out["code"].isna().all()
    line = portfolio.preflight(table, policy).first()
    assert line["violation"] == "TOO_FEW_CANDIDATES"


def test_unknown_industries_switch_the_cap_off(spark):
    policy = Portfolio(top_k=10, entry_rank=10, exit_rank=15, max_stock_weight=0.1)
    out = select(spark, ranked(spark, ["UNKNOWN"] * 20), [], policy)
    assert len(out) == 10
    assert out["target_weight"].sum() == pytest.approx(0.98, abs=1e-9)


def test_buffer_that_never_exits_is_rejected(spark):
    policy = Portfolio(top_k=2, entry_rank=2, exit_rank=3, max_stock_weight=0.5,
                       max_industry_weight=1.0)
    with pytest.raises(Exception, match="EXIT_RANK_NOT_BELOW_POOL"):
        select(spark, ranked(spark, ["BANK", "TECH", "UTILITY"]), ["000000", "000001"], policy)


def test_mid_caps_limit_count_and_weight(spark):
    policy = Portfolio(top_k=5, entry_rank=10, exit_rank=10, max_stock_weight=0.4,
                       max_industry_weight=1.0, weighting_method="score_tilt")
    out = select(spark, ranked(spark, [f"I{i}" for i in range(10)], ["MID"] * 5 + ["LARGE"] * 5),
                 [], policy)
    assert out["size_bucket"].value_counts().to_dict() == {"MID": 3, "LARGE": 2}
    assert out[out.size_bucket == "MID"]["target_weight"].sum() <= 0.70 + 1e-9


def test_replacements_are_limited(spark):
    policy = Portfolio(top_k=5, entry_rank=5, exit_rank=6, max_stock_weight=0.2,
                       max_industry_weight=1.0, max_replacements_per_rebalance=1,
                       min_replacement_rank_improvement=3)
    held = {f"{i:06d}" for i in range(5, 10)}
    chosen = set(select(spark, ranked(spark, ["UNKNOWN"] * 20), held, policy)["code"])
    assert len(chosen - held) == 1 and len(held - chosen) == 1 and "000000" in chosen


def reference_choice(table, held, policy, cap, mids):
    """Plain sequential selection over the whole table, for comparison with the bounded pool."""
    t = table.sort_values("rank")
    keep = t[t.code.isin(held)].head(policy.top_k).code.tolist()
    entry = [c for c in t[t["rank"] <= policy.entry_rank].code if c not in keep]
    room = policy.top_k - len(keep)
    keep, entry = keep + entry[:room], entry[room:]
    rank = dict(zip(t.code, t["rank"]))
    done = 0
    for c in entry:
        worst = max(keep, key=rank.get)
        if done >= policy.max_replacements_per_rebalance or rank[worst] <= policy.exit_rank:
            break
        if rank[worst] - rank[c] >= policy.min_replacement_rank_improvement:
            keep[keep.index(worst)] = c
            done += 1
    first = sorted(keep, key=lambda c: (c not in held, rank[c]))
    info = t.set_index("code")
    out, used, mid = [], {}, 0
    for c in [*first, *[c for c in t.code if c not in keep]]:
        ind, m = info.loc[c, "industry"], info.loc[c, "size_bucket"] == "MID"
        if used.get(ind, 0) >= cap or (m and mid >= mids) or len(out) == policy.top_k:
            continue
        out.append(c)
        used[ind] = used.get(ind, 0) + 1
        mid += m
    return out


@pytest.mark.parametrize("seed", range(4))
def test_bounded_pool_gives_the_choice_over_the_whole_market(spark, seed):
    rng = np.random.default_rng(seed)
    n = 400
    # One industry and one size hold most of the market, so quotas bind deep down the list.
    pdf = pd.DataFrame(
        {"date": day("2024-01-31"), "code": [f"{i:06d}" for i in rng.permutation(n)],
         "score": rng.permutation(n).astype(float),
         "industry": rng.choice(["A", "B", "C", "D"], n, p=[0.85, 0.05, 0.05, 0.05]),
         "size_bucket": rng.choice(["MID", "LARGE", "SMALL"], n, p=[0.8, 0.1, 0.1]),
         "tradable": rng.random(n) < 0.9, "idio_vol_60": rng.random(n) + 0.1})
    policy = Portfolio(top_k=6, entry_rank=6, exit_rank=9, max_stock_weight=0.5,
                       max_industry_weight=0.34, max_replacements_per_rebalance=3,
                       min_replacement_rank_improvement=2, max_mid_cap_weight=0.9,
                       weighting_method="inverse_volatility")
    pdf["rank"] = pdf["score"].rank(ascending=False).astype(int)
    live = pdf[pdf.tradable]
    held = set(rng.choice(live.code, 9, replace=False))
    want = reference_choice(live, held, policy, portfolio.industry_cap(policy),
                            portfolio.mid_cap(policy))
    out = select(spark, spark.createDataFrame(pdf.drop(columns="rank")), held, policy, strict=False)
    large = pdf[pdf.code.isin(want)]["size_bucket"].eq("LARGE").sum()
    if len(want) < policy.top_k or large < policy.top_k - portfolio.mid_cap(policy):
        assert len(out) == 1 and out["status"].item() in ("QUOTAS_EXHAUSTED", "LARGE_SHORTAGE")
    else:
        assert set(out["code"]) == set(want)
        assert out["target_weight"].sum() == pytest.approx(0.98, abs=1e-8)


def test_sweep_counts_every_scenario(spark):
    table = ranked(spark, ["UNKNOWN"] * 20)
    books = spark.createDataFrame([("p", day("2024-01-31"))], "portfolio_id string, date date")
    holdings = spark.createDataFrame(
        [("p", day("2024-01-31"), f"{i:06d}", 0.2) for i in range(5, 10)],
        "portfolio_id string, date date, code string, weight double")
    policy = Portfolio(top_k=5, entry_rank=5, exit_rank=6, max_stock_weight=0.2)
    got = rows(portfolio.parameter_sweep(table, books, holdings, policy, exit_ranks=[6, 12],
                                         replacements=[1, 2], bands=[0.01]),
               "exit_rank", "max_replacements", "entered")
    assert got == [(6, 1, 1), (6, 2, 2), (12, 1, 0), (12, 2, 0)]


def test_sweep_counts_books_it_cannot_fill(spark):
    table = ranked(spark, ["UNKNOWN"] * 8)
    books = spark.createDataFrame([("p", day("2024-01-31"))], "portfolio_id string, date date")
    holdings = spark.createDataFrame(
        [("p", day("2024-01-31"), "000001", 1.0)],
        "portfolio_id string, date date, code string, weight double")
    policy = Portfolio(top_k=5, entry_rank=5, exit_rank=6, max_stock_weight=0.2)
    got = rows(portfolio.parameter_sweep(table, books, holdings, policy, exit_ranks=[6, 12],
                                         replacements=[1], bands=[0.01]),
               "exit_rank", "books", "infeasible", "positions")
    assert got == [(6, 1, 0, 5), (12, 0, 1, 0)]


def test_groups_of_a_date_share_its_candidates(spark, monkeypatch):
    monkeypatch.setattr(portfolio, "BOOKS_PER_GROUP", 2)
    on = day("2024-01-31")
    table = ranked(spark, ["UNKNOWN"] * 20)
    books = spark.createDataFrame([(f"p{i}", on) for i in range(9)],
                                  "portfolio_id string, date date")
    holdings = spark.createDataFrame(
        [(f"p{i}", on, f"{5 + i:06d}") for i in range(9)],
        "portfolio_id string, date date, code string")
    policy = Portfolio(top_k=3, entry_rank=3, exit_rank=19, max_stock_weight=0.5)
    out = portfolio.select_portfolios(table, books, holdings, policy).toPandas()
    assert set(out["status"]) == {"SELECTED"} and len(out) == 27
    kept = out[out["held"]].set_index("portfolio_id")["code"].to_dict()
    assert kept == {f"p{i}": f"{5 + i:06d}" for i in range(9)}


def test_weights_respect_every_cap():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(2, 12))
        industry, mid = rng.choice(list("ABC"), n), rng.random(n) < 0.5
        got = portfolio.water_fill(rng.random(n), industry, mid, target=0.98, stock=0.3,
                                   per_industry=0.5, mid=0.6)
        per = pd.Series(got).groupby(industry).sum()
        assert got.max() <= 0.3 + 1e-9 and per.max() <= 0.5 + 1e-9
        assert got[mid].sum() <= 0.6 + 1e-9 and got.sum() <= 0.98 + 1e-9
    # One capped name: the rest shares what it leaves in proportion.
    got = portfolio.water_fill(np.array([6.0, 2.0, 1.0]), np.array(["A", "B", "C"]),
                               np.zeros(3, bool), target=0.9, stock=0.5, per_industry=1, mid=1)
    assert got == pytest.approx([0.5, 0.8 / 3, 0.4 / 3])


def test_policy_ranges():
    for field, value in (("initial_cash", 0.0), ("cash_buffer", 1.0), ("min_trade_value", -1.0),
                         ("rebalance_weight_tolerance", 1.0), ("entry_rank", 49)):
        with pytest.raises(ValueError, match=field):
            Portfolio(**{field: value}).check()


def test_selected_plan_gates_on_the_last_bar(spark):
    on = day("2024-03-29")
    codes = [f"00000{i}" for i in range(1, 7)]
    scores = spark.createDataFrame([(on, c, 10.0 - i) for i, c in enumerate(codes)],
                                   "date date, code string, x_score double")
    # The best name is suspended, the second ST; the others can be bought.
    bars = spark.createDataFrame(
        [(on, c, 10.0, "IND", 100, i != 0, i == 1) for i, c in enumerate(codes)],
        "date date, code string, close double, industry string, lot_size int, "
        "is_trading boolean, is_st boolean")
    held = spark.createDataFrame([("p", "000006", 1000), ("q", "000001", 50)],
                                 "portfolio_id string, code string, quantity long")
    cash = spark.createDataFrame([("p", 100_000.0), ("q", 100_000.0)],
                                 "portfolio_id string, cash double")
    policy = Portfolio(top_k=2, entry_rank=2, exit_rank=3, max_stock_weight=0.5,
                       max_industry_weight=1.0)
    plan = portfolio.selected_order_plan(scores, bars, held, cash, policy, Costs(), "x_score")
    got = {(r.portfolio_id, r.code): r.action for r in plan.collect()}
    assert got[("q", "000003")] == "BUY" and got[("q", "000001")] == "SELL"
    assert ("p", "000001") not in got and ("q", "000002") not in got
    tight = Portfolio(top_k=5, entry_rank=5, exit_rank=6, max_stock_weight=0.5)
    failed = portfolio.selected_order_plan(scores, bars, held, cash, tight, Costs(), "x_score")
    assert {(r.portfolio_id, r.code, r.action, r.reason) for r in failed.collect()} == {
        (p, None, "REVIEW", "TOO_FEW_CANDIDATES") for p in "pq"}


def test_order_plan_sells_departures_and_buys_targets(spark):
    on = day("2024-03-29")
    scores = spark.createDataFrame(
        [(on, "000001", 3.0), (on, "000002", 2.0), (on, "000003", 1.0)],
        "date date, code string, x_score double")
    bars = spark.createDataFrame(
        [(on, f"00000{i}", 10.0, "IND", 100) for i in (1, 2, 3)],
        "date date, code string, raw_close double, industry string, lot_size int"
    ).withColumn("close", F.col("raw_close"))
    held = spark.createDataFrame(
        [("p", "000003", 100), ("p", "999999", 5)],
        "portfolio_id string, code string, quantity long")
    targets = spark.createDataFrame(
        [("p", "000001", 0.45), ("p", "000002", 0.45)],
        "portfolio_id string, code string, target_weight double")
    cash = spark.createDataFrame([("p", 99_000.0)], "portfolio_id string, cash double")
    plan = portfolio.order_plan(scores, bars, held, targets, cash, Portfolio(), Costs(), "x_score")
    got = {r["code"]: (r["action"], r["order_quantity"]) for r in plan.collect()}
    assert got == {"000003": ("SELL", 100), "000001": ("BUY", 4500), "000002": ("BUY", 4500),
                   "999999": ("REVIEW", None)}
    line = portfolio.order_plan_summary(plan).first()
    assert line["estimated_equity"] == 100_000 and line["target_positions"] == 2
    assert line["target_exposure"] == pytest.approx(0.9)


def test_signals_execute_on_the_next_trading_day(spark):
    days = spark.createDataFrame(
        [(day(d),) for d in ("2024-01-31", "2024-02-01", "2024-03-01")], "date date")
    signals = spark.createDataFrame(
        [(day("2024-01-31"), "a"), (day("2024-02-29"), "a"), (day("2024-03-01"), "a")],
        "date date, code string")
    assert rows(orders.schedule_signals(signals, days), "signal_date", "execution_date") == [
        (day("2024-01-31"), day("2024-02-01")), (day("2024-02-29"), day("2024-03-01"))]


def fills(spark, data):
    return spark.createDataFrame(
        data, "portfolio_id string, date date, code string, side string, quantity long, "
        "price double")


def test_actions_book_dividends_bonus_and_rights(spark):
    spans = orders.position_spans(orders.daily_flows(
        fills(spark, [("p", day("2024-02-01"), "000001", "BUY", 10_000, 10.0)]), FREE))
    actions = spark.createDataFrame(
        [("000001", day("2024-02-05"), 0.2, 0.1, 0.3, 8.0),
         ("000001", day("2024-02-01"), 9.0, 9.0, 9.0, 9.0)],
        "code string, ex_date date, cash_dividend_per_share double, bonus_share_ratio double, "
        "rights_share_ratio double, rights_price double")
    got = orders.action_bookings(actions, spans).collect()
    assert len(got) == 1
    row = got[0]
    assert (row["quantity_before"], row["cash_dividend"], row["bonus_quantity"],
            row["quantity_after"], row["rights_eligible_quantity"], row["rights_policy"]) == (
        10_000, 2000.0, 1000, 11_000, 3000, "NOT_SUBSCRIBED")


def test_ledger_carries_positions_and_prices_forward(spark):
    bars = spark.createDataFrame(
        [(day("2024-01-02"), "a", 10.0), (day("2024-01-04"), "a", 12.0),
         (day("2024-01-02"), "b", 5.0)], "date date, code string, close double")
    flows = orders.daily_flows(fills(spark, [
        ("p", day("2024-01-02"), "a", "BUY", 10, 10.0),
        ("p", day("2024-01-03"), "b", "BUY", 4, 5.0),
        ("p", day("2024-01-05"), "a", "SELL", 10, 12.0)]), FREE)
    dates = flows.select("portfolio_id", "date").distinct()
    held = orders.positions(orders.position_spans(flows), dates, bars)
    nav = orders.ledger_nav(flows, held, 1000.0)
    assert rows(nav, "date", "cash", "market_value", "nav", "holdings") == [
        (day("2024-01-02"), 900.0, 100.0, 1000.0, 1), (day("2024-01-03"), 880.0, 120.0, 1000.0, 2),
        (day("2024-01-05"), 1000.0, 20.0, 1020.0, 1)]


def test_positions_equal_a_scan_of_spans_days_and_closes(spark):
    rng = np.random.default_rng(3)
    at = lambda n: date(2024, 1, 1) + timedelta(days=int(n))
    spans = [(p, c, q, at(a), None if rng.random() < 0.3 else at(a + 1 + rng.integers(0, 70)))
             for p in "pq" for c in ("a", "b", "c") for q, a in zip((0, 3, -2), rng.integers(0, 90, 3))]
    days = [(p, at(n)) for p in "pqr" for n in rng.integers(0, 120, 25)] + [("p", None)]
    closes = {(c, at(n)): None if rng.random() < 0.2 else float(rng.integers(1, 99))
              for c in ("a", "b") for n in rng.choice(120, 12, replace=False)}
    frames = (
        spark.createDataFrame(spans, "portfolio_id string, code string, quantity long, held_from date, changed_on date"),
        spark.createDataFrame(days, "portfolio_id string, date date"),
        spark.createDataFrame([(c, d, x) for (c, d), x in closes.items()], "code string, date date, close double"),
        spark.createDataFrame([("a", "LARGE"), ("b", None)], "code string, size_bucket string"),
    )
    got = orders.positions(*frames)
    wanted = []
    for p, c, q, start, stop in spans:
        for d in {d for own, d in days if own == p and d and q and start <= d and (stop is None or d < stop)}:
            known = [x for (k, n), x in sorted(closes.items()) if k == c and n <= d and x is not None]
            price = known[-1] if known else None
            wanted.append((p, d, c, q, price, q * (price or 0.0), "LARGE" if c == "a" else "UNKNOWN"))
    key = lambda r: (r[0], r[1], r[2], r[3])
    assert wanted and sorted((tuple(r) for r in got.collect()), key=key) == sorted(wanted, key=key)


def test_positions_shuffle_a_row_a_span(spark):
    """A span was a row a month in one shuffle and a row a day in the next."""
    flows = orders.daily_flows(fills(spark, [("p", day("2024-01-02"), "a", "BUY", 10, 10.0)]), FREE)
    bars = spark.createDataFrame([(day("2024-01-02"), "a", 10.0)], "date date, code string, close double")
    held = orders.positions(orders.position_spans(flows), flows.select("portfolio_id", "date"), bars)
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(") == 1 and plan.index("explode(") < plan.index("Join") and "sequence(" not in plan


def test_infeasible_orders_tell_why(spark):
    bars = spark.createDataFrame(
        [(day("2024-01-02"), "a", 10.0, 1000.0, True, 100, 11.0, 9.0),
         (day("2024-01-02"), "b", 11.0, 1000.0, True, 100, 11.0, 9.0),
         (day("2024-01-02"), "c", 10.0, 0.0, True, 100, 11.0, 9.0)],
        "date date, code string, open double, volume double, is_trading boolean, lot_size int, "
        "limit_up double, limit_down double")
    asked = spark.createDataFrame(
        [("p", day("2024-01-02"), c, s, q, f) for c, s, q, f in (
            ("a", "BUY", 900, False), ("a", "SELL", 5, False), ("a", "SELL", 50, True),
            ("b", "BUY", 500, False), ("c", "SELL", 500, True))],
        "portfolio_id string, date date, code string, side string, quantity long, "
        "is_full_exit boolean")
    out = orders.order_feasibility(asked, bars, Portfolio(max_participation_rate=0.5), FREE)
    assert rows(out, "code", "side", "quantity", "filled_quantity", "status", "reason") == [
        ("a", "BUY", 900, 500, "PARTIALLY_FILLED", ""),
        ("a", "SELL", 5, 0, "REJECTED", "BELOW_MIN_TRADE_VALUE"),
        ("a", "SELL", 50, 0, "REJECTED", "CAPACITY_OR_CASH_LIMIT"),
        ("b", "BUY", 500, 0, "REJECTED", "SUSPENDED_OR_LIMIT_LOCKED"),
        ("c", "SELL", 500, 0, "REJECTED", "SUSPENDED_OR_LIMIT_LOCKED")]


def test_sales_come_first_and_good_buys_before_poor_ones(spark):
    df = spark.createDataFrame(
        [("p", day("2024-01-02"), c, s, x) for c, s, x in (
            ("a", "BUY", 1.0), ("b", "BUY", 2.0), ("c", "SELL", 5.0), ("d", "SELL", 3.0))],
        "portfolio_id string, date date, code string, side string, score double")
    assert rows(orders.order_priority(df), "priority", "code") == [
        (1, "d"), (2, "c"), (3, "b"), (4, "a")]


def test_policy_resizing_keeps_an_explicit_exit_rank():
    assert Portfolio().with_holdings(5, exit_rank=9).exit_rank == 9
    small = Portfolio().with_holdings(5)
    assert (small.exit_rank, small.max_stock_weight) == (7, 0.2)
    with pytest.raises(ValueError):
        Costs().scaled(-1)


def test_orders_meet_bars_by_code_without_moving_them(spark):
    a, b = day("2024-01-02"), day("2024-01-03")
    bars = durable_by(spark.createDataFrame(
        [("x", a, 1.0, 5.0), ("x", a, 2.0, 5.0), ("x", b, 3.0, 5.0), ("y", b, 4.0, 5.0), (None, a, 9.0, 5.0)],
        "code string, date date, open double, volume double",
    ), "code")
    asked = spark.createDataFrame(
        [("p", a, "x", 1), ("q", a, "x", 2), ("p", a, "y", 3), ("p", a, None, 4), ("p", None, "x", 5)],
        "portfolio_id string, date date, code string, volume int",
    ).withColumn("quantity", F.col("volume"))
    got = orders.attach_market(asked, bars)
    assert got.columns == ["date", "code", "portfolio_id", "quantity", "open", "volume"]
    assert rows(got, "portfolio_id", "quantity", "code", "open", "volume") == [
        (p, n, "x", price, 5.0) for p, n in (("p", 1), ("q", 2)) for price in (1.0, 2.0)
    ]
    assert plan(got).count("Exchange ") == 1
