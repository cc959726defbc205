"""Factors, labels, splits, reports and NAV analytics."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.config import MODEL_FEATURES, RAW_FEATURES, Boosting
from barloom.functions import cross, rolling
from barloom.operators import (
    evaluate, factors, labels, models, performance, preprocess, scoring, splits,
)
from tests.helpers import bars_frame, day, random_bars, rows


@pytest.fixture(scope="module")
def panel(spark):
    return bars_frame(spark, random_bars()).cache()


def test_future_rows_do_not_change_past_factors(panel):
    cutoff = day("2020-08-20")
    columns = ["date", "code", *RAW_FEATURES]
    short = factors.raw_factors(panel.where(F.col("date") <= cutoff)).select(columns)
    full = factors.raw_factors(panel).where(F.col("date") <= cutoff).select(columns)
    a = short.toPandas().sort_values(["code", "date"]).reset_index(drop=True)
    b = full.toPandas().sort_values(["code", "date"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, rtol=1e-12, atol=1e-12)


def test_factors_equal_pandas(panel):
    got = factors.raw_factors(panel).toPandas().sort_values(["code", "date"])
    pdf = got.reset_index(drop=True)
    by = pdf.groupby("code")
    ret = by["close"].pct_change(fill_method=None)
    residual = ret - ret.groupby(pdf["date"]).transform("median")
    checks = {
        "momentum_60_5": by["close"].shift(5) / by["close"].shift(60) - 1,
        "reversal_5": -residual.groupby(pdf["code"]).transform(lambda s: s.rolling(5).sum()),
        "idio_vol_60": residual.groupby(pdf["code"]).transform(
            lambda s: s.rolling(60, min_periods=40).std()),
        "high_position_120": pdf["close"] / by["close"].transform(lambda s: s.rolling(120).max())
        - 1,
        "median_amount_20": by["amount"].transform(lambda s: s.rolling(20, min_periods=15).median()),
    }
    for name, want in checks.items():
        assert np.allclose(pdf[name], want, rtol=1e-9, atol=1e-12, equal_nan=True), name
    x = np.arange(60.0)
    tail = np.log(pdf[pdf.code == "000003"]["close"].to_numpy()[-60:])
    slope, icpt = np.polyfit(x, tail, 1)
    rss = ((tail - icpt - slope * x) ** 2).sum()
    t = slope / np.sqrt(rss / 58 / ((x - x.mean()) ** 2).sum())
    assert pdf[pdf.code == "000003"]["trend_quality_60"].iloc[-1] == pytest.approx(t, rel=1e-8)


def test_a_flat_price_has_no_trend(spark):
    df = spark.createDataFrame(
        [("a", day("2024-01-01").replace(month=1 + i // 28, day=1 + i % 28), 7.0)
         for i in range(70)], "code string, date date, close double")
    got = factors.add_trend_quality(df).orderBy("date").collect()
    assert got[0]["trend_quality_60"] is None and got[-1]["trend_quality_60"] == 0.0


def test_bottom_liquidity_is_not_tradable(panel):
    last = factors.raw_factors(panel).where(F.col("date") == panel.agg(F.max("date")).scalar())
    got = last.orderBy("liquidity_percentile").collect()
    low = [r for r in got if r["liquidity_percentile"] <= 0.20]
    assert low and not any(r["tradable"] for r in low)
    assert got[-1]["tradable"]


def test_forward_label_starts_at_next_open(spark):
    df = spark.createDataFrame(
        [(day(f"2024-01-0{i + 1}"), "000001", float(o), float(c)) for i, (o, c) in
         enumerate(zip([10, 11, 12, 13, 14, 15], [10, 12, 13, 14, 15, 16]))],
        "date date, code string, open double, close double")
    first = labels.forward_labels(df, 2).orderBy("date").first()
    assert first["forward_return"] == pytest.approx(13 / 11 - 1)
    assert first["label_end_date"] == day("2024-01-03")








def test_degenerate_cross_sections_become_zero(spark):
    df = spark.createDataFrame(
        [("d", "1", 5.0), ("d", "2", 5.0), ("d", "3", None)], "date string, code string, x double")
    assert rows(preprocess.robust_zscore(df, ["x"]), "code", "x") == [
        ("1", 0.0), ("2", 0.0), ("3", 0.0)]


def monthly(spark, months, symbols=3, label_days=20):
    dates = pd.date_range("2018-01-31", periods=months, freq="ME")
    return spark.createDataFrame(pd.DataFrame(
        [{"date": d.date(), "label_end_date": (d + pd.Timedelta(days=label_days)).date(),
          "code": f"{s:06d}"} for d in dates for s in range(symbols)]))


def test_purged_split_has_no_label_overlap(spark):
    df = monthly(spark, 20, 2, 35)
    got = splits.purged_split(df).groupBy("split").agg(
        F.max("label_end_date").alias("end"), F.min("date").alias("lo")).collect()
    part = {r["split"]: r for r in got}
    assert part["train"]["end"] < part["validation"]["lo"]
    assert part["validation"]["end"] < part["test"]["lo"]
    with pytest.raises(Exception, match="At least 12"):
        splits.purged_split(monthly(spark, 8)).collect()


@pytest.mark.parametrize("window", ["expanding", "rolling"])
def test_walk_forward_is_purged_and_contiguous(spark, window):
    df = monthly(spark, 72)
    months = {"train_months": 36, "validation_months": 12, "test_months": 12, "window": window}
    out = splits.fold_summary(df, **months).orderBy("fold_id").collect()
    assert len(out) == 2 and out[0]["test_end"] < out[1]["test_start"]
    assert (out[1]["train_start"] > out[0]["train_start"]) == (window == "rolling")
    folds = splits.walk_forward_folds(df, **months)
    ends = folds.groupBy("fold_id", "split").agg(F.max("label_end_date").alias("e")).collect()
    for r in ends:
        start = {"train": "validation_start", "validation": "test_start"}.get(r["split"])
        if start:
            assert r["e"] < out[r["fold_id"] - 1][start]
    overlap = splits.fold_overlap(folds.where(F.col("split") == "test")).first()
    assert overlap["overlapping"] == 0 and overlap["keys"] == 72
    assert splits.empty_folds(splits.fold_summary(df, **months)).count() == 0


def test_walk_forward_rejects_bad_windows(spark):
    with pytest.raises(Exception, match="at least 60 rebalance dates"):
        splits.walk_forward_folds(monthly(spark, 59), train_months=36, validation_months=12,
                                  test_months=12).collect()
    with pytest.raises(ValueError, match="contiguous and non-overlapping"):
        splits.walk_forward_folds(monthly(spark, 72), step_months=6)


def test_segment_report_separates_buckets(spark):
    data = [(day(d), b, f"{b}{r}", float(r), s * r / 100) for d in ("2024-01-31", "2024-02-29")
            for b, s in (("LARGE", 1.0), ("MID", -1.0)) for r in range(1, 6)]
    df = spark.createDataFrame(
        data, "date date, size_bucket string, code string, m_score double, "
        "target_excess_return double")
    got = rows(evaluate.segment_model_report(df, ["m_score"]), "size_bucket", "mean_rank_ic")
    assert got == [("LARGE", pytest.approx(1.0)), ("MID", pytest.approx(-1.0))]


def predictions(spark):
    data = []
    for i, d in enumerate(("2024-01-31", "2024-02-29")):
        for r in range(4):
            data.append((day(d), f"00000{r + 1}", "LARGE" if r < 2 else "MID", (r + 1) / 100,
                         (r - 1.5) / 100, float(r), float(r if i == 0 else 3 - r)))
    return spark.createDataFrame(
        data, "date date, code string, size_bucket string, forward_return double, "
        "target_excess_return double, a_score double, b_score double")


def test_selection_regime_and_replacement_reports(spark):
    df = predictions(spark)
    report = evaluate.selection_report(df, ["a_score", "b_score"], top_k=2)
    got = {r["group"]: r["mean_excess_return"] for r in report.collect()
           if r["period"] == "ALL" and r["model"] == "a"}
    assert got["selected"] > got["not_selected"]
    moves = evaluate.replacement_report(df, ["b_score"], top_k=2).collect()
    assert len(moves) == 1 and moves[0]["entrants"] == 2 and moves[0]["observable_exits"] == 2
    days = pd.bdate_range("2023-07-01", "2024-02-29")
    index = spark.createDataFrame(pd.DataFrame(
        {"date": days.date, "benchmark_key": "i", "close": np.arange(100.0, 100 + len(days))}))
    regimes = evaluate.market_regimes(index, "i", lookback=5, threshold=0.001)
    out = evaluate.market_regime_report(df, regimes, "i", ["a_score"], top_k=2).collect()
    assert {r["regime"] for r in out} == {"BULL"} and out[0]["rebalance_dates"] == 2


def test_linear_reasons_follow_contributions(spark):
    df = spark.createDataFrame(
        [("1", *[0.0] * 10), ("2", *[1.0] * 10)],
        "code string, " + ", ".join(f"{f} double" for f in MODEL_FEATURES))
    got = rows(scoring.add_reasons(df), "code", "baseline_reason_1", "baseline_reason_2")
    assert got == [("1", "momentum_20_5", "momentum_60_5"),
                   ("2", "momentum_60_5", "momentum_20_5")]


def test_benchmarks_align_without_future_fill(spark):
    nav = spark.createDataFrame(
        [("p", day("2024-01-02"), 100.0), ("p", day("2024-01-03"), 110.0),
         ("p", day("2024-01-04"), 121.0)], "portfolio_id string, date date, nav double")
    index = spark.createDataFrame(
        [(day("2024-01-01"), "SSE composite", 100.0), (day("2024-01-02"), "SSE composite", 110.0),
         (day("2024-01-03"), "SSE composite", 121.0), (day("2024-01-04"), "SSE composite", 133.1)],
        "date date, benchmark_key string, close double")
    aligned = performance.benchmark_nav(nav, index, 100.0)
    assert [r["benchmark_nav"] for r in aligned.orderBy("date").collect()] == pytest.approx(
        [110.0, 121.0, 133.1])
    row = performance.benchmark_metrics(aligned, 100.0).first()
    assert row["benchmark"] == "sse_composite" and row["beta"] == 0.0
    assert row["excess_total_return"] == pytest.approx(-0.121)
    annual = performance.annual_returns(performance.series(nav, aligned), 100.0)
    assert rows(annual, "series", "year") == [("nav", 2024), ("sse_composite", 2024)]


def test_drawdown_episode_counts_the_initial_value(spark):
    nav = spark.createDataFrame(
        [("p", day(f"2024-01-0{i + 2}"), v) for i, v in enumerate([90.0, 80.0, 100.0, 95.0])],
        "portfolio_id string, date date, nav double")
    row = performance.drawdown_episode(nav, 100.0).first()
    assert row["peak_date"] == day("2024-01-01") and row["trough_date"] == day("2024-01-03")
    assert row["max_drawdown"] == pytest.approx(-0.2) and row["recovery_date"] == day("2024-01-04")


def test_equal_weight_uses_members_only(spark):
    data = [(day(f"2024-01-0{i + 2}"), c, p * g**i, m) for i in range(3)
            for c, p, g, m in (("1", 10.0, 1.1, True), ("2", 10.0, 2.0, False))]
    df = spark.createDataFrame(
        data, "date date, code string, close double, is_universe_member boolean")
    got = performance.equal_weight_nav(df, 100_000.0).orderBy("date").collect()
    assert [r["universe_equal_weight_nav"] for r in got] == pytest.approx(
        [100_000.0, 110_000.0, 121_000.0])


def test_best_rounds_keeps_patience():
    assert models.best_rounds([3.0, 2.0, 2.5, 1.0, 4.0, 4.0], 3) == (4, False)
    assert models.best_rounds([3.0, 2.0, 2.5, 2.5, 1.0], 2) == (2, True)
    assert models.best_rounds([1.0], 5) == (1, False)


def test_boosting_grows_trees_that_help(spark):
    rng = np.random.default_rng(0)
    x = rng.random((1500, 2))
    pdf = pd.DataFrame({
        "a": x[:, 0], "b": x[:, 1], "target_rank": (np.sin(6 * x[:, 0]) + x[:, 1] + 1) / 3,
        "split": np.where(np.arange(1500) % 3 == 0, "validation", "train")})
    data = spark.createDataFrame(pdf)
    config = Boosting(n_estimators=24, max_depth=3, learning_rate=0.2, early_stopping_rounds=4)
    model = models.fit_ranker(data, config, ["a", "b"])
    assert model.stages[-1].getNumTrees > 10
    one = models.fit_ranker(data, Boosting(n_estimators=1, max_depth=3), ["a", "b"])

    def corr(m):
        got = models.score(m, data.where("split = 'validation'")).toPandas()
        return got["boosted_score"].rank().corr(got["target_rank"].rank())

    assert corr(model) > corr(one) + 0.02
    again = models.fit_ranker(data, config, ["a", "b"])
    assert again.stages[-1].getNumTrees == model.stages[-1].getNumTrees


def test_latest_factors_equal_those_of_all_dates(spark):
    bars = bars_frame(spark, random_bars(symbols=8, days=200)).persist()
    last = bars.agg(F.max("date")).first()[0]
    whole = factors.time_series_factors(bars).where(F.col("date") == last)
    latest = factors.latest_factors(bars)
    assert latest.columns == whole.columns and latest.count() == whole.count() > 0
    a, b = (df.select("code", "listing_days", *RAW_FEATURES).orderBy("code").toPandas() for df in (latest, whole))
    assert np.allclose(a.drop(columns="code").astype(float), b.drop(columns="code").astype(float), equal_nan=True, atol=1e-12)


def test_factors_on_some_dates_equal_those_of_all_dates(spark):
    pdf = random_bars(symbols=8, days=260)
    pdf.loc[pdf.index % 9 == 0, "amount"] = None  # fewer known values than rows
    bars = bars_frame(spark, pdf).persist()
    days = labels.month_ends(bars).persist()
    whole = factors.time_series_factors(bars).join(days, "date", "left_semi")
    some = factors.factors_on(bars, days)
    assert set(some.columns) == set(whole.columns) and some.count() == whole.count() > 50
    order = ["code", "date"]
    a, b = (df.select(*order, "listing_days", *RAW_FEATURES).orderBy(*order).toPandas() for df in (some, whole))
    assert np.allclose(a.drop(columns=order).astype(float), b.drop(columns=order).astype(float), equal_nan=True, atol=1e-12)


def test_frames_at_wanted_rows_equal_windows_and_copy_no_row(spark):
    """Every bar was copied to each row that asks for it, and both sides of a join ran all windows."""
    rng = np.random.default_rng(3)
    rows = [
        (f"c{c}", date(2020, 1, 1) + timedelta(days=d), None if rng.random() < 0.2 else float(rng.integers(4)),
         float("nan") if rng.random() < 0.01 else float(rng.normal()), bool(rng.random() < 0.3))
        for c in range(4) for d in range(int(rng.integers(1, 90)))
    ]
    df = rolling.in_order(spark.createDataFrame(rows, "code string, date date, x double, y double, asks boolean"))
    df = df.withColumn("_n", F.row_number().over(rolling.by_code()))
    one = {f"{a.__name__}_{m}": rolling.gated(a, "x", 9, m) for a in (F.avg, F.sum, F.max, F.stddev_samp) for m in (0, 7)}
    frames = {
        **one, "top": rolling.Frame(F.max, ("y",), 30), "n": rolling.Frame(F.count, ("x",), 30),
        "v": rolling.Frame(F.var_pop, ("x",), 2), "c": rolling.Frame(F.covar_pop, ("x", "y"), 12),
        "l": rolling.Frame(rolling.last_values, ("x",), 3),
    }
    default = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        some = rolling.frames_at(df, frames, "asks").orderBy("code", "date").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", default)
    whole = df.withColumns({n: f.over() for n, f in frames.items()}).where("asks").orderBy("code", "date").collect()
    assert len(some) == len(whole) > 10
    for a, b in zip(some, whole):
        assert (a.code, a.date, a.x, a.l, a.n) == (b.code, b.date, b.x, b.l, b.n)
        for name in frames.keys() - {"l", "n"}:
            assert (a[name] is None) == (b[name] is None), name
            assert a[name] is None or np.isclose(a[name], b[name], atol=1e-12, equal_nan=True), name
    plan = rolling.frames_at(df, frames, "asks")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_month_ends_compute_no_long_window(spark):
    """Frames of 60 rows and more were evaluated on every bar; a median was one of 20 rows on each."""
    bars = bars_frame(spark, random_bars(symbols=2, days=150))
    plan = factors.factors_on(bars, labels.month_ends(bars))._jdf.queryExecution().optimizedPlan().toString()
    assert "-59" not in plan and "-119" not in plan and "percentile(" not in plan


def test_raw_factors_send_no_factor_through_the_ranks(spark, panel, monkeypatch):
    bars = panel.unionByName(panel.where("code = '000003'").withColumn("code", F.lit(None).cast("string")))
    written = []
    monkeypatch.setattr(cross, "durable", lambda df, real=cross.durable: written.append(df.columns) or real(df))
    got = factors.raw_factors(bars)
    assert written and not any(f in columns for columns in written for f in RAW_FEATURES)
    want = factors.add_tradable(factors.time_series_factors(bars))
    assert got.columns == want.columns
    columns = ["code", "date", "listing_days", "median_amount_20", "liquidity_percentile", "tradable"]
    assert rows(got, *columns) == rows(want, *columns)
