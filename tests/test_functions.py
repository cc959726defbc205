"""Order statistics, as-of joins and scalar rules against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import asof, cross
from barloom.functions.scalars import cents, normalize_symbol, st_name, with_venue
from barloom.session import durable_by
from tests.helpers import day, plan, rows


def sample(seed, n=400):
    rng = np.random.default_rng(seed)
    value = np.round(rng.normal(0, 3, n), 1)
    value[rng.random(n) < 0.35] = 1.5  # one value holds a third of all rows
    value[rng.random(n) < 0.05] = np.nan
    return pd.DataFrame(
        {
            "date": rng.choice(["a", "b", "c"], n, p=[0.6, 0.3, 0.1]),
            "code": [f"{i:06d}" for i in range(n)],
            "v": value,
        }
    )


def clean(spark, pdf):
    from barloom.functions.scalars import finite

    return spark.createDataFrame(pdf).withColumn("v", finite("v"))


def test_quantiles_equal_pandas(spark):
    pdf = sample(1)
    probs = [0.0, 0.01, 0.25, 0.5, 0.8, 0.99, 1.0]
    got = cross.group_quantiles(clean(spark, pdf), ["date"], ["v"], probs)
    for r in got.collect():
        want = pdf[pdf.date == r["date"]]["v"].quantile(probs)
        assert np.allclose([r[f"v__q{i}"] for i in range(len(probs))], want, atol=1e-12)


def test_attached_quantiles_keep_every_row(spark):
    pdf = sample(2)
    got = cross.with_quantiles(clean(spark, pdf), ["date"], ["v"], [0.5]).toPandas()
    assert len(got) == len(pdf)
    want = pdf.groupby("date")["v"].transform("median")
    got = got.sort_values("code")
    assert np.allclose(got["v__q0"].to_numpy(), want.to_numpy())


def test_average_rank_equals_pandas(spark):
    pdf = sample(3)
    got = cross.percent_rank_average(
        clean(spark, pdf), ["date"], "v", "pct"
    ).toPandas().sort_values("code")
    want = pdf.groupby("date")["v"].rank(pct=True, method="average")
    assert len(got) == len(pdf)
    assert np.allclose(got["pct"].astype(float), want, equal_nan=True)


def test_ordinal_rank_breaks_ties_by_code(spark):
    pdf = sample(4)
    got = cross.ordinal_rank(
        clean(spark, pdf), ["date"], "v", "code", "place"
    ).toPandas()
    for _, group in got.groupby("date"):
        known = group.dropna(subset=["v"])
        want = known.sort_values(["v", "code"], ascending=[False, True])["place"].tolist()
        assert want == list(range(1, len(known) + 1))
        assert group[group["v"].isna()]["place"].isna().all()


def test_rank_correlation_equals_spearman(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(
        {"date": ["a"] * 50 + ["b"] * 50 + ["c"] * 3, "x": np.round(rng.normal(size=103), 1),
         "y": np.round(rng.normal(size=103), 1)}
    )
    pdf.loc[100:, "x"] = 1.0  # a constant side has no correlation
    got = cross.rank_correlation(spark.createDataFrame(pdf), ["date"], "x", "y")
    ic = {r["date"]: r["rank_ic"] for r in got.collect()}
    for name in ("a", "b"):
        part = pdf[pdf.date == name]
        want = part["x"].rank().corr(part["y"].rank())
        assert ic[name] == pytest.approx(want, abs=1e-12)
    assert ic["c"] is None


def test_flag_top_k_ties_and_short_groups(spark):
    df = spark.createDataFrame(
        [("a", "1", 5.0), ("a", "2", 5.0), ("a", "3", 5.0), ("a", "4", 9.0), ("b", "1", 1.0),
         ("b", "2", None)],
        "date string, code string, s double",
    )
    got = rows(cross.flag_top_k(df, "s", 3), "date", "code", "selected")
    assert got == [
        ("a", "1", True), ("a", "2", True), ("a", "3", False), ("a", "4", True),
        ("b", "1", True), ("b", "2", False),
    ]


@pytest.fixture
def ranges(spark):
    """Seven ranges a shuffle, whatever their size, and batches of 50 rows."""
    new = {
        "spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "50",
    }
    old = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("dates", [["a"], ["a", "b", "c"], list("abcdefghij")])
def test_one_date_over_many_ranges(spark, ranges, dates):
    """A third of the rows hold one value and a fifth none; ranges cut dates and equal values."""
    rng = np.random.default_rng(len(dates))
    n = 3000
    value = np.round(rng.normal(0, 3, n), 2)
    value[rng.random(n) < 0.35] = 1.5
    value[rng.random(n) < 0.2] = np.nan
    share = np.r_[0.9, np.full(len(dates) - 1, 0.1 / max(1, len(dates) - 1))] if len(dates) > 1 else [1.0]
    pdf = pd.DataFrame({"date": rng.choice(dates, n, p=share), "code": [f"{i:06d}" for i in range(n)], "v": value})
    df = clean(spark, pdf).repartition(5)
    parts = cross._numbered(df.where("v is not null"), ["date", "v"])
    assert parts.select("_part").distinct().count() == 7
    assert parts.where("v = 1.5 and date = 'a'").select("_part").distinct().count() > 1
    probs = [0.0, 0.01, 0.3, 0.5, 0.99, 1.0]
    for r in cross.group_quantiles(df, ["date"], ["v"], probs).collect():
        want = pdf[pdf.date == r["date"]]["v"].quantile(probs)
        assert np.allclose([r[f"v__q{i}"] for i in range(len(probs))], want, atol=1e-12)
    ranked = cross.average_rank(df, ["date"], "v", "x").toPandas().sort_values("code")
    assert len(ranked) == n
    grouped = pdf.groupby("date")["v"]
    assert np.allclose(ranked["x_rank"].astype(float), grouped.rank(), equal_nan=True)
    assert np.allclose(ranked["x_n"].astype(float), grouped.transform("count").where(pdf["v"].notna()), equal_nan=True)
    placed = cross.ordinal_rank(df, ["date"], "v", "code", "place").toPandas().sort_values("code")
    best = pdf.sort_values(["v", "code"], ascending=[False, True])
    want = (best.groupby("date").cumcount() + 1).where(best["v"].notna()).sort_index()
    assert np.allclose(placed["place"].astype(float), want, equal_nan=True)


def test_no_rows_have_no_ranks(spark):
    df = clean(spark, sample(6)).limit(0)
    assert cross.group_quantiles(df, ["date"], ["v"], [0.5]).count() == 0
    assert cross.average_rank(df, ["date"], "v", "x").count() == 0
    assert cross.ordinal_rank(df, ["date"], "v", "code", "p").count() == 0
    nulls = clean(spark, sample(6)).withColumn("v", F.lit(None).cast("double"))
    assert cross.average_rank(nulls, ["date"], "v", "x").where("x_rank is null").count() == 400


def brute_interval(bars, spans):
    out = []
    for code, on in bars:
        hits = [s for s in spans if s[0] == code and s[1] <= on and (s[2] is None or on <= s[2])]
        out.append((code, on, max(hits, key=lambda s: s[1])[3] if hits else None))
    return sorted(out, key=str)


def test_interval_join_equals_brute_force_with_overlaps(spark):
    rng = np.random.default_rng(6)
    base = day("2024-01-01")
    from datetime import timedelta

    spans = set()
    for code in ("000001", "000002"):
        for start in rng.choice(60, 12, replace=False):
            end = None if rng.random() < 0.1 else base + timedelta(int(start + rng.integers(0, 25)))
            spans.add((code, base + timedelta(int(start)), end, f"v{start}"))
    bars = [(c, base + timedelta(d)) for c in ("000001", "000002", "000003")
            for d in range(-3, 90, 2)]
    left = spark.createDataFrame(bars, "code string, date date")
    right = spark.createDataFrame(
        list(spans), "code string, effective_from date, effective_to date, v string"
    )
    got = asof.interval_join(left, right, ["v"])
    assert sorted(rows(got, "code", "date", "v"), key=str) == brute_interval(bars, spans)
    assert all((r["v"] is not None) == r["_matched"] for r in got.collect())


def test_asof_backward_includes_the_same_day_only_backwards(spark):
    left = spark.createDataFrame(
        [("k", day("2024-01-01")), ("k", day("2024-01-03")), ("k", day("2024-01-05"))],
        "k string, date date",
    )
    right = spark.createDataFrame(
        [("k", day("2024-01-03"), 1.0), ("k", day("2024-01-06"), 2.0)], "k string, date date, x double"
    )
    got = asof.asof_backward(left, right, ["k"], ["x"])
    assert rows(got, "date", "x") == [
        (day("2024-01-01"), None), (day("2024-01-03"), 1.0), (day("2024-01-05"), 1.0),
    ]


def test_symbols_venues_and_names(spark):
    df = spark.createDataFrame(
        [(" 1 ",), ("sh.600000",), ("000002.SZ",), ("300001.0",), ("920001",), ("1234567",),
         ("abc",)], "raw string",
    )
    got = with_venue(df.select("raw", normalize_symbol("raw").alias("code")))
    assert {r["raw"]: (r["code"], r["exchange"], r["board"]) for r in got.collect()} == {
        " 1 ": ("000001", "SZSE", "MAIN"), "sh.600000": ("600000", "SSE", "MAIN"),
        "000002.SZ": ("000002", "SZSE", "MAIN"), "300001.0": ("300001", "SZSE", "CHINEXT"),
        "920001": ("920001", "BSE", "BSE"), "1234567": ("1234567", "UNKNOWN", "UNKNOWN"),
        "abc": ("ABC", "UNKNOWN", "UNKNOWN"),
    }
    names = spark.createDataFrame([("*ST A",), ("st b",), ("S*ST c",), ("BEST",)], "n string")
    assert [r[0] for r in names.select(st_name("n")).collect()] == [True, True, True, False]


def test_cents_round_half_to_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (10.995,)], "x double")
    assert [r[0] for r in df.select(cents(F.col("x"))).collect()] == list(
        np.round([0.125, 0.375, 10.995], 2)
    )


def test_asof_equals_a_scan_of_each_row(spark):
    rng = np.random.default_rng(8)
    days = pd.date_range("2019-12-20", periods=200).date
    right = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 120), "date": rng.choice(days, 120), "v": rng.normal(size=120)})
    right = right.drop_duplicates(["k", "date"])
    # One key holds nearly all rows; dates come more than once, and before the first value.
    left = pd.DataFrame({"k": rng.choice(["a", "b", "z"], 900, p=[0.9, 0.05, 0.05]), "date": rng.choice(days, 900)})
    left["i"] = range(900)
    got = asof.asof_backward(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], ["v"])
    assert got.columns == ["k", "date", "i", "v"]
    found = {r["i"]: r["v"] for r in got.collect()}
    for r in left.itertuples():
        known = right[(right.k == r.k) & (right.date <= r.date)].sort_values("date")
        assert found[r.i] == (known["v"].iloc[-1] if len(known) else None)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("Join")[0]  # left rows go through joins alone


def test_span_join_equals_all_pairs(spark):
    rng = np.random.default_rng(9)
    days = pd.date_range("2019-12-20", periods=500).date
    spans = [
        ("ab"[i % 2], i, days[a], None if i % 5 == 0 else days[min(499, a + int(rng.integers(0, 200)))])
        for i, a in enumerate(rng.integers(0, 480, 60))
    ]
    points = [(k, d) for k in "abc" for d in rng.choice(days, 40, replace=False)]
    want = sorted((i, d) for k, i, a, z in spans for p, d in points if p == k and a <= d and (z is None or d < z))
    frames = (
        spark.createDataFrame(spans, "k string, i int, a date, z date"), spark.createDataFrame(points, "k string, d date"),
    )
    for unit in ("month", "year"):
        got = asof.span_join(*frames, ["k"], start="a", stop="z", date="d", unit=unit)
        assert sorted((r["i"], r["d"]) for r in got.collect()) == want
    assert asof.span_join(frames[0], frames[1].limit(0), ["k"], start="a", stop="z", date="d").count() == 0


def test_sweep_equals_every_day(spark):
    rng = np.random.default_rng(10)
    days = pd.date_range("2020-01-01", periods=60).date
    spans = []
    for i in range(80):
        a = int(rng.integers(0, 55))
        z = None if rng.random() < 0.1 else days[min(59, a + int(rng.integers(-1, 25)))]
        spans.append((f"c{rng.integers(0, 4)}", days[a], z, i))
    frame = spark.createDataFrame(spans, "code string, effective_from date, effective_to date, v int")
    bars = spark.createDataFrame([(f"c{c}", d) for c in range(5) for d in days], "code string, date date")
    got = {(r["code"], r["date"]): (r["_matched"], r["v"]) for r in asof.interval_join(bars, frame, ["v"]).collect()}
    far = day("9999-12-31")
    for (code, d), found in got.items():
        active = [(a, z or far, i) for c, a, z, i in spans if c == code and a <= d <= (z or far)]
        # Of one start, the interval that ends last; it hides the others for good.
        starts = max((a for a, _, _ in active), default=None)
        best = [i for a, z, i in active if a == starts and z == max(z for a, z, _ in active if a == starts)]
        assert found[0] == bool(active) and (found[1] in best if best else found[1] is None)


def test_sweep_is_linear_in_intervals_of_one_code(spark):
    """100,000 intervals of one code that all overlap; comparing each turn with each would be 10^10."""
    n = 100_000
    frame = spark.range(n).select(
        F.lit("c").alias("code"), F.date_add(F.lit(day("1800-01-01")), F.col("id").cast("int")).alias("effective_from"),
        F.date_sub(F.lit(day("2400-01-01")), F.col("id").cast("int")).alias("effective_to"), F.col("id").alias("v"),
    )
    steps = asof.step_function(frame, ["v"])
    told = steps.agg(F.count(F.lit(1)).alias("n"), F.min("date"), F.max("date"), F.count_if(~F.col("_in.on")).alias("off")).first()
    assert (told.n, told["min(date)"], told["max(date)"], told.off) == (2 * n, day("1800-01-01"), day("2400-01-02"), 1)
    last = steps.where(F.col("date") == day("2399-12-31")).first()
    assert last["_in"]["v"] == 1


def test_tables_kept_by_a_key_are_not_moved_for_it(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 4)], "code string, x int")
    kept = durable_by(df, "code")
    assert rows(kept) == rows(df)
    summed = kept.withColumn("s", F.sum("x").over(Window.partitionBy("code")))
    assert "Exchange" not in plan(summed)
    assert rows(summed, "s") == [(3,), (3,), (3,), (8,), (8,)]


def test_lists_beside_move_only_the_side_that_does_not_lie_by_code(spark):
    left = durable_by(spark.createDataFrame(
        [("a", 1, "p"), ("a", 1, "q"), ("a", 2, "r"), ("b", 1, "s"), (None, 1, "t"), ("a", None, "u")],
        "code string, n int, x string",
    ), "code")
    right = spark.createDataFrame(
        [("a", 1, 7), ("a", 1, 8), ("b", 2, 9), (None, 1, 10), ("a", None, 11)], "code string, n int, v int"
    )
    got = asof.lists_beside(left, right, ["code", "n"], "found")
    assert got.columns == ["code", "n", "x", "found"]
    assert plan(got).count("Exchange ") == 1
    found = {r["x"]: sorted(v["v"] for v in r["found"]) for r in got.collect()}
    assert found == {"p": [7, 8], "q": [7, 8], "r": [], "s": [], "t": [10], "u": [11]}


def test_asof_does_not_move_a_right_side_that_lies_by_its_key(spark):
    d = [day(f"2024-0{m}-1{i}") for m in (1, 2, 4) for i in range(3)]
    right = durable_by(spark.createDataFrame(
        [("a", x, float(i)) for i, x in enumerate(d)] + [("b", d[4], 9.0)], "k string, date date, v double"
    ), "k")
    left = spark.createDataFrame(
        [("a", day("2024-03-01")), ("a", d[7]), ("b", d[8]), ("b", d[0]), ("c", d[0])], "k string, date date"
    )
    got = asof.asof_backward(left, right, ["k"], ["v"])
    assert rows(got, "k", "date", "v") == [
        ("a", day("2024-03-01"), 5.0), ("a", d[7], 7.0), ("b", d[0], None), ("b", d[8], 9.0), ("c", d[0], None),
    ]
    # From the scan of the right side to the months asked for, nothing is moved.
    lines = plan(got).split("\n")
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x)
    kept = next(i for i in range(scan, 0, -1) if "Union" in lines[i])
    assert "Exchange" not in "".join(lines[kept:scan])


def test_ranks_of_written_rows_are_the_same(spark):
    df = spark.createDataFrame(sample(5))
    one, two = (cross.average_rank(df, ["date"], "v", "x", written) for written in (False, True))
    assert rows(one, "date", "code", "x_rank", "x_n") == rows(two, "date", "code", "x_rank", "x_n")
