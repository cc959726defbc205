"""Cleaning, point-in-time joins, enrichment, readers and writers on literal tables."""

from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom import schemas
from barloom.operators import assemble, clean, pit, quality
from barloom.plans import market
from barloom.sources import feeds, fixtures, readers, writers
from tests.helpers import day, plan, rows

BAR = "date string, code string, open double, high double, low double, close double, " \
    "volume double, amount double"


def bar(on="2024-01-02", code="000001", close=10.2, volume=1000.0):
    return (on, code, 10.0, 10.5, 9.8, close, volume, 10_200.0)


def test_last_duplicate_wins_and_codes_keep_zeros(spark):
    raw = spark.createDataFrame(
        [("2024-01-02", "1", 10.0, 11.0, 9.0, 10.5, 1000.0, 10000.0, 0),
         ("2024-01-02", "000001", 10.0, 11.0, 9.0, 10.6, 1000.0, 10000.0, 1)],
        BAR + ", _seq int",
    )
    assert rows(clean.clean_bars(raw), "code", "close") == [("000001", 10.6)]
    report = clean.data_quality(clean.checked_bars(raw)).first()
    assert (report["rows"], report["duplicate_rows_removed"]) == (1, 1)


def test_an_invalid_later_duplicate_removes_the_valid_row(spark):
    raw = spark.createDataFrame(
        [bar() + (0,), bar(close=99.0) + (1,), bar(on="bad date", code="000002") + (0,)],
        BAR + ", _seq int",
    )
    assert clean.clean_bars(raw).count() == 0
    assert clean.data_quality(clean.checked_bars(raw)).first()["invalid_rows_removed"] == 2


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="amount"):
        clean.clean_bars(spark.createDataFrame([bar()], BAR).drop("amount"))


def test_snapshots_compress_without_hiding_reentry(spark):
    data = [
        ("2024-01-31", "000001", "A", "MID"), ("2024-02-29", "000001", "A", "MID"),
        ("2024-03-29", "000001", "A", "LARGE"), ("2024-01-31", "600000", "B", "LARGE"),
        ("2024-03-29", "600000", "B", "LARGE"),
    ]
    snaps = spark.createDataFrame(
        data, "snapshot_date string, code string, security_name string, size_bucket string"
    ).withColumn("snapshot_date", F.to_date("snapshot_date"))
    got = rows(pit.compress_snapshots(snaps), "code", "effective_from", "effective_to", "size_bucket")
    assert got == [
        ("000001", day("2024-01-31"), day("2024-03-28"), "MID"),
        ("000001", day("2024-03-29"), None, "LARGE"),
        ("600000", day("2024-01-31"), day("2024-02-28"), "LARGE"),
        ("600000", day("2024-03-29"), None, "LARGE"),
    ]


def industry_table(spark):
    raw = spark.createDataFrame(
        [("000001", "2020-01-01", "A", "OLD"), ("000001", "2022-01-01", "B", "NEW")],
        "`股票代码` string, `纳入时间` string, `行业代码` string, `行业名称` string",
    )
    return pit.normalize_industry_history(raw)


def test_industry_caps_and_limits_without_lookahead(spark):
    bars = spark.createDataFrame(
        [("2021-06-01", "000001", "MAIN", False, True, 10.0, 10.1, 1_000_000, 0.01),
         ("2023-06-01", "000001", "MAIN", False, True, 20.0, 20.2, 2_000_000, 0.02)],
        "date string, code string, board string, is_st boolean, status_is_point_in_time boolean, "
        "preclose double, raw_close double, volume long, turnover double",
    ).withColumn("date", F.to_date("date"))
    out = assemble.add_price_limits(
        assemble.add_market_cap(pit.apply_industry(bars, industry_table(spark)))
    )
    got = rows(out, "date", "industry", "industry_is_point_in_time", "market_cap", "limit_up",
               "limit_down")
    assert got == [
        (day("2021-06-01"), "OLD", True, pytest.approx(1.01e9), 11.0, 9.0),
        (day("2023-06-01"), "NEW", True, pytest.approx(2.02e9), 22.0, 18.0),
    ]


def test_chinext_limit_after_reform_and_missing_turnover(spark):
    df = spark.createDataFrame(
        [("2024-01-02", "CHINEXT", False, True, 10.0), ("2020-08-21", "CHINEXT", False, True, 10.0),
         ("2024-01-02", "STAR", True, True, 10.0)],
        "date string, board string, is_st boolean, status_is_point_in_time boolean, preclose double",
    ).withColumn("date", F.to_date("date"))
    got = rows(assemble.add_price_limits(df), "limit_up", "limit_down")
    assert got == [(10.5, 9.5), (11.0, 9.0), (12.0, 8.0)]
    bare = spark.createDataFrame([(10.0, 1000)], "raw_close double, volume long")
    row = assemble.add_market_cap(bare).first()
    assert row["market_cap"] is None and row["market_cap_source"] == "UNAVAILABLE"


def test_backfilled_industry_never_counts_as_point_in_time(spark):
    now = spark.createDataFrame(
        [("000001", "BANK", "Bank")], "code string, industry_code string, industry_name string"
    )
    history = pit.backfilled_industry(now, "2020-01-01")
    bars = spark.createDataFrame([(day("2021-01-04"), "000001")], "date date, code string")
    assert rows(pit.apply_industry(bars, history), "industry", "industry_is_point_in_time") == [
        ("Bank", False)
    ]


def write_market(spark, root, bars, membership=None):
    for code, part in bars.items():
        spark.createDataFrame(part, BAR).coalesce(1).write.parquet(f"{root}/tmp-{code}")
        pdf = pd.DataFrame(part, columns=[c.split()[0] for c in BAR.split(", ")])
        (root / "bars").mkdir(exist_ok=True)
        pdf.to_parquet(root / "bars" / f"{code}.parquet", index=False)
    if membership is not None:
        membership.to_parquet(root / "universe_membership.parquet", index=False)


def test_market_root_flags_members_but_keeps_history(spark, tmp_path):
    write_market(
        spark, tmp_path, {"000001": [bar(f"2024-01-0{i}") for i in range(1, 5)]},
        pd.DataFrame({"code": ["000001"], "effective_from": ["2024-01-02"],
                      "effective_to": ["2024-01-03"], "membership_mode": ["point_in_time"]}),
    )
    out = readers.load_bars(spark, str(tmp_path))
    assert [r["is_universe_member"] for r in out.orderBy("date").collect()] == [
        False, True, True, False
    ]


def test_current_snapshot_drops_stale_files(spark, tmp_path):
    write_market(
        spark, tmp_path, {"000001": [bar()], "600000": [bar(code="600000")]},
        pd.DataFrame({"code": ["000001"], "membership_mode": ["current_snapshot"],
                      "size_bucket": ["LARGE"]}),
    )
    assert rows(readers.load_bars(spark, str(tmp_path)), "code", "size_bucket") == [
        ("000001", "LARGE")
    ]


def test_csv_and_code_from_file_name(spark, tmp_path):
    pd.DataFrame([bar()[:1] + bar()[2:]],
                 columns=["date", "open", "high", "low", "close", "volume", "amount"]).to_csv(
        tmp_path / "000007.csv", index=False)
    assert rows(readers.load_bars(spark, str(tmp_path)), "code", "close") == [("000007", 10.2)]
    with pytest.raises(FileNotFoundError):
        readers.load_bars(spark, str(tmp_path / "absent"))


def test_missing_actions_are_an_empty_typed_table(spark, tmp_path):
    empty = readers.load_actions(spark, str(tmp_path / "none"))
    assert empty.schema == schemas.ACTION and empty.count() == 0


def test_positions_reject_duplicates(spark, tmp_path):
    pd.DataFrame({"code": ["1", "2"], "quantity": [5, 0]}).to_csv(tmp_path / "a.csv", index=False)
    assert rows(readers.load_positions(spark, str(tmp_path / "a.csv"))) == [("000001", 5)]
    pd.DataFrame({"code": ["1", "000001"], "quantity": [5, 1]}).to_csv(
        tmp_path / "b.csv", index=False)
    with pytest.raises(Exception, match="unique codes"):
        readers.load_positions(spark, str(tmp_path / "b.csv")).collect()


def test_actions_merge_by_ex_date(spark):
    dividends = spark.createDataFrame(
        [("1", "2024-05-01", 1.0, 2.0, 3.0), ("1", "soon", 1.0, 1.0, 1.0)],
        "code string, `除权除息日` string, `送股` double, `转增` double, `派息` double",
    )
    rights = spark.createDataFrame(
        [("1", "2024-05-01", 3.0, 8.0)],
        "code string, `除权日` string, `配股方案` double, `配股价格` double",
    )
    got = rows(assemble.merge_actions(assemble.normalize_dividends(dividends),
                                      assemble.normalize_rights(rights)))
    assert got == [
        ("000001", day("2024-05-01"), 0.3, 0.3, 0.3, 8.0, "dividend_feed+rights_feed")
    ]


def test_calendar_mismatch_rejects_the_security(spark):
    def feed(days):
        return spark.createDataFrame(
            [(c, day(f"2024-01-{d:02d}"), 1.0, 1.0, 1.0, 1.0, 10.0, 10.0) for c, d in days],
            "code string, date date, open double, high double, low double, close double, "
            "volume double, amount double",
        )

    raw = feed([("a", 2), ("a", 3), ("a", 4), ("b", 2), ("b", 3), ("b", 4)])
    adjusted = feed([("a", 2), ("a", 3), ("b", 2)])
    out = assemble.match_calendars(raw, adjusted, "2024-01-01", "2024-02-01")
    assert rows(out, "code", "date") == [("a", day("2024-01-02")), ("a", day("2024-01-03"))]


def test_feeds_of_a_day_meet_in_one_shuffle(spark):
    prices = "code string, date date, open double, high double, low double, close double"
    d = [day(f"2024-01-0{i}") for i in range(1, 6)]

    def feed(found):
        return spark.createDataFrame([(c, x, 1.0, 1.0, 1.0, v) for c, x, v in found], prices)

    # Days of one feed alone, a day without a close, rows that come twice, no code, outside the window.
    raw = feed([("a", d[0], 1.0), ("a", d[1], 2.0), ("a", d[1], 3.0), ("b", d[0], None), ("b", d[1], 4.0),
                ("c", d[0], 5.0), ("c", d[1], 5.0), (None, d[0], 6.0), ("a", None, 7.0), ("a", d[4], 8.0)])
    adjusted = feed([("a", d[0], 10.0), ("a", d[1], 20.0), ("a", d[1], 30.0), ("a", d[2], 40.0),
                     ("b", d[0], 50.0), ("b", d[1], 60.0), ("b", d[2], 60.0), ("c", d[1], 70.0),
                     (None, d[0], 80.0), ("a", None, 90.0)])
    beside = spark.createDataFrame(
        [("a", d[0], "x"), ("a", d[3], "y"), ("c", d[1], "z"), ("c", d[1], "w"), (None, d[0], "v")],
        "code string, date date, st string",
    )
    out = assemble.match_calendars(raw, adjusted, "2024-01-01", "2024-01-04", beside=beside)
    assert rows(out.na.fill("-", ["st"]), "code", "date", "raw_close", "close", "unmatched", "st") == [
        ("a", d[0], 1.0, 10.0, 1, "x"), *[("a", d[1], r, c, 1, "-") for r in (2.0, 3.0) for c in (20.0, 30.0)],
        ("c", d[1], 5.0, 70.0, 1, "w"), ("c", d[1], 5.0, 70.0, 1, "z"),
    ]
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_feeds_come_from_one_pass_over_the_trades(spark, tmp_path):
    line = (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp"
    )
    at = datetime(1997, 5, 6)
    lines = [
        (2, 1, 1, 1, 2.0, 10.0, 0.02, 0.02, "N", "O", at), (1, 1, 1, 2, 1.0, 7.0, 0.04, 0.01, "R", "F", at),
        (1, 1, 1, 1, 4.0, 8.0, 0.06, 0.00, "A", "F", at), (2, 1, 1, 1, 2.0, 10.0, 0.02, 0.02, "N", "O", at),
        (3, 1, None, 1, 1.0, 3.0, 0.0, 0.0, "N", "O", at), (4, 1, 1, 1, 1.0, 4.0, 0.0, 0.0, "N", "O", None),
    ]
    spark.createDataFrame(lines, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 5000.0)], "s_suppkey long, s_acctbal double").write.parquet(
        f"{tmp_path}/supplier.parquet"
    )
    daily = fixtures.days(spark, str(tmp_path))
    assert rows(fixtures.raw_feed(spark, str(tmp_path), daily)) == [
        ("000001", day("1997-05-06"), 2.0, 7.0, 2.0, 5.0, 9.0, 35.0, 0.035)
    ]
    assert rows(fixtures.status_feed(spark, str(tmp_path), daily).where("date is not null")) == [
        ("000001", "1997-05-06", "1.96", "1", "0")
    ]
    assert daily.select(*fixtures.BAR).count() == fixtures.bars(spark, str(tmp_path)).count() == 3
    assert market.FROM_DAYS == {"raw_feed", "status_feed"}


def test_membership_of_bars_in_one_shuffle(spark):
    d = [day(f"2024-0{m}-1{i}") for m in (1, 2) for i in range(4)]
    bars = spark.createDataFrame(
        [("a", x, float(i)) for i, x in enumerate(d)]
        + [("a", None, 9.0), ("b", d[0], 1.0), ("c", d[0], 1.0), (None, d[0], 1.0)],
        "code string, date date, close double",
    )
    members = spark.createDataFrame(
        [("a", d[1], d[2], "MID"), ("a", d[5], None, "large"), ("b", d[1], None, None)],
        "code string, effective_from date, effective_to date, size_bucket string",
    )
    out = pit.point_in_time_membership(bars, members)
    bucket = {d[1]: "MID", d[2]: "MID", d[5]: "LARGE", d[6]: "LARGE", d[7]: "LARGE"}
    want = [("00000a", x, i, x in bucket, bucket.get(x, "UNKNOWN")) for i, x in enumerate(d)]
    want += [("00000a", None, 9.0, False, "UNKNOWN"), ("00000b", d[0], 1.0, False, "UNKNOWN")]
    got = rows(out, "code", "date", "close", "is_universe_member", "size_bucket", order=["code", "close"])
    assert got == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    # Of the bars: the wide shuffle by code alone, no join on code and month.
    assert "_month" not in plan


def test_upsert_and_source_priority(spark):
    old = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0)], "code string, d int, x double")
    new = spark.createDataFrame([("a", 2, 9.0), ("b", 1, 5.0)], "code string, d int, x double")
    merged = writers.upsert(old, new, ["code", "d"])
    assert rows(merged, "code", "d", "x") == [("a", 1, 1.0), ("a", 2, 9.0), ("b", 1, 5.0)]
    again = writers.upsert(merged, new, ["code", "d"])
    assert rows(again, "code", "d", "x") == rows(merged, "code", "d", "x")
    best = feeds.resolve_sources({"first": new.where("code = 'b'"), "second": old}, ["code"])
    assert rows(best, "code", "source_endpoint") == [
        ("a", "second"), ("a", "second"), ("b", "first")
    ]


def test_store_upsert_leaves_other_years_alone(spark, tmp_path):
    def bars(*rows):
        return spark.createDataFrame([(day(d), c, x, s) for d, c, x, s in rows], "date date, code string, x double, _seq int")

    path = str(tmp_path / "store")
    keys = ["code", "date"]
    first = bars(("2019-12-31", "a", 1.0, 0), ("2020-01-02", "a", 2.0, 0), ("2021-05-05", "b", 3.0, 0), ("2021-05-05", "a", 4.0, 0))
    assert writers.upsert_store(first, path, keys) == [2019, 2020, 2021]

    def files():
        return {str(p.relative_to(path)) for p in (tmp_path / "store").rglob("*.parquet")}

    before = files()
    # Two rows of one key in the batch: the later stands. One new key in an old year, one new year.
    batch = bars(("2020-01-02", "a", 8.0, 1), ("2020-01-02", "a", 9.0, 2), ("2020-02-03", "c", 5.0, 1), ("2022-01-01", "a", 6.0, 1))
    assert writers.upsert_store(batch, path, keys) == [2020, 2022]
    after = files()
    kept = {f for f in before if "_year=2020" not in f}
    assert kept <= after and not {f for f in before if "_year=2020" in f} & after
    want = [
        (day("2019-12-31"), "a", 1.0), (day("2020-01-02"), "a", 9.0), (day("2020-02-03"), "c", 5.0),
        (day("2021-05-05"), "a", 4.0), (day("2021-05-05"), "b", 3.0), (day("2022-01-01"), "a", 6.0),
    ]
    assert rows(writers.read_store(spark, path), "date", "code", "x") == want
    writers.upsert_store(batch, path, keys)  # again: nothing changes
    assert rows(writers.read_store(spark, path), "date", "code", "x") == want
    assert writers.upsert_store(batch.limit(0), path, keys) == []
    # A column that older years do not have.
    writers.upsert_store(batch.where("code = 'c'").withColumn("y", F.lit(7)), path, keys)
    assert rows(writers.read_store(spark, path).where("y = 7"), "code", "x") == [("c", 5.0)]
    with pytest.raises(ValueError):
        writers.upsert_store(batch, path, ["code"])


def test_index_feed_without_volume(spark):
    raw = spark.createDataFrame(
        [("2024-01-02", "1", "2", "3", "1", "500", 12.0)],
        "`日期` string, `开盘` string, `收盘` string, `最高` string, `最低` string, "
        "`成交额` string, `换手率` double",
    )
    row = feeds.normalize_history(raw, turnover_is_percent=True, index=True).first()
    assert (row["volume"], row["amount"], row["turnover"]) == (500.0, 0.0, 0.12)


def test_audit_names_the_first_broken_rule(spark):
    names = ["open", "high", "low", "close", "raw_open", "raw_high", "raw_low", "raw_close"]
    good = dict(zip(names, [2.0, 3.0, 1.0, 2.0] * 2), volume=1.0, amount=1.0)

    def line(code, d, **change):
        return {"code": code, "date": day(f"2024-01-{d:02d}"), **good, **change}

    data = pd.DataFrame(
        [line("a", 2), line("a", 3), line("b", 2), line("b", 2), line("c", 2, raw_low=0.0),
         line("d", 2, high=1.5)]
    )
    got = rows(quality.audit_symbols(spark.createDataFrame(data), min_rows=2), "code", "status",
               "error")
    assert got == [
        ("a", "PASS", None), ("b", "FAIL", "duplicate date/code rows"),
        ("c", "FAIL", "non-positive or missing adjusted/raw prices"),
        ("d", "FAIL", "invalid adjusted high price"),
    ]


def test_reports_are_written_as_a_pack(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "model string, x double")
    writers.write_reports({"selection_report": df, "diagnostic_summary": df}, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/selection_report").count() == 1
    assert spark.read.json(f"{tmp_path}/diagnostic_summary").first()["x"] == 1.0


def test_last_row_of_a_key_stays_and_columns_go_by_name(spark, tmp_path):
    head = "date,code,open,high,low,close,volume,amount"
    (tmp_path / "a.csv").write_text(
        f"{head}\n2024-01-02,000001,10,11,9,10.5,100,1000\n2024-01-02,000001,10,11,9,10.6,100,1000\n"
    )
    (tmp_path / "b.csv").write_text(
        "code,date,close,open,high,low,amount,volume\n000002,2024-01-02,10.2,10,11,9,1000,100\n"
    )
    (tmp_path / "c.csv").write_text(f"{head}\n2024-01-03,000002,10,11,9,10.3,100,1000\n2024-01-02,000002,10,11,9,10.4,100,1000\n")
    got = readers.load_bars(spark, str(tmp_path)).select("code", "date", "close", "volume").collect()
    assert sorted((r.code, str(r.date), r.close, r.volume) for r in got) == [
        ("000001", "2024-01-02", 10.6, 100.0), ("000002", "2024-01-02", 10.4, 100.0), ("000002", "2024-01-03", 10.3, 100.0)
    ]


def test_membership_reader_refuses_broken_files(spark, tmp_path):
    def read(name, *lines):
        (tmp_path / name).write_text("\n".join(["code,effective_from,effective_to,size_bucket", *lines]))
        return readers.load_membership(spark, str(tmp_path / name)).collect()

    good = read("good.csv", "1,2020-01-01,2020-06-30,large", "SH.600000,2020-01-01,,", "2,2020-01-01,open,mid")
    assert [(r.code, r.effective_to, r.size_bucket) for r in good] == [
        ("000001", day("2020-06-30"), "LARGE"), ("600000", None, "UNKNOWN"), ("000002", None, "MID")
    ]
    for name, line in (
        ("code", "12A,2020-01-01,,large"), ("order", "1,2020-01-02,2020-01-01,large"), ("bucket", "1,2020-01-01,,huge"),
        ("start", "1,soon,,large"),
    ):
        with pytest.raises(Exception, match="Membership|CAST_INVALID_INPUT"):
            read(f"{name}.csv", line)
    (tmp_path / "short.csv").write_text("code,effective_from\n1,2020-01-01")
    with pytest.raises(ValueError):
        readers.load_membership(spark, str(tmp_path / "short.csv"))


def test_signals_are_typed_strictly(spark):
    df = spark.createDataFrame([("2020-01-31", "000001", "0.5"), ("2020-01-31", "000002", None)], "date string, code string, s string")
    out = schemas.signals(df, "s")
    assert out.columns == schemas.SIGNAL.names
    assert rows(out, "date", "code", "score", "industry") == [
        (day("2020-01-31"), "000001", 0.5, None), (day("2020-01-31"), "000002", None, None)
    ]
    for bad in (("2020-01-31", "1", "much"), (None, "1", "0.5"), ("2020-01-31", None, "0.5")):
        with pytest.raises(Exception, match="CAST_INVALID_INPUT|without a"):
            schemas.signals(spark.createDataFrame([bad], df.schema), "s").collect()
    with pytest.raises(ValueError):
        schemas.signals(df, "t")


@pytest.fixture
def desk_tables(spark, tmp_path):
    line = (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp"
    )
    at, later = datetime(1997, 5, 6), datetime(1997, 5, 20)

    def traded(order, supplier, quantity, flag="N", when=at):
        return (order, 1, supplier, 1, quantity, quantity and 10.0 * quantity, 0.0, 0.0, flag, "O", when)

    tables = {
        "lineitem": ([
            traded(1, 1, 30.0), traded(1, 1, 20.0), traded(2, 1, 50.0, "R"), traded(2, 2, 8.0),
            traded(3, 2, 4.0, when=later), traded(9, 1, 1.0), traded(None, 1, 1.0), traded(3, 1, None),
        ], line),
        "orders": ([(1, 11), (2, 12), (3, 13), (3, 13), (9, 99)], "o_orderkey long, o_custkey long"),
        "customer": ([(11, 1), (12, 1), (13, 2), (None, 1)], "c_custkey long, c_nationkey long"),
        "nation": ([(1, "N1"), (2, "N2"), (3, "N3")], "n_nationkey long, n_name string"),
    }
    for name, (own, schema) in tables.items():
        spark.createDataFrame(own, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_desk_requests_move_lines_once_to_meet_their_desk(spark, desk_tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = fixtures.desk_requests(spark, desk_tables)
        moved = plan(got)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    d, e = day("1997-05-06"), day("1997-05-20")
    assert rows(got, "portfolio_id", "date", "code", "side", "quantity", "score", "is_full_exit") == [
        ("N1", d, "000001", "BUY", 50, 10.0, False), ("N1", d, "000001", "SELL", 50, 10.0, True),
        ("N1", d, "000002", "BUY", 8, 10.0, False), ("N2", d, "000001", "BUY", None, None, False),
        ("N2", e, "000002", "BUY", 8, 10.0, False),
    ]
    # Once by order and once by code; orders get their desk before.
    upper = moved.split("FileScan")[0]
    assert upper.count("Exchange ") == 2 and "hashpartitioning(code" in upper and "l_orderkey" in upper


def test_desk_holdings_are_written_once(spark, desk_tables):
    m = market.Market(spark, desk_tables)
    d = day("1997-05-20")
    assert rows(m.desk_holdings, "portfolio_id", "date", "code", "quantity", "weight") == [
        ("N1", d, "000002", 8, 1.0), ("N2", d, "000002", 8, 1.0),
    ]
    assert m.desk_holdings is m.desk_holdings and "FileScan" in plan(m.desk_holdings)
    assert "lineitem" not in plan(m.desk_holdings)


def test_bars_derive_prices_after_their_only_shuffle(spark, desk_tables):
    bars = market.Market(spark, desk_tables).bars
    built = plan(fixtures.bars(spark, desk_tables))
    assert built.count("Exchange ") == 1
    assert " AS seq" not in built.split("Exchange ")[1] and " AS price" not in built.split("Exchange ")[1]
    assert rows(bars, "code", "volume", "amount", "open", "close") == rows(
        fixtures.bars(spark, desk_tables), "code", "volume", "amount", "open", "close"
    )
    by_code = bars.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("code")))
    assert "Exchange" not in plan(by_code)


def test_members_meet_bars_that_lie_by_code_without_moving_them(spark, desk_tables):
    bars = market.Market(spark, desk_tables).bars
    members = spark.createDataFrame(
        [("1", day("1997-05-01"), None, "MID")],
        "code string, effective_from date, effective_to date, size_bucket string",
    )
    plain, padded = (pit.point_in_time_membership(bars, members, padded=p) for p in (False, True))
    assert rows(plain) == rows(padded)
    assert plan(padded).count("Bucketed: true") == 1
