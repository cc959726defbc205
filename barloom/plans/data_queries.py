"""Registered queries: ingestion, cleaning, point-in-time joins and data quality."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.functions.scalars import normalize_symbol, with_venue
from barloom.operators import assemble, clean, pit, quality, splits
from barloom.plans.market import Market
from barloom.plans.research_queries import test_rows
from barloom.registry import query
from barloom.session import shared_folder
from barloom.sources import feeds, readers, writers

START, END = "1996-01-01", "2001-06-30"
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
MEMBERSHIP_SOURCE = "month_end_history"


def build_membership(m: Market):
    return pit.compress_snapshots(m.view("membership_snapshots"))


def membership(m: Market):
    """Membership intervals as landed in storage."""
    return m.membership


def build_industry(m: Market):
    return pit.normalize_industry_history(m.view("raw_industry"))


def industry(m: Market):
    """Industry intervals as landed in storage."""
    return m.keep("industry", lambda: build_industry(m))


def security_master(m: Market):
    """Suppliers as a listing with exchange and board."""
    listed = with_venue(m.view("master").withColumnRenamed("is_st", "is_st_current"))
    return listed.select(
        "code", "security_name", "exchange", "board", F.lit("STOCK").alias("instrument_type"),
        "is_st_current",
    )


def status(m: Market):
    return assemble.normalize_status(m.view("status_feed"))


def assembled(m: Market):
    return assemble.assemble_bars(
        m.view("raw_feed"), m.view("adjusted_feed"), status(m), security_master(m),
        start=START, end=END,
    )


def build_actions(m: Market):
    return assemble.merge_actions(
        assemble.normalize_dividends(m.view("raw_dividends")),
        assemble.normalize_rights(m.view("raw_rights")),
    )


def actions(m: Market):
    """Corporate actions as landed in storage."""
    return m.keep("actions", lambda: build_actions(m))


@query(
    "load_bars", "date code is_universe_member size_bucket industry industry_is_point_in_time "
    "is_trading lot_size", "open high low close volume amount", 8,
)
def load_bars(m: Market):
    root = f"{shared_folder(m.spark)}/barloom/market-{uuid.uuid4().hex}"
    writers.write_table(m.bars, f"{root}/bars/part.parquet")
    writers.write_table(membership(m), f"{root}/universe_membership.parquet")
    writers.write_table(industry(m), f"{root}/industry_history.parquet")
    return readers.load_bars(m.spark, root)


@query(
    "load_actions", "code ex_date source",
    "cash_dividend_per_share bonus_share_ratio rights_share_ratio rights_price", 8,
)
def load_actions(m: Market):
    root = f"{shared_folder(m.spark)}/barloom/market-{uuid.uuid4().hex}"
    writers.write_table(actions(m), f"{root}/corporate_actions.parquet")
    return readers.load_actions(m.spark, root)


@query(
    "corporate_actions", "code ex_date source",
    "cash_dividend_per_share bonus_share_ratio rights_share_ratio rights_price", 8,
)
def corporate_actions(m: Market):
    window = F.col("ex_date").between(F.lit(START).cast("date"), F.lit(END).cast("date"))
    return build_actions(m).where(window)


@query("normalize_symbol", "raw code exchange board")
def normalize(m: Market):
    return with_venue(
        m.view("listings").select(
            F.col("代码").alias("raw"), normalize_symbol("代码").alias("code")
        )
    )


@query("security_master", "code security_name exchange board instrument_type is_st_current source")
def canonical_master(m: Market):
    return assemble.security_master(feeds.resolve_listing(m.view("listings")), source="listing")


@query(
    "clean_bars", "date code is_trading is_st industry lot_size",
    "open high low close volume amount", 8,
)
def clean_bars(m: Market):
    return clean.clean_bars(m.view("dirty_bars"))


@query(
    "data_quality", "rows symbols start_date end_date duplicate_rows_removed "
    "invalid_rows_removed non_trading_rows",
)
def data_quality(m: Market):
    return clean.data_quality(clean.checked_bars(m.view("dirty_bars")))


@query("upsert_bars", "code date", "open high low close volume amount", 8)
def upsert_bars(m: Market):
    stored = m.bars
    fresh = m.view("adjusted_feed").where(F.col("date") >= F.lit(START).cast("date"))
    return writers.upsert(stored, fresh, ["code", "date"])


@query("upsert_store", "code date", "open high low close volume amount", 8)
def upsert_store(m: Market):
    """The same through a yearly store: the bars, then the feed, which touches its own years only."""
    path = f"{shared_folder(m.spark)}/barloom/store-{uuid.uuid4().hex}"
    writers.upsert_store(m.bars, path, ["code", "date"])
    fresh = m.view("adjusted_feed").where(F.col("date") >= F.lit(START).cast("date"))
    writers.upsert_store(fresh, path, ["code", "date"])
    return writers.read_store(m.spark, path)


@query(
    "vendor_history", "kind code date", "open high low close volume amount turnover", 8,
)
def vendor_history(m: Market):
    raw = m.view("vendor_history")
    stock = feeds.normalize_history(raw, turnover_is_percent=True)
    index = feeds.normalize_history(raw.drop("成交量"), turnover_is_percent=True, index=True)
    return stock.withColumn("kind", F.lit("stock")).unionByName(
        index.withColumn("kind", F.lit("index"))
    )


@query("source_priority", "code date source_endpoint", "close volume", 8)
def source_priority(m: Market):
    return feeds.resolve_sources(m.view("rival_feeds"), ["code", "month"])


@query("latest_industry", "code kind industry_code industry_name effective_from is_point_in_time")
def latest_industry(m: Market):
    log = m.view("industry_changes")
    last = assemble_backfill(pit.latest_classification(log)).withColumn("kind", F.lit("latest"))
    first = assemble_backfill(pit.first_classification(log)).withColumn("kind", F.lit("first"))
    return last.unionByName(first)


def assemble_backfill(current):
    return pit.backfilled_industry(current, START)


@query("benchmark_series", "date benchmark_key expected_start expected_end", "close", 9)
def benchmark_series(m: Market):
    # A later download repeats the dates from START on with revised closes.
    table = m.view("benchmarks")
    later = table.where(
        (F.col("date") >= F.lit(START).cast("date")) & F.col("benchmark_key").isin(REGIONS)
    ).withColumn("close", F.col("close") + 1)
    merged = feeds.lay_benchmarks(later, table)
    window = feeds.common_window(merged, START, END).select(F.struct("*")).scalar()
    return merged.withColumn("_w", window).withColumns(
        {c: F.col("_w")[c] for c in ("expected_start", "expected_end")}
    ).drop("_w")


@query(
    "membership_rules", "intervals invalid_codes reversed_intervals invalid_buckets open_intervals",
)
def membership_rules(m: Market):
    return pit.membership_rules(membership(m))


@query(
    "membership_intervals", "code effective_from effective_to size_bucket security_name",
)
def membership_intervals(m: Market):
    return build_membership(m)


@query("pit_membership", "code date is_universe_member size_bucket")
def pit_membership(m: Market):
    return pit.point_in_time_membership(m.bars, membership(m))


@query("snapshot_membership", "code date size_bucket")
def snapshot_membership(m: Market):
    return pit.snapshot_membership(m.bars, membership(m))


@query(
    "industry_history", "code effective_from effective_to industry_code industry_name "
    "industry_standard is_point_in_time",
)
def industry_history(m: Market):
    return build_industry(m).join(m.view("master").select("code"), "code", "left_semi")


@query("pit_industry", "code date industry industry_code industry_is_point_in_time")
def pit_industry(m: Market):
    return pit.apply_industry(m.bars, industry(m))


@query(
    "status_enrich", "code date is_st is_trading status_is_point_in_time status_source",
    "preclose", 9,
)
def status_enrich(m: Market):
    raw = m.view("raw_feed").withColumn("raw_close", F.col("close"))
    return assemble.enrich_status(raw, status(m), security_master(m))


@query("market_cap", "code date market_cap_source", "float_shares_estimate market_cap", 4)
def market_cap(m: Market):
    return assemble.add_market_cap(m.view("raw_feed").withColumn("raw_close", F.col("close")))


@query(
    "price_limits", "code date limit_rule_is_point_in_time", "limit_rate limit_up limit_down", 6,
)
def price_limits(m: Market):
    return assembled(m)


@query(
    "assemble_bars", "code date exchange board instrument_type is_st is_trading lot_size "
    "status_source market_cap_source",
    "open high low close raw_open raw_high raw_low raw_close volume amount adjustment_factor "
    "preclose", 8,
)
def assemble_bars(m: Market):
    return assembled(m)


def stored(m: Market):
    """Assembled bars with some repeated rows, as an audit may meet them."""
    bars = kept_bars(m)
    return bars.unionByName(bars.where(F.col("volume") > 124))


def kept_bars(m: Market):
    """Assembled bars as storage holds them; the audit reads stored tables."""
    return m.keep("assembled", lambda: assembled(m))


@query(
    "audit_symbols", "code status error rows start_date end_date",
    "point_in_time_status_coverage market_cap_coverage",
)
def audit_symbols(m: Market):
    return quality.audit_symbols(stored(m))


@query("audit_coverage", "code problem")
def audit_coverage(m: Market):
    listed = assemble.security_master(feeds.resolve_listing(m.view("listings")), source="listing")
    return quality.audit_coverage(listed, kept_bars(m))


def audit(m: Market):
    listed = security_master(m)
    return quality.audit_summary(
        quality.audit_symbols(stored(m)), quality.audit_coverage(listed, kept_bars(m)),
        listed, m.view("benchmarks"), industry(m), actions(m), benchmark_keys=REGIONS,
    )


@query(
    "audit_summary", "passed symbols rows start_date end_date benchmarks failures warnings "
    "industry_history_symbols corporate_action_rows",
    "point_in_time_status_coverage market_cap_coverage",
)
def audit_summary(m: Market):
    return audit(m)


@query(
    "quality_gates", "point_in_time_membership universe_completeness historical_security_status "
    "point_in_time_industry historical_industry_required corporate_actions "
    "raw_and_adjusted_prices required_benchmarks storage_audit_passed research_ready "
    "evidence_grade large_members mid_members survivorship_bias stored_active stored_usable",
)
def quality_gates(m: Market):
    members = membership(m)
    gates = quality.quality_gates(
        universe="csi800", start=START, end=END, master=security_master(m), membership=members,
        industry=industry(m), actions=actions(m), symbols=quality.audit_symbols(stored(m)),
        benchmarks=m.view("benchmarks"), audit=audit(m), benchmark_keys=REGIONS,
    )
    bias = quality.survivorship_bias(
        quality.whole_market(security_master(m), END), START
    ).select("survivorship_bias").scalar()
    kept = quality.stored_membership_usable(
        members.withColumn("membership_source", F.lit(MEMBERSHIP_SOURCE)), START, END,
        source=MEMBERSHIP_SOURCE, minimum=30,
    )
    return gates.withColumns(
        {
            "survivorship_bias": bias, "stored_active": kept.select("active").scalar(),
            "stored_usable": kept.select("usable").scalar(),
        }
    )


@query("universe_segments", "code security_name universe_segment size_bucket segments")
def universe_segments(m: Market):
    members = membership(m).where(F.col("effective_to").isNull()).select(
        "code", "security_name", "size_bucket"
    )
    listed = m.view("master")
    return quality.universe_segments(
        {
            "csi300": listed.where(F.col("size_bucket") == "LARGE"),
            "csi500": members.where(F.col("size_bucket") == "MID"),
            "csi1000": members,
        }
    )


@query("sample_universe", "code date", "close", 8)
def sample_universe(m: Market):
    return quality.sample_universe(m.bars, 7)


@query("backfill_gaps", "code request_start request_end complete missing_head_to missing_tail_from")
def backfill_gaps(m: Market):
    bounds = quality.request_bounds(security_master(m), membership(m), START, END)
    return quality.backfill_gaps(bounds, m.view("adjusted_feed"))


@query(
    "run_manifest", "rows rebalance_dates train_rows validation_rows test_rows latest_scored_date "
    "latest_symbols latest_large latest_mid latest_small folds out_of_sample_rows "
    "out_of_sample_start out_of_sample_end",
)
def run_manifest(m: Market):
    return quality.run_manifest(
        m.predictions, splits.purged_split(m.predictions), test_rows(m), m.month_end
    )
