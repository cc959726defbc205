"""Storage audit, universe checks, quality gates and run manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.asof import active_on
from barloom.functions.scalars import any_of, bucket_order, ratio
from barloom.operators.clean import number
from barloom.schemas import BAR_REQUIRED, require_columns

RAW_PRICES = ["raw_open", "raw_high", "raw_low", "raw_close"]

# Smallest universes that count as complete.
COMPLETE_FROM = {
    "csi800_large": 270,
    "csi800_mid": 450,
    "csi300": 270,
    "csi500": 450,
    "csi1000": 900,
    "membership_file": 200,
    "all_a": 1000,
}
# Sizes of index segments.
SEGMENT_BUCKETS = {"csi300": "LARGE", "csi500": "MID", "csi1000": "SMALL"}
STORED_MEMBERS_FROM = 700


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def audit_symbols(bars: DataFrame, *, min_rows: int = 120) -> DataFrame:
    """One line per security with the first broken storage rule, coverage and a row-count warning.

    Copies of a (code, date) are counted in a first aggregation, so nothing is collected per code.
    """
    require_columns(bars, [*BAR_REQUIRED, *RAW_PRICES], "Bar storage")
    prices = ["open", "high", "low", "close", *RAW_PRICES]
    typed = bars.withColumns({c: number(c) for c in prices})
    bad_price = any_of([F.coalesce(F.col(c) <= 0, F.lit(True)) for c in prices])
    pit = (
        F.coalesce("status_is_point_in_time", F.lit(False))
        if "status_is_point_in_time" in bars.columns else F.lit(False)
    )
    cap = number("market_cap") > 0 if "market_cap" in bars.columns else F.lit(False)
    daily = typed.groupBy("code", F.col("date").try_cast("date").alias("date")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(bad_price).alias("bad_price"),
        F.count_if(F.col("high") < F.greatest("open", "close", "low")).alias("bad_high"),
        F.count_if(F.col("low") > F.least("open", "close", "high")).alias("bad_low"),
        F.count_if(pit).alias("pit"),
        F.count_if(cap).alias("cap"),
    )
    per_code = daily.groupBy("code").agg(
        F.sum("n").alias("rows"), F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.count_if(F.col("date").isNull()).alias("null_dates"),
        F.count_if(F.col("n") > 1).alias("repeated"),
        *[F.sum(c).alias(c) for c in ("bad_price", "bad_high", "bad_low", "pit", "cap")],
    )
    error = (
        F.when(F.col("null_dates") > 0, F.lit("invalid dates"))
        .when(F.col("repeated") > 0, F.lit("duplicate date/code rows"))
        .when(F.col("bad_price") > 0, F.lit("non-positive or missing adjusted/raw prices"))
        .when(F.col("bad_high") > 0, F.lit("invalid adjusted high price"))
        .when(F.col("bad_low") > 0, F.lit("invalid adjusted low price"))
    )
    status = (
        F.when(F.col("error").isNotNull(), F.lit("FAIL"))
        .when(F.col("rows") < min_rows, F.lit("WARN")).otherwise(F.lit("PASS"))
    )
    return per_code.withColumn("error", error).withColumns(
        {
            "status": status,
            "point_in_time_status_coverage": F.col("pit") / F.col("rows"),
            "market_cap_coverage": F.col("cap") / F.col("rows"),
        }
    ).select(
        "code", "status", "error", "rows", "start_date", "end_date", "pit", "cap",
        "point_in_time_status_coverage", "market_cap_coverage",
    )


def audit_coverage(master: DataFrame, bars: DataFrame) -> DataFrame:
    """Listed securities without bars and bars of unlisted securities."""
    listed, stored = master.select("code"), bars.select("code").distinct()
    return listed.join(stored, "code", "left_anti").withColumn(
        "problem", F.lit("MASTER_WITHOUT_BARS")
    ).unionByName(
        stored.join(listed, "code", "left_anti").withColumn(
            "problem", F.lit("BARS_WITHOUT_MASTER")
        )
    )


def one_row(spark, **columns: Column) -> DataFrame:
    """A single row whose columns are one-row subqueries or expressions of them."""
    return spark.range(1).select(*[c.alias(name) for name, c in columns.items()])


def audit_summary(
    symbols: DataFrame, coverage: DataFrame, master: DataFrame, benchmarks: DataFrame,
    industry: DataFrame, actions: DataFrame, *, benchmark_keys: list[str],
) -> DataFrame:
    """One row: totals, coverage and the number of failed rules; `passed` without any failure."""
    good = F.col("status") != "FAIL"
    totals = symbols.agg(
        F.count(F.lit(1)).alias("symbols"),
        F.sum(F.when(good, F.col("rows"))).alias("rows"),
        F.min(F.when(good, F.col("start_date"))).alias("start_date"),
        F.max(F.when(good, F.col("end_date"))).alias("end_date"),
        F.count_if(~good).alias("failed"),
        F.count_if(F.col("status") == "WARN").alias("warnings"),
        F.sum(F.when(good, F.col("pit"))).alias("pit"),
        F.sum(F.when(good, F.col("cap"))).alias("cap"),
    )
    listing = master.groupBy("code").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.col("instrument_type") != "STOCK").alias("other"),
        F.bool_or(F.col("exchange") == "UNKNOWN").alias("unknown"),
    ).agg(
        (F.coalesce(F.bool_or(F.col("n") > 1), F.lit(False)).cast("int")
         + F.coalesce(F.bool_or("other"), F.lit(False)).cast("int")
         + F.coalesce(F.bool_or("unknown"), F.lit(False)).cast("int")).alias("broken")
    )
    gaps = coverage.agg(F.count_distinct("problem").cast("int").alias("broken"))
    keys = benchmarks.groupBy("benchmark_key", "date").agg(F.count(F.lit(1)).alias("n")).groupBy(
        "benchmark_key"
    ).agg(F.bool_or(F.col("n") > 1).alias("twice"))
    wanted = F.col("benchmark_key").isin(benchmark_keys)
    index = keys.agg(
        (F.coalesce(F.bool_or("twice"), F.lit(False)).cast("int")
         + (F.count_if(wanted) < len(benchmark_keys)).cast("int")).alias("broken"),
        F.array_join(F.array_sort(F.collect_set("benchmark_key")), "+").alias("names"),
    )
    out = totals.withColumns(
        {
            "failures": F.col("failed") + listing.scalar() + gaps.scalar()
            + index.select("broken").scalar(),
            "benchmarks": index.select("names").scalar(),
            "industry_history_symbols": industry.select("code").distinct().agg(
                F.count(F.lit(1)).alias("n")).scalar(),
            "corporate_action_rows": actions.agg(F.count(F.lit(1)).alias("n")).scalar(),
            "point_in_time_status_coverage": ratio("pit", "rows"),
            "market_cap_coverage": ratio("cap", "rows"),
        }
    )
    return out.withColumn("passed", F.col("failures") == 0).drop("failed", "pit", "cap")


def universe_segments(segments: dict[str, DataFrame]) -> DataFrame:
    """Union of index segments; a code in several keeps the larger bucket, `segments` counts them."""
    rows = None
    for segment, members in segments.items():
        tagged = members.select(
            "code", "security_name", F.lit(segment).alias("universe_segment"),
            F.lit(SEGMENT_BUCKETS.get(segment, "UNKNOWN")).alias("size_bucket"),
        )
        rows = tagged if rows is None else rows.unionByName(tagged)
    picked = rows.groupBy("code").agg(
        F.min_by(
            F.struct("security_name", "universe_segment", "size_bucket"),
            F.struct(bucket_order("size_bucket"), "universe_segment"),
        ).alias("_row"),
        F.count(F.lit(1)).alias("segments"),
    )
    return picked.select("code", "_row.*", "segments").withColumn(
        "membership_mode", F.lit("current_snapshot")
    )


def whole_market(master: DataFrame, snapshot: str) -> DataFrame:
    """Every listed security as a current member without a size."""
    return master.select(
        "code", "security_name", day(snapshot).alias("effective_from"),
        F.lit(None).cast("date").alias("effective_to"), F.lit("UNKNOWN").alias("size_bucket"),
        F.lit("current_snapshot").alias("membership_mode"),
    )


def sample_universe(df: DataFrame, symbols: int) -> DataFrame:
    """Rows of the first `symbols` codes in order; a top-k of distinct codes, then a semi-join."""
    first = df.select("code").distinct().orderBy("code").limit(symbols)
    return df.join(F.broadcast(first), "code", "left_semi")


def survivorship_bias(membership: DataFrame, start: str) -> DataFrame:
    """Whether a current snapshot would be carried back to `start`."""
    current = F.col("membership_mode") == "current_snapshot"
    latest = F.max(F.when(current, F.col("effective_from")))
    return membership.agg(
        latest.alias("snapshot_date"),
        F.coalesce(day(start) < latest, F.lit(False)).alias("survivorship_bias"),
    )


def active_members(membership: DataFrame, on: str) -> DataFrame:
    """(code, size_bucket) of members on a date, by the interval that started last."""
    active = membership.where(
        active_on(day(on), F.col("effective_from"), F.col("effective_to"))
    )
    return active.groupBy("code").agg(
        F.max_by("size_bucket", "effective_from").alias("size_bucket")
    )


def bucket_counts(membership: DataFrame, on: str) -> DataFrame:
    return active_members(membership, on).groupBy("size_bucket").agg(
        F.count(F.lit(1)).alias("symbols")
    )


def stored_membership_usable(
    membership: DataFrame, start: str, end: str, *, source: str, minimum: int = STORED_MEMBERS_FROM
) -> DataFrame:
    """Whether stored intervals may be reused for a request."""
    first = day(start)
    month_end = F.when(
        first == F.last_day(first), F.last_day(F.add_months(first, 1))
    ).otherwise(F.last_day(first))
    head = membership.agg(
        F.coalesce(F.bool_or(F.col("membership_source") == source), F.lit(False)).alias("tagged"),
        F.coalesce(F.min("effective_from") <= month_end, F.lit(False)).alias("early"),
    )
    active = active_members(membership, end).agg(F.count(F.lit(1)).alias("n")).scalar()
    return head.withColumn("active", active).withColumn(
        "usable", F.col("tagged") & F.col("early") & (F.col("active") >= minimum)
    )


def industry_coverage(
    master: DataFrame, membership: DataFrame, history: DataFrame, start: str
) -> DataFrame:
    """Securities whose first point-in-time industry is not after their first required day."""
    members = membership.groupBy("code").agg(F.min("effective_from").alias("first"))
    industries = history.where(F.coalesce("is_point_in_time", F.lit(False))).groupBy("code").agg(
        F.min("effective_from").alias("known")
    )
    required = F.greatest(day(start), F.coalesce("first", day(start)))
    return master.select("code").join(members, "code", "left").join(
        industries, "code", "left"
    ).agg(
        F.count(F.lit(1)).alias("symbols"),
        F.count_if(F.col("known") <= required).alias("covered"),
    )


def request_bounds(
    master: DataFrame, membership: DataFrame, start: str, end: str
) -> DataFrame:
    """Range of bars each security needs: look-back before admission, a tail after it left."""
    spans = membership.groupBy("code").agg(
        F.min("effective_from").alias("first"),
        F.max("effective_to").alias("last"),
        F.bool_or(F.col("effective_to").isNull() | (F.col("effective_to") >= day(end)))
        .alias("open"),
    )
    late = F.least(day(end), F.date_add("last", 60))
    return master.select("code").join(spans, "code", "left").select(
        "code",
        F.greatest(day(start), F.coalesce(F.date_sub("first", 252), day(start)))
        .alias("request_start"),
        F.when(F.coalesce("open", F.lit(True)), day(end)).otherwise(late).alias("request_end"),
    )


def backfill_gaps(bounds: DataFrame, bars: DataFrame) -> DataFrame:
    """Request ranges that stored bars do not cover; null ends mean nothing is missing there."""
    held = bars.groupBy("code").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    joined = bounds.join(held, "code", "left")
    before = F.coalesce(F.col("lo") > F.col("request_start"), F.lit(True))
    after = F.coalesce(F.col("hi") < F.col("request_end"), F.lit(True))
    return joined.withColumn("complete", ~before & ~after).select(
        "code", "request_start", "request_end", "complete",
        F.when(before, F.least(F.coalesce(F.date_sub("lo", 1), F.col("request_end")),
                               F.col("request_end"))).alias("missing_head_to"),
        F.when(after, F.greatest(F.coalesce(F.date_add("hi", 1), F.col("request_start")),
                                 F.col("request_start"))).alias("missing_tail_from"),
    )


def universe_complete(universe: str, large: Column, mid: Column, symbols: Column) -> Column:
    """Whether the universe has at least the size expected of it."""
    if universe == "csi800":
        return (large >= COMPLETE_FROM["csi800_large"]) & (mid >= COMPLETE_FROM["csi800_mid"])
    return symbols >= COMPLETE_FROM.get(universe, COMPLETE_FROM["all_a"])


def quality_gates(
    *, universe: str, end: str, start: str, master: DataFrame, membership: DataFrame,
    industry: DataFrame, actions: DataFrame, symbols: DataFrame, benchmarks: DataFrame,
    audit: DataFrame, benchmark_keys: list[str], industry_required: bool = True,
    truncated: bool = False,
) -> DataFrame:
    """One row of gates, readiness and evidence grade."""
    spark = master.sparkSession
    active = active_members(membership, end).agg(
        F.struct(
            F.count_if(F.col("size_bucket") == "LARGE").alias("large"),
            F.count_if(F.col("size_bucket") == "MID").alias("mid"),
        ).alias("s")
    ).scalar()
    listed = master.agg(F.count(F.lit(1)).alias("n")).scalar()
    cover = industry_coverage(master, membership, industry, start).agg(
        F.bool_and(F.col("covered") == F.col("symbols")).alias("c")
    ).scalar()
    stocks = symbols.agg(
        F.struct(
            F.count_if(F.col("status") == "FAIL").alias("failed"),
            F.coalesce(F.bool_and(F.col("point_in_time_status_coverage") == 1.0), F.lit(False))
            .alias("status"),
        ).alias("s")
    ).scalar()
    keys = benchmarks.where(F.col("benchmark_key").isin(benchmark_keys)).select(
        "benchmark_key"
    ).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    base = one_row(
        spark,
        active=active, listed=listed,
        point_in_time_membership=membership.agg(
            F.coalesce(F.bool_and(F.col("membership_mode") == "point_in_time"), F.lit(False))
            .alias("p")).scalar(),
        point_in_time_industry=F.coalesce(cover, F.lit(False)),
        stocks=stocks,
        corporate_actions=actions.agg((F.count(F.lit(1)) > 0).alias("a")).scalar(),
        required_benchmarks=keys == len(benchmark_keys),
        storage_audit_passed=audit.select("passed").scalar(),
    )
    complete = F.lit(not truncated) & universe_complete(
        universe, F.col("active.large"), F.col("active.mid"), F.col("listed")
    )
    gates = base.withColumns(
        {
            "large_members": F.col("active.large"), "mid_members": F.col("active.mid"),
            "universe_completeness": complete,
            "raw_and_adjusted_prices": F.col("stocks.failed") == 0,
            "historical_security_status": F.col("stocks.status")
            & (F.col("stocks.failed") == 0),
            "historical_industry_required": F.lit(industry_required),
        }
    )
    core = (
        F.col("universe_completeness") & F.col("raw_and_adjusted_prices")
        & F.col("required_benchmarks") & F.col("storage_audit_passed")
    )
    ready = (
        core & F.col("point_in_time_membership") & F.col("historical_security_status")
        & (F.col("point_in_time_industry") | ~F.col("historical_industry_required"))
        & F.col("corporate_actions")
    )
    grade = (
        F.when(F.col("research_ready") & ~F.col("historical_industry_required"),
               F.lit("REPRODUCIBLE_FREE_DATA"))
        .when(F.col("research_ready"), F.lit("FORMAL"))
        .when(core & F.lit(not truncated), F.lit("LIMITED_RESEARCH"))
        .otherwise(F.lit("ENGINEERING_ONLY"))
    )
    return gates.withColumn("research_ready", ready).withColumn("evidence_grade", grade).drop(
        "active", "listed", "stocks"
    )


def run_manifest(
    dataset: DataFrame, split: DataFrame, test_rows: DataFrame, frame: DataFrame
) -> DataFrame:
    """One row of counts describing a research run."""
    last = frame.agg(F.max("date").alias("d"))
    latest = frame.where((F.col("date") == last.scalar()) & F.col("tradable")).agg(
        F.struct(
            F.count(F.lit(1)).alias("symbols"),
            F.max("date").alias("date"),
            *[F.count_if(F.col("size_bucket") == b).alias(b.lower())
              for b in ("LARGE", "MID", "SMALL")],
        ).alias("s")
    ).scalar()
    parts = split.agg(
        F.struct(*[F.count_if(F.col("split") == p).alias(p)
                   for p in ("train", "validation", "test")]).alias("s")
    ).scalar()
    oos = test_rows.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.min("date").alias("lo"),
                 F.max("date").alias("hi"), F.max("fold_id").alias("folds")).alias("s")
    ).scalar()
    per_date = dataset.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    head = per_date.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("rebalance_dates")
    ).withColumns({"p": parts, "l": latest, "o": oos})
    return head.select(
        "rows", "rebalance_dates",
        *[F.col(f"p.{p}").alias(f"{p}_rows") for p in ("train", "validation", "test")],
        F.col("l.date").alias("latest_scored_date"), F.col("l.symbols").alias("latest_symbols"),
        F.col("l.large").alias("latest_large"), F.col("l.mid").alias("latest_mid"),
        F.col("l.small").alias("latest_small"),
        F.col("o.folds").alias("folds"), F.col("o.n").alias("out_of_sample_rows"),
        F.col("o.lo").alias("out_of_sample_start"), F.col("o.hi").alias("out_of_sample_end"),
    )
