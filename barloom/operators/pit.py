"""Point-in-time membership and industry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import asof
from barloom.functions.scalars import bucket_order, normalize_symbol, pad_code, word_to_bool
from barloom.operators.clean import keep_last
from barloom.schemas import require_columns


def membership_rules(membership: DataFrame) -> DataFrame:
    """One row of rule violations: bad codes, ends before starts, unknown buckets."""
    bucket = F.upper(F.coalesce("size_bucket", F.lit("UNKNOWN")))
    return membership.agg(
        F.count(F.lit(1)).alias("intervals"),
        F.count_if(~F.coalesce(normalize_symbol("code").rlike(r"^\d{6}$"), F.lit(False)))
        .alias("invalid_codes"),
        F.count_if(F.col("effective_to") < F.col("effective_from")).alias("reversed_intervals"),
        F.count_if(~bucket.isin("LARGE", "MID", "SMALL", "UNKNOWN")).alias("invalid_buckets"),
        F.count_if(F.col("effective_to").isNull()).alias("open_intervals"),
    )


def compress_snapshots(snapshots: DataFrame) -> DataFrame:
    """Turn dated membership lists into intervals of unbroken membership in one bucket.

    A member missing from the next snapshot leaves the day before it; one that comes back starts a
    new interval. In a snapshot that lists a code twice the larger bucket counts.
    """
    require_columns(snapshots, ["snapshot_date", "code", "size_bucket"], "Membership snapshots")
    named = "security_name" in snapshots.columns
    data = snapshots.withColumns(
        {"code": normalize_symbol("code"), "size_bucket": F.upper("size_bucket")}
    )
    keep = ["size_bucket", *(["security_name"] if named else [])]
    data = data.groupBy("snapshot_date", "code").agg(
        F.min_by(F.struct(*keep), bucket_order("size_bucket")).alias("_row")
    ).select("snapshot_date", "code", *[F.col("_row")[c].alias(c) for c in keep])
    # One row per snapshot date.
    one = Window.partitionBy(F.lit(0)).orderBy("snapshot_date")
    calendar = data.select("snapshot_date").distinct().select(
        "snapshot_date",
        F.row_number().over(one).alias("_i"),
        F.date_sub(F.lead("snapshot_date").over(one), 1).alias("_until"),
    )
    w = Window.partitionBy("code").orderBy("_i")
    starts = (
        F.lag("_i").over(w).isNull() | (F.lag("_i").over(w) + 1 != F.col("_i"))
        | (F.lag("size_bucket").over(w) != F.col("size_bucket"))
    )
    runs = (
        data.join(F.broadcast(calendar), "snapshot_date")
        .withColumn("_new", starts.cast("int"))
        .withColumn("_run", F.sum("_new").over(w))
    )
    names = [F.max_by("security_name", "_i").alias("security_name")] if named else []
    return runs.groupBy("code", "_run").agg(
        F.min("snapshot_date").alias("effective_from"),
        F.max_by("_until", "_i").alias("effective_to"),
        F.max_by("size_bucket", "_i").alias("size_bucket"),
        *names,
    ).drop("_run").withColumn("membership_mode", F.lit("point_in_time"))


def point_in_time_membership(bars: DataFrame, membership: DataFrame, *, padded: bool = False) -> DataFrame:
    """Bars of every security that was ever a member, flagged on the days it was one.

    History before admission stays, so look-back factors of a new member are complete. Bars whose codes are
    `padded` already, and lie by code, are not moved.
    """
    require_columns(membership, ["code", "effective_from", "effective_to"], "Membership")
    members = membership.withColumn("code", pad_code("code"))
    rows = (bars if padded else bars.withColumn("code", pad_code("code"))).drop("size_bucket")
    rows = rows.join(members.select("code").distinct(), "code", "left_semi")
    if "membership_mode" in members.columns:
        members = members.where(F.col("membership_mode") == "point_in_time")
    values = ["size_bucket"] if "size_bucket" in members.columns else []
    if values:
        members = members.withColumn(
            "size_bucket", F.upper(F.coalesce("size_bucket", F.lit("UNKNOWN")))
        )
    out = asof.interval_join_bars(rows, members, values)
    if values:
        out = out.withColumn("size_bucket", F.coalesce("size_bucket", F.lit("UNKNOWN")))
    return out.withColumnRenamed("_matched", "is_universe_member")


def latest_bucket(membership: DataFrame, order: str = "effective_from") -> DataFrame:
    """(code, size_bucket) of the membership that started last."""
    bucket = F.upper(F.coalesce("size_bucket", F.lit("UNKNOWN")))
    return membership.groupBy(pad_code("code").alias("code")).agg(
        F.max_by(bucket, order).alias("size_bucket")
    )


def snapshot_membership(
    bars: DataFrame, membership: DataFrame, order: str = "effective_from"
) -> DataFrame:
    """Bars of current members only, with the bucket of their last membership row."""
    rows = bars.withColumn("code", pad_code("code"))
    if "size_bucket" not in membership.columns:
        codes = membership.select(pad_code("code").alias("code")).distinct()
        return rows.join(codes, "code", "left_semi")
    return rows.drop("size_bucket").join(latest_bucket(membership, order), "code")


# Vendor headers of the industry history.
INDUSTRY_ALIASES = {
    "股票代码": "code",
    "symbol": "code",
    "纳入时间": "effective_from",
    "start_date": "effective_from",
    "行业代码": "industry_code",
    "行业名称": "industry_name",
    "行业名称一级": "industry_name",
}


def normalize_industry_history(raw: DataFrame, order: str = "_seq") -> DataFrame:
    """Canonical industry intervals; each ends the day before the next of the same code."""
    df = raw.withColumnsRenamed(INDUSTRY_ALIASES)
    require_columns(df, ["code", "effective_from", "industry_code"], "Industry history")
    known = set(df.columns)
    code = F.trim(F.col("industry_code").cast("string"))
    name = F.col("industry_name") if "industry_name" in known else F.lit(None)
    standard = (
        F.coalesce(F.col("industry_standard").cast("string"), F.lit("UNKNOWN"))
        if "industry_standard" in known else F.lit("SW")
    )
    pit = F.lit(True)
    if "is_point_in_time" in known:
        pit = F.coalesce(word_to_bool("is_point_in_time"), F.lit(False))
    df = df.withColumns(
        {
            "code": normalize_symbol("code"),
            "effective_from": F.col("effective_from").try_cast("date"),
            "industry_code": code,
            "industry_name": F.trim(F.coalesce(name.cast("string"), code)),
            "industry_standard": standard,
            "is_point_in_time": pit,
        }
    ).where(F.col("effective_from").isNotNull())
    if order in known:
        df = keep_last(df, ["code", "effective_from"], [order])
    w = Window.partitionBy("code").orderBy("effective_from")
    return df.withColumn(
        "effective_to", F.date_sub(F.lead("effective_from").over(w), 1)
    ).select(
        "code", "effective_from", "effective_to", "industry_code", "industry_name",
        "industry_standard", "is_point_in_time",
    )


def apply_industry(bars: DataFrame, history: DataFrame) -> DataFrame:
    """Industry in force on the bar's date; none gives UNKNOWN and no point-in-time mark."""
    rows = bars.withColumn("code", normalize_symbol("code")).drop(
        "industry", "industry_code", "industry_is_point_in_time"
    )
    out = asof.interval_join(
        rows, history.withColumn("code", normalize_symbol("code")),
        ["industry_name", "industry_code", "is_point_in_time"],
    )
    return out.withColumns(
        {
            "industry": F.coalesce("industry_name", F.lit("UNKNOWN")),
            "industry_is_point_in_time": F.coalesce("is_point_in_time", F.lit(False)),
        }
    ).drop("_matched", "industry_name", "is_point_in_time")


def latest_classification(changes: DataFrame, order: str = "_seq") -> DataFrame:
    """Latest industry per code from a change log; rows without a date sort after all dates."""
    place = F.struct(F.coalesce("change_date", F.lit("9999-12-31").cast("date")), F.col(order))
    name = F.trim("industry_name")
    last = changes.groupBy(normalize_symbol("code").alias("code")).agg(
        F.max_by(F.struct(F.trim("industry_code").alias("industry_code"),
                          name.alias("industry_name")), place).alias("_row")
    )
    return last.select(
        "code", F.col("_row.industry_code").alias("industry_code"),
        F.col("_row.industry_name").alias("industry_name"),
    ).where((F.col("industry_name") != "") & (F.lower("industry_name") != "nan"))


def first_classification(members: DataFrame, order: str = "_seq") -> DataFrame:
    """First board listing of each code; the code is the first run of digits in the text."""
    digits = F.regexp_extract(F.col("code").cast("string"), r"\d{1,6}", 0)
    rows = members.where(digits != "").withColumn("code", F.lpad(digits, 6, "0"))
    first = rows.groupBy("code").agg(
        F.min_by(F.struct("industry_code", "industry_name"), order).alias("_row")
    )
    return first.select("code", "_row.industry_code", "_row.industry_name")


def backfilled_industry(current: DataFrame, start: str) -> DataFrame:
    """Current industries as one open interval that never counts as point-in-time."""
    return normalize_industry_history(
        current.withColumns(
            {
                "effective_from": F.lit(start),
                "industry_standard": F.lit("FREE_CURRENT_SNAPSHOT_BACKFILL"),
                "is_point_in_time": F.lit(False),
            }
        )
    )
