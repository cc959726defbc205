"""Registered queries: tables written as their owners would, and read back by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom import schemas
from barloom.plans.data_queries import REGIONS, membership
from barloom.plans.market import Market
from barloom.registry import query
from barloom.session import shared_folder
from barloom.sources import feeds, readers, writers


def _place(m: Market, name: str) -> str:
    return f"{shared_folder(m.spark)}/barloom/{name}-{uuid.uuid4().hex}"


def _csv(m: Market, df: DataFrame, name: str) -> str:
    path = _place(m, name)
    df.write.option("header", True).csv(path)
    return path


@query("load_benchmarks", "date benchmark_key", "close", 6)
def load_benchmarks(m: Market):
    path = _place(m, "benchmarks")
    writers.write_table(m.view("benchmarks").withColumn("date", F.col("date").cast("timestamp")), path)
    return readers.load_benchmarks(m.spark, path)


@query("load_membership", "code effective_from effective_to size_bucket membership_mode")
def load_membership(m: Market):
    """Codes without leading zeros, small letters, and words for open ends, as files have them."""
    rows = membership(m).select(
        F.col("code").cast("int").alias("code"), "effective_from",
        F.coalesce(F.col("effective_to").cast("string"), F.lit("open")).alias("effective_to"),
        F.lower("size_bucket").alias("size_bucket"),
    )
    return readers.load_membership(m.spark, _csv(m, rows, "membership"))


@query(
    "load_industry_history", "code effective_from effective_to industry_code industry_name "
    "industry_standard is_point_in_time",
)
def load_industry_history(m: Market):
    return readers.load_industry_history(m.spark, _csv(m, m.view("raw_industry"), "industry"), m.view("master"))


@query("load_positions", "code quantity")
def load_positions(m: Market):
    """Shares traded of each security, modulo a lot: some come out as zero and are dropped."""
    held = m.view("fills").groupBy(F.col("code").cast("int").alias("code")).agg(
        (F.sum("quantity") % 10).alias("quantity")
    )
    return readers.load_positions(m.spark, _csv(m, held, "positions"))


@query("load_predictions", "date code label_end_date", "baseline_score", 5)
def load_predictions(m: Market):
    path = _place(m, "predictions")
    rows = m.predictions.select(
        F.col("date").cast("timestamp").alias("date"), F.col("code").cast("int").cast("string").alias("code"),
        F.col("label_end_date").cast("string").alias("label_end_date"), "baseline_score",
    )
    writers.write_table(rows, path)
    return readers.load_predictions(m.spark, path)


@query("signal_table", "date code industry size_bucket tradable", "score", 5)
def signal_table(m: Market):
    """Saved scores as text, taken as signals."""
    saved = m.predictions.withColumn("saved_score", F.col("baseline_score").cast("string"))
    return schemas.signals(saved, "saved_score")


@query("resolve_constituents", "snapshot_date index_code code security_name")
def resolve_constituents(m: Market):
    """Month-end members under vendor headers, codes with their exchange."""
    raw = m.view("membership_snapshots").select(
        F.col("snapshot_date").cast("string").alias("日期"),
        F.concat(F.lit("sh."), "code").alias("成分券代码"), F.concat(F.lit("S"), "code").alias("成分券名称"),
    )
    return feeds.resolve_constituents(raw, str(len(REGIONS)))
