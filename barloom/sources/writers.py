"""Keyed upsert, the yearly store and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.clean import keep_last
from barloom.session import durable
from barloom.sources.readers import exists

YEAR = "_year"


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with incoming ones laid over them by key.

    Where a key repeats inside a batch its last row by `_seq` wins, and without `_seq` the largest by
    its columns in the order of their names, so the result does not depend on the partitioning.
    """
    both = existing.withColumn("_batch", F.lit(0)).unionByName(
        incoming.withColumn("_batch", F.lit(1)), allowMissingColumns=True
    )
    told = [c for c in ("_batch", "_seq") if c in both.columns]
    rest = sorted(c for c in both.columns if c not in keys and c not in told)
    return keep_last(both, keys, [*told, *rest]).drop("_batch", "_copies")


def upsert_store(incoming: DataFrame, path: str, keys: list[str], *, date: str = "date") -> list[int]:
    """Lay a batch over a store partitioned by year; returns the years it touched.

    Only these are read and written again, the files of all others stay as they are. The merged years
    are written aside first, so a failing job leaves the store whole and may be run again; a year's
    files are then replaced by Spark's dynamic partition overwrite. Rows without a date are kept in
    year 0. The date must be a key, or a row could move between years.
    """
    if date not in keys:
        raise ValueError(f"{date} must be a key of the store")
    spark = incoming.sparkSession
    year = F.coalesce(F.year(date), F.lit(0)).alias(YEAR)
    batch = durable(incoming.select("*", year))
    # At most the years of the calendar.
    years = sorted(r[0] for r in batch.select(YEAR).distinct().collect())
    if not years:
        return []
    stored = batch.limit(0)
    if exists(spark, path):
        stored = spark.read.option("mergeSchema", True).parquet(path).where(F.col(YEAR).isin(years))
    merged = durable(upsert(stored, batch, keys))
    # Keys spread a year over several files.
    merged.repartition(YEAR, *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        YEAR
    ).parquet(path)
    return years


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path).drop(YEAR)


def write_table(df: DataFrame, path: str, *, partition_by: list[str] | None = None) -> None:
    """Replace a Parquet table; the commit protocol publishes it as a whole."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_reports(reports: dict[str, DataFrame], folder: str, *, prefix: str = "") -> None:
    """Write a pack of reports: tables as CSV with header, `*_summary` as JSON lines."""
    for name, df in reports.items():
        path = f"{folder}/{prefix}{name}"
        if name.endswith("_summary"):
            df.write.mode("overwrite").json(path)
        else:
            df.write.mode("overwrite").option("header", True).csv(path)
