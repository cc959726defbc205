"""Readers of bar folders, membership, industry, actions, benchmarks and positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import schemas
from barloom.functions.scalars import normalize_symbol, pad_code
from barloom.operators import clean, pit

COLUMNAR = ("parquet", "pq")
INGEST = "_ingest"


def _files(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Names under a folder by suffix, or the path itself, through Hadoop's file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        raise FileNotFoundError(path)
    if fs.getFileStatus(hadoop).isFile():
        return {path.rsplit(".", 1)[-1].lower(): [path]}
    found: dict[str, list[str]] = {}
    for status in fs.listStatus(hadoop):
        name = status.getPath().getName()
        if not name.startswith(("_", ".")) and "." in name:
            found.setdefault(name.rsplit(".", 1)[-1].lower(), []).append(f"{path}/{name}")
    return found


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """All bar files of a folder, or one file; a missing code column comes from the file name.

    The column INGEST orders rows by file name, then by place in the file.
    """
    found = _files(spark, path)
    parts = []
    if "csv" in found:
        # Everything as text, so codes keep their zeros; types come with validation. Files that name
        # their columns in another order are scans of their own, joined by name.
        by_header: dict[str, list[str]] = {}
        for file in found["csv"]:
            by_header.setdefault(_first_line(spark, file), []).append(file)
        for header in sorted(by_header):
            parts.append(spark.read.option("header", True).csv(by_header[header]))
    columnar = [f for kind in COLUMNAR for f in found.get(kind, [])]
    if columnar:
        parts.append(spark.read.option("mergeSchema", True).parquet(*columnar))
    if not parts:
        raise FileNotFoundError(f"No CSV or Parquet files found under {path}")
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.", 1)
    named = F.when(stem != "", pad_code(stem))
    frames = []
    for part in parts:
        code = F.coalesce(F.col("code").cast("string"), named) if "code" in part.columns else named
        # Rows of one block of a file are read in order by one task, so their ids rise.
        place = F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        )
        frames.append(
            part.select("*", code.alias("_code"), place.alias(INGEST)).drop("code")
            .withColumnRenamed("_code", "code")
        )
    if len(frames) == 1:
        return frames[0]
    text = [
        f.select([F.col(c) if c == INGEST else F.col(c).cast("string").alias(c) for c in f.columns])
        for f in frames
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), text)


def _first_line(spark: SparkSession, file: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        reader = spark._jvm.java.io.InputStreamReader(stream, "UTF-8")
        return spark._jvm.java.io.BufferedReader(reader).readLine() or ""
    finally:
        stream.close()


def load_bars(spark: SparkSession, path: str, *, default_lot_size: int = 100) -> DataFrame:
    """Validated bars of a file, a folder of files or a market root.

    A market root holds `bars/` and may hold `universe_membership.parquet` and
    `industry_history.parquet`, which are applied before validation.
    """
    root = exists(spark, f"{path}/bars")
    bars = read_bars(spark, f"{path}/bars" if root else path)
    schemas.require_columns(bars, schemas.BAR_REQUIRED, "Market data")
    # The last row of a date and code stands for it, before any join looks at it.
    bars = clean.keep_last(clean.coerce(bars), ["date", "code"], [INGEST]).drop(INGEST, "_copies")
    if root:
        side = f"{path}/universe_membership.parquet"
        if exists(spark, side):
            membership = spark.read.parquet(side)
            bars = _apply_membership(bars, membership)
        side = f"{path}/industry_history.parquet"
        if exists(spark, side):
            bars = pit.apply_industry(bars, spark.read.parquet(side))
    return clean.clean_bars(bars, default_lot_size=default_lot_size)


def _apply_membership(bars: DataFrame, membership: DataFrame) -> DataFrame:
    schemas.require_columns(membership, ["code"], "Universe membership")
    if "membership_mode" not in membership.columns:
        return pit.snapshot_membership(bars, _ordered(membership), "_seq")
    # A handful of modes at most; the branch is a property of the stored table.
    historical = membership.where(F.col("membership_mode") == "point_in_time").limit(1).count()
    if historical:
        return pit.point_in_time_membership(bars, membership)
    return pit.snapshot_membership(bars, _ordered(membership), "_seq")


def _ordered(membership: DataFrame) -> DataFrame:
    if "effective_from" in membership.columns:
        return membership.withColumn("_seq", F.col("effective_from"))
    return membership.withColumn("_seq", F.monotonically_increasing_id())


def load_actions(spark: SparkSession, path: str) -> DataFrame:
    """Corporate actions of a file or market root; a missing file is an empty table."""
    inner = f"{path}/corporate_actions.parquet"
    source = inner if exists(spark, inner) else path
    if not exists(spark, source):
        return spark.createDataFrame([], schemas.ACTION)
    actions = spark.read.parquet(source)
    schemas.require_columns(actions, schemas.ACTION.names[:-1], "Corporate actions")
    return actions.withColumns(
        {"code": pad_code("code"), "ex_date": F.col("ex_date").cast("date")}
    )


def load_benchmarks(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    schemas.require_columns(df, schemas.BENCHMARK.names, "Benchmark data")
    return df.withColumn("date", F.col("date").cast("date"))


BUCKETS = ("LARGE", "MID", "SMALL", "UNKNOWN")


def _checked(value: Column, rules: dict[str, Column]) -> Column:
    """The value; a row that breaks a rule fails the read, in the task that meets it."""
    out = value
    for message, broken in rules.items():
        out = F.when(F.coalesce(broken, F.lit(False)), F.raise_error(F.lit(message)).cast("string")).otherwise(out)
    return out


def load_membership(spark: SparkSession, path: str) -> DataFrame:
    """Point-in-time membership intervals from CSV.

    A bad code, an end before its start or an unknown bucket fails the read; `pit.membership_rules`
    counts them all.
    """
    df = spark.read.option("header", True).csv(path)
    schemas.require_columns(df, ["code", "effective_from", "effective_to"], "Membership file")
    bucket = F.col("size_bucket") if "size_bucket" in df.columns else F.lit(None)
    typed = df.withColumns(
        {
            "code": normalize_symbol("code"),
            "effective_from": F.col("effective_from").cast("date"),
            "effective_to": F.col("effective_to").try_cast("date"),
            "membership_mode": F.lit("point_in_time"),
            "size_bucket": F.upper(F.coalesce(bucket.cast("string"), F.lit("UNKNOWN"))),
        }
    )
    return typed.withColumn(
        "code",
        _checked(
            F.col("code"),
            {
                "Membership file contains a code that has not six digits":
                    ~F.coalesce(F.col("code").rlike(r"^\d{6}$"), F.lit(False)),
                "Membership ends before it starts": F.col("effective_to") < F.col("effective_from"),
                f"Membership buckets are {', '.join(BUCKETS)}": ~F.col("size_bucket").isin(*BUCKETS),
            },
        ),
    )


def load_industry_history(
    spark: SparkSession, path: str, master: DataFrame | None = None
) -> DataFrame:
    """Industry intervals from CSV or Parquet, limited to listed securities."""
    if path.lower().endswith(COLUMNAR):
        raw = spark.read.parquet(path)
    else:
        raw = spark.read.option("header", True).csv(path)
    history = pit.normalize_industry_history(raw)
    return history if master is None else history.join(
        master.select("code"), "code", "left_semi"
    )


def load_positions(spark: SparkSession, path: str) -> DataFrame:
    """Current holdings, zero quantities dropped; a bad or repeated row fails the read."""
    df = spark.read.option("header", True).csv(path)
    schemas.require_columns(df, ["code", "quantity"], "Positions file")
    rows = df.groupBy(pad_code("code").alias("code")).agg(
        F.max(F.col("quantity").cast("long")).alias("quantity"), F.count(F.lit(1)).alias("n")
    )
    bad = F.raise_error(F.lit("Positions must contain unique codes and non-negative quantities"))
    checked = F.when((F.col("n") == 1) & (F.col("quantity") >= 0), F.col("quantity")).otherwise(
        bad.cast("long")
    )
    return rows.select("code", checked.alias("quantity")).where(F.col("quantity") > 0)


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Saved scores with padded codes and day dates."""
    df = spark.read.parquet(path)
    typed = {"code": pad_code("code"), "date": F.col("date").cast("date")}
    if "label_end_date" in df.columns:
        typed["label_end_date"] = F.col("label_end_date").cast("date")
    return df.withColumns(typed)
