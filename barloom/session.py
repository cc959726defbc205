"""Session settings and the durable cut used between long plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("barloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    Only a local session that names none, as in tests, gets a temporary one.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder all executors share")
    key = context.applicationId
    if key not in _local_folders:
        _local_folders[key] = tempfile.mkdtemp(prefix="barloom-")
    return _local_folders[key]


def durable(df: DataFrame) -> DataFrame:
    """Write the table to the shared folder and read it back.

    The lineage ends here, so lost executors cost nothing computed before, later plans stay small,
    read only the columns they need and know the table's true size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/barloom/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def durable_by(df: DataFrame, key: str) -> DataFrame:
    """`durable`, written in buckets of `key`: windows and groups by it find its rows together.

    There are as many buckets as a shuffle has partitions, one file each. The catalog knows the table by
    its folder, which stays the owner's to clear.
    """
    spark = df.sparkSession
    name = f"barloom_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        df.repartition(buckets, key).write.option("compression", "zstd")
        .option("path", f"{shared_folder(spark)}/barloom/{name}")
        .bucketBy(buckets, key).sortBy(key).saveAsTable(name, format="parquet")
    )
    # Under new names, as a union knows its sides to lie alike only for columns that name no table.
    table = spark.table(name)
    return table.select(*[F.col(c).alias(c) for c in table.columns])
