"""Helpers shared by the operators: written cuts, free column names, readers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import barloom
from barloom.session import durable as landed  # noqa: F401  a table in spark.checkpoint.dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not use, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def column(df: DataFrame, name: str) -> Column:
    """The column by its whole name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


_shipped: dict[str, str] = {}


def shipped(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(barloom.__file__).resolve().parents[1]
        name = Path(tempfile.mkdtemp(prefix="package-")) / "barloom.zip"
        with zipfile.ZipFile(name, "w") as out:
            for file in sorted((root / "barloom").rglob("*.py")):
                out.write(file, file.relative_to(root))
        context.addPyFile(str(name))
        _shipped[context.applicationId] = str(name)


def mapped(df: DataFrame, run, ddl) -> DataFrame:
    shipped(df.sparkSession)
    return df.mapInArrow(run, ddl)


def utf8(batch, name: str) -> list[bytes]:
    """The texts of an Arrow column as bytes; null is empty."""
    import pyarrow as pa

    col = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [b if b is not None else b"" for b in col.cast(kind).to_pylist()]


def small_batches(batches, name: str, most: int = 4 << 20):
    """The same rows in batches of at most some bytes of text, so that memory stays bounded."""
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).cumsum()
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            stop = max(start + 1, int(size.searchsorted(before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
