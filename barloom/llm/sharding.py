"""Sharding by sampled splitters with DataFrame operations only; the law is `bytes`.

Records are ordered by (hash of the text, doc_id, row). A sample of keys, drawn with weights equal to
the sizes, gives splitters at its quantiles; they cut the order into ranges. Ranges that exceed
OVERFULL times the mean number of rows are cut again by a sample of their own rows. A record's shard
follows from the bytes that stand before it: those of the ranges before and, by a window over its
range alone, those before it in its range. So shard sizes differ by less than two records, whatever
the sample, and a hot text is spread like any other. The number of ranges grows with the rows, so a
range never holds more rows than one task can sort.

Edge cases: a null text has size 1, an empty one too; null ids come first; repeated rows are told
apart by a row number; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import column, documents, filled, landed

SHARDS = 16
RANGES_PER_SHARD = 32
ROWS_PER_RANGE = 2_000_000
SAMPLES_PER_RANGE = 16
OVERFULL = 2
LEAST_ROWS = 250
KEY = "struct<h:bigint,doc_id:bigint,row:bigint>"
BY_KEY = ("h", "doc_id", "row")


def _sampled(keys: DataFrame, samples: int, weight: Column) -> list[tuple]:
    """Keys drawn with these weights: the smallest of exponential times with these rates.

    Only times below a limit that about twice the sample passes leave their tasks, so what the driver
    gets does not grow with the number of partitions. Few heavy rows pass less; then the limit rises.
    """
    chance = (F.xxhash64(F.lit("splitters"), *BY_KEY) / F.lit(2.0**64)) + 0.5
    times = -F.log(F.greatest(chance, F.lit(1e-18))) / weight
    timed = keys.select(*BY_KEY, times.alias("time"), weight.cast("double").alias("weight"))
    total, count = timed.agg(F.sum("weight"), F.count(F.lit(1))).first()
    if not count:
        return []
    limit = 2.0 * samples / total
    while True:
        got = timed.where(F.col("time") < limit).orderBy("time", *BY_KEY).limit(samples).collect()
        if len(got) == min(samples, count):
            break
        limit *= 4
    return sorted(((r.h, r.doc_id, r.row) for r in got), key=_order)


def _order(key: tuple) -> tuple:
    h, doc, row = key
    return (h, doc is not None, doc or 0, row)


def _range_of(splitters: list[tuple]) -> Column:
    """Number of splitters not above the key, found in two levels of about the square root each."""
    if not splitters:
        return F.lit(0)
    wide = max(1, int(len(splitters) ** 0.5))
    blocks = [splitters[i : i + wide] for i in range(0, len(splitters), wide)]
    as_json = lambda x: [dict(zip(BY_KEY, k)) for k in x]
    # One literal each, folded into arrays when the plan is made.
    tops = F.from_json(F.lit(json.dumps(as_json([b[0] for b in blocks]))), f"array<{KEY}>")
    all_of = F.from_json(F.lit(json.dumps([as_json(b) for b in blocks])), f"array<array<{KEY}>>")
    key = F.struct(*BY_KEY)
    block = F.size(F.filter(tops, lambda s: s <= key))
    inner = F.size(F.filter(F.element_at(all_of, F.greatest(block, F.lit(1))), lambda s: s <= key))
    return F.when(block == 0, 0).otherwise((block - 1) * wide + inner)


def splitters_of(keys: DataFrame, ranges: int, n: int, samples_per_range: int = SAMPLES_PER_RANGE,
                 least_rows: int = LEAST_ROWS) -> tuple[list[tuple], list]:
    """Splitters and, for each range in order, its (range, bytes, rows)."""
    sample = _sampled(keys, ranges * samples_per_range, F.col("size"))
    splitters = sorted(set(sample[samples_per_range::samples_per_range]), key=_order)
    most = OVERFULL * max(least_rows, n // ranges)
    while True:
        sizes = (
            keys.groupBy(_range_of(splitters).alias("range"))
            .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).orderBy("range").collect()
        )
        over = {r["range"]: r["n"] for r in sizes if r["n"] > most}
        if not over:
            return splitters, sizes
        # Rows are drawn alike here: what such a range holds is many small records.
        parts = -(-2 * sum(over.values()) // most)
        drawn = _sampled(keys.where(_range_of(splitters).isin(list(over))), parts * samples_per_range, F.lit(1.0))
        splitters = sorted({*splitters, *drawn[samples_per_range // 2 :: samples_per_range]}, key=_order)


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
            ranges: int | None = None, samples_per_range: int = SAMPLES_PER_RANGE, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row for each record."""
    text = column(docs, text_col)
    raw = filled(text)
    keys = landed(
        docs.select(
            column(docs, id_col).cast("long").alias("doc_id"),
            (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"),
            F.xxhash64(raw).alias("h"), F.monotonically_increasing_id().alias("row"),
        )
    )
    total, n = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = ranges or shards * max(RANGES_PER_SHARD, -(-n // (shards * ROWS_PER_RANGE)))
    splitters, sizes = splitters_of(keys, ranges, n, samples_per_range, least_rows)
    before, begun, rows = [], 0, 0
    for r in sizes:
        before.append({"range": r["range"], "bytes": begun, "n": rows})
        begun, rows = begun + r["bytes"], rows + r["n"]
    # One row for each range: at most a few for every ROWS_PER_RANGE rows of the input.
    offsets = keys.sparkSession.createDataFrame(
        [(b["range"], b["bytes"], b["n"]) for b in before], "range int, bytes_before long, rows_before long"
    )
    inside = Window.partitionBy("range").orderBy("h", "doc_id", "row")
    placed = landed(
        keys.withColumn("range", _range_of(splitters).cast("int"))
        .withColumn("bytes_inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("rows_inside", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "range")
        .select(
            "doc_id", "size", "text_crc32",
            F.least(F.lit(shards - 1), F.expr(f"(bytes_before + bytes_inside) * {shards} div {max(total, 1)}")).cast("int").alias("shard"),
            (F.col("rows_before") + F.col("rows_inside")).alias("place"),
        )
    )
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_sharding(spark, sf_dir):
    return sharded(documents(spark, sf_dir))


ORACLE: dict[str, str] = {}
