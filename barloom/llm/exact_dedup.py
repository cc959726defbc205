"""Exact deduplication with a split of the heavy digests.

Texts are equal when identical after every run of ASCII white space is one blank; the SHA-256 of that
form is the digest. A Misra-Gries summary of each partition, summed by digest, names every digest
with more than 2 / (COUNTERS + 1) of all rows. These candidates are fewer than COUNTERS, whatever the
input, so an exact second count of them and their winners is broadcast, and their copies are decided
on the map side. The other digests, none of which is large, are decided by an ordinary shuffle.

Edge cases: null counts as the empty text; a null doc_id sorts after all others; of rows that repeat
both doc_id and text exactly one is kept; an empty table gives no rows; other columns are ignored by
`exact_labels` and kept by `without_copies`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import column, documents, filled, free_name, landed, mapped

COUNTERS = 1024
BLANKS = r"[\x20\x09-\x0D]+"


def digest_of(text):
    return F.sha2(F.regexp_replace(filled(text), BLANKS, " "), 256)


def _summary(counters: int):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        keys, counts = pa.array([], pa.string()), pa.array([], pa.int64())
        for batch in batches:
            got = pc.value_counts(batch.column(0).cast(pa.string()))
            table = pa.table({
                "digest": pa.concat_arrays([keys, got.field("values")]),
                "n": pa.concat_arrays([counts, got.field("counts").cast(pa.int64())]),
            }).group_by("digest").aggregate([("n", "sum")])
            keys, counts = table["digest"].combine_chunks(), table["n_sum"].combine_chunks()
            if len(keys) > counters:
                # Take the (counters + 1)-th largest count from all: at most `counters` stay above 0.
                ranked = pc.array_sort_indices(counts, order="descending")
                counts = pc.subtract(counts, counts[ranked[counters].as_py()])
                stay = pc.greater(counts, 0)
                keys, counts = keys.filter(stay), counts.filter(stay)
        if len(keys):
            yield pa.RecordBatch.from_arrays([keys, counts], ["digest", "low"])

    return run


def heavy_digests(tagged: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, winner, group_size) of every digest above 2 / (counters + 1) of all rows, and of at
    most `counters` digests: a count is never too high, and too low by at most rows / (counters + 1)."""
    rows = tagged.count()
    summed = (
        mapped(tagged.select("digest"), _summary(counters), "digest string, low long")
        .groupBy("digest").agg(F.sum("low").alias("low"))
        .where(F.col("low") > rows // (counters + 1))
        .select("digest")
    )
    return (
        tagged.join(F.broadcast(summed), "digest")
        .groupBy("digest")
        .agg(F.min("place").alias("winner"), F.count(F.lit(1)).alias("group_size"))
    )


def exact_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of `docs`."""
    doc = column(docs, id_col)
    tagged = landed(
        docs.select(doc.alias("doc_id"), digest_of(column(docs, text_col)).alias("digest")).withColumn(
            "place", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.monotonically_increasing_id().alias("row"))
        ).drop("doc_id")
    )
    heavy = landed(heavy_digests(tagged, counters))
    # `heavy` has at most `counters` rows: fit for a broadcast at every input size.
    marked = tagged.join(F.broadcast(heavy), "digest", "left")
    same = Window.partitionBy("digest")
    rest = (
        marked.where(F.col("group_size").isNull()).select("digest", "place")
        .withColumn("winner", F.min("place").over(same))
        .withColumn("group_size", F.count(F.lit(1)).over(same))
    )
    return (
        marked.where(F.col("group_size").isNotNull())
        .unionByName(rest)
        .select(
            F.col("place.doc_id").alias("doc_id"), F.col("winner.doc_id").alias("keep_id"), "group_size",
            (F.col("place.row") == F.col("winner.row")).alias("kept"), F.col("digest").alias("text_sha256"),
        )
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with their columns: one for each distinct text."""
    key, again = free_name(docs, "row_key"), free_name(docs, "row_again")

    def row_key(doc, digest):
        return F.concat_ws(":", digest, doc.cast("string"))

    dropped = exact_labels(docs, id_col, text_col).where(~F.col("kept"))
    # A row that repeats doc_id and text of the winner shares its key, so the key alone cannot drop it.
    lost = dropped.select(
        row_key(F.col("doc_id"), F.col("text_sha256")).alias(key),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias(again),
    ).groupBy(key).agg(F.max(again).alias(again))
    held = docs.withColumn(key, row_key(column(docs, id_col), digest_of(column(docs, text_col))))
    # The dropped rows grow with the input, so they are never broadcast, however few they are here.
    joined = held.join(landed(lost).hint("merge"), key, "left")
    once = joined.where(F.col(again).isNull()).select([column(joined, c) for c in docs.columns])
    first = (
        joined.where(F.col(again))
        .groupBy(key).agg(F.first(F.struct(*[column(joined, c) for c in docs.columns])).alias(again))
        .select(f"{again}.*")
    )
    return once.unionByName(first)


def op1_exact_dedup(spark, sf_dir):
    return exact_labels(documents(spark, sf_dir))


ORACLE = {
    "op1_exact_dedup": r"""
WITH d AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
}
