"""Small tables with the awkward cases that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def clashing(df):
    """The table with extra columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = "digest row_key key kept keep_id row h text_sha256 near_id rid sig pii_text pii_finds media page lang_pred score `a.b`"
    for name in names.split():
        df = df.withColumn(name.strip("`"), F.lit("x"))
    return df


AWKWARD = [
    (1, None), (2, ""), (3, "  \t\n"), (4, "same text here for all of us"), (4, "same text here for all of us"),
    (None, "same text here for all of us"), (None, None), (5, "x" * 5000), (6, "word " * 2000), (7, "!!! 123"),
]
