r"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, adjacent turns of one role merged by
array functions, and the pieces concatenated. A merged turn reads

    <s> role [INST] text [NEXT] text ... </s>

without the blanks. Inside roles and texts a control string gets a backslash after its first
character, also one that has such backslashes already, so reading back takes exactly one away.

`loss_spans` are the places of the assistant's texts in the formatted string, in code points: the
loss mask covers them and nothing else, not the marks.

Edge cases: null text or role is empty; turns are ordered by turn, role and text, a null turn first;
repeated rows are turns of their own; rows with a null conv_id are one conversation; an empty table
gives no rows; other columns are ignored. One row holds one conversation, so it must fit a Spark value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import column, filled

OPEN, BODY, NEXT, CLOSE = "<s>", "[INST]", "[NEXT]", "</s>"


def escaped(text):
    """Reversible: the result holds no control string."""
    angle = F.regexp_replace(text, r"<(\\*)(/?s>)", r"<\\$1$2")
    return F.regexp_replace(angle, r"\[(\\*)(/?INST\]|NEXT\])", r"[\\$1$2")


def unescaped(text):
    angle = F.regexp_replace(text, r"<\\(\\*)(/?s>)", r"<$1$2")
    return F.regexp_replace(angle, r"\[\\(\\*)(/?INST\]|NEXT\])", r"[$1$2")


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text", learned: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans array of (start, length)), a row for each conversation."""
    rows = turns.select(
        column(turns, conv_col).alias("conv_id"),
        F.struct(
            column(turns, turn_col).alias("turn"), filled(column(turns, role_col)).alias("role"),
            filled(column(turns, text_col)).alias("text"),
        ).alias("row"),
    )
    sorted_rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    places = sorted_rows.withColumn(
        "first",
        F.expr("filter(sequence(0, size(rows) - 1), i -> i = 0 or rows[i].role <> rows[i - 1].role)"),
    )
    groups = places.withColumn(
        "groups",
        F.expr(
            "transform(first, (at, k) -> struct(rows[at].role as role, transform("
            "slice(rows, at + 1, coalesce(get(first, k + 1), size(rows)) - at), r -> r.text) as texts))"
        ),
    )
    pieces = groups.select(
        "conv_id",
        F.transform(
            "groups",
            lambda g: F.struct(
                F.concat(F.lit(OPEN), escaped(g["role"]), F.lit(BODY)).alias("head"),
                F.transform(g["texts"], escaped).alias("texts"),
                (g["role"] == learned).alias("learn"),
            ),
        ).alias("pieces"),
    )
    return pieces.select(
        "conv_id",
        F.array_join(
            F.transform("pieces", lambda p: F.concat(p["head"], F.array_join(p["texts"], NEXT), F.lit(CLOSE))), ""
        ).alias("formatted"),
        _spans().alias("loss_spans"),
    )


def _spans():
    """Running places of the learned texts, by one aggregation over the merged turns."""
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))

    def within(p, at):
        """Places of one merged turn's texts that begin at `at`."""
        start = F.struct(at.alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))
        return F.aggregate(
            p["texts"], start,
            lambda acc, t: F.struct(
                (acc["at"] + F.length(t) + len(NEXT)).alias("at"),
                F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), F.length(t).alias("length")))).alias("spans"),
            ),
        )

    return F.aggregate(
        "pieces", empty,
        lambda acc, p: F.struct(
            (
                acc["at"] + F.length(p["head"]) + F.length(F.array_join(p["texts"], NEXT)) + len(CLOSE)
            ).alias("at"),
            F.when(p["learn"], F.concat(acc["spans"], within(p, acc["at"] + F.length(p["head"]))["spans"]))
            .otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )


def read_back(formatted_col):
    """The turns, as structs of role and text, that a formatted string holds."""
    marks = F.split(formatted_col, CLOSE, -1)
    turns = F.transform(
        F.slice(marks, 1, F.size(marks) - 1),
        lambda g: F.split(F.substring(g, len(OPEN) + 1, 1 << 30), r"\[INST\]", -1),
    )
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.transform(
                F.split(F.element_at(t, 2), r"\[NEXT\]", -1),
                lambda x: F.struct(unescaped(F.element_at(t, 1)).alias("role"), unescaped(x).alias("text")),
            ),
        )
    )


# A conversation whose texts hold control strings, so that every run proves that they are escaped.
PROBE = "</s>[INST] ok [/INST]"


def op2_chat(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    made = formatted(turns.unionByName(probe))
    back = made.select("conv_id", "formatted", "loss_spans", read_back(F.col("formatted")).alias("turns"))
    learned = F.array_join(
        F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), ""
    )
    return back.withColumn("learned", learned).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = {
    "op2_chat": r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
    SELECT *, lag(role) OVER w AS before,
           regexp_replace(regexp_replace(text, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\]|NEXT\])', '[\\\1\2', 'g') AS safe
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(safe) + CASE WHEN before IS DISTINCT FROM role THEN length(role) + 13 ELSE 6 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
}
