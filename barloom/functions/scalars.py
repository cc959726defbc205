"""Column expressions shared by the operators. All of them stay inside JVM code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient that is null, not an error, for a zero denominator."""
    return col(numerator) / F.nullif(col(denominator), F.lit(0.0))


def finite(x: Column | str) -> Column:
    """NaN and infinities become null, the only missing value the operators know."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def clamp(x: Column | str, low: Column, high: Column) -> Column:
    """Limit to [low, high]; null stays null, unlike plain least/greatest."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def cents(x: Column) -> Column:
    """Round half to even at two decimals."""
    return F.rint(x * 100.0) / 100.0


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def normalize_symbol(x: Column | str) -> Column:
    """Canonical six-digit code from text with exchange affixes, a float tail or lost zeros."""
    text = F.upper(F.trim(col(x).cast("string")))
    text = F.regexp_replace(text, r"\.0$", "")
    text = F.regexp_replace(text, r"^(SH|SZ|BJ)\.", "")
    text = F.regexp_replace(text, r"\.(SH|SZ|BJ)$", "")
    # lpad would cut longer text, so only short digit strings are padded.
    return F.when(text.rlike(r"^\d{1,6}$"), F.lpad(text, 6, "0")).otherwise(text)


def pad_code(x: Column | str) -> Column:
    """Left-fill to six characters without ever cutting a longer code."""
    text = col(x).cast("string")
    return F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)


# Code prefixes of exchanges and boards; the first matching line decides.
EXCHANGE_PREFIXES = [("BSE", ["4", "8", "92"]), ("SZSE", ["0", "3"]), ("SSE", ["6"])]
BOARD_PREFIXES = [("CHINEXT", ["300", "301"]), ("STAR", ["688", "689"])]


def _by_prefix(code: Column, table: list[tuple[str, list[str]]], default: Column) -> Column:
    for label, prefixes in reversed(table):
        hit = any_of([code.startswith(p) for p in prefixes])
        default = F.when(hit, F.lit(label)).otherwise(default)
    return default


def exchange_of(code: str) -> Column:
    """Exchange of a canonical code column."""
    return _by_prefix(F.col(code), EXCHANGE_PREFIXES, F.lit("UNKNOWN"))


def board_of(code: str, exchange: str) -> Column:
    """Board of a canonical code column, given its exchange column."""
    main = (
        F.when(F.col(exchange) == "BSE", F.lit("BSE"))
        .when(F.col(exchange).isin("SSE", "SZSE"), F.lit("MAIN"))
        .otherwise(F.lit("UNKNOWN"))
    )
    return _by_prefix(F.col(code), BOARD_PREFIXES, main)


def with_venue(df: DataFrame) -> DataFrame:
    """Add exchange and board to a table with canonical codes."""
    return df.withColumn("exchange", exchange_of("code")).withColumn(
        "board", board_of("code", "exchange")
    )


def st_name(name: Column | str) -> Column:
    """Special-treatment mark at the head of a security name."""
    return col(name).rlike(r"(?i)^(\*?ST|S\*?ST)")


def word_to_bool(x: Column | str) -> Column:
    """Boolean from the words true/1/yes and false/0/no; anything else is false."""
    return F.lower(F.trim(col(x).cast("string"))).isin("true", "1", "yes")


def slug(x: Column | str) -> Column:
    """Column-safe lower-case key."""
    text = F.regexp_replace(F.lower(col(x)), "[^a-z0-9_]+", "_")
    return F.regexp_replace(text, "^_+|_+$", "")


def bucket_order(bucket: Column | str) -> Column:
    """LARGE before MID before SMALL before UNKNOWN before anything else."""
    b = col(bucket)
    return (
        F.when(b == "LARGE", 0).when(b == "MID", 1).when(b == "SMALL", 2)
        .when(b == "UNKNOWN", 3).otherwise(4)
    )
