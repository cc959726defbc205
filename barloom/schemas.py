"""Typed table contracts and the column check used at the entry of each operator."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _B, _L, _I, _DT = (
    T.StringType(), T.DoubleType(), T.BooleanType(), T.LongType(), T.IntegerType(), T.DateType(),
)


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.items()])


BAR_REQUIRED = ["date", "code", "open", "high", "low", "close", "volume", "amount"]

BAR = _struct(
    date=_DT, code=_S, open=_D, high=_D, low=_D, close=_D, volume=_D, amount=_D,
    turnover=_D, market_cap=_D, raw_open=_D, raw_high=_D, raw_low=_D, raw_close=_D,
    limit_up=_D, limit_down=_D, security_name=_S, exchange=_S, board=_S, instrument_type=_S,
    industry=_S, size_bucket=_S, is_trading=_B, is_st=_B, lot_size=_I,
)
MEMBERSHIP = _struct(
    code=_S, effective_from=_DT, effective_to=_DT, size_bucket=_S, membership_mode=_S,
)
INDUSTRY_HISTORY = _struct(
    code=_S, effective_from=_DT, effective_to=_DT, industry_code=_S, industry_name=_S,
    industry_standard=_S, is_point_in_time=_B,
)
ACTION = _struct(
    code=_S, ex_date=_DT, cash_dividend_per_share=_D, bonus_share_ratio=_D,
    rights_share_ratio=_D, rights_price=_D, source=_S,
)
BENCHMARK = _struct(date=_DT, benchmark_key=_S, close=_D)
POSITION = _struct(code=_S, quantity=_L)
SIGNAL = _struct(
    date=_DT, code=_S, score=_D, industry=_S, size_bucket=_S, tradable=_B, idio_vol_60=_D,
)


def require_columns(df: DataFrame, needed: Iterable[str], what: str) -> None:
    """Raise when a table lacks columns its operator needs; decided from the plan, runs no job."""
    missing = sorted(set(needed).difference(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")


def signals(df: DataFrame, score: str) -> DataFrame:
    """The columns of SIGNAL, typed, with the named score as `score`.

    A score that is no number, or a date or code that is missing, fails the job: cast is strict.
    Optional columns that are absent are null.
    """
    require_columns(df, ["date", "code", score], "Predictions")
    columns = []
    for field in SIGNAL.fields:
        source = score if field.name == "score" else field.name
        value = F.col(source).cast(field.dataType) if source in df.columns else F.lit(None).cast(field.dataType)
        if field.name in ("date", "code"):
            lacking = F.raise_error(F.lit(f"Predictions without a {field.name}")).cast(field.dataType)
            value = F.coalesce(value, lacking)
        columns.append(value.alias(field.name))
    return df.select(*columns)
