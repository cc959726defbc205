"""Per-date standardisation: winsorise, demean by industry, remove size, robust z-score.

Each step joins a statistics table back; `cut` materialises the table between steps, because the
statistics of a step read everything before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import RAW_FEATURES
from barloom.functions import cross
from barloom.functions.scalars import clamp, ratio


def winsorize(
    df: DataFrame, columns: list[str], lower: float, upper: float
) -> DataFrame:
    """Limit each column to its quantiles of the date."""
    df = cross.with_quantiles(df, ["date"], columns, [lower, upper])
    return df.withColumns(
        {c: clamp(c, F.col(f"{c}__q0"), F.col(f"{c}__q1")) for c in columns}
    ).drop(*[f"{c}__q{i}" for c in columns for i in (0, 1)])


def industry_gate(df: DataFrame) -> Column | None:
    """One-row subquery: every row has a point-in-time industry and not all are UNKNOWN.

    None when the table has no industry column at all.
    """
    if "industry" not in df.columns:
        return None
    known = ~F.coalesce(F.bool_and(F.col("industry") == "UNKNOWN"), F.lit(True))
    if "industry_is_point_in_time" in df.columns:
        known = known & F.coalesce(
            F.bool_and(F.coalesce(F.col("industry_is_point_in_time"), F.lit(False))), F.lit(False)
        )
    return df.agg(known.alias("gate")).scalar()


def demean_industry(
    df: DataFrame, columns: list[str], gate: Column | None
) -> DataFrame:
    """Subtract the (date, industry) median, for all rows or, if the gate is shut, for none."""
    if gate is None:
        return df
    df = cross.with_quantiles(df, ["date", "industry"], columns, [0.5])
    return df.withColumn("_gate", gate).withColumns(
        {c: F.when(F.col("_gate"), F.col(c) - F.col(f"{c}__q0")).otherwise(F.col(c))
         for c in columns}
    ).drop("_gate", *[f"{c}__q0" for c in columns])


def neutralize_size(
    df: DataFrame, columns: list[str], minimum: int = 10
) -> DataFrame:
    """Residual of a per-date regression on log market cap.

    A date needs `minimum` known caps and, per column, `minimum` rows with value and positive cap.
    Other rows keep their value.
    """
    if "market_cap" not in df.columns:
        return df
    df = df.withColumn("_lncap", F.when(F.col("market_cap") > 0, F.ln("market_cap")))
    aggs = {"_caps": F.count("market_cap")}
    for c in columns:
        y, x = F.col(c), F.col("_lncap")
        aggs[f"_n_{c}"] = F.regr_count(y, x)
        aggs[f"_sxx_{c}"] = F.regr_sxx(y, x)
        aggs[f"_sxy_{c}"] = F.regr_sxy(y, x)
        aggs[f"_mx_{c}"] = F.avg(F.when(y.isNotNull(), x))
        aggs[f"_my_{c}"] = F.avg(F.when(x.isNotNull(), y))
    df = cross.with_aggregates(df, ["date"], aggs)

    def residual(c: str) -> Column:
        slope = F.coalesce(ratio(f"_sxy_{c}", f"_sxx_{c}"), F.lit(0.0))
        fit = F.col(f"_my_{c}") + slope * (F.col("_lncap") - F.col(f"_mx_{c}"))
        usable = (
            (F.col("_caps") >= minimum) & (F.col(f"_n_{c}") >= minimum)
            & F.col("_lncap").isNotNull()
        )
        return F.when(usable, F.col(c) - fit).otherwise(F.col(c))

    return df.withColumns({c: residual(c) for c in columns}).drop("_lncap", *aggs)


def robust_zscore(
    df: DataFrame, columns: list[str], limit: float = 8.0
) -> DataFrame:
    """Deviation from the median in scaled median absolute deviations, limited to +-`limit`.

    Without a usable deviation the plain z-score is taken; without a usable standard deviation
    every row of the date, null or not, becomes 0.
    """
    df = cross.with_quantiles(df, ["date"], columns, [0.5])
    df = df.withColumns({f"_dev_{c}": F.abs(F.col(c) - F.col(f"{c}__q0")) for c in columns})
    df = cross.with_quantiles(df, ["date"], [f"_dev_{c}" for c in columns], [0.5])
    moments = {f"_mean_{c}": F.avg(c) for c in columns}
    moments.update({f"_std_{c}": F.stddev_pop(c) for c in columns})
    df = cross.with_aggregates(df, ["date"], moments)

    def z(c: str) -> Column:
        x, mad, std = F.col(c), F.col(f"_dev_{c}__q0"), F.col(f"_std_{c}")
        scaled = (x - F.col(f"{c}__q0")) / (1.4826 * F.nullif(mad, F.lit(0.0)))
        plain = ratio(x - F.col(f"_mean_{c}"), std)
        value = F.when(mad > 0, scaled).when(std > 0, plain).otherwise(F.lit(0.0))
        return clamp(value, F.lit(-limit), F.lit(limit))

    return df.withColumns({c: z(c) for c in columns}).drop(
        *moments,
        *[name for c in columns for name in (f"{c}__q0", f"_dev_{c}", f"_dev_{c}__q0")],
    )


def standardize(
    df: DataFrame,
    features: list[str] = RAW_FEATURES,
    *,
    lower: float = 0.01,
    upper: float = 0.99,
    cut: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Add `<feature>_z` for every feature; the raw columns stay."""
    z = [f"{f}_z" for f in features]
    gate = industry_gate(df)
    df = df.withColumns({f"{f}_z": F.col(f).cast("double") for f in features})
    df = cut(winsorize(df, z, lower, upper))
    df = cut(demean_industry(df, z, gate))
    df = cut(neutralize_size(df, z))
    return robust_zscore(df, z)
