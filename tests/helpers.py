"""Small tables for the tests."""

from datetime import date, timedelta

import numpy as np
import pandas as pd


def day(text):
    return date.fromisoformat(text)


def rows(df, *columns, order=None):
    out = df.select(*columns) if columns else df
    return [tuple(r) for r in out.orderBy(*(order or out.columns)).collect()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def random_bars(symbols=20, days=280, seed=7):
    """Plausible daily bars: a random walk per code, some days missing."""
    rng = np.random.default_rng(seed)
    start = date(2020, 1, 1)
    out = []
    for s in range(symbols):
        price = 10.0 * np.exp(np.cumsum(rng.normal(0, 0.02, days)))
        for i in range(days):
            if rng.random() < 0.03:
                continue
            c = float(price[i])
            high, low = c * (1 + rng.random() * 0.02), c * (1 - rng.random() * 0.02)
            volume = float(rng.integers(1000, 90000))
            out.append(
                (start + timedelta(days=i), f"{s + 1:06d}", (high + low) / 2, high, low, c,
                 volume, volume * c * (s + 1), ["BANK", "TECH", "FOOD"][s % 3],
                 ["LARGE", "MID"][s % 2], 1e6 * (s + 1) * c)
            )
    columns = ["date", "code", "open", "high", "low", "close", "volume", "amount", "industry",
               "size_bucket", "market_cap"]
    return pd.DataFrame(out, columns=columns)


def bars_frame(spark, pdf):
    from pyspark.sql import functions as F

    return spark.createDataFrame(pdf).withColumns(
        {"is_trading": F.lit(True), "is_st": F.lit(False), "lot_size": F.lit(100)}
    )
