"""Purged train/validation/test splits and walk-forward folds.

Boundaries are dates picked from the table of distinct rebalance dates, which holds one row per
month whatever the size of the dataset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.schemas import require_columns


def numbered_dates(dataset: DataFrame) -> DataFrame:
    """Distinct rebalance dates with position `i` from 0 and their count `c`."""
    # One row per rebalance date, so a single partition is the right size.
    one = Window.partitionBy(F.lit(0))
    return dataset.select("date").distinct().select(
        "date",
        (F.row_number().over(one.orderBy("date")) - 1).alias("i"),
        F.count(F.lit(1)).over(one).alias("c"),
    )


def split_bounds(
    dataset: DataFrame, *, train_fraction: float = 0.60, validation_fraction: float = 0.20
) -> DataFrame:
    """One row: first validation date and first test date."""
    dates = numbered_dates(dataset)
    first = F.greatest(F.lit(1), F.floor(F.col("c") * train_fraction))
    second = F.greatest(first + 1, F.floor(F.col("c") * (train_fraction + validation_fraction)))
    second = F.least(second, F.col("c") - 1)
    enough = F.max("c") >= 12
    short = F.raise_error(F.lit("At least 12 rebalance dates are required for splitting"))
    return dates.agg(
        F.max(F.when(F.col("i") == first, F.col("date"))).alias("validation_start"),
        F.max(F.when(F.col("i") == second, F.col("date"))).alias("test_start"),
        enough.alias("enough"),
    ).select(
        F.when(F.col("enough"), F.col("validation_start"))
        .otherwise(short.cast("date")).alias("validation_start"),
        "test_start",
    )


def purged_split(
    dataset: DataFrame,
    *,
    train_fraction: float = 0.60,
    validation_fraction: float = 0.20,
    keep_purged: bool = False,
) -> DataFrame:
    """Add `split`. Rows whose label reaches into the next part are dropped, or marked `purged`."""
    require_columns(dataset, ["date", "label_end_date"], "Dataset")
    bounds = split_bounds(
        dataset, train_fraction=train_fraction, validation_fraction=validation_fraction
    )
    both = bounds.select(F.struct("validation_start", "test_start").alias("s")).scalar()
    date, end = F.col("date"), F.col("label_end_date")
    v, t = F.col("_b.validation_start"), F.col("_b.test_start")
    out = dataset.withColumn("_b", both).withColumn(
        "split",
        F.when((date < v) & (end < v), "train")
        .when((date >= v) & (date < t) & (end < t), "validation")
        .when(date >= t, "test").otherwise("purged"),
    ).drop("_b")
    return out if keep_purged else out.where(F.col("split") != "purged")


def fold_dates(
    dataset: DataFrame,
    *,
    train_months: int = 36,
    validation_months: int = 12,
    test_months: int = 12,
    step_months: int | None = None,
    window: str = "expanding",
) -> DataFrame:
    """One row per fold and date it uses, with the date's part; the last fold may be short.

    `limit` is the first date of the fold's next part, which a row's label must not reach.
    """
    if window not in {"expanding", "rolling"}:
        raise ValueError("window must be expanding or rolling")
    step = test_months if step_months is None else step_months
    if min(train_months, validation_months, test_months, step) < 1:
        raise ValueError("train, validation, test and step months must be at least 1")
    if step != test_months:
        raise ValueError("step must equal test so test windows are contiguous and non-overlapping")
    lead_in = train_months + validation_months
    minimum = lead_in + test_months
    i, c, k = F.col("i"), F.col("c"), F.col("k")
    # A date of position i is a test date of fold (i - lead_in) div test, and serves every later
    # fold as history, so it is repeated once per fold it belongs to.
    last_fold = F.floor((c - 1 - lead_in) / F.lit(test_months))
    first_fold = F.greatest(F.lit(0), F.floor((i - lead_in) / F.lit(test_months)))
    dates = numbered_dates(dataset).withColumn(
        "k",
        F.when(c >= minimum, F.sequence(first_fold.cast("int"), last_fold.cast("int"))).otherwise(
            F.raise_error(
                F.concat(
                    F.lit(f"Walk-forward requires at least {minimum} rebalance dates, got "),
                    c.cast("string"),
                )
            ).cast("array<int>")
        ),
    )
    placed = dates.withColumn("k", F.explode("k")).withColumns(
        {"t0": lead_in + k * test_months, "v0": train_months + k * test_months}
    )
    begin = F.lit(0) if window == "expanding" else F.col("v0") - train_months
    used = placed.where((i >= begin) & (i < F.col("t0") + test_months))
    part = (
        F.when(i < F.col("v0"), F.lit("train")).when(i < F.col("t0"), F.lit("validation"))
        .otherwise(F.lit("test"))
    )
    # One row per fold and rebalance date.
    fold = Window.partitionBy("fold_id")
    first = {p: F.min(F.when(F.col("split") == p, F.col("date"))).over(fold)
             for p in ("validation", "test")}
    return used.select((k + 1).alias("fold_id"), "date", part.alias("split")).withColumn(
        "limit",
        F.when(F.col("split") == "train", first["validation"])
        .when(F.col("split") == "validation", first["test"]),
    )


def fold_bounds(dataset: DataFrame, **months) -> DataFrame:
    """One row per fold with the first and last date of each part."""
    ends = {
        f"{p}_{end}": agg(F.when(F.col("split") == p, F.col("date")))
        for p in ("train", "validation", "test") for end, agg in (("start", F.min), ("end", F.max))
    }
    return fold_dates(dataset, **months).groupBy("fold_id").agg(
        *[value.alias(name) for name, value in ends.items()]
    )


def walk_forward_folds(dataset: DataFrame, **months) -> DataFrame:
    """Rows of every fold as (fold_id, split, ...), purged; a row appears once per fold it serves."""
    require_columns(dataset, ["date", "label_end_date"], "Walk-forward dataset")
    # Bounded by the number of months, squared at most.
    placed = fold_dates(dataset, **months)
    joined = dataset.join(F.broadcast(placed), "date")
    inside = (F.col("split") == "test") | (F.col("label_end_date") < F.col("limit"))
    return joined.where(inside).select("fold_id", "split", *dataset.columns)


def fold_summary(dataset: DataFrame, **months) -> DataFrame:
    """Boundaries, effective ends after purging and row counts per fold."""
    bounds = fold_bounds(dataset, **months)
    rows = walk_forward_folds(dataset, **months)

    def part(name: str, agg, value):
        return agg(F.when(F.col("split") == name, value))

    counts = rows.groupBy("fold_id").agg(
        part("train", F.max, F.col("date")).alias("effective_train_end_after_purge"),
        part("validation", F.max, F.col("date")).alias("effective_validation_end_after_purge"),
        *[part(p, F.count, F.lit(1)).alias(f"{p}_rows") for p in ("train", "validation", "test")],
    )
    return bounds.join(counts, "fold_id", "left")


def empty_folds(summary: DataFrame) -> DataFrame:
    """Folds that purging left without train, validation or test rows; must be empty."""
    return summary.where(
        F.least(*[F.coalesce(f"{p}_rows", F.lit(0)) for p in ("train", "validation", "test")]) == 0
    )


def fold_overlap(test_rows: DataFrame) -> DataFrame:
    """Predictions, distinct (date, code) and the surplus, which must be 0."""
    keys = test_rows.groupBy("date", "code").agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(
        F.sum("n").alias("predictions"), F.count(F.lit(1)).alias("keys"),
        (F.sum("n") - F.count(F.lit(1))).alias("overlapping"),
    )
