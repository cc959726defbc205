"""Exact order statistics inside groups such as dates: quantiles, ranks and top-k.

A date may hold more rows than a task can sort. So all rows of a step, of every group and column, go
through one range shuffle on (column, group, value): Spark samples the splitters, a long group is cut
wherever its rows need it, and equal values are cut too, by a hash of the row. Each task sorts its range
and rows are numbered in that order; the table is written, since numbers must not change between uses.
What is left is a count per group and range, no more rows than groups plus ranges, whose running sums turn
local places into places in the group. There is one plan, whatever the size of a group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import durable

# Equal rows are cut into as many parts at most; a short salt adds little to a shuffle.
_SALT_BITS = 12
# `monotonically_increasing_id` has the partition above these bits and the row below.
_ROW_BITS = 33


def _in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows dealt and sorted by `order`; equal ones may lie in several tasks.

    Sampling the splitters reads `df` once more than the shuffle, so callers write it first.
    """
    plain = [c for c, kind in df.dtypes if "map<" not in kind]
    salt = F.shiftright(F.xxhash64(*plain), 64 - _SALT_BITS).cast("short")
    spread = df.withColumn("_salt", salt).repartitionByRange(*order, "_salt")
    return spread.sortWithinPartitions(*order).drop("_salt")


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """The written table with `_id`, which grows with `order`, and `_part`, the range."""
    return durable(
        _in_ranges(df, order).withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", _ROW_BITS))
    )


def _with_places(segments: DataFrame, groups: list[str]) -> DataFrame:
    """Add rows of the group before the segment, and in the whole group, to `_count` per (group, range)."""
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumns(
        {
            "_before": F.coalesce(F.sum("_count").over(before), F.lit(0)),
            "_total": F.sum("_count").over(Window.partitionBy(*groups)),
        }
    )


def group_quantiles(
    df: DataFrame,
    keys: list[str],
    columns: list[str],
    probs: list[float]
) -> DataFrame:
    """Linearly interpolated quantiles, one row per key; columns `<name>__q<i>` for probs[i]."""

    slim = durable(df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]))
    long = slim.unpivot(keys, columns, "_f", "_v")
    ids = ["_f", *keys]
    rows = _numbered(long.where(F.col("_v").isNotNull()), [*ids, "_v"])
    segments = rows.groupBy(*ids, "_part").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_count")
    )
    last = F.col("_total") - 1
    wanted = []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * last
        share = place - F.floor(place)
        for at, part in ((F.floor(place), 1 - share), (F.ceil(place), share)):
            wanted.append(F.struct(F.lit(i).alias("i"), at.cast("long").alias("at"), part.alias("share")))
    told = _with_places(segments, ids).withColumn("_want", F.explode(F.array(*wanted)))
    offset = F.col("_want.at") - F.col("_before")
    told = told.where((offset >= 0) & (offset < F.col("_count"))).select(
        *ids, (F.col("_first") + offset).alias("_id"), F.col("_want.i").alias("_i"),
        F.col("_want.share").alias("_share"),
    )
    # A few rows per date and column, bounded by sizing.MAX_DATES; other keys get no hint.
    told = F.broadcast(told) if keys == ["date"] else told
    # The two neighbours of a quantile, each with its share.
    part = F.col("_v") * F.col("_share")
    return rows.select("_id", "_v").join(told, "_id").groupBy(*keys).agg(
        *[
            F.sum(F.when((F.col("_f") == c) & (F.col("_i") == i), part)).alias(f"{c}__q{i}")
            for c in columns
            for i in range(len(probs))
        ]
    )


def with_aggregates(
    df: DataFrame, keys: list[str], aggs: dict[str, Column]
) -> DataFrame:
    """Attach aggregates of the row's group.

    Partial aggregation and a join, broadcast when the key is the date alone.
    """
    stats = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggs.items()])
    return _attach(df, stats, keys)


def with_quantiles(
    df: DataFrame,
    keys: list[str],
    columns: list[str],
    probs: list[float]
) -> DataFrame:
    """Attach `<name>__q<i>`, the quantile probs[i] of each column within the row's group."""
    return _attach(df, group_quantiles(df, keys, columns, probs), keys)


def _attach(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    # One row per date is bounded by sizing.MAX_DATES; other keys grow with the data and get no hint.
    side = F.broadcast(stats) if keys == ["date"] else stats
    return df.join(side, keys, "left")


def _tie_runs(group: str, value: str):
    """Adds to sorted rows `_low`, the values of the group below the row's in this task, and `_ties`,
    the rows here that share its value. A run is held until it ends."""

    def run(batches):
        import pyarrow as pa

        held, key, done = [], None, 0  # `done`: values of group `key` given out before

        def give(last: bool):
            nonlocal held, key, done
            table = pa.Table.from_batches(held).combine_chunks()
            g = table[group].to_numpy()
            v = table[value].to_numpy(zero_copy_only=False).astype(float)
            index = np.arange(len(g))
            new_group = np.concatenate([[True], g[1:] != g[:-1]])
            new_run = new_group | np.concatenate([[True], v[1:] != v[:-1]])
            starts = np.flatnonzero(new_run)
            stop = len(g) if last else int(starts[-1])
            # Values, not nulls, before each row; nulls sort first.
            valued = ~np.isnan(v)
            seen = np.cumsum(valued) - valued
            origin = seen[np.maximum.accumulate(np.where(new_group, index, 0))]
            carried = np.where(np.cumsum(new_group) == 1, done if key == g[0] else 0, 0)
            run_of = np.cumsum(new_run) - 1
            low = (seen - origin + carried)[starts][run_of]
            ties = np.diff(np.append(starts, len(g)))[run_of]
            if stop:
                out = table.slice(0, stop)
                out = out.append_column("_low", pa.array(low[:stop])).append_column("_ties", pa.array(ties[:stop]))
                yield from out.combine_chunks().to_batches()
            if stop < len(g):
                key, done = g[stop], int(low[stop])
                held = table.slice(stop).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            g, v = batch.column(group), batch.column(value)
            one = len(held) and g[0] == g[-1] and v[0].is_valid and v[0] == v[-1]
            one = one and held[-1].column(group)[-1] == g[0] and held[-1].column(value)[-1] == v[0]
            held.append(batch)
            if not one:  # else the run goes on through the whole batch
                yield from give(False)
        if held:
            yield from give(True)

    return run


def average_rank(
    df: DataFrame, keys: list[str], value: str, out: str, written: bool = False
) -> DataFrame:
    """Add `<out>_rank` (ties share their mean rank) and `<out>_n` (non-null values in the group).

    `written` rows come from a written table without a shuffle, so reading them twice is cheap.
    """
    rows = df.withColumn(value, F.col(value).cast("double"))
    rows = rows if written else durable(rows)
    ordered = _in_ranges(rows, [*keys, value]).withColumn("_group", F.xxhash64(*keys))
    schema = T.StructType([*ordered.schema.fields, *(T.StructField(c, T.LongType()) for c in ("_low", "_ties"))])
    # The range's number is that of the task that wrote it.
    ran = durable(
        ordered.mapInArrow(_tie_runs("_group", value), schema).withColumn("_part", F.spark_partition_id()).drop("_group")
    )
    v = F.col(value)
    segments = ran.where(v.isNotNull()).groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_count"), F.min(F.struct(v.alias("v"), "_low", "_ties")).alias("_head"),
        F.max(F.struct(v.alias("v"), "_low", "_ties")).alias("_tail"),
    )
    placed = _with_places(segments, keys)
    # Values at the borders of ranges may go on in the next. Two segments of a range at most belong to
    # groups with several, so this is small whatever the rows.
    borders = (
        placed.where(F.col("_count") < F.col("_total"))
        .select(*keys, "_before", F.explode(F.array_distinct(F.array("_head", "_tail"))).alias("_end"))
        .groupBy(*keys, F.col("_end.v").alias(value))
        .agg(F.min(F.col("_before") + F.col("_end._low")).alias("_start"), F.sum("_end._ties").alias("_same"))
    )
    side = placed.select(*keys, "_part", "_before", "_total")
    # A row per date and range; ranges are as many as a shuffle's partitions.
    side = F.broadcast(side) if keys == ["date"] else side
    first = F.coalesce("_start", F.col("_before") + F.col("_low"))
    return (
        ran.join(side, [*keys, "_part"], "left")
        .join(F.broadcast(borders), [*keys, value], "left")
        .withColumns(
            {
                f"{out}_rank": F.when(v.isNotNull(), first + (F.coalesce("_same", "_ties") + 1) / 2.0),
                f"{out}_n": F.when(v.isNotNull(), F.col("_total")),
            }
        )
        .select(*df.columns, f"{out}_rank", f"{out}_n")
    )


def percent_rank_average(
    df: DataFrame, keys: list[str], value: str, out: str, written: bool = False
) -> DataFrame:
    """Add `out`, the average rank divided by the number of non-null values."""
    ranked = average_rank(df, keys, value, "_r", written)
    return ranked.withColumn(
        out, F.col("_r_rank") / F.nullif(F.col("_r_n"), F.lit(0))
    ).drop("_r_rank", "_r_n")


def ordinal_rank(
    df: DataFrame, keys: list[str], score: str, tiebreak: str, out: str
) -> DataFrame:
    """Add `out`: 1 for the highest score of the group, equal scores ordered by `tiebreak`.

    (keys, tiebreak) must identify a row. Rows without a score get no rank.
    """
    s = F.col(score)
    df = durable(df)
    scored = df.where(s.isNotNull()).withColumn("_v", -s.cast("double"))
    rows = _numbered(scored, [*keys, "_v", tiebreak])
    segments = rows.groupBy(*keys, "_part").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_count")
    )
    side = _with_places(segments, keys).select(*keys, "_part", "_first", "_before")
    # A row per date and range; ranges are as many as a shuffle's partitions.
    side = F.broadcast(side) if keys == ["date"] else side
    place = (F.col("_before") + F.col("_id") - F.col("_first") + 1).cast("int").alias(out)
    ranked = rows.join(side, [*keys, "_part"], "left").select(*df.columns, place)
    return ranked.unionByName(df.where(s.isNull()).withColumn(out, F.lit(None).cast("int")))


def top_k(
    df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank"
) -> DataFrame:
    """First `k` rows of each group.

    Spark's group limit keeps at most k rows per group and input partition before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def flag_top_k(
    df: DataFrame, score: str, k: int, out: str = "selected", keys: tuple[str, ...] = ("date",)
) -> DataFrame:
    """Add `out`: whether the row is among the `k` best scores of its group, ties by code.

    The last admitted (score, code) of each group is found by a group-limited window; the flag is
    then a comparison with that one row, so the full cross-section is never sorted. `keys` are the
    date and at most a column with a few values, such as the model.
    """
    slim = df.where(F.col(score).isNotNull()).select(
        *keys, F.col(score).alias("_s"), F.col("code").alias("_c")
    )
    best = top_k(slim, list(keys), [F.col("_s").desc(), F.col("_c")], k, "_k")
    cut = best.groupBy(*keys).agg(F.max_by(F.struct("_s", "_c"), "_k").alias("_cut"))
    s, c = F.col(score), F.col("code")
    inside = (s > F.col("_cut._s")) | ((s == F.col("_cut._s")) & (c <= F.col("_cut._c")))
    # One row per date (and model): bounded by sizing.MAX_DATES.
    return (
        df.join(F.broadcast(cut), list(keys), "left")
        .withColumn(out, F.coalesce(inside, F.lit(False)))
        .drop("_cut")
    )


def rank_correlation(
    df: DataFrame, keys: list[str], x: str, y: str
) -> DataFrame:
    """Spearman correlation per group as `rank_ic`, null when either side is constant.

    Mean ranks sum to n(n+1)/2 whatever the ties, so deviations from (n+1)/2 are exact halves and
    the three sums are exact: a correlation of zero is exactly zero. `n` counts the pairs used.
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(pairs, keys, x, "_x")
    ranked = average_rank(ranked, keys, y, "_y")
    mid = (F.col("_x_n") + 1) / 2.0
    dx, dy = F.col("_x_rank") - mid, F.col("_y_rank") - mid
    sums = ranked.groupBy(*keys).agg(
        F.sum(dx * dy).alias("_xy"),
        F.sum(dx * dx).alias("_xx"),
        F.sum(dy * dy).alias("_yy"),
        F.count(F.lit(1)).alias("n"),
    )
    spread_product = F.sqrt(F.col("_xx") * F.col("_yy"))
    return sums.select(
        *keys, (F.col("_xy") / F.nullif(spread_product, F.lit(0.0))).alias("rank_ic"), "n"
    )
