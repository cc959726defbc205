"""As-of, interval and span joins on (key, date)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    values: list[str],
    *,
    date: str = "date",
) -> DataFrame:
    """Attach to each left row the right values of the latest right date not after it.

    Two levels: the last value of each key and month is carried over the months, at most the calendar;
    inside its month a left row looks at the month's values, 31 at most. Left rows are only joined,
    on key and month, so one key may hold them all. `right` must be unique on (keys, date). Rows of `right`
    that lie by the keys already are not moved, and only months that are asked for meet the left rows.
    """
    packed = F.struct(*[F.col(v) for v in values])
    month = F.trunc(F.col(date), "month").alias("_month")
    marks = right.groupBy(*keys, month).agg(
        F.array_sort(F.collect_list(F.struct(F.col(date).alias("d"), packed.alias("v")))).alias("_marks")
    )
    over_months = Window.partitionBy(*keys).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    tasks = int(right.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = left.select(*keys, month).distinct().withColumn("_asked", F.lit(True)).repartition(tasks, *keys)
    line = marks.repartition(tasks, *keys).unionByName(asked, allowMissingColumns=True)
    months = line.groupBy(*keys, "_month").agg(
        F.first("_marks", ignorenulls=True).alias("_marks"), F.bool_or("_asked").alias("_asked")
    ).withColumn(
        "_before", F.last(F.get("_marks", F.size("_marks") - 1)["v"], ignorenulls=True).over(over_months)
    ).where("_asked").drop("_asked")
    seen = F.filter("_marks", lambda m: m["d"] <= F.col(date))
    inside = F.when(F.size(seen) > 0, F.get(seen, F.size(seen) - 1)["v"]).otherwise(F.col("_before"))
    placed = left.withColumn("_month", month).join(months, [*keys, "_month"], "left").withColumn("_val", inside)
    return placed.select(*left.columns, *[F.col("_val")[v].alias(v) for v in values])


def feeds_by_day(feeds: dict[str, DataFrame]) -> DataFrame:
    """(code, date) of any feed and, named after each feed, the list of its rows there.

    The full join of several feeds in one shuffle, by code alone, so windows by code that follow need
    none. For feeds of which a code has no more rows than a few times the calendar; rows without a code
    meet nothing and are left out.
    """
    keys = ["code", "date"]
    packed = {n: F.struct(*[c for c in f.columns if c not in keys]) for n, f in feeds.items()}
    kinds = {n: f.select(packed[n].alias(n)).schema[n].dataType for n, f in feeds.items()}
    rows = [
        f.where(F.col("code").isNotNull()).select(
            *keys, *[(packed[n] if n == own else F.lit(None).cast(kinds[n])).alias(n) for n in feeds]
        ) for own, f in feeds.items()
    ]
    return reduce(DataFrame.unionByName, rows).repartition("code").groupBy(*keys).agg(
        *[F.collect_list(n).alias(n) for n in feeds]
    )


def lists_beside(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Left rows with the list `name` of what `right` has at their keys, of which the first deals out the rows.

    Sides that lie by that key already are not moved, where a join on all keys would move both. Lists are
    for a right side with a row or a few for the same keys; null keys are equal here.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = F.struct(*[c for c in right.columns if c not in keys]).alias(name)
    both = left.withColumn("_left", F.lit(True)).unionByName(
        right.select(*keys, values).repartition(tasks, keys[0]), allowMissingColumns=True
    )
    listed = F.collect_list(name).over(Window.partitionBy(*keys))
    return both.withColumn(name, listed).where("_left").drop("_left")


def span_join(
    spans: DataFrame, points: DataFrame, keys: list[str], *, start: str, stop: str, date: str,
    unit: str = "month", last: Column | None = None,
) -> DataFrame:
    """Pairs of a span and a point of its keys with start <= date < stop; a null stop is open.

    Spans are cut at the borders of months (or years) and met by the points of each, an equality join:
    a span gives a row a unit, none carries a list. `last` ends open spans; by default the last point.
    """
    last = points.agg(F.max(date)).scalar() if last is None else last
    ends = F.least(F.date_sub(F.coalesce(F.col(stop), F.date_add(last, 1)), 1), last)
    cut = spans.where(F.col(start) <= ends).withColumn(
        "_unit",
        F.explode(F.sequence(F.trunc(F.col(start), unit), F.trunc(ends, unit), F.expr(f"INTERVAL 1 {unit}"))),
    )
    met = cut.join(points.withColumn("_unit", F.trunc(F.col(date), unit)), [*keys, "_unit"])
    inside = (F.col(start) <= F.col(date)) & (F.col(stop).isNull() | (F.col(date) < F.col(stop)))
    return met.where(inside).drop("_unit")


def active_on(date: Column, start: Column, end: Column) -> Column:
    """Inclusive interval test; a null end is open."""
    return (date >= start) & (end.isNull() | (date <= end))


def _swept(fields: list[str]):
    """Turns of sorted intervals: a stack holds the active ones, later starts above earlier ends.

    An interval that starts pushes out those that end no later: they can never be in force again. So
    each interval enters and leaves the stack once.
    """
    from datetime import date, timedelta

    day, never = timedelta(days=1), date.max

    def run(batches):
        import pyarrow as pa

        code, stack, out = None, [], []

        def ended(until):
            """Give the turns of intervals that end before `until`; one at `until` itself is left out."""
            while stack and stack[-1][0] < until:
                end = stack.pop()[0]
                if end < never and end + day < until:
                    out.append((code, end + day, stack[-1][1] if stack else None))

        def given():
            codes, days, picked = zip(*out)
            kinds = [(f, batch.schema.field(f).type) for f in fields]
            values = [
                {"on": p is not None, **dict(zip(fields, p or [None] * len(fields)))} for p in picked
            ]
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(codes, batch.schema.field("code").type), pa.array(days, pa.date32()),
                 pa.array(values, pa.struct([("on", pa.bool_()), *kinds]))],
                ["code", "date", "_in"],
            )

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("code", "effective_from", "effective_to")),
                       zip(*(batch.column(f).to_pylist() for f in fields)) if fields else [()] * batch.num_rows)
            for own, start, end, values in rows:
                if own != code:
                    ended(never)
                    code = own
                    stack.clear()
                ended(start)
                end = never if end is None else end
                while stack and stack[-1][0] <= end:
                    stack.pop()
                stack.append((end, values))
                out.append((code, start, values))
            if len(out) > 10_000:
                yield given()
        ended(never)
        if out:
            yield given()

    return run


def step_function(intervals: DataFrame, values: list[str]) -> DataFrame:
    """(code, date, _in): the interval in force from each date on which that can change.

    `_in.on` is false where none is active; of several active intervals the latest start wins, of
    several with that start the one that ends last. Intervals are first combined by start, so a code
    has no more of them than the calendar has days; then one ordered pass, linear in intervals, sweeps
    over their starts and ends.
    """
    # Stored intervals may have their dates as text.
    dated = intervals.withColumns({c: F.col(c).cast("date") for c in ("effective_from", "effective_to")})
    far = F.coalesce(F.col("effective_to"), F.lit("9999-12-31").cast("date"))
    row = F.struct("effective_to", *values)
    spans = (
        dated.where(F.col("effective_from").isNotNull() & (far >= F.col("effective_from")))
        .groupBy("code", "effective_from").agg(F.max_by(row, F.struct(far, row)).alias("_row"))
        .select("code", "effective_from", "_row.*")
        .repartition("code").sortWithinPartitions("code", "effective_from")
    )
    inside = T.StructType([T.StructField("on", T.BooleanType()), *[intervals.schema[v] for v in values]])
    inside = T.StructType([T.StructField(f.name, f.dataType) for f in inside.fields])
    schema = T.StructType([
        T.StructField("code", intervals.schema["code"].dataType), T.StructField("date", T.DateType()),
        T.StructField("_in", inside),
    ])
    return spans.mapInArrow(_swept(list(values)), schema)


def interval_join(left: DataFrame, intervals: DataFrame, values: list[str]) -> DataFrame:
    """Left join on code and date-in-interval, with `_matched`.

    The intervals become a step function, which is then carried forward over the dates of each
    code: one pass, without comparing every bar to every interval.
    """
    steps = step_function(intervals, values)
    return _in_force(asof_backward(left, steps, ["code"], ["_in"]), left.columns, values)


def interval_join_bars(bars: DataFrame, intervals: DataFrame, values: list[str]) -> DataFrame:
    """`interval_join` of a bar table: steps and bars lie by code and date, so rows move once.

    Bars that lie by code already, as `durable_by` leaves them, do not move at all: steps are dealt like
    them. A code has no more bars than the calendar has days. The result lies by code.
    """
    tasks = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = step_function(intervals, values).repartition(tasks, "code")
    order = Window.partitionBy("code").orderBy("date", "_bar").rowsBetween(Window.unboundedPreceding, 0)
    both = bars.withColumn("_bar", F.lit(True)).unionByName(
        steps.withColumn("_bar", F.lit(False)), allowMissingColumns=True
    )
    carried = both.withColumn("_in", F.last("_in", ignorenulls=True).over(order)).where("_bar")
    return _in_force(carried, bars.columns, values)


def _in_force(df: DataFrame, columns: list[str], values: list[str]) -> DataFrame:
    return df.select(
        *columns,
        F.coalesce(F.col("_in.on"), F.lit(False)).alias("_matched"),
        *[F.col("_in")[v].alias(v) for v in values],
    )
