"""Row-based trailing windows that need a minimum number of non-null values."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


def by_code() -> WindowSpec:
    """Bars of one security in date order.

    (date, code) is unique after cleaning, so a group never exceeds the number of trading dates,
    however much of the raw feed belongs to one security.
    """
    return Window.partitionBy("code").orderBy("date")


def trailing(rows: int) -> WindowSpec:
    return by_code().rowsBetween(-(rows - 1), 0)


class Frame(NamedTuple):
    """Aggregate of the last `rows` rows, null while fewer than `minimum` of them have a value."""

    agg: Callable[..., Column]
    columns: tuple[str, ...]
    rows: int
    minimum: int = 0

    def over(self) -> Column:
        """On every row, by a window."""
        if self.agg is last_values:
            return last_values(*self.columns, self.rows)
        frame = trailing(self.rows)
        value = self.agg(*[F.col(c) for c in self.columns]).over(frame)
        if not self.minimum:
            return value
        return F.when(F.count(self.columns[0]).over(frame) >= self.minimum, value)

    @property
    def kind(self) -> T.DataType:
        if self.agg is last_values:
            return T.ArrayType(T.DoubleType())
        return T.LongType() if self.agg is F.count else T.DoubleType()


def gated(agg: Callable[[Column], Column], x: str, rows: int, minimum: int) -> Frame:
    return Frame(agg, (x,), rows, minimum)


def last_values(x: str, rows: int) -> Column:
    """The values of the last `rows` rows, the current one first."""
    return F.array(F.col(x), *[F.lag(x, i).over(by_code()) for i in range(1, rows)])


def median_of(values: str, minimum: int) -> Column:
    """Median of a short list, null while fewer than `minimum` of its values are known."""
    known = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    n = F.size(known)
    low, high = F.floor((n - 1) / 2), F.ceil((n - 1) / 2)
    return F.when(n >= minimum, 0.5 * F.get(known, low.cast("int")) + 0.5 * F.get(known, high.cast("int")))


def _asked_frames(frames: list[tuple[str, tuple[str, ...], int, int]], names: list[str], wanted: str):
    """The rows of sorted batches that ask, with their frames; what frames reach back to is held.

    A frame comes as the name of its aggregate and its other fields, so workers need no module of ours.
    """
    used = list(dict.fromkeys(c for _, columns, _, _ in frames for c in columns))
    longest = max(rows for _, _, rows, _ in frames)

    def centred(x, ok, n):
        # Off a value of the frame first, so equal values have no spread at all.
        first = np.take_along_axis(x, ok.argmax(axis=1)[:, None], axis=1)
        off = np.where(ok, x - first, 0.0)
        return np.where(ok, off - (off.sum(axis=1) / n)[:, None], 0.0)

    def aggregated(agg, rows, minimum, values, known):
        """A line of the matrices is the frame of a row; `known` tells which values are not null."""
        import pyarrow as pa

        x, ok = values[0], np.logical_and.reduce(known)
        n = ok.sum(axis=1)
        least = {"count": 0, "stddev_samp": 2}.get(agg, 1)
        if agg == "last_values":
            items = pa.array(x.ravel(), mask=~ok.ravel())
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * rows, pa.int32()), items)
        with np.errstate(all="ignore"):
            if agg == "count":
                out = n
            elif agg == "max":
                out = np.where(ok, x, -np.inf).max(axis=1)
            elif agg in ("sum", "avg"):
                out = np.where(ok, x, 0.0).sum(axis=1) / (n if agg == "avg" else 1)
            else:
                parts = [centred(v, ok, n) for v in values]
                out = (parts[0] * parts[-1]).sum(axis=1)
                out = {
                    "stddev_samp": lambda: np.sqrt(out / (n - 1)), "var_pop": lambda: out / n,
                    "covar_pop": lambda: out / n,
                }[agg]()
        return pa.array(out, mask=(n < least) | (known[0].sum(axis=1) < minimum))

    def run(batches):
        import pyarrow as pa

        held = {c: (np.empty(0), np.empty(0, bool)) for c in used}
        for batch in batches:
            before = len(held[used[0]][0])
            for c in used:
                own = batch.column(c).cast("float64")
                known = own.is_valid().to_numpy(zero_copy_only=False)
                value = own.fill_null(0.0).to_numpy(zero_copy_only=False)
                held[c] = np.append(held[c][0], value), np.append(held[c][1], known)
            asks = np.flatnonzero(batch.column(wanted).to_numpy(zero_copy_only=False))
            if len(asks):
                number = batch.column("_n").to_numpy()[asks, None]
                out = []
                for agg, columns, rows, minimum in frames:
                    back = np.arange(rows)
                    # A code's rows are numbered from 1, so a frame ends where they begin.
                    inside = back < number
                    at = np.maximum(asks[:, None] + before - back, 0)
                    values = [held[c][0][at] for c in columns]
                    out.append(aggregated(agg, rows, minimum, values, [held[c][1][at] & inside for c in columns]))
                own = batch.take(pa.array(asks))
                yield pa.RecordBatch.from_arrays([*own.columns, *out], [*own.schema.names, *names])
            held = {c: (v[-longest:], k[-longest:]) for c, (v, k) in held.items()}

    return run


def in_order(df: DataFrame) -> DataFrame:
    """Rows of a code in one task by date. After a `by_code` window they lie so, and nothing is moved."""
    return df.repartition("code").sortWithinPartitions("code", "date")


def frames_at(df: DataFrame, frames: dict[str, Frame], wanted: str) -> DataFrame:
    """The rows where `wanted` holds, with their frames.

    `df` lies as `in_order` leaves it and `_n` numbers the rows of a code. Rows may be missing where no
    frame reaches. One pass: no row is copied to the rows that ask for it, and a task holds a batch and
    the longest frame. What no frame reads travels only with rows that ask.
    """
    read = list(dict.fromkeys(["_n", wanted, *(c for f in frames.values() for c in f.columns)]))
    rest = [c for c in df.columns if c not in read]
    slim = df.select(*read, F.when(F.col(wanted), F.struct(*rest)).alias("_rest"))
    schema = T.StructType([*slim.schema.fields, *(T.StructField(n, f.kind) for n, f in frames.items())])
    plain = [(f.agg.__name__, f.columns, f.rows, f.minimum) for f in frames.values()]
    return slim.mapInArrow(_asked_frames(plain, list(frames), wanted), schema).select("_rest.*", *read, *frames)


def change(x: Column | str, new: int = 0, old: int = 1) -> Column:
    """Relative change between the rows `old` and `new` steps back."""
    x = F.col(x) if isinstance(x, str) else x
    w = by_code()
    top = F.lag(x, new).over(w) if new else x
    return top / F.nullif(F.lag(x, old).over(w), F.lit(0.0)) - 1.0
