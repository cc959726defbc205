"""Whitening of embeddings: QDWH spectral divide and conquer.

The fit takes all usable vectors. One pass sums them, a second sums the products of the centred entries;
each task reduces its rows to a matrix of dims x dims, and Spark adds the entries up by (row, column). The
covariance is the only thing the driver sees: its size depends on the dimension alone, which is checked
against `MOST_DIMS`.

Method. The covariance is shifted so that its spectrum has both signs; the orthogonal polar factor U of
the shifted matrix (QR-based dynamically weighted Halley iteration) has the eigenvalues -1 and 1, and
(U + I) / 2 is the projector on the components above the shift. Orthonormal bases of its range and of the
rest split the matrix into two smaller ones, and each is split again until it has one row, or is a
multiple of the identity. Only parts that can hold one of the wanted components are split. The projection
on the wanted components, scaled to variance one, is broadcast with the tasks (dims x components numbers).

Entries c become x = floor(1024 c) + 100000, where 1024 c is held within +-2^40.

Edge cases: vectors that are null or hold null, NaN or infinite entries are left out, of the fit and of
the result; so are those shorter than the longest vector, whose last entries count as null. Repeated rows
and null ids are rows like others. An empty table, or one without usable entries, gives no row. A
component whose variance is not above rounding (one vector, equal vectors) has a null `whitened` and is
not part of `identity_error`; `explained` is null where the whole variance is 0. There are as many
components as dimensions if these are fewer than asked. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import column, free_name, mapped

COMPONENTS = 8
MOST_DIMS = 2048
HELD = float(1 << 40)
_EPS = np.finfo(float).eps


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix without an eigenvalue 0."""
    n = len(a)
    x, low = a / np.linalg.norm(a), _EPS / 4
    for _ in range(30):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        weight = np.sqrt(1 + d) + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d))) / 2
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        q = np.linalg.qr(np.concatenate([np.sqrt(c) * x, np.eye(n)]))[0]
        new = b / c * x + (weight - b / c) / np.sqrt(c) * q[:n] @ q[n:].T
        new = (new + new.T) / 2
        low = min(1.0, low * (weight + b * square) / (1 + c * square))
        moved = np.linalg.norm(new - x)
        x = new
        if 1 - low < 4 * _EPS and moved < 1e-8:
            break
    return x


def _parts(a: np.ndarray, shift: float, rng) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Bases of the invariant subspaces above and below a shift, and what couples them."""
    n = len(a)
    projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    rank = int(round(np.trace(projector)))
    if not 0 < rank < n:
        return None
    basis = np.linalg.qr(projector @ rng.standard_normal((n, rank)))[0]
    whole = np.linalg.qr(projector @ basis, mode="complete")[0]
    above, below = whole[:, :rank], whole[:, rank:]
    return above, below, float(np.linalg.norm(above.T @ a @ below))


def components(a: np.ndarray, most: int, rng=None, least: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    rng = rng or np.random.default_rng(0)
    n = len(a)
    level = np.trace(a) / n
    least = n * _EPS * np.linalg.norm(a) if least is None else least
    if n == 1 or np.linalg.norm(a - level * np.eye(n)) <= least:
        most = min(most, n)
        return np.diag(a)[:most].copy(), np.eye(n)[:, :most]
    # Diagonal entries lie inside the spectrum; so does their mean, strictly.
    diagonal = np.diag(a)
    best = None
    for attempt in range(8):
        shift = (np.median(diagonal), level)[attempt] if attempt < 2 else rng.uniform(diagonal.min(), diagonal.max())
        split = _parts(a, float(shift), rng)
        if split and (best is None or split[2] < best[2]):
            best = split
        if best and best[2] <= 8 * least:
            break
    if best is None:
        raise ArithmeticError("no shift parts the spectrum")
    values, vectors = [], []
    for basis in best[:2]:
        wanted = most - sum(len(v) for v in values)
        if wanted > 0:
            inner = basis.T @ a @ basis
            value, vector = components((inner + inner.T) / 2, wanted, rng, least)
            values.append(value)
            vectors.append(basis @ vector)
    value, vector = np.concatenate(values), np.concatenate(vectors, axis=1)
    order = np.argsort(-value, kind="stable")
    return value[order], vector[:, order]


def usable(df: DataFrame, vector: str = "embedding") -> tuple[DataFrame, str]:
    """Rows with whole vectors, and the name of the added column with their entries as longs."""
    name = free_name(df, "x")
    entry = column(df, vector)
    finite = F.forall(entry, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    held = F.transform(entry, lambda c: F.greatest(F.least(c.cast("double") * 1024, F.lit(HELD)), F.lit(-HELD)))
    x = F.transform(held, lambda c: F.floor(c) + F.lit(100000))
    return df.where(entry.isNotNull() & finite & (F.size(entry) > 0)).withColumn(name, x), name


def _matrix(lists, dims: int):
    """Which lists of an Arrow array have `dims` entries, and these as a matrix."""
    import pyarrow.compute as pc

    full = pc.equal(lists.value_lengths(), dims)
    return full, lists.filter(full).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def totals(x: DataFrame) -> tuple[int, list[int]]:
    """Number and exact sums of the longest vectors of a one-column table, summed in tasks first."""

    def run(batches):
        import pyarrow as pa

        sums: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            lists = batch.column(0)
            for dims in np.unique(lists.value_lengths().to_numpy(zero_copy_only=False)):
                _, m = _matrix(lists, int(dims))
                count, old = sums.get(int(dims), (0, [0] * int(dims)))
                # In slices whose sums fit a long.
                for at in range(0, len(m), 1 << 16):
                    old = [a + int(b) for a, b in zip(old, m[at : at + (1 << 16)].sum(axis=0))]
                sums[int(dims)] = (count + len(m), old)
        for dims, (count, total) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([dims] * dims, pa.int64()), pa.array(range(dims), pa.int64()),
                    pa.array([count] * dims, pa.int64()), pa.array([str(t) for t in total], pa.string()),
                ],
                ["dims", "at", "n", "total"],
            )

    parts = mapped(x, run, "dims long, at long, n long, total string")
    longest = parts.groupBy("dims", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    )
    # The longest vectors only; one row a dimension.
    rows = longest.orderBy(F.desc("dims"), "at").limit(MOST_DIMS + 1).collect()
    rows = [r for r in rows if r["dims"] == rows[0]["dims"]]
    if len(rows) > MOST_DIMS:
        raise ValueError(f"vectors may have {MOST_DIMS} dimensions at most")
    return (rows[0]["n"] if rows else 0), [int(r["total"]) for r in rows]


def covariance(x: DataFrame, n: int, mean: np.ndarray, basis: np.ndarray | None = None) -> np.ndarray:
    """Covariance, divisor n, of the vectors or of their projections on a basis."""
    dims, width = len(mean), len(mean) if basis is None else basis.shape[1]

    def run(batches):
        import pyarrow as pa

        # The last row sums the centred entries themselves, whose mean is 0 but for rounding.
        sums = np.zeros((width + 1, width))
        for batch in batches:
            _, m = _matrix(batch.column(0), dims)
            m = m - mean
            m = m if basis is None else m @ basis
            sums[:-1] += m.T @ m
            sums[-1] += m.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(width + 1), width)), pa.array(np.tile(np.arange(width), width + 1)),
             pa.array(sums.ravel())],
            ["i", "j", "v"],
        )

    parts = mapped(x, run, "i long, j long, v double")
    out = np.zeros((width + 1, width))
    for row in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        out[row["i"], row["j"]] = row["v"]
    rest = out[-1] / n
    v = out[:-1] / n - np.outer(rest, rest)
    return (v + v.T) / 2


@dataclass(frozen=True)
class Whitening:
    """What a fit gives: counts and sums, and per component variance share and scaled direction."""

    n: int
    sums: list[int]
    explained: list[float | None]
    basis: np.ndarray  # dims x components; not a number where the variance is rounding
    identity_error: float | None

    @property
    def mean(self) -> np.ndarray:
        # A whole part and a rest, so that the division does not round large sums first.
        return np.array([t // self.n + t % self.n / self.n for t in self.sums])


def fitted(df: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> Whitening | None:
    """Means, components and check of all usable vectors; None without any."""
    rows, name = usable(df, vector)
    x = rows.select(name)
    n, sums = totals(x)
    if not n:
        return None
    bare = Whitening(n, sums, [], np.zeros((len(sums), 0)), None)
    v = covariance(x, n, bare.mean)
    values, vectors = components(v, most)
    # Either sign will do; the entry of largest size is positive.
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))] < 0, -1.0, 1.0)
    trace = float(np.trace(v))
    real = values > len(v) * _EPS * max(float(np.linalg.norm(v)), _EPS)
    basis = vectors / np.sqrt(np.where(real, values, 1.0))
    error = None
    if real.any():
        error = float(np.abs(covariance(x, n, bare.mean, basis[:, real]) - np.eye(int(real.sum()))).max())
    explained = [float(e) / trace if trace > 0 else None for e in values]
    return Whitening(n, sums, explained, np.where(real, basis, np.nan), error)


def _squares(m: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Exact sum of (n x - S)^2 of each row; in Python integers where a long could be too short."""
    most = n * int(np.abs(m).max(initial=0)) + max(abs(s) for s in sums)
    if most < 1 << 62:
        d = m * n - np.array(sums, dtype=np.int64)
        if int(np.abs(d).max(initial=0)) ** 2 * m.shape[1] >= 1 << 63:
            d = d.astype(object)
    else:
        d = m.astype(object) * n - np.array(sums, dtype=object)
    return (d * d).sum(axis=1)


def whitened(
    df: DataFrame, fit: Whitening, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",)
) -> DataFrame:
    """The usable rows' `keep`, with `whitened` (one entry a component) and `deviation`, exact."""
    x, name = usable(df, vector)
    mean, basis, sums, n, dims = fit.mean, fit.basis, fit.sums, fit.n, len(fit.sums)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            full, m = _matrix(batch.column(name), dims)
            out = (m - mean) @ basis
            flat = pa.array(out.ravel(), from_pandas=True)
            offsets = pa.array(np.arange(len(m) + 1) * basis.shape[1], pa.int32())
            rest = batch.filter(full).drop_columns([name])
            deviation = pa.array([str(d) for d in _squares(m, n, sums)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.ListArray.from_arrays(offsets, flat), deviation],
                [*rest.schema.names, "whitened", "deviation"],
            )

    kept = x.select(*keep, name)
    fields = [f for f in kept.schema.fields if f.name != name]
    out = mapped(kept, run, T.StructType([*fields, T.StructField("whitened", T.ArrayType(T.DoubleType())),
                                          T.StructField("deviation", T.StringType())]))
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


OUT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`deviation` is null where the exact number does not fit a long."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    fit = fitted(rows)
    if fit is None:
        return spark.createDataFrame([], OUT)
    explained = F.array(*[F.lit(e).cast("double") for e in fit.explained])
    out = whitened(rows, fit).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"), "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(fit.identity_error).cast("double").alias("identity_error"),
    )
