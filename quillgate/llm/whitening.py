"""Embedding whitening: a distributed centred covariance, its leading components, a broadcast projection.

1. One pass counts the vectors and sums each dimension, exactly, in integers.
2. A second pass adds up the outer products of the centred vectors.  A task sends one matrix, cut
   into bands of rows; bands are added in two steps, so no worker holds more than a share of them.
3. The driver solves the ``d x d`` matrix, whose size depends on the dimensions only and is
   checked: Householder reflections to tridiagonal form, Sturm counts and bisection for the
   leading eigenvalues, inverse iteration for the vectors.  Vectors whose eigenvalues lie close
   together are made orthogonal within their cluster.
4. The components are broadcast and every vector is projected in one scan.
5. A last pass merges centred moments of the result and states how far they are from the identity.

Defined results: a vector that is null, empty, or holds a null, a non-finite entry or one beyond
``most_entry`` is left out.  Where lengths differ, the most frequent one counts (the longer of equals)
and other vectors are left out.  Rows that repeat an id are rows of their own, also a null id.
Components without variance (``e <= 1e-12 * trace``) cannot be whitened and are left out, so equal
vectors, a single one or an empty table give no row.  ``deviation`` is null where it exceeds a
long.  Each component's largest entry in size is positive, so reruns agree.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm.shared import table, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])
_EPS = np.finfo(float).eps
_FLOOR = 1e-100  #: stands for the norm of a zero matrix


@dataclass(frozen=True)
class Settings:
    components: int = 32
    scale: float = 64.0
    offset: int = 1_000_000
    most_entry: float = 2.0**40  #: entries beyond it are left out like infinite ones
    most_dims: int = 4096  #: bound of the matrix that reaches the driver
    band: int = 64  #: rows of the matrix that travel together
    rows: int = 4096  #: vectors that a worker expands at a time


@dataclass(frozen=True)
class Fit:
    """``axes`` holds a unit component in each column, ``values`` their variances, falling."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    trace: float


# --- symmetric eigenproblem ---


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit reflection vectors of a symmetric matrix."""
    a = np.array(matrix, dtype=float)
    d = len(a)
    mirrors = []
    for k in range(d - 2):
        column = a[k + 1 :, k]
        v = column.copy()
        v[0] += np.copysign(np.linalg.norm(column), column[0])
        size = np.linalg.norm(v)
        v = v / size if size > 0 else v
        mirrors.append(v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def back(mirrors: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Vectors of the tridiagonal matrix as vectors of the first one."""
    out = vectors.copy()
    for k in range(len(mirrors) - 1, -1, -1):
        out[k + 1 :] -= 2 * np.outer(mirrors[k], mirrors[k] @ out[k + 1 :])
    return out


def count_below(diagonal: np.ndarray, beside: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues are less than each value of ``at``."""
    least = _EPS * max(np.abs(diagonal).max(initial=0), np.abs(beside).max(initial=0), _FLOOR)
    q = np.ones(len(at))
    below = np.zeros(len(at), dtype=int)
    for k in range(len(diagonal)):
        q = diagonal[k] - at - (beside[k - 1] ** 2 / q if k else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        below += q < 0
    return below


def leading_values(diagonal: np.ndarray, beside: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each by bisection to the last bits."""
    d = len(diagonal)
    around = np.zeros(d)
    around[:-1] += np.abs(beside)
    around[1:] += np.abs(beside)
    lo, hi = (diagonal - around).min(), (diagonal + around).max()
    slack = 4 * _EPS * max(abs(lo), abs(hi), _FLOOR)
    low, high = np.full(k, lo - slack), np.full(k, hi + slack)
    wanted = d - 1 - np.arange(k)  # index of each among all, rising
    for _ in range(200):
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        above = count_below(diagonal, beside, middle) <= wanted
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return (low + high) / 2


def _solved(diagonal: np.ndarray, beside: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """``(T - shift) x = right`` by elimination with row exchanges."""
    d = len(diagonal)
    main, up, upper = diagonal - shift, np.append(beside, 0.0), np.zeros(d)
    x = right.copy()
    down = beside.copy()
    for k in range(d - 1):
        if abs(down[k]) > abs(main[k]):
            main[k], down[k] = down[k], main[k]
            up[k], main[k + 1] = main[k + 1], up[k]
            upper[k], up[k + 1] = up[k + 1], 0.0
            x[k], x[k + 1] = x[k + 1], x[k]
        if abs(main[k]) < least:
            main[k] = least
        m = down[k] / main[k]
        main[k + 1] -= m * up[k]
        up[k + 1] -= m * upper[k]
        x[k + 1] -= m * x[k]
    if abs(main[-1]) < least:
        main[-1] = least
    for k in range(d - 1, -1, -1):
        if k + 1 < d:
            x[k] -= up[k] * x[k + 1]
        if k + 2 < d:
            x[k] -= upper[k] * x[k + 2]
        x[k] /= main[k]
        if abs(x[k]) > 1e150:  # only the direction counts
            x /= abs(x[k])
    return x


def inverse_iteration(diagonal: np.ndarray, beside: np.ndarray, values: np.ndarray, gap: float = 1e-3) -> np.ndarray:
    """Unit vectors for the falling ``values``; those closer than ``gap`` of the norm are one cluster."""
    d = len(diagonal)
    norm = max(np.abs(diagonal).max(initial=0), np.abs(beside).max(initial=0), _FLOOR)
    out = np.zeros((d, len(values)))
    rng = np.random.default_rng(7)
    first, shift = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > gap * norm:
            first = j
        # equal values get shifts a few bits apart
        shift = min(value, shift - 4 * _EPS * norm) if j > first else value
        cluster = out[:, first:j]
        x = rng.standard_normal(d)
        for _ in range(6):
            x = _solved(diagonal, beside, shift, x / np.linalg.norm(x), _EPS * norm)
            for _ in range(2):  # twice is enough
                x -= cluster @ (cluster.T @ x)
        out[:, j] = x / np.linalg.norm(x)
    return out


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and unit vectors in columns."""
    k = min(k, len(matrix))
    if not k:
        return np.zeros(0), np.zeros((len(matrix), 0))
    scale = np.abs(matrix).max() or 1.0
    diagonal, beside, mirrors = tridiagonal(matrix / scale)
    # A negligible entry beside the diagonal parts the matrix; vectors of equal values in
    # different parts are told apart by the cluster's orthogonality.
    values = leading_values(diagonal, beside, k)
    axes = back(mirrors, inverse_iteration(diagonal, beside, values))
    largest = np.abs(axes).argmax(axis=0)
    return values * scale, axes * np.sign(axes[largest, np.arange(k)])


# --- distributed passes ---


def vectors_of(embeddings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``vec_id, vector``: the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    sound = F.forall(vector, lambda c: F.coalesce(F.abs(c) <= settings.most_entry, F.lit(False)))  # NaN is greater than any number
    whole = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("vector")).where(sound & (F.size(vector) > 0))
    lengths = whole.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return whole.where(F.size("vector") == (lengths.d if lengths else 0))


def _entries(column: pa.Array, settings: Settings, dims: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """The integer entries of some rows at a time."""
    for lo in range(0, len(column), settings.rows):
        part = column.slice(lo, settings.rows)
        c = part.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        yield lo, lo + len(part), np.floor(settings.scale * c).astype(np.int64) + settings.offset


def _sums(settings: Settings):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = len(batch.column("vector")[0])
            for lo, hi, x in _entries(batch.column("vector"), settings, dims):
                part = x.sum(axis=0)
                total, n = part.astype(object) if total is None else total + part, n + hi - lo
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(total)), pa.int32()), "n": pa.array([n] * len(total), pa.int64()), "total": pa.array([str(x) for x in total])})

    return add


def _bands(matrix: np.ndarray, part: int, settings: Settings, n: int, mean: np.ndarray) -> pa.RecordBatch:
    starts = list(range(0, len(matrix), settings.band))
    return pa.RecordBatch.from_pydict({
        "band": pa.array(starts, pa.int32()), "part": pa.array([part] * len(starts), pa.int64()), "n": pa.array([n] * len(starts), pa.int64()),
        "mean": pa.array([mean.tobytes()] * len(starts), pa.binary()), "products": pa.array([matrix[s : s + settings.band].tobytes() for s in starts], pa.binary()),
    })


class _Moments:
    """Count, mean and centred products of a band of rows; batches and parts merge."""

    def __init__(self):
        self.n, self.mean, self.products = 0, None, None

    def merge(self, n: int, mean: np.ndarray, products: np.ndarray, rows: slice = slice(None)) -> None:
        if not self.n:
            self.n, self.mean, self.products = n, mean.copy(), products.copy()
            return
        gap, both = mean - self.mean, self.n + n
        self.products += products + np.outer(gap[rows], gap) * (self.n * n / both)
        self.mean += gap * (n / both)
        self.n = both


def _products(settings: Settings, column: str, centre: np.ndarray, integers: bool):
    """Centred products of ``column``; one matrix for each task."""
    from pyspark import TaskContext

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_rows = _Moments()
        for batch in batches:
            for lo in range(0, batch.num_rows, settings.rows):
                part = batch.column(column).slice(lo, settings.rows)
                values = part.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(centre))
                if integers:
                    values = np.floor(settings.scale * values) + settings.offset
                z = values - centre
                mean = z.mean(axis=0)
                z -= mean
                all_rows.merge(len(z), mean, z.T @ z)
        if all_rows.n:
            yield _bands(all_rows.products, TaskContext.get().partitionId(), settings, all_rows.n, all_rows.mean)

    return add


def _merged(settings: Settings):
    def merge(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        out = _Moments()
        start = rows[0]["band"]
        for r in rows:
            mean = np.frombuffer(r["mean"])
            out.merge(r["n"], mean, np.frombuffer(r["products"]).reshape(-1, len(mean)), slice(start, start + settings.band))
        return pa.table({
            "band": pa.array([start], pa.int32()), "part": pa.array([rows[0]["part"]], pa.int64()), "n": pa.array([out.n], pa.int64()),
            "mean": pa.array([out.mean.tobytes()], pa.binary()), "products": pa.array([out.products.tobytes()], pa.binary()),
        })

    return merge


_BAND = "band int, part long, n long, mean binary, products binary"


def covariance(rows: DataFrame, column: str, centre: np.ndarray, settings: Settings, integers: bool = False) -> np.ndarray:
    """The covariance (divisor n) of an array column, centred on ``centre`` and on the remaining mean."""
    bands = rows.select(column).mapInArrow(_products(settings, column, centre, integers), _BAND)
    shares = max(1, round(rows.rdd.getNumPartitions() ** 0.5))  # two steps of about as many matrices each
    merge = _merged(settings)
    some = bands.groupBy("band", (F.col("part") % shares).alias("share")).applyInArrow(merge, _BAND)
    found = some.groupBy("band").applyInArrow(merge, _BAND).orderBy("band").collect()  # d x d numbers
    d = len(centre)
    out = np.concatenate([np.frombuffer(r["products"]).reshape(-1, d) / r["n"] for r in found]) if found else np.zeros((d, d))
    return (out + out.T) / 2


def fitted(vectors: DataFrame, settings: Settings = Settings()) -> Fit:
    """Fit on every row of ``vectors``."""
    parts = vectors.select("vector").mapInArrow(_sums(settings), "at int, n long, total string")
    sums = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("at").limit(settings.most_dims + 1).collect()
    if len(sums) > settings.most_dims:
        raise ValueError(f"vectors of more than {settings.most_dims} entries: raise Settings.most_dims if the driver holds the matrix")
    if not sums:
        return Fit(0, np.zeros(0, dtype=object), np.zeros(0), np.zeros((0, 0)), 0.0)
    n, totals = sums[0].n, np.array([int(r.total) for r in sums], dtype=object)
    v = covariance(vectors, "vector", _means(n, totals), settings, integers=True)
    values, axes = leading(v, settings.components)
    trace = float(np.trace(v))
    has = values > 1e-12 * trace
    return Fit(n, totals, values[has], axes[:, has], trace)


def _means(n: int, totals: np.ndarray) -> np.ndarray:
    """S / n to the last bit, from whole and rest."""
    return np.array([float(t // n) + float(t % n) / n for t in totals])


def _projector(fit: Fit, settings: Settings):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string("vec_id long, deviation long, whitened array<double>"))
    whole, rest = np.array([int(t // fit.n) for t in fit.sums]), np.array([int(t % fit.n) for t in fit.sums])
    turn = fit.axes / np.sqrt(fit.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, x in _entries(batch.column("vector"), settings, len(whole)):
                gap = x - whole  # n*x - S = n*gap - rest
                far = fit.n * (np.abs(gap).astype(float) + 1)
                plain = (far.max(axis=1) < 2**31) & ((far**2).sum(axis=1) < 2.0**62)
                square = np.zeros(hi - lo, dtype=np.int64)
                square[plain] = ((fit.n * gap[plain] - rest) ** 2).sum(axis=1)
                exact = [int(s) for s in square]
                for k in np.flatnonzero(~plain):
                    exact[k] = sum((fit.n * int(g) - int(r)) ** 2 for g, r in zip(gap[k], rest, strict=True))
                    exact[k] = exact[k] if exact[k] < 2**63 else None
                w = (gap - rest / fit.n) @ turn
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").slice(lo, hi - lo), pa.array(exact, pa.int64()), lists.cast(out.field("whitened").type)], schema=out)

    return project


def projected(vectors: DataFrame, fit: Fit, settings: Settings = Settings()) -> DataFrame:
    """``vec_id, deviation, whitened``: the array holds an entry for each component."""
    kind = "vec_id long, deviation long, whitened array<double>"
    if not len(fit.values):
        return vectors.sparkSession.createDataFrame([], kind)
    return vectors.mapInArrow(_projector(fit, settings), kind)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vectors_of(table(spark, sf_dir, "embeddings"))
    fit = fitted(vectors)
    white = written(projected(vectors, fit), "whitened")
    k = len(fit.values)
    off = covariance(white, "whitened", np.zeros(k), Settings()) - np.eye(k)
    share = F.array(*[F.lit(float(e / fit.trace)) for e in fit.values]).cast("array<double>")
    rows = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(float(np.abs(off).max(initial=0))).alias("identity_error"),
    )
