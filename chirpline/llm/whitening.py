"""Operator 13: whitening of vectors by eigenpairs that FEAST contour integration finds.

Entries become whole numbers (``floor(64 * c) + 1000000``), so counts, sums and products over the fit
list (each distinct vector once) are exact: numpy multiplies limbs of 20 bits within a task, Spark
adds the tasks' sums. Only the covariance, of a size fixed by the number of dimensions, comes to the
driver. There the wanted end of the spectrum is cut into intervals by inertia counts (Sylvester's
law on shifted tridiagonal forms). On each interval a subspace is filtered by Gauss-Legendre quadrature
of ``(z I - V)^-1 Y`` on a circle around it, Rayleigh-Ritz extracts eigenpairs from the subspace, and
both are repeated until residuals are at rounding level. The interval's inertia count says how many
there must be; a subspace that gives fewer is enlarged. Every row is then projected where it lies.

Rows whose vector is null or holds null or non-finite entries are dropped, and so are those of another
length than the most frequent one (ties: the longer), which no one covariance can hold; empty vectors
go too. Components with no variance (to 1e-12 of the trace) don't exist: vectors that are all alike
give no rows, nor does an empty table. Repeated rows and null ids are kept, each with rows of its own.
Entries beyond the long range take its ends; ``deviation`` is null where it doesn't fit a long. Other
columns aren't read. Equal eigenvalues have an arbitrary basis of their space, one for all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, table

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
#: Rows multiplied at once, so that sums of products of two limbs stay whole in a double.
BLOCK = 4_096
LIMB = 20
#: A sum goes to Spark as three longs of this many bits.
PIECE = 42
POINTS = 8
ROUNDS = 60
#: Share of the trace below which a component has no variance.
FLAT = 1e-12
#: Share of the trace that intervals keep between their ends and any eigenvalue.
APART = 1e-10
LONG = 1 << 63


# ---- exact sums -----------------------------------------------------------------------------------


def matrix_of(column) -> np.ndarray:
    """A column of equally long lists of longs as a matrix."""
    values = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
    return values.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as signed limbs of ``LIMB`` bits, the lowest first, in doubles."""
    out = []
    while True:
        low = y & ((1 << LIMB) - 1)
        rest = y >> LIMB
        if not rest.any() or not (rest + 1).any() or not (rest * (rest + 1)).any():
            out.append(y.astype(np.float64))
            return out
        out.append(low.astype(np.float64))
        y = rest


def exact_sums(y: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and sums of products of a matrix of longs, as Python integers."""
    d = y.shape[1]
    sums, products = np.zeros(d, object), np.zeros((d, d), object)
    for i in range(0, len(y), BLOCK):
        parts = limbs(y[i : i + BLOCK])
        for a, u in enumerate(parts):
            sums += u.sum(0).astype(np.int64).astype(object) << (LIMB * a)
            for b, v in enumerate(parts):
                products += (u.T @ v).astype(np.int64).astype(object) << (LIMB * (a + b))
    return len(y), sums, products


def in_pieces(value: int) -> tuple[int, int, int]:
    mask = (1 << PIECE) - 1
    return value & mask, (value >> PIECE) & mask, value >> (2 * PIECE)


def moments(fit: DataFrame, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Exact n, sums and sums of products of the vectors ``x``, less ``OFFSET``, as Python integers."""

    def run(batches):
        n, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for b in batches:
            k, s, p = exact_sums(matrix_of(b.column("x")) - OFFSET)
            n, sums, products = n + k, sums + s, products + p
        rows = [(-1, -1, n), *((-1, j, v) for j, v in enumerate(sums)), *((i, j, products[i, j]) for i in range(dims) for j in range(i, dims))]
        if n:
            at, of, value = zip(*rows)
            low, mid, high = zip(*map(in_pieces, map(int, value)))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(of, pa.int32()), *(pa.array(c, pa.int64()) for c in (low, mid, high))], ["i", "j", "low", "mid", "high"])

    parts = map_arrow(fit, run, "i int, j int, low long, mid long, high long")
    got = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("low", "mid", "high"))).collect()  # a row for each pair of dimensions
    n, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
    for r in got:
        value = r.low + (r.mid << PIECE) + (r.high << (2 * PIECE))
        if r.i >= 0:
            products[r.i, r.j] = products[r.j, r.i] = value
        elif r.j >= 0:
            sums[r.j] = value
        else:
            n = value
    return n, sums, products


def covariance(n: int, sums: np.ndarray, products: np.ndarray) -> np.ndarray:
    """Divisor n; centred in whole numbers and rounded once."""
    centred = products * n - np.outer(sums, sums)
    return np.array([[int(v) / (n * n) for v in row] for row in centred], np.float64).reshape(len(sums), len(sums))


# ---- eigenpairs of a symmetric matrix -------------------------------------------------------------


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared off-diagonal of an orthogonally similar tridiagonal matrix (Householder)."""
    a = v.copy()
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if not size:
            continue
        x[0] += size if x[0] >= 0 else -size
        x /= np.linalg.norm(x)
        a[k + 1 :, :] -= 2 * np.outer(x, x @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, 1) ** 2


def inertia_above(form: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """How many eigenvalues are greater than ``shift``: the positive pivots of the shifted form."""
    diagonal, off = form
    above, pivot = 0, 1.0
    for i, x in enumerate(diagonal):
        pivot = x - shift - (off[i - 1] / pivot if i else 0.0)
        if pivot == 0.0:
            pivot = -1e-300
        above += pivot > 0
    return above


def cut_below(form, low: float, high: float, wanted: int, apart: float) -> float:
    """A shift above which there are at least ``wanted`` eigenvalues, with none within ``apart`` of it.

    Equal eigenvalues, and chains of almost equal ones, stay on one side. ``low`` if there is no such shift.
    """
    shift, upper = low, high
    for _ in range(200):
        mid = (shift + upper) / 2
        if not shift < mid < upper:
            break
        above = inertia_above(form, mid)
        if above == wanted:
            shift = mid
            break
        shift, upper = (mid, upper) if above > wanted else (shift, mid)
    while shift > low and inertia_above(form, shift - apart) != inertia_above(form, shift + apart):
        shift -= apart
    return max(shift, low)


def widest_gap(form, near: float, low: float, high: float) -> float:
    """A shift with the same count as ``near``, in the middle between the eigenvalues beside it."""
    count = inertia_above(form, near)
    edges = []
    for far in (low, high):
        inner, outer = near, far
        for _ in range(60):
            mid = (inner + outer) / 2
            inner, outer = (mid, outer) if inertia_above(form, mid) == count else (inner, mid)
        edges.append(inner)
    return (edges[0] + edges[1]) / 2


def contour(v: np.ndarray, low: float, high: float, count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of ``v`` within (low, high), by FEAST."""
    d = len(v)
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    angles = np.pi / 2 * (1 - nodes)  # the upper half circle; the lower is its conjugate
    points = centre + radius * np.exp(1j * angles)
    scale = np.linalg.norm(v, 2)
    rng = np.random.default_rng(seed)
    width = min(d, count + max(4, count // 2))
    while True:
        y = rng.standard_normal((d, width))
        for _ in range(ROUNDS):
            q = np.zeros((d, y.shape[1]))
            for z, angle, w in zip(points, angles, weights):
                q += (w / 2 * radius * np.exp(1j * angle) * np.linalg.solve(z * np.eye(d) - v, y.astype(complex))).real
            left, sizes, _ = np.linalg.svd(q, full_matrices=False)
            basis = left[:, sizes > 1e-13 * sizes[0]]
            values, small = np.linalg.eigh(basis.T @ v @ basis)
            vectors = basis @ small
            inside = (values > low) & (values < high)
            residual = np.linalg.norm(v @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0)
            if inside.sum() == count and residual.max(initial=0) <= 1e-14 * d * scale:
                return values[inside], vectors[:, inside]
            y = vectors
        if width == d:
            raise ArithmeticError(f"{count} eigenvalues between {low} and {high} by inertia, {int(inside.sum())} found")
        width = min(d, 2 * width)  # some were missed, or have not settled


def leading(v: np.ndarray, wanted: int = COMPONENTS, batch: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues above ``FLAT`` of the trace, falling, and their vectors as columns."""
    d, trace = len(v), float(np.trace(v))
    if not d or trace <= 0:
        return np.zeros(0), np.zeros((d, 0))
    form = tridiagonal(v)
    top = float(np.abs(v).sum(1).max()) * 1.01  # no eigenvalue is beyond a row's sum
    floor = FLAT * trace
    wanted = min(wanted, inertia_above(form, floor))
    values, vectors, high, done = [], [], top, 0
    while done < wanted:
        aim = min(done + batch, wanted)
        low = cut_below(form, floor, high, aim, APART * trace)
        found = inertia_above(form, low)
        if low > floor:
            low = max(widest_gap(form, low, 0.0, high), floor)
        e, u = contour(v, low, high, found - done)
        values.append(e[::-1])
        vectors.append(u[:, ::-1])
        high, done = low, found
    e, u = np.concatenate(values), np.concatenate(vectors, 1)
    u, r = np.linalg.qr(u)  # vectors of different intervals are orthogonal to rounding already
    return e[:wanted], (u * np.sign(np.diag(r)))[:, :wanted]


# ---- rows -----------------------------------------------------------------------------------------


def whole_numbers(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``key`` and ``x``, of the rows whose entries are all finite numbers."""
    c = F.col(vector)
    finite = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    x = F.transform(c, lambda e: F.least(F.floor(F.least(e.cast("double"), F.lit(1.4e17)) * SCALE), F.lit(LONG - 1 - OFFSET)) + OFFSET)
    return vectors.where(c.isNotNull() & finite & (F.size(c) > 0)).select(F.col(key).alias("key"), x.alias("x"))


class Whitening:
    """Exact centre and components of a fit list."""

    def __init__(self, n: int, sums: np.ndarray, products: np.ndarray, wanted: int = COMPONENTS):
        self.n, self.sums = n, sums
        v = covariance(n, sums, products)
        self.trace = float(np.trace(v))
        self.values, self.vectors = leading(v, wanted)

    def deviations(self, y: np.ndarray) -> np.ndarray:
        """n * y - sums, exact: longs where they fit, else Python integers."""
        most = max(int(np.abs(y).max(initial=0)), 1) * self.n + max(map(abs, map(int, self.sums)), default=0)
        if most * most * y.shape[1] < LONG:
            return y * self.n - self.sums.astype(np.int64)
        return y.astype(object) * self.n - self.sums

    def project(self, y: np.ndarray) -> tuple[list, np.ndarray]:
        """Each row's exact squared deviation and its whitened coordinates."""
        away = self.deviations(y)
        squares = (away * away).sum(1).tolist()
        centred = (away / self.n).astype(np.float64)
        return [s if s < LONG else None for s in squares], centred @ self.vectors / np.sqrt(self.values)


def identity_error(fit: DataFrame, shared, components: int) -> float:
    """Largest entry of the whitened fit list's covariance, measured, minus the identity."""

    def run(batches):
        total, squares = np.zeros(components), np.zeros((components, components))
        for b in batches:
            _, z = shared.value.project(matrix_of(b.column("x")) - OFFSET)
            total += z.sum(0)
            squares += z.T @ z
        cells = [(-1, j, total[j]) for j in range(components)] + [(i, j, squares[i, j]) for i in range(components) for j in range(components)]
        at, of, value = zip(*cells)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(of, pa.int32()), pa.array(value, pa.float64())], ["i", "j", "value"])

    got = {(r.i, r.j): r.value for r in map_arrow(fit, run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()}
    n = shared.value.n
    mean = np.array([got[-1, j] for j in range(components)]) / n
    second = np.array([[got[i, j] for j in range(components)] for i in range(components)]) / n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(components)).max())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per row and component: ``key``, component, n, deviation, whitened, explained and identity_error."""
    spark = vectors.sparkSession
    kind = vectors.select(key).schema.fields[0].dataType.simpleString()
    schema = "key {}, component int, n long, deviation long, whitened double, explained double, identity_error double".format(kind)
    rows = whole_numbers(vectors, key, vector)
    lengths = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    empty = spark.createDataFrame([], schema).withColumnRenamed("key", key)
    if not lengths:
        return empty
    dims = lengths[0].dims
    rows = rows.where(F.size("x") == dims)
    fit = cut(rows.select("x").distinct(), "fit-list")
    model = Whitening(*moments(fit, dims), components)
    found = len(model.values)
    if not found:
        return empty
    shared = spark.sparkContext.broadcast(model)
    error = identity_error(fit, shared, found)

    def run(batches):
        m = shared.value
        explained = m.values / m.trace
        for b in batches:
            deviation, z = m.project(matrix_of(b.column("x")) - OFFSET)
            each = pa.array(np.repeat(np.arange(len(z)), found))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("key").take(each),
                    pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), len(z))),
                    pa.array(np.full(len(each), m.n, np.int64)),
                    pa.array(deviation, pa.int64()).take(each),
                    pa.array(z.ravel()),
                    pa.array(np.tile(explained, len(z))),
                    pa.array(np.full(len(each), error)),
                ],
                ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return map_arrow(rows, run, schema).withColumnRenamed("key", key)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """Every row of ``embeddings`` on the first sixteen components."""
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
