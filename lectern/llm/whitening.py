"""Whitening of embeddings by FEAST: eigenvectors of the covariance by contour integration.

1. Entries become whole numbers. Counts and sums are taken over all vectors, then the second moments
   of vectors centred on the whole number next to their mean. All of these are exact integers, so
   the covariance is the same however rows lie in partitions and tasks are run again.
2. Inertia: the covariance is reflected to a tridiagonal matrix, and the signs of the pivots of
   T - s tell how many eigenvalues lie below s. Bisection on that finds an interval, with its ends
   in gaps, that holds the components asked for.
3. FEAST: a random block is filtered by quadrature of the resolvent along a circle around the
   interval. Each node of the quadrature is a complex shifted solve with the covariance, a Spark
   task of its own. Rayleigh-Ritz on the filtered block gives eigenpairs; it is filtered again until
   the residuals are at rounding level. The count of pairs in the interval must equal the inertia.
4. Vectors are projected on the components and divided by the roots of their eigenvalues.

What passes through the driver are d sums and d x d second moments for vectors of d entries.

Vectors that are null or hold null or non-finite entries are dropped. All vectors must have one
length; of several, the most frequent (of ties the longest) holds and others count as vectors with
entries missing, so they are dropped. Components whose eigenvalue is not above rounding level
can't be whitened and give no rows; so one vector, equal vectors, or none give no rows. Null ids
and repeated rows stay as they are, each a row of the fit list. Other columns are not read.
``deviation`` is null where it is beyond a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import stored

SCALE, OFFSET = 1024, 100_000
#: Nodes on the half circle, filter rounds at most, and rounds with a larger block at most.
NODES, ROUNDS, GROWTHS = 8, 30, 4
EPSILON = float(np.finfo(float).eps)
#: Rows of a batch times entries at a time, so that sums of squares of batches stay exact.
CELLS = 4_000_000


# --- exact statistics --------------------------------------------------------------------------------


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x): whole-number vectors of one length without missing or non-finite entries."""
    double = F.transform(F.col(embedding), lambda c: c.cast("double"))
    ok = F.forall(double, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = vectors.filter(F.col(embedding).isNotNull() & (F.size(embedding) > 0)).filter(ok).select(
        F.col(vec_id).alias("vec_id"), F.transform(double, lambda c: F.floor(c * SCALE) + OFFSET).alias("x"))
    sizes = whole.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    return whole.filter(F.size("x") == (sizes[0]["size"] if sizes else 0))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _summed(x: DataFrame, rows_of: Callable[[np.ndarray], np.ndarray]) -> dict[int, list[int]]:
    """Whole numbers ``rows_of`` a batch, a list for each key 0, 1, .., added up exactly over all
    vectors: inside tasks first, then by position as decimals."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            m = _matrix(batch.column(0))
            step = max(1, CELLS // max(1, m.shape[1]))
            for at in range(0, len(m), step):
                more = rows_of(m[at:at + step]).astype(object)  # whole numbers without bound
                total = more if total is None else total + more
        if total is not None:
            for key, row in enumerate(total):
                yield pa.RecordBatch.from_pydict(
                    {"key": pa.array([key] * len(row), pa.int32()), "at": pa.array(range(len(row)), pa.int32()), "value": [str(v) for v in row]})

    parts = x.select("x").mapInArrow(inside, "key int, at int, value string")
    sums = parts.groupBy("key", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("string").alias("value"))
    out: dict[int, dict[int, int]] = {}
    for r in sums.collect():  # d + 1 or d x d numbers
        out.setdefault(r["key"], {})[r["at"]] = int(r["value"])
    return {key: [row[k] for k in range(len(row))] for key, row in out.items()}


def _squares(y: np.ndarray) -> np.ndarray:
    """y'y in whole numbers: by floating point where that is exact, else by integers of any size."""
    largest = int(np.abs(y).max(initial=0))
    if largest ** 2 * max(1, len(y)) < 2 ** 53:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64)
    if largest ** 2 * max(1, len(y)) < 2 ** 63:
        return y.T @ y
    return y.astype(object).T @ y.astype(object)


@dataclass
class Statistics:
    n: int
    sums: list[int]
    covariance: np.ndarray


def statistics(x: DataFrame) -> Statistics:
    """Over all rows of ``x``. n * (second moments about m) - (sums about m)(sums about m)' is n * n
    times the covariance for any m; m next to the mean keeps the numbers short."""
    first = _summed(x, lambda m: np.concatenate([[[len(m)] + [0] * (m.shape[1] - 1)], m.astype(object).sum(0, keepdims=True)]))
    if not first:
        return Statistics(0, [], np.zeros((0, 0)))
    n, sums = first[0][0], first[1]
    near = [(2 * s + n) // (2 * n) for s in sums]
    centre = np.array(near, np.int64)
    second = _summed(x, lambda m: _squares(m - centre))
    about = [s - n * c for s, c in zip(sums, near, strict=True)]
    exact = [[float(Fraction(n * second[i][j] - about[i] * about[j], n * n)) for j in range(len(sums))] for i in range(len(sums))]
    return Statistics(n, sums, np.array(exact))


# --- inertia -----------------------------------------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and subdiagonal of a tridiagonal matrix of the same eigenvalues, by reflections."""
    a = a.copy()
    d = len(a)
    for k in range(d - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += size if v[0] >= 0 else -size
        v /= np.linalg.norm(v)
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        first = a[k + 1:, k]
        first -= 2 * (v @ first) * v
        a[k, k + 1:] = first
    return np.diag(a).copy(), np.diag(a, -1).copy()


def count_below(t: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """Eigenvalues below ``shift``: the negative pivots of T - shift."""
    diagonal, below = t
    tiny = EPSILON * max(1e-300, float(np.abs(diagonal).max(initial=0)) + float(np.abs(below).max(initial=0)))
    pivot, n = 1.0, 0
    for k in range(len(diagonal)):
        pivot = diagonal[k] - shift - (below[k - 1] ** 2 / pivot if k else 0)
        if abs(pivot) < tiny * EPSILON:
            pivot = -tiny * EPSILON
        n += pivot < 0
    return n


def eigenvalue(t: tuple[np.ndarray, np.ndarray], rank: int, low: float, high: float) -> float:
    """The ``rank``-th largest (from 1), by bisection on the counts, to some nine digits."""
    d = len(t[0])
    while high - low > 1e-9 * max(abs(low), abs(high)) and (low + high) / 2 not in (low, high):
        mid = (low + high) / 2
        low, high = (mid, high) if d - count_below(t, mid) >= rank else (low, mid)
    return (low + high) / 2


def interval(t: tuple[np.ndarray, np.ndarray], wanted: int, floor: float) -> tuple[float, float, int]:
    """(low, high, eigenvalues between): all from the largest down to the ``wanted``-th at least. The
    lower end lies in the widest gap among as many again, but not below ``floor``."""
    d = len(t[0])
    reach = float((np.abs(t[0]) + np.append(np.abs(t[1]), 0) + np.append(0, np.abs(t[1]))[:d]).max()) * (1 + 4 * EPSILON)
    held = min(wanted, d - count_below(t, floor))
    if not held:
        return floor, reach, 0
    ranks = range(held, min(d, 2 * held) + 1)
    values = [max(floor, eigenvalue(t, k, min(0.0, -reach), reach)) for k in ranks] + ([floor] if 2 * held >= d else [])
    gaps = [(a - b) / max(a, EPSILON) for a, b in zip(values, values[1:], strict=False)]
    k = int(np.argmax(gaps)) if gaps else 0
    low = (values[k] + values[k + 1]) / 2 if gaps and gaps[k] > 0 else floor
    return low, reach * 1.0001, d - count_below(t, low)


# --- FEAST -------------------------------------------------------------------------------------------


def _filtered(spark: SparkSession, a: np.ndarray, block: np.ndarray, low: float, high: float) -> np.ndarray:
    """Quadrature of (z - A)^-1 Y along the circle around [low, high], a task for each node. By
    symmetry the nodes of the upper half circle are enough."""
    angles, weights = np.polynomial.legendre.leggauss(NODES)
    middle, radius = (low + high) / 2, (high - low) / 2

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                turn = np.exp(1j * np.pi / 2 * (1 + angles[k]))
                solved = np.linalg.solve((middle + radius * turn) * np.eye(len(a)) - a, block.astype(complex))
                part = weights[k] / 2 * radius * (turn * solved).real
                yield pa.RecordBatch.from_pydict({"node": pa.array([k], pa.int32()), "part": [part.ravel().tolist()]})

    nodes = spark.range(NODES, numPartitions=NODES)
    parts = nodes.mapInArrow(solve, "node int, part array<double>").collect()  # NODES blocks of d x columns
    return sum(np.array(r["part"]) for r in sorted(parts, key=lambda r: r["node"])).reshape(block.shape)


def feast(spark: SparkSession, a: np.ndarray, low: float, high: float, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """All ``inside`` eigenpairs of ``a`` with values in [low, high], the largest first, as
    (values, columns). The number comes from the inertia; if fewer are found, the block grows."""
    d, size = len(a), float(np.linalg.norm(a))
    draw = np.random.default_rng(0)
    columns = min(d, inside + max(4, inside // 2))
    for _ in range(GROWTHS):
        block, before = draw.standard_normal((d, columns)), np.inf
        for _ in range(ROUNDS):
            basis, _ = np.linalg.qr(_filtered(spark, a, block, low, high))
            basis, _ = np.linalg.qr(basis)  # twice, for full orthogonality
            values, turn = np.linalg.eigh(basis.T @ a @ basis)  # Rayleigh-Ritz: columns x columns
            block = basis @ turn
            held = (values >= low) & (values <= high)
            residual = float(np.linalg.norm(a @ block[:, held] - block[:, held] * values[held], axis=0).max(initial=0))
            if held.sum() == inside and (residual <= 20 * EPSILON * size or residual <= 1e-12 * size and residual > before / 2):
                order = np.flatnonzero(held)[::-1]
                return values[order], block[:, order]
            before = residual
        columns = min(d, 2 * columns)
    raise ArithmeticError(f"{int(held.sum())} of {inside} eigenvalues between {low} and {high}")


@dataclass
class Components:
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray


def components(spark: SparkSession, covariance: np.ndarray, wanted: int) -> Components:
    """The ``wanted`` largest components that have a variance at all."""
    d, total = len(covariance), float(np.trace(covariance)) if len(covariance) else 0.0
    if total <= 0:
        return Components(np.zeros(0), np.zeros((d, 0)), np.zeros(0))
    scaled = covariance / total  # eigenvalues are shares from here on
    t = tridiagonal(scaled)
    low, high, inside = interval(t, wanted, 16 * d * EPSILON)
    values, vectors = feast(spark, scaled, low, high, inside) if inside else (np.zeros(0), np.zeros((d, 0)))
    values, vectors = values[:wanted], vectors[:, :wanted]
    largest = np.abs(vectors).argmax(0) if vectors.size else np.zeros(0, int)
    vectors = vectors * np.sign(vectors[largest, np.arange(vectors.shape[1])])  # one sign for good
    return Components(values * total, vectors, values)


# --- rows --------------------------------------------------------------------------------------------


def _projected(x: DataFrame, stats: Statistics, found: Components) -> DataFrame:
    """(vec_id, deviation, w): one row per vector."""
    n, sums = stats.n, np.array(stats.sums, object)
    whole = [s // n for s in stats.sums]
    part = np.array([float(Fraction(s - n * w, n)) for s, w in zip(stats.sums, whole, strict=True)])
    whole, turn = np.array(whole, np.int64), found.vectors / np.sqrt(found.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1))
            centred = (m - whole) - part  # the first difference is exact
            w = centred @ turn
            reach = n * (int(np.abs(m - whole).max(initial=0)) + 1)
            if reach ** 2 * m.shape[1] < 2 ** 63:
                gone = n * m - sums.astype(np.int64) if n * int(np.abs(m).max(initial=0)) < 2 ** 62 else (n * m.astype(object) - sums).astype(np.int64)
                deviation = pa.array((gone * gone).sum(1))
            else:
                exact = ((n * m.astype(object) - sums) ** 2).sum(1)
                deviation = pa.array([int(v) if v < 2 ** 63 else None for v in exact], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, lists], names=["vec_id", "deviation", "w"])

    return x.mapInArrow(project, f"vec_id {x.schema['vec_id'].dataType.simpleString()}, deviation long, w array<double>")


def _identity_error(projected: DataFrame, count: int) -> float:
    pairs = list(combinations_with_replacement(range(count), 2))
    row = projected.select(*[F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, wanted: int = 8, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained,
    identity_error."""
    spark = vectors.sparkSession
    x = stored(usable(vectors, vec_id, embedding))
    stats = statistics(x)
    found = components(spark, stats.covariance, wanted)
    count = len(found.values)
    out = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not count:
        return spark.createDataFrame([], out.format(x.schema["vec_id"].dataType.simpleString()))
    projected = stored(_projected(x, stats, found))
    error = _identity_error(projected, count)
    each = F.explode(F.array(*[
        F.struct(F.lit(k + 1).alias("component"), F.get("w", F.lit(k)).alias("whitened"), F.lit(float(found.explained[k])).alias("explained")) for k in range(count)]))
    return projected.select("vec_id", "deviation", each.alias("c")).select(
        "vec_id", "c.component", F.lit(stats.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).alias("identity_error"))
