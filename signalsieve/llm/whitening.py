"""Whitening of embeddings by the leading eigenvectors of their covariance, found by Jacobi-Davidson.

Every entry c becomes the whole number floor(256 c). The covariance is that of the distinct vectors, divisor n.
It is never formed: a product with it is one Spark job over the distinct vectors, in which each task centres
its rows and multiplies them by a block of a few directions, and Spark adds the tasks' sums.

Jacobi-Davidson on top of that product: Rayleigh-Ritz on a growing orthonormal basis; Ritz pairs whose residual
has reached double precision are locked, largest first; for each other pair of the block the correction equation,
projected on the complement of the locked and current Ritz vectors, is solved roughly by MINRES, all of them in
step so that one job serves the block. The corrections widen the basis; a full basis starts again from its best
Ritz vectors. The driver holds a few dozen vectors of one dimension's length, nothing that grows with the rows.

Defined results: rows without vector, with null or non-finite entries, or with entries of 2^31 / 256 and beyond
are left out, and so are rows whose vector is not as long as most vectors (of equally frequent lengths the
longest counts). Repeated vectors count once in the fit and are all returned, also rows without id. Only
components with an eigenvalue above rounding of the largest are returned: fewer than ``k`` where the distinct vectors
span fewer dimensions, none where all are equal or the table is empty. A deviation beyond 64 bits is null.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalsieve.llm.shared import written

STEP = 256  # whole numbers to one
LIMIT = 2**31
BLOCK = 4  # directions that are worked on beside the wanted ones' own
INNER_STEPS = 6  # MINRES steps of one correction
BASIS = 40  # vectors of the basis before it starts again
MAX_TURNS = 400
HELD_ENTRIES = 1 << 20  # entries of a matrix that a task works on at a time
PRECISION = 16 * np.finfo(float).eps  # residual over the largest eigenvalue, times the root of the length

Product = Callable[[np.ndarray], np.ndarray]


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and x, the vector of whole numbers as an array of ints; rows with unusable vectors are left out."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * STEP))
    usable = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LIMIT // STEP))
    rows = embeddings.select("vec_id", "embedding").where(F.col("embedding").isNotNull()).where(F.coalesce(usable, F.lit(False)))
    rows = rows.select("vec_id", F.transform(x, lambda v: v.cast("int")).alias("x"))
    usual = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.where(F.size("x") == (usual.length if usual else 0))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of batches and their x as matrices of bounded size; all rows are equally long."""
    for batch in batches:
        if batch.num_rows:
            step = max(HELD_ENTRIES // max(len(batch.column("x")[0]), 1), 1)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """Each x once. Copies are dropped in the tasks that read them and again behind the shuffle."""
    return written(rows.select("x").distinct(), "distinct-vectors")


@dataclass(frozen=True)
class Moments:
    """Of the distinct vectors: how many, and per dimension the sum and the sum of squares, exactly."""

    n: int
    sums: list[int]
    squares: list[int]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def trace(self) -> float:
        return float(sum(self.n * q - s * s for q, s in zip(self.squares, self.sums))) / self.n**2


def moments(distinct: DataFrame) -> Moments:
    """Exact sums: 64-bit within a batch (entries are below 2^31, squares are split in halves), decimals beyond."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, None, None
        for _, small in _slices(batches):
            x = small.astype(np.int64)
            square = x * x
            high, low = square >> 31, square & (LIMIT - 1)
            exact = (high.sum(0).astype(object) << 31) + low.sum(0).astype(object)
            total = x.sum(0).astype(object)
            n += len(x)
            sums, squares = (total, exact) if sums is None else (sums + total, squares + exact)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums), pa.int64()),
                 *(pa.array([str(int(v)) for v in c], pa.string()) for c in (sums, squares))],
                names=["j", "n", "total", "square"])

    parts = distinct.mapInArrow(run, "j int, n long, total string, square string")
    found = parts.groupBy("j").agg(
        F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("total", "square")))
    rows = found.orderBy("j").collect()  # one row a dimension
    return Moments(rows[0].n if rows else 0, [int(r.total) for r in rows], [int(r.square) for r in rows])


def covariance_product(distinct: DataFrame, moment: Moments) -> Product:
    """Directions (columns) times the covariance: sum of (x - mean) ((x - mean) . v) over n, as one job."""
    mean = moment.mean

    def product(directions: np.ndarray) -> np.ndarray:
        width = directions.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(directions.shape)
            for _, whole in _slices(batches):
                x = whole - mean
                total += x.T @ (x @ directions)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), *(pa.array(total[:, i]) for i in range(width))],
                names=["j", *(f"y{i}" for i in range(width))])

        parts = distinct.mapInArrow(run, ", ".join(["j int", *(f"y{i} double" for i in range(width))]))
        rows = parts.groupBy("j").agg(*(F.sum(f"y{i}").alias(f"y{i}") for i in range(width))).orderBy("j").collect()
        return np.array([[r[f"y{i}"] for i in range(width)] for r in rows]).reshape(directions.shape) / moment.n

    return product


def _beside(basis: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Orthonormal directions of ``vectors`` outside ``basis``; what is left of a vector by rounding alone is dropped."""
    out = basis
    for v in vectors.T:
        size = np.linalg.norm(v)
        if not size:
            continue
        v = v / size
        left = 1.0
        for _ in range(3):
            v = v - out @ (out.T @ v)
            size = np.linalg.norm(v)
            left *= size
            if left < 1e-12:
                break
            v /= size
        if left >= 1e-12:
            out = np.column_stack([out, v])
    return out[:, basis.shape[1]:]


def corrections(product: Product, ritz: np.ndarray, values: np.ndarray, known: np.ndarray, residuals: np.ndarray,
                steps: int, share: float) -> np.ndarray:
    """For each column: MINRES steps on (I - QQ')(A - value)(I - QQ') t = -residual, t beside Q = (known, ritz), until
    what is left of the right side is ``share`` of it."""
    q = _beside(np.empty((len(ritz), 0)), np.column_stack([known, ritz]))
    outside = lambda z: z - q @ (q.T @ z)
    r = outside(-residuals)
    beta = np.linalg.norm(r, axis=0)
    start = beta.copy()
    width = r.shape[1]
    v_old, v = np.zeros_like(r), r / np.where(beta > 0, beta, 1)
    w_old, w, t = np.zeros_like(r), np.zeros_like(r), np.zeros_like(r)
    eta, c_old, c, s_old, s = beta.copy(), np.ones(width), np.ones(width), np.zeros(width), np.zeros(width)
    beta = np.zeros(width)
    live = start > 0
    for _ in range(steps):
        at = np.flatnonzero(live)
        if not len(at):
            break
        image = np.zeros_like(r)
        image[:, at] = product(v[:, at])
        image = outside(image - v * values)
        alpha = np.einsum("ij,ij->j", v, image)
        image -= v * alpha + v_old * beta
        image = outside(image)
        grown = np.linalg.norm(image, axis=0)
        delta = c * alpha - c_old * s * beta
        rho1 = np.hypot(delta, grown)
        rho2 = s * alpha + c_old * c * beta
        rho3 = s_old * beta
        live &= rho1 > 0
        safe = np.where(rho1 > 0, rho1, 1)
        c_old, s_old, c, s = c, s, delta / safe, grown / safe
        w_new = (v - rho3 * w_old - rho2 * w) / safe
        t += np.where(live, c * eta, 0) * w_new
        w_old, w = w, w_new
        eta = -s * eta
        live &= (grown > 1e-14 * np.abs(values)) & (np.abs(eta) > share * start)
        v_old, v, beta = v, image / np.where(grown > 0, grown, 1), grown
    return outside(t)


def leading_pairs(product: Product, length: int, k: int, inner: int = INNER_STEPS, basis: int = BASIS) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues (falling) and their vectors (columns) of a symmetric, non-negative product."""
    k = min(k, length)
    if not k:
        return np.empty(0), np.empty((length, 0))
    width = min(k + BLOCK, length)
    basis = max(basis, 3 * width)
    at_once = min(k, length)
    # a fixed start, the same in every run
    v = _beside(np.empty((length, 0)), np.random.default_rng(7).standard_normal((length, width)))
    av = product(v)
    for turn in range(MAX_TURNS):
        small = v.T @ av
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        ritz, images = v @ vectors[:, :k], av @ vectors[:, :k]
        residuals = images - ritz * values[:k]
        bound = PRECISION * np.sqrt(length) * max(values[0], np.finfo(float).tiny)
        ready = np.linalg.norm(residuals, axis=0) <= bound
        locked = k if ready.all() else int(np.argmin(ready))  # falling from the largest, without a gap
        if locked == k:
            return values[:k], ritz
        if v.shape[1] == length:  # the basis is the whole space: only rounding is left; renew it and its images
            v = _beside(np.empty((length, 0)), v @ vectors)
            av = product(v)
            small = v.T @ av
            values, vectors = np.linalg.eigh((small + small.T) / 2)
            return values[::-1][:k], v @ vectors[:, ::-1][:, :k]
        work = np.flatnonzero(~ready)[:at_once]
        if v.shape[1] + len(work) > min(basis, length):
            keep = min(width, length)
            v, av = v @ vectors[:, :keep], av @ vectors[:, :keep]
            kept = _beside(np.empty((length, 0)), v)
            if kept.shape[1] != keep or np.abs(kept - v).max() > 1e-12:
                v = kept
                av = product(v)
        found = corrections(product, ritz[:, work], values[work], ritz[:, ready], residuals[:, work], inner, max(0.5 ** (turn + 1), 1e-8))
        new = _beside(v, found)
        if not new.shape[1]:  # the corrections lie in the basis: go on from the residuals, or from anywhere outside
            new = _beside(v, residuals[:, work])
        if not new.shape[1]:
            new = _beside(v, np.random.default_rng(v.shape[1]).standard_normal((length, 1)))
        v, av = np.column_stack([v, new]), np.column_stack([av, product(new)])
    raise RuntimeError(f"residuals {np.linalg.norm(residuals, axis=0)} after {MAX_TURNS} turns, wanted {bound}")


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: moments, eigenvalues (falling) and vectors (columns)."""

    moment: Moments
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float

    @property
    def scale(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def fit(embeddings: DataFrame, k: int = 4) -> Whitening:
    """Fits on the distinct vectors of all usable rows."""
    distinct = distinct_vectors(whole_vectors(embeddings))
    moment = moments(distinct)
    length = len(moment.sums)
    if moment.n < 2:
        return Whitening(moment, np.empty(0), np.empty((length, 0)), 0.0)
    product = covariance_product(distinct, moment)
    values, vectors = leading_pairs(product, length, k)
    real = values > length * np.finfo(float).eps * max(values[0], 0) * 16
    values, vectors = values[real], vectors[:, real]
    return Whitening(moment, values, vectors, _identity_error(distinct, moment, vectors / np.sqrt(values)))


def _identity_error(distinct: DataFrame, moment: Moments, scale: np.ndarray) -> float:
    """Largest entry of the whitened vectors' covariance less the identity, from the vectors themselves."""
    mean, width = moment.mean, scale.shape[1]
    if not width:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second, first = np.zeros((width, width)), np.zeros(width)
        for _, x in _slices(batches):
            w = (x - mean) @ scale
            second += w.T @ w
            first += w.sum(0)
        i, j = np.divmod(np.arange(width * width), width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i, np.arange(width)).astype(np.int32)),
             pa.array(np.append(j, np.full(width, -1)).astype(np.int32)),
             pa.array(np.append(second.ravel(), first))], names=["i", "j", "v"])

    sums = distinct.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    of = {(r.i, r.j): r.v / moment.n for r in sums}
    return max(abs(of[i, j] - of[i, -1] * of[j, -1] - (i == j)) for i in range(width) for j in range(width))


def _deviations(x: np.ndarray, moment: Moments) -> list[int | None]:
    """Exact sum of (n x - S)^2 a row; null beyond 64 bits."""
    n, sums = moment.n, np.array(moment.sums, object)
    reach = n * int(np.abs(x).max(initial=0)) + max(map(abs, moment.sums))
    if reach < LIMIT and reach * reach * x.shape[1] < 2**63:
        d = n * x.astype(np.int64) - sums.astype(np.int64)
        return (d * d).sum(1).tolist()
    exact = ((n * x.astype(object) - sums) ** 2).sum(1)
    return [int(v) if v < 2**63 else None for v in exact]


def transform(embeddings: DataFrame, fitted: Whitening) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row and component."""
    moment, width = fitted.moment, len(fitted.values)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    mean, scale, error = moment.mean if moment.n else None, fitted.scale, fitted.identity_error
    explained = fitted.values / moment.trace if width else fitted.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _slices(batches):
            if not width:
                continue
            rows = batch.num_rows
            every = np.repeat(np.arange(rows), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(every)),
                 pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), rows)),
                 pa.array(np.full(rows * width, moment.n, np.int64)),
                 pa.array(_deviations(x, moment), pa.int64()).take(pa.array(every)),
                 pa.array(((x - mean) @ scale).ravel()),
                 pa.array(np.tile(explained, rows)),
                 pa.array(np.full(rows * width, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    rows = whole_vectors(embeddings).withColumn("vec_id", F.col("vec_id").cast("long"))
    return rows.mapInArrow(run, schema)


def whitened(embeddings: DataFrame, k: int = 4) -> DataFrame:
    """``embeddings`` (vec_id, embedding) whitened by its own covariance."""
    return transform(embeddings, fit(embeddings, k))
