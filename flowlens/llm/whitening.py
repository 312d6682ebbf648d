"""Operator 11: whitening of embeddings by QDWH spectral divide-and-conquer on their covariance."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: x = floor(SCALE * c) + OFFSET; entries are clipped to +-LARGEST first, up to which doubles hold every integer.
SCALE, OFFSET, LARGEST = 1024, 100_000, 2**52
#: Rows that a task turns into one matrix at a time.
ROWS = 2048
#: A component whose eigenvalue is below this share of the largest (times the number of dimensions) has no variance to speak of and is left out.
FLAT = 1e-13
EPS = float(np.finfo(float).eps)


# ---------------------------------------------------------------- spectral divide-and-conquer (dims x dims, on the driver)


def polar(a: np.ndarray, steps: int = 30) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by dynamically weighted Halley iterations (QDWH), in QR form while ill-conditioned, then in Cholesky form."""
    n = len(a)
    x = a / max(np.linalg.norm(a, 1), np.finfo(float).tiny)
    try:  # 1-norms bound singular values: the largest from above, that of the inverse the smallest from below
        low = max(1.0 / float(np.linalg.norm(np.linalg.inv(x), 1)), EPS)
    except np.linalg.LinAlgError:
        low = EPS
    for _ in range(steps):
        d = np.cbrt(4.0 * (1.0 - low * low) / low**4)
        w = np.sqrt(1.0 + d)
        h = w + 0.5 * np.sqrt(8.0 - 4.0 * d + 8.0 * (2.0 - low * low) / (low * low * w))
        b = (h - 1.0) ** 2 / 4.0
        c = h + b - 1.0
        before = x
        if c > 100.0:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))
            x = (b / c) * x + (h - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        else:
            z = np.eye(n) + c * (x.T @ x)
            x = (b / c) * x + (h - b / c) * np.linalg.solve(z, x.T).T
        x = (x + x.T) / 2.0
        low = min(low * (h + b * low * low) / (1.0 + c * low * low), 1.0)
        if np.linalg.norm(x - before) <= 1e-10 * n and abs(1.0 - low) < 1e-10:
            break
    return 1.5 * x - 0.5 * x @ x @ x  # one Newton-Schulz step takes off what rounding has left


def split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces of `a` above and below a shift, from the spectral projector (sign(a - shift) + 1) / 2; None if all eigenvalues are equal.

    The first shift is the mean of the eigenvalues, which lies strictly between the smallest and the largest. If it falls onto an eigenvalue, others beside it follow.
    """
    n = len(a)
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)  # standard deviation of the eigenvalues
    if spread <= n * EPS * scale:
        return None
    noise, best = np.random.default_rng(n).standard_normal((n, n)), None
    for share in (0.0, 0.11, -0.11, 0.37, -0.37, 0.73, -0.73):
        projector = (polar(a - (mean + share * spread) * np.eye(n)) + np.eye(n)) / 2.0
        k = int(round(float(np.trace(projector))))
        if not 0 < k < n:
            continue
        q, _ = np.linalg.qr(projector @ noise[:, :k])
        q, _ = np.linalg.qr(projector @ q, mode="complete")
        above, below = q[:, :k], q[:, k:]
        left = np.linalg.norm(below.T @ a @ above)
        if best is None or left < best[0]:
            best = (left, above, below)
        if left <= 10 * n * EPS * scale:
            break
    return None if best is None else best[1:]


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a covariance, falling, and their unit eigenvectors as columns (the largest entry of each positive).

    The invariant subspace above a shift is split on until single components are left; below it only as far as k asks for.
    """
    scale = max(np.linalg.norm(v, 1), np.finfo(float).tiny)

    def within(basis: np.ndarray, wanted: int) -> list[np.ndarray]:
        if wanted <= 0:
            return []
        if basis.shape[1] == 1:
            return [basis[:, 0]]
        a = basis.T @ v @ basis
        parts = split((a + a.T) / 2.0, scale)
        if parts is None:  # equal eigenvalues: any basis will do
            return [basis[:, i] for i in range(min(wanted, basis.shape[1]))]
        above = within(basis @ parts[0], wanted)
        return above + within(basis @ parts[1], wanted - len(above))

    found = np.array(within(np.eye(len(v)), min(k, len(v)))).T.reshape(len(v), -1)
    found = found / np.linalg.norm(found, axis=0)
    values = np.einsum("ij,ij->j", found, v @ found)
    order = np.argsort(-values, kind="stable")
    found, values = found[:, order], values[order]
    heads = found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])]
    return values, found * np.where(heads < 0, -1.0, 1.0)


# ---------------------------------------------------------------- passes over the vectors


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return np.clip(np.floor(SCALE * v), -LARGEST, LARGEST).astype(np.int64) + OFFSET


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            piece = b.slice(at, ROWS)
            yield piece, _matrix(piece.column("v"), width)


def _sums(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for _, x in _pieces(batches, width):
            n += len(x)
            high = x >> 26  # two halves, so that no sum of a piece passes 64 bits
            total = total + (x - (high << 26)).sum(axis=0).astype(object) + high.sum(axis=0).astype(object) * 2**26
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)), pa.array([n] * width, pa.int64())], names=["i", "s", "n"])

    return run


def _products(width: int, mean: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, n = np.zeros((width, width)), 0
        for _, x in _pieces(batches, width):
            y = x - mean
            v += y.T @ y
            n += len(x)
        if n:
            for i in range(width):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(width, i, np.int32)), pa.array(np.arange(width, dtype=np.int32)), pa.array(v[i])], names=["i", "j", "v"])

    return run


def _exact_deviation(x: np.ndarray, n: int, total: list[int]) -> pa.Array:
    """sum (n x - S)^2 in integers; null where it passes 64 bits."""
    top = max([abs(t) for t in total], default=0) + n * int(np.abs(x).max(initial=0))
    if x.shape[1] * top * top < 2**63:
        d = x * np.int64(n) - np.array(total, np.int64)
        return pa.array((d * d).sum(axis=1))
    near = x.astype(float) - np.array([t / n for t in total])
    out = []
    for row, rough in zip(x.tolist(), (near * near).sum(axis=1) * float(n) * float(n), strict=True):
        exact = sum((n * c - t) ** 2 for c, t in zip(row, total, strict=True)) if rough < 2**64 else 2**63
        out.append(exact if exact < 2**63 else None)
    return pa.array(out, pa.int64())


def _whitened(width: int, mean: np.ndarray, weights: np.ndarray, n: int, total: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _pieces(batches, width):
            w = (x - mean) @ weights
            whole = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), w.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), _exact_deviation(x, n, total), whole], names=["vec_id", "deviation", "w"])

    return run


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) for each vector and leading component.

    Each task sums its own matrix, so that d sums and d^2 products a task are shuffled, whatever the number of rows; the d x d covariance alone comes to the
    driver, where QDWH polar decompositions of it, shifted, give spectral projectors that split invariant subspaces until single components are left
    (see `leading`). Mean and weights (d x components) go out with the tasks, which whiten their rows; the covariance of what they wrote is measured in Spark.

    Vectors that are null, empty, or hold null or non-finite entries are dropped, as are those of another length than the most frequent one (ties: the longest).
    Entries are clipped to +-2^52 / 1024. Components without variance (all vectors equal; fewer vectors than components) are left out, so that no row
    comes out where there is no variance at all. `deviation` is null where it passes 64 bits. Ties between eigenvalues: some basis of their space. Repeated rows
    count and come out each; null ids stay; extra columns are ignored; an empty table gives no row.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "whitening")
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("embedding").isNotNull() & (F.size(v) > 0) & finite)
    widths = clean.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not widths:
        return spark.createDataFrame([], schema)
    d, clean = widths[0].width, clean.where(F.size("v") == widths[0].width)
    rows = clean.mapInArrow(_sums(d), "i int, s decimal(38,0), n long").groupBy("i").agg(F.sum("s").cast("string").alias("s"), F.sum("n").alias("n")).collect()
    n, total = rows[0].n, [int(r.s) for r in sorted(rows, key=lambda r: r.i)]
    mean = np.array([t // n + (t % n) / n for t in total])
    cells = clean.mapInArrow(_products(d, mean), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    cov = np.zeros((d, d))
    cov[cells.column("i").to_numpy(), cells.column("j").to_numpy()] = cells.column("v").to_numpy() / n
    values, basis = leading((cov + cov.T) / 2.0, components)
    good = values > FLAT * d * max(float(values[0]), 0.0)
    values, basis = values[good], basis[:, good]
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    out = scratch.keep(clean.mapInArrow(_whitened(d, mean, basis / np.sqrt(values), n, total), "vec_id long, deviation long, w array<double>"))
    w = lambda i: F.get("w", F.lit(i))
    means = out.agg(*[F.avg(w(i)).alias(f"m{i}") for i in range(k)]).first()
    centred = out.select(*[(w(i) - means[i]).alias(f"c{i}") for i in range(k)])
    measured = centred.agg(*[F.avg(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"v{i}_{j}") for i in range(k) for j in range(i + 1)]).first()
    error = max(abs(measured[f"v{i}_{j}"] - (i == j)) for i in range(k) for j in range(i + 1))
    explained = F.array(*[F.lit(float(e / np.trace(cov))) for e in values])
    each = out.select("vec_id", "deviation", F.posexplode("w").alias("pos", "whitened"))
    return each.select("vec_id", (F.col("pos") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("pos")).alias("explained"), F.lit(float(error)).alias("identity_error"))
