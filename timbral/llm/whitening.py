"""Whitening of embeddings: principal components by TSQR and a one-sided Jacobi SVD.

A vector's entries c become integers floor(64 * c) + 1000000, so that counts and
sums are exact.  Every task centres its rows, reduces them block by block to a
triangle R (as many columns as the vectors have entries), and triangles are
stacked and reduced again until one is left: R'R is n times the covariance,
though it is never formed.  Plane rotations make R's columns orthogonal; their
lengths are the standard deviations (times the root of n), and the rotations,
multiplied up, are the components.  Columns of very different length keep their
relative accuracy, which an eigensolver on the covariance would lose.

What tasks hand on has the size of a triangle, whatever their number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How an entry becomes an integer.
SCALE, SHIFT = 64.0, 1_000_000
#: Rows that a task reduces at a time.
BLOCK = 4096
#: Triangles that one task of a level stacks.
FAN_IN = 64
#: Components kept.
MOST = 32
#: A direction whose variance is below this share of the largest one is rounding, not a component.
RANK = 1e-20
_PART = "part long, n long, payload binary"


def _vectors(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The batch's vectors of this width without null or non-finite entries, as integers, and their row numbers."""
    column = batch.column("embedding").cast(pa.list_(pa.float64()))
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == width)
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    whole = np.isfinite(values).all(axis=1)  # a null entry arrives as NaN
    return np.floor(values[whole] * SCALE).astype(np.int64) + SHIFT, rows[whole]


def _partial(width: int, start: Callable[[], np.ndarray], add: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable:
    """For mapInArrow: one row for a task, its number of vectors and what add() has made of all its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, state = 0, start()
        for batch in batches:
            x, _ = _vectors(batch, width)
            n += len(x)
            for a in range(0, len(x), BLOCK):
                state = add(state, x[a : a + BLOCK])
        if n:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [n], "payload": [state.tobytes()]})

    return run


def _combined(parts: DataFrame, kind: str, join: Callable[[list[np.ndarray]], np.ndarray]) -> tuple[int, np.ndarray | None]:
    """The number of vectors and all tasks' payloads as one: FAN_IN at a time, in three levels, the last of which is read here."""

    def level(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table
        table = table.sort_by("part")  # the same order in each run
        payload = join([np.frombuffer(p, kind) for p in table.column("payload").to_pylist()])
        part = table.column("part")[0].as_py() // FAN_IN
        return pa.table({"part": [part], "n": [sum(table.column("n").to_pylist())], "payload": [payload.tobytes()]})

    for _ in range(3):
        parts = parts.groupBy(F.expr(f"part div {FAN_IN}")).applyInArrow(level, _PART)
    found = level(parts.toArrow())  # a row for each FAN_IN ** 3 tasks
    if not found.num_rows:
        return 0, None
    return found.column("n")[0].as_py(), np.frombuffer(found.column("payload")[0].as_py(), kind)


def common_width(vectors: DataFrame) -> int:
    """The length that most vectors have, the larger of two as frequent; 0 if there are none."""
    lengths = vectors.where("size(embedding) > 0").groupBy(F.size("embedding").alias("width")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("width")).first()
    return int(most["width"]) if most else 0


def sums(vectors: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Number of whole vectors and the exact sum of each dimension's integers."""
    parts = vectors.select("embedding").mapInArrow(_partial(width, lambda: np.zeros(width, np.int64), lambda s, x: s + x.sum(axis=0)), _PART)
    n, total = _combined(parts, "<i8", lambda found: np.sum(found, axis=0))
    return n, np.zeros(width, np.int64) if total is None else total


def _centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x - S / n, of which the integer part is taken off exactly before anything is rounded."""
    whole, rest = total // n, total % n
    return (x - whole) - rest / n


def triangle(vectors: DataFrame, width: int, n: int, total: np.ndarray) -> np.ndarray:
    """R of the centred vectors' QR decomposition."""
    reduce = lambda rows: np.linalg.qr(rows, mode="r")
    add = lambda r, x: reduce(np.concatenate([r, _centred(x, n, total)]))
    parts = vectors.select("embedding").mapInArrow(_partial(width, lambda: np.zeros((0, width)), add), _PART)
    _, r = _combined(parts, "<f8", lambda found: reduce(np.concatenate([f.reshape(-1, width) for f in found])))
    return (np.zeros((0, width)) if r is None else r).reshape(-1, width)


def _rounds(width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of columns once, in rounds of pairs that have no column in common (one column stays, the others move on)."""
    ring = list(range(width + width % 2))
    out = []
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1], strict=True) if max(a, b) < width]
        out.append((np.array([min(p) for p in pairs], np.int64), np.array([max(p) for p in pairs], np.int64)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def one_sided_jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and the right vectors as columns, of which the entry of largest size is positive."""
    a, width = np.array(r, np.float64), r.shape[1]
    turned = np.eye(width)
    size = np.abs(a).max(initial=0.0)
    a = a / size if size else a
    rounds = _rounds(width)
    for _ in range(sweeps):
        off = 0.0
        for i, j in rounds:
            p, q = a[:, i], a[:, j]
            pp, qq, pq = (p * p).sum(axis=0), (q * q).sum(axis=0), (p * q).sum(axis=0)
            norm = np.sqrt(pp * qq)
            cosine = np.divide(np.abs(pq), norm, out=np.zeros_like(pq), where=norm > 0)
            off = max(off, cosine.max(initial=0.0))
            turn = cosine > 1e-16
            zeta = np.divide(qq - pp, 2 * pq, out=np.zeros_like(pq), where=turn)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            c = np.where(turn, 1 / np.sqrt(1 + t * t), 1.0)
            s = np.where(turn, c * t, 0.0)
            a[:, i], a[:, j] = c * p - s * q, s * p + c * q
            p, q = turned[:, i], turned[:, j]
            turned[:, i], turned[:, j] = c * p - s * q, s * p + c * q
        if off <= 4e-15:
            break
    lengths = np.sqrt((a * a).sum(axis=0)) * size
    order = np.argsort(-lengths, kind="stable")
    turned = turned[:, order]
    heads = turned[np.abs(turned).argmax(axis=0), np.arange(width)] if width else np.zeros(0)
    return lengths[order], turned * np.where(heads < 0, -1.0, 1.0)


def identity_error(vectors: DataFrame, width: int, n: int, total: np.ndarray, matrix: np.ndarray) -> float:
    """Largest entry, by size, of the covariance of the whitened vectors minus the identity: measured over all rows."""
    k = matrix.shape[1]

    def add(state: np.ndarray, x: np.ndarray) -> np.ndarray:
        w = _centred(x, n, total) @ matrix
        return state + np.concatenate([w.sum(axis=0)[None, :], w.T @ w])

    parts = vectors.select("embedding").mapInArrow(_partial(width, lambda: np.zeros((k + 1, k)), add), _PART)
    _, found = _combined(parts, "<f8", lambda found: np.sum(found, axis=0))
    state = found.reshape(k + 1, k) / n
    return float(np.abs(state[1:] - np.outer(state[0], state[0]) - np.eye(k)).max())


def _deviation(x: np.ndarray, n: int, total: np.ndarray) -> list[int]:
    """Sum over dimensions of (n * x - S) ** 2, in integers of any size where 64 bits might not do."""
    away = np.abs(x * n - total).max(initial=0) if n < 1 << 40 else 1 << 62
    if int(away) ** 2 * x.shape[1] < 1 << 62:
        d = x * n - total
        return (d * d).sum(axis=1).tolist()
    return [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, total, strict=True)) for row in x]


def whiten(vectors: DataFrame, most: int = MOST) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    vectors: vec_id, embedding; other columns, also of these names, are left
    aside.  A vector that is null, empty, or holds a null or non-finite entry is
    dropped, as is one of another length than most have: they can't share a
    covariance.  A null or repeated vec_id is kept, repeated rows count as often
    as they occur.  Directions without variance (constant dimensions, fewer rows
    than dimensions, a single row) have no whitened value, so they have no rows;
    an empty table gives none.  Of equal eigenvalues any orthonormal pair is
    right.  A deviation beyond 64 bits is an error of the job, not a wrong number.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    width = common_width(given)
    n, total = sums(given, width) if width else (0, np.zeros(0))
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    lengths, components = one_sided_jacobi(triangle(given, width, n, total))
    variance = lengths**2 / n
    kept = [k for k in range(min(most, width)) if variance[k] > RANK * variance[0]]
    if not kept:
        return vectors.sparkSession.createDataFrame([], schema)
    matrix = components[:, kept] / np.sqrt(variance[kept])
    explained = variance[kept] / variance.sum()
    error = identity_error(given, width, n, total, matrix)
    names = [part.split()[0] for part in schema.split(", ")]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(kept)
        for batch in batches:
            x, rows = _vectors(batch, width)
            for a in range(0, len(x), BLOCK):
                part, ids = x[a : a + BLOCK], batch.column("vec_id").take(pa.array(rows[a : a + BLOCK]))
                m = len(part)
                w = _centred(part, n, total) @ matrix
                columns = [
                    ids.take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    pa.array(_deviation(part, n, total), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(w.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return given.mapInArrow(project, schema)
