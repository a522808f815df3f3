"""Whitening of embeddings by a one-sided Jacobi SVD.

Entries are put on a whole-number grid, so that counts and sums are exact. The
fit list is each distinct vector once. Every task centres its rows of that
list, n * x - S in whole numbers and then divided by n, and compresses them
block by block to a triangle R (TSQR); triangles are stacked and compressed
again, ``FAN_IN`` at a time, until few are left for the driver. Plane rotations
make the columns of the last R orthogonal: their lengths are the standard
deviations times the root of n, small ones as accurate as large ones since no
product of the matrix with itself is ever formed, and the accumulated rotations
are the components.

Only packed vectors are shuffled, once, to find distinct ones; copies are
dropped before that. The driver gets a row for each dimension and a few
triangles.

Defined results: rows whose vector is null, empty, or holds null, NaN or
infinite entries are left out, and so are those of another length than the most
frequent one (of equally frequent ones the longest), for one matrix has one
width; entries beyond the grid's whole numbers (about 10^16) are held at its
end; repeated rows are given each, and count once in the fit; a component
without variance has null in place of a whitened value, and so has a fit of one
vector; ``deviation`` is null where it doesn't fit a long; components of equal
variance come in any order, the same for all rows; an empty table gives no row;
other columns pass through, but for those that a new one replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm.storage import Scratch, as_struct, extended, quoted, without

# The grid of whole numbers.
SCALE, SHIFT = 64, 1_000_000
_END = 1 << 60

#: Rows that are compressed at once, and triangles that one task stacks.
BLOCK_ROWS, FAN_IN = 4096, 32
#: Sweeps of rotations at most; six to ten make all columns orthogonal to the last bits.
MOST_SWEEPS = 60


@dataclass(frozen=True)
class Whitening:
    """What a fit knows: n and S of the fit list, components as columns, their variances, and the trace of all."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def width(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n of rows on the grid: the difference is exact, in whole numbers, before it is divided."""
        return self.offsets(x).astype(np.float64) / self.n

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, in Python's numbers where longs are too short."""
        most = max(int(np.abs(x).max(initial=0)), int(max(map(abs, self.sums.tolist()), default=0)) // self.n + 1)
        if most * self.n >= 1 << 62:
            return x.astype(object) * self.n - self.sums
        return x * self.n - self.sums.astype(np.int64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            scaled = self.centred(x) @ self.components / np.sqrt(self.variances)
        scaled[:, self.variances == 0] = np.nan
        return scaled

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of the squared offsets, exact."""
        d = self.offsets(x)
        if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * self.width < 1 << 63:
            return (d * d).sum(1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in d]
        return [v if v < 1 << 63 else None for v in exact]


def grid(vectors: np.ndarray) -> np.ndarray:
    """floor(64 * c) + 1,000,000 of finite numbers."""
    return np.clip(np.floor(SCALE * vectors.astype(np.float64)), -_END, _END).astype(np.int64) + SHIFT


def usable(column: pa.ListArray, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(whether a row can be used, the usable rows as a matrix). Without width: usable ones of any length, and no matrix."""
    lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
    values = column.flatten()
    numbers = np.asarray(values.cast(pa.float64()).fill_null(np.nan), np.float64)
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(numbers))])
    ends = np.cumsum(lengths)
    fine = (lengths > 0) & (wrong[ends] == wrong[ends - lengths])
    if width is None:
        return fine, np.empty((0, 0))
    fine &= lengths == width
    return fine, numbers[np.repeat(fine, lengths)].reshape(-1, max(width, 1))


def rotated(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths of the orthogonal columns that plane rotations make of r's, descending; the accumulated rotations).

    A round rotates disjoint pairs of columns at once; rounds meet all pairs once in a sweep.
    """
    a, v = r.astype(np.float64).copy(), np.eye(r.shape[1])
    d = a.shape[1]
    seats = list(range(d)) + [-1] * (d % 2)
    tiny = np.finfo(float).eps
    floor = (np.linalg.norm(a) * tiny) ** 2  # of columns that are nothing but rounding
    for _ in range(MOST_SWEEPS if d > 1 else 0):
        off = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(p, q) for p, q in zip(seats[:half], seats[: half - 1 : -1], strict=True) if p >= 0 and q >= 0]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            p, q = (np.array(x) for x in zip(*pairs, strict=True))
            alpha, beta, gamma = (np.einsum("ij,ij->j", a[:, x], a[:, y]) for x, y in ((p, p), (q, q), (p, q)))
            both = np.sqrt(alpha * beta)
            turn = (np.abs(gamma) > tiny * both) & (np.minimum(alpha, beta) > floor * tiny)
            if not turn.any():
                continue
            p, q, alpha, beta, gamma = p[turn], q[turn], alpha[turn], beta[turn], gamma[turn]
            off = max(off, float((np.abs(gamma) / both[turn]).max()))
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (a, v):
                left, right = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
        if off <= 4 * d * tiny:
            break
    lengths = np.linalg.norm(a, axis=0)
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:, order]


def _compressed(blocks: Iterator[np.ndarray], width: int) -> np.ndarray | None:
    """R of all blocks, one under the other."""
    r = None
    for block in blocks:
        r = np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")
    return r


def _triangle(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    for value in column:
        yield np.frombuffer(value.as_buffer(), "<f8").reshape(-1, width)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """Packed vectors as a matrix on the grid."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, width)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    held, n = [], 0
    for batch in batches:
        for at in range(0, len(batch), BLOCK_ROWS):
            held.append(_rows(batch.column(0).slice(at, BLOCK_ROWS), width))
            n += len(held[-1])
            if n >= BLOCK_ROWS:
                yield np.vstack(held)
                held, n = [], 0
    if n:
        yield np.vstack(held)


def fit(df: DataFrame, vector: str = "embedding", most_components: int = 16) -> Whitening:
    """Components of the distinct vectors' covariance (divisor n), the first ``most_components`` of them."""
    scratch = Scratch(df.sparkSession, "whitening")
    bare = df.select(F.col(quoted(vector)).alias("v"))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine, _ = usable(batch.column(0), None)
            size = np.asarray(batch.column(0).value_lengths().fill_null(0), np.int64)[fine]
            values, counts = np.unique(size, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64))], names=["width", "n"])

    widths = bare.mapInArrow(lengths, "width long, n long").groupBy("width").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    if not widths:
        return Whitening(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0)
    width = widths[0][0]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, found = usable(batch.column(0), width)
            x = np.unique(grid(found), axis=0).astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in x], pa.binary())], names=["x"])

    listed = scratch.put(bare.mapInArrow(packed, "x binary").distinct(), "listed")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for block in _blocks(batches, width):
            n += len(block)  # two halves of the numbers, so that no sum overflows
            high, low = high + (block >> 32).sum(0), low + (block & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(high), pa.array(low), pa.array(np.full(width, n))], names=["k", "high", "low", "n"])

    totals = listed.mapInArrow(summed, "k int, high long, low long, n long").groupBy("k").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n"))).collect()
    totals.sort(key=lambda r: r.k)
    n, sums = int(totals[0].n), np.array([(int(r.high) << 32) + int(r.low) for r in totals], dtype=object)
    model = Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0)

    def triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _compressed((model.centred(b) for b in _blocks(batches, width)), width)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.astype("<f8").tobytes()], pa.binary())], names=["r"])

    def stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _compressed((t for b in batches for t in _triangle(b.column(0), width)), width)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.astype("<f8").tobytes()], pa.binary())], names=["r"])

    level = scratch.put(listed.mapInArrow(triangles, "r binary"), "triangles")
    while (left := level.count()) > FAN_IN:
        level = scratch.put(level.repartition(-(-left // FAN_IN)).mapInArrow(stacked, "r binary"), "triangles")
    r = _compressed((np.frombuffer(x[0], "<f8").reshape(-1, width) for x in level.collect()), width)
    lengths, turns = rotated(r)
    variances = lengths**2 / n
    variances[lengths <= lengths.max(initial=0) * width * np.finfo(float).eps] = 0.0  # rounding, not variance
    kept = min(most_components, width)
    model = Whitening(n, sums, turns[:, :kept], variances[:kept], float(variances.sum()))
    error = _identity_error(listed, model)
    scratch.drop(listed)
    return Whitening(n, sums, model.components, model.variances, model.trace, error)


def _identity_error(listed: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list less the identity, over components with variance; None without one."""
    live = np.flatnonzero(model.variances > 0)
    if not len(live):
        return None
    k = len(live)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each task the mean of its rows, and the sum of products of what is left without it."""
        n, mean, second = 0, np.zeros(k), np.zeros((k, k))
        for block in _blocks(batches, model.width):
            n, mean, second = _joined((n, mean, second), _moments(model.whitened(block)[:, live]))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()]), pa.array([second.ravel().tolist()])], names=["n", "mean", "second"])

    found = listed.mapInArrow(moments, "n long, mean array<double>, second array<double>")
    total = (0, np.zeros(k), np.zeros((k, k)))
    for row in found.toLocalIterator():  # 17 * 16 numbers a task
        total = _joined(total, (row.n, np.array(row.mean), np.array(row.second).reshape(k, k)))
    return float(np.abs(total[2] / total[0] - np.eye(k)).max())


_Moments = tuple[int, np.ndarray, np.ndarray]


def _moments(rows: np.ndarray) -> _Moments:
    mean = rows.mean(0)
    left = rows - mean
    return len(rows), mean, left.T @ left


def _joined(a: _Moments, b: _Moments) -> _Moments:
    n = a[0] + b[0]
    if not n:
        return a
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """The rows that can be used, with ``whitened`` (a number for each component, null without variance) and ``deviation``."""
    new = ["whitened", "deviation"]
    kept = without(df, new)
    rows = df.select(as_struct(df.select(*(F.col(quoted(c)) for c in kept))), F.col(quoted(vector)).alias("v"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            fine, found = usable(batch.column("v"), m.width)
            if not m.width or not fine.any():
                continue
            x = grid(found)
            w = m.whitened(x)
            values = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column("__row").filter(pa.array(fine)), arrays, pa.array(m.deviations(x), pa.int64())], names=["__row", *new])

    schema = extended(rows.select("__row").schema, "whitened array<double>, deviation long")
    return rows.mapInArrow(run, schema).select(*(F.col(f"__row.{quoted(c)}").alias(c) for c in kept), *new)


def components(df: DataFrame, model: Whitening) -> DataFrame:
    """A row for each row of ``whiten`` and component: its columns but for the vectors, component, n, whitened, explained and identity_error."""
    numbers = df.sparkSession.createDataFrame([(k, float(v / model.trace) if model.trace else None) for k, v in enumerate(model.variances.tolist())], "__k int, explained double")
    taken = ["component", "n", "whitened", "explained", "identity_error"]
    others = [F.col(quoted(c)) for c in without(df, taken)]
    each = df.select(*others, F.posexplode("whitened").alias("__k", "whitened"))
    error = F.lit(model.identity_error).cast("double")
    return each.join(F.broadcast(numbers), "__k").select(*others, (F.col("__k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "whitened", "explained", error.alias("identity_error"))
