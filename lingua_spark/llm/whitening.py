"""Whitening of embeddings by incremental eigendecomposition.

The covariance is never formed from the vectors. Every task keeps the spectrum
(eigenvalues and eigenvectors of the scatter), the mean and the number of the
vectors it has seen, and takes each further vector in as one rank-one update:

1. the vector less the mean is expressed in the eigenvectors;
2. deflation sets aside directions it does not touch and merges those that
   share an eigenvalue, by one reflection per group;
3. the roots of the secular equation, found together between their poles, are
   the new eigenvalues; weights recomputed from the roots give eigenvectors
   that stay orthogonal.

Two spectra are combined by rank-one updates of the one with each eigenpair of
the other and with the difference of their means, in a tree of tasks of bounded
fan-in. The eigenvectors of all vectors are then a basis for one Rayleigh-Ritz
step: tasks sum up the products of centred, rotated vectors, and the small
matrix left on the driver is diagonalised. As the basis spans all dimensions,
this step removes what rounding the updates have gathered.

What leaves a task is a few matrices of the vectors' dimension.

Defined cases: vectors that are null, or hold null or non-finite entries, or
are not as long as most (of two lengths equally frequent, the longer) have no
part and no rows; an entry beyond ``LARGEST`` counts as that; a null key is
kept; equal rows count each; without vectors there are no rows; a component
without variance (below rounding) has null ``whitened`` and does not count in
``identity_error``; a ``deviation`` beyond a long is null. A component's sign is
that which makes its largest entry positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingua_spark.llm.common import stage

EPS = np.finfo(float).eps
#: Largest entry of a quantized vector, so that sums fit a long.
LARGEST = 1 << 40
#: Spectra that one task combines, and rows that it works on at once.
FAN_IN, ROWS = 16, 4096


def secular_roots(d: np.ndarray, z2: np.ndarray) -> np.ndarray:
    """Differences (root_i - d_j) of the roots of 1 + sum(z2 / (d - x)) = 0.

    ``d`` ascends strictly and ``z2`` is positive, so root i lies between d_i
    and d_i+1, the last within sum(z2) of its pole. Each root is sought as its
    distance from the nearer pole, by rational interpolation at the two poles
    around it (the last: below it), inside a shrinking bracket.
    """
    k = len(d)
    if k == 1:
        return z2.reshape(1, 1).copy()
    at, total = np.arange(k), z2.sum()
    width = np.append(np.diff(d), total)
    middle = d + width / 2
    value = 1 + (z2 / (d - middle[:, None])).sum(1)
    right = (value < 0) & (at < k - 1)
    origin = at + right
    gaps = d - d[origin][:, None]
    half = width / 2
    low = np.where(right, -half, np.where(value < 0, half, 0.0))
    high = np.where(right, 0.0, np.where(value < 0, width, half))
    x = (low + high) / 2
    one = np.minimum(at, k - 2)
    left_side = (at[None, :] <= one[:, None]).astype(float)
    last = at == k - 1
    sign = np.where(last, 1.0, -1.0)
    settled = np.zeros(k, bool)
    for _ in range(80):
        apart = gaps - x[:, None]
        with np.errstate(all="ignore"):
            inverse = 1 / apart
            slopes = inverse * inverse
            value = 1 + inverse @ z2
            slope, psi = slopes @ z2, (slopes * left_side) @ z2
            low, high = np.where(value <= 0, x, low), np.where(value > 0, x, high)
            p, q = apart[at, one], apart[at, one + 1]
            c = value - p * psi - q * (slope - psi)
            a = (p + q) * value - p * q * slope
            b = p * q * value
            root = sign * np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a * sign >= 0, (a + root) / (2 * c), 2 * b / (a - root))
            new = x + step
        tiny = np.abs(step) <= 1e-6 * np.abs(x)
        new = np.where(tiny | ((new > low) & (new < high)), new, (low + high) / 2)
        x = np.where(settled, x, new)
        # near the root a step leaves the cube of its own size or so
        settled |= tiny
        if settled.all():
            break
    return x[:, None] - gaps


class Spectrum:
    """Eigenvalues (ascending) and eigenvectors of a scatter, with its mean."""

    def __init__(self, dim: int):
        self.count, self.mean = 0, np.zeros(dim)
        self.values, self.vectors = np.zeros(dim), np.eye(dim)

    def update(self, weight: float, direction: np.ndarray) -> None:
        """Add ``weight`` times the outer product of ``direction``."""
        z = self.vectors.T @ direction * np.sqrt(weight)
        d, q = self.values, self.vectors
        norm = np.sqrt(z @ z)
        if norm == 0:
            return
        tiny = 8 * EPS * max(abs(d[-1]), norm * norm)
        # directions with one eigenvalue: a reflection leaves one that is touched
        starts = np.flatnonzero(np.append(True, np.diff(d) > tiny))
        if len(starts) < len(d):
            q = q.copy()
            for a, b in zip(starts, np.append(starts[1:], len(d))):
                length = np.sqrt(z[a:b] @ z[a:b])
                if b - a > 1 and length * norm > tiny:
                    h = z[a:b].copy()
                    h[-1] += length if h[-1] >= 0 else -length
                    q[:, a:b] -= np.outer(q[:, a:b] @ h, h * (2 / (h @ h)))
                    z[b - 1] = -length if z[b - 1] >= 0 else length
                    z[a : b - 1] = 0
        live = np.flatnonzero(np.abs(z) * norm > tiny)
        if not len(live):
            return
        poles, z2 = d[live], z[live] ** 2
        apart = secular_roots(poles, z2)  # root i less pole j
        k = len(live)
        new = poles[np.arange(k)] + np.diagonal(apart)
        if k == 1:
            values, vectors = new, q[:, live]
        else:
            # weights for which the roots are exact: a product of quotients near 1
            i, j = np.arange(k - 1)[:, None], np.arange(k)[None, :]
            below = np.where(i < j, poles[i], poles[i + 1])
            with np.errstate(all="ignore"):
                quotients = apart[:-1] / (below - poles[j])
            exact = np.sqrt(np.abs(quotients.prod(0) * apart[-1]))
            exact = np.copysign(exact, z[live])
            turned = exact[None, :] / -apart
            turned /= np.sqrt((turned**2).sum(1))[:, None]
            values, vectors = new, q[:, live] @ turned.T
        if k < len(d):
            rest = np.setdiff1d(np.arange(len(d)), live)
            values, vectors = np.append(d[rest], values), np.hstack([q[:, rest], vectors])
            order = np.argsort(values, kind="stable")
            values, vectors = values[order], vectors[:, order]
        self.values, self.vectors = values, vectors

    def add(self, row: np.ndarray) -> None:
        """One more vector."""
        away = row - self.mean
        self.count += 1
        if self.count > 1:
            self.update((self.count - 1) / self.count, away)
        self.mean = self.mean + away / self.count

    def combine(self, other: Spectrum) -> None:
        """All vectors of another spectrum."""
        if not other.count:
            return
        away, n = other.mean - self.mean, self.count + other.count
        if self.count:
            self.update(self.count * other.count / n, away)
        for value, direction in zip(other.values, other.vectors.T):
            if value > 0:
                self.update(value, direction)
        self.mean, self.count = self.mean + away * (other.count / n), n

    def pack(self) -> bytes:
        return np.concatenate([[float(self.count)], self.mean, self.values, self.vectors.ravel()]).tobytes()

    @classmethod
    def unpack(cls, raw: bytes, dim: int) -> Spectrum:
        held = np.frombuffer(raw)
        out = cls(dim)
        out.count, out.mean = int(held[0]), held[1 : dim + 1].copy()
        out.values, out.vectors = held[dim + 1 : 2 * dim + 1].copy(), held[2 * dim + 1 :].reshape(dim, dim).copy()
        return out


def gather(parts: DataFrame, combine: Callable[[list[bytes]], bytes], label: str) -> bytes | None:
    """One binary of a column ``raw``, combined ``FAN_IN`` at a time by tasks;
    the driver combines the last few."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                held.append(raw)
                if len(held) == FAN_IN:
                    held = [combine(held)]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([combine(held)], pa.binary())], names=["raw"])

    parts = stage(parts, label)
    while (n := parts.count()) > FAN_IN:
        parts = stage(parts.repartition(-(-n // FAN_IN)).mapInArrow(fold, "raw binary"), label)
    rows = [r["raw"] for r in parts.collect()]
    return combine([bytes(r) for r in rows]) if rows else None


def add_up(parts: list[bytes]) -> bytes:
    return sum(np.frombuffer(p) for p in parts).tobytes()


def matrices(batch: pa.RecordBatch, dim: int, scale: float) -> Iterator[tuple[int, np.ndarray]]:
    """Quantized vectors of a batch as blocks of integers, with their place."""
    column = batch.column("vector")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    rows = flat.reshape(-1, dim)
    for at in range(0, len(rows), ROWS):
        found = np.clip(np.floor(scale * rows[at : at + ROWS]), -LARGEST, LARGEST)
        yield at, found.astype(np.int64)


def usable(vector: str, dim: int | None = None) -> Column:
    """Whether a vector is there, of that length, and all finite."""
    entries = F.col(vector)
    fine = entries.isNotNull() & ~F.exists(
        entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    )
    return fine & (F.size(entries) == dim if dim is not None else F.size(entries) > 0)


def usual_length(df: DataFrame, vector: str) -> int | None:
    """The most frequent length of the usable vectors."""
    lengths = df.filter(usable(vector)).groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias("n"))
    row = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    return row["dim"] if row else None


def whiten(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8, scale: float = 1024
) -> DataFrame:
    """A row per vector and component: ``key``, ``component``, ``n``,
    ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Vectors are quantized to floor(scale * entry) before anything else; a
    constant added to all entries would change none of the results.
    """
    kind = dict(df.dtypes)[key]
    schema = f"key {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    dim = usual_length(df, vector)
    if dim is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    rows = df.filter(usable(vector, dim)).select(F.col(key).alias("key"), F.col(vector).alias("vector"))

    def spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sums = Spectrum(dim), np.zeros(dim, object)
        for batch in batches:
            for _, block in matrices(batch, dim, scale):
                sums += block.sum(0).astype(object)
                for row in block.astype(float):
                    seen.add(row)
        if seen.count:
            raw = [pa.array([seen.pack()], pa.binary()), pa.array([list(map(str, sums))], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(raw, names=["raw", "sums"])

    def combined(parts: list[bytes]) -> bytes:
        first, *rest = (Spectrum.unpack(p, dim) for p in parts)
        for other in rest:
            first.combine(other)
        return first.pack()

    parts = stage(rows.select("vector").mapInArrow(spectra, "raw binary, sums array<string>"), "spectra")
    spectrum = Spectrum.unpack(gather(parts.select("raw"), combined, "spectra"), dim)
    exact = parts.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = np.array([int(r["s"]) for r in exact.orderBy("at").collect()], object)
    n = spectrum.count
    basis, _ = np.linalg.qr(spectrum.vectors)

    def centred(block: np.ndarray) -> np.ndarray:
        """(n * x - S) / n, whole numbers before the division where they fit."""
        if n * (np.abs(block).max(initial=0) + 1) < 1 << 61:
            return (n * block - sums.astype(np.int64)).astype(float) / n
        return np.array((n * block.astype(object) - sums) / n, float)

    def products(project: np.ndarray):
        def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, some = np.zeros((project.shape[1],) * 2), False
            for batch in batches:
                for _, block in matrices(batch, dim, scale):
                    turned = centred(block) @ project
                    total, some = total + turned.T @ turned, True
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["raw"])

        found = gather(rows.select("vector").mapInArrow(sum_up, "raw binary"), add_up, "products")
        return np.frombuffer(found).reshape(project.shape[1], -1) / n

    values, turned = np.linalg.eigh(products(basis))
    values, axes = values[::-1], (basis @ turned)[:, ::-1]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(dim)])
    trace = values.sum()
    kept = min(components, dim)
    real = int((values[:kept] > dim * EPS * max(trace, 0) * 4).sum())  # the others have no variance
    project = axes[:, :real] / np.sqrt(values[:real])
    error = float(np.abs(products(project) - np.eye(real)).max()) if real else None
    explained = [float(v / trace) if trace > 0 else None for v in values[:kept]]

    def project_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in matrices(batch, dim, scale):
                keys = batch.column("key").slice(at, len(block))
                out = np.full((len(block), kept), np.nan)
                out[:, :real] = centred(block) @ project
                away, mask = deviations(block, n, sums)
                m = len(block) * kept
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(np.repeat(np.arange(len(block)), kept))),
                        pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(block))),
                        pa.array(np.full(m, n, np.int64)),
                        pa.array(np.repeat(away, kept), mask=np.repeat(mask, kept)),
                        pa.array(out.ravel(), mask=np.isnan(out.ravel())),
                        pa.array(explained * len(block), pa.float64()),
                        pa.array([error] * m, pa.float64()),
                    ],
                    names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project_rows, schema).withColumnRenamed("key", key)


def deviations(block: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the entries of (n * x - S) squared, and which exceed a long."""
    dim = block.shape[1]
    if n * (int(np.abs(block).max(initial=0)) + 1) * 2 < int((2.0**63 / dim) ** 0.5):
        away = n * block - sums.astype(np.int64)
        return (away * away).sum(1), np.zeros(len(block), bool)
    away = n * block.astype(object) - sums
    rough = (np.array(away, float) ** 2).sum(1)
    if rough.max(initial=0) < 2.0**62:  # small after all, as S takes the common part away
        small = away.astype(np.int64)
        return (small * small).sum(1), np.zeros(len(block), bool)
    total = [int(t) for t in (away * away).sum(1)]
    too_large = np.array([t >= 1 << 63 for t in total])
    return np.array([0 if big else t for t, big in zip(total, too_large)], np.int64), too_large


__all__ = ["Spectrum", "secular_roots", "whiten"]
