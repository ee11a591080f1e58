"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance is never formed. A block of directions Q is improved by passes over the stored vectors, each
of which centres the vectors and adds up XᵀXQ; a Chebyshev recurrence of such passes damps everything below
the block's smallest Ritz value, then QR and a Rayleigh-Ritz step follow, until every wanted pair has a
residual that is zero to double precision. A round that gains less than a digit doubles the block, and a block of
all dimensions is exact, so the iteration ends.

What reaches the driver is one row per dimension, never one per vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendgrid.llm.common import keep

SCALE, SHIFT = 1024, 100_000  # fixed values: an entry c becomes floor(1024 * c) + 100000
TOLERANCE = 1e-13  # residual of a certified pair, as a share of the largest eigenvalue
DEGREE = 8  # passes of one filter


@dataclass(frozen=True)
class Basis:
    """The components as columns of ``vectors``, largest eigenvalue first."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray  # of each pair, as a share of the largest eigenvalue


def whole_vectors(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x`` (longs) of every usable vector, stored.

    Left out are vectors that are null, empty or hold null or non-finite entries, and those whose length
    isn't the most frequent one (of equally frequent ones the largest). A repeated row counts as often as it
    stands there. An entry beyond 2^53 / 1024 has no exact long and stops the job.
    """
    # An entry less itself is 0 for finite numbers alone.
    finite = F.forall(column, lambda c: F.coalesce(c.cast("double") - c.cast("double") == 0, F.lit(False)))
    usable = embeddings.where(F.col(column).isNotNull() & (F.size(column) > 0) & finite)
    wide = usable.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    entry = lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + SHIFT
    refused = F.raise_error(F.lit("entry out of range for whitening")).cast("bigint")
    rows = usable.where(F.size(column) == (wide["d"] if wide else 0)).select(
        F.col("vec_id"),
        F.transform(
            column, lambda c: F.when(F.abs(c.cast("double")) <= 2.0**43, entry(c)).otherwise(refused)
        ).alias("x"),
    )
    return keep(rows, "vectors")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n with one rounding: the whole part of S/n is subtracted in longs."""
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([(s % n) / n for s in sums])
    return (x - whole) - part


def _pass(vectors: DataFrame, add: Callable[[np.ndarray], np.ndarray], d: int, m: int) -> np.ndarray:
    """Sum of a d x m matrix over all vectors: one matrix a task, added up by Spark element by element."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, m))
        for batch in batches:
            if len(batch):
                total += add(_matrix(batch))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(d), pa.int32()), *[pa.array(total[:, j]) for j in range(m)]],
            ["i", *[f"y{j}" for j in range(m)]],
        )

    schema = "i int, " + ", ".join(f"y{j} double" for j in range(m))
    rows = vectors.mapInArrow(partial, schema).groupBy("i").agg(*[F.sum(f"y{j}").alias(f"y{j}") for j in range(m)])
    found = np.zeros((d, m))
    for row in rows.collect():
        found[row["i"]] = row[1:]
    return found


def _totals(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums per dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if len(batch):
                n, x = n + len(batch), _matrix(batch).sum(axis=0)
                total = x if total is None else total + x
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total)), pa.int32()), pa.array(total), pa.array([n] * len(total), pa.int64())],
                ["i", "s", "n"],
            )

    rows = vectors.mapInArrow(partial, "i int, s long, n long").groupBy("i").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")
    )
    found = sorted(rows.collect(), key=lambda r: r["i"])
    return (found[0]["n"] if found else 0), [int(r["s"]) for r in found]


def filtered(
    apply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, y: np.ndarray, top: float, low: float, degree: int
) -> np.ndarray:
    """The Chebyshev polynomial of ``degree``, small on [0, ``low``] and scaled to 1 at ``top``, applied to q
    by its three-term recurrence; ``y`` is ``apply(q)`` already."""
    half = low / 2
    scale = half / (top - half)
    first = scale
    last, now = q, (y - half * q) * (scale / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - scale)
        last, now = now, (apply(now) - half * now) * (2 * following / half) - scale * following * last
        scale = following
    return now


def subspace(
    apply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, block: int | None = None, seed: int = 20240611
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, vectors, residuals) of the ``wanted`` largest eigenpairs of a positive semidefinite operator.

    ``apply`` maps a d x m block to its image, which is all that is known of the operator. The start is a
    fixed random block, in general position to every eigenvector with probability one.
    """
    rng = np.random.default_rng(seed)
    m = min(d, block or 2 * wanted + 8)
    q = np.linalg.qr(rng.standard_normal((d, m)))[0]
    y = apply(q)
    before = np.inf
    while True:
        small = q.T @ y
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        q, y = q @ turn, y @ turn
        top = max(float(theta[0]), 0.0)
        if not top:
            return np.zeros(0), np.zeros((d, 0)), np.zeros(0)
        residuals = np.linalg.norm(y[:, :wanted] - q[:, :wanted] * theta[:wanted], axis=0) / top
        # A block of all dimensions leaves rounding alone.
        if residuals.max() <= TOLERANCE or m == d:
            return theta[:wanted], q[:, :wanted], residuals
        low = max(float(theta[-1]), top * 1e-12)
        if residuals.max() > before / 10:
            more = min(d, 2 * m)
            q = np.hstack([q, rng.standard_normal((d, more - m))])
            m, before = more, np.inf
        else:
            before = residuals.max()
            q = filtered(apply, q, y, top, low, DEGREE)
        q = np.linalg.qr(q)[0]
        y = apply(q)


def fit(vectors: DataFrame, wanted: int = 8) -> Basis:
    """Components of ``whole_vectors``; fewer than ``wanted`` where the vectors span fewer dimensions."""
    n, sums = _totals(vectors)
    d = len(sums)
    if not n:
        return Basis(0, [], 0.0, np.zeros(0), np.zeros((0, 0)), np.zeros(0))

    def apply(q: np.ndarray) -> np.ndarray:
        def add(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            return c.T @ (c @ q)

        return _pass(vectors, add, d, q.shape[1]) / n

    squares = _pass(vectors, lambda x: (_centred(x, n, sums) ** 2).sum(axis=0)[:, None], d, 1)
    trace = float(squares.sum() / n)
    values, found, residuals = subspace(apply, d, min(wanted, d))
    # A direction without spread has no whitened value.
    spread = values > trace * 1e-12
    return Basis(n, sums, trace, values[spread], found[:, spread], residuals[spread])


def whiten(vectors: DataFrame, basis: Basis) -> DataFrame:
    """``vec_id``, ``deviation`` (exact, decimal) and ``whitened`` (array, one entry a component)."""
    n, sums = basis.n, basis.sums
    turn = basis.vectors / np.sqrt(basis.values)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, largest = np.array(sums, object), float(max(map(abs, sums)))
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch)
            # Longs where everything fits them; whole numbers of any size otherwise.
            if n * float(np.abs(x).max()) + largest < 2.0**62:
                apart = n * x - total.astype(np.int64)
                if float(np.abs(apart).max()) ** 2 * x.shape[1] > 2.0**62:
                    apart = apart.astype(object)
            else:
                apart = n * x.astype(object) - total
            deviation = (apart * apart).sum(axis=1)
            white = _centred(x, n, sums) @ turn
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    pa.array([Decimal(int(v)) for v in deviation], pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1], pa.int32()), pa.array(white.ravel())
                    ),
                ],
                ["vec_id", "deviation", "whitened"],
            )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(rows, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` (centred, divisor n) less the identity."""
    if not components:
        return 0.0
    columns = [F.col("whitened")[j] for j in range(components)]
    means = whitened.agg(*[F.avg(c) for c in columns]).first()
    apart = [c - F.lit(m) for c, m in zip(columns, means, strict=True)]
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    found = whitened.agg(*[F.avg(apart[i] * apart[j]) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs, strict=True))


def whitened_components(embeddings: DataFrame, wanted: int = 8, column: str = "embedding") -> DataFrame:
    """One row per usable vector and component: ``vec_id``, ``component`` (from 1), ``n``, ``deviation``,
    ``whitened``, ``explained``, ``identity_error`` and ``residual`` (the pair's certificate).

    Repeated rows and a null vec_id stay, each with rows of its own. Without usable vectors, or with vectors that are all equal,
    there are no components and no rows; other columns of the input are left unread. A deviation beyond 64 bits stays exact, as a decimal here.
    """
    vectors = whole_vectors(embeddings, column)
    basis = fit(vectors, wanted)
    k = len(basis.values)
    if not k:
        return vectors.where("false").selectExpr(
            "vec_id", "0 component", "0L n", "cast(0 as decimal(38,0)) deviation", "0D whitened", "0D explained",
            "0D identity_error", "0D residual",
        )
    white = keep(whiten(vectors, basis), "whitened")
    error = identity_error(white, k)
    numbered = white.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    explained = F.array(*[F.lit(float(v / basis.trace)) for v in basis.values])
    residual = F.array(*[F.lit(float(r)) for r in basis.residuals])
    return numbered.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(basis.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained[F.col("place")].alias("explained"),
        F.lit(error).alias("identity_error"),
        residual[F.col("place")].alias("residual"),
    )
