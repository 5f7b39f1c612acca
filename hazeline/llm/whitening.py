"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers x; their sums S and number n give the centred rows x - S/n, a matrix X that stays where it
is. Each step makes the two products in one pass over X: with the right vector v at hand, a task forms t = Xv - beta u'
for its rows (u' the last left vector), and sums X't, t't and the products of t with all left vectors. Left vectors have
one entry a row and are never stored: u = Xp for a p of one entry a dimension, so a task recomputes what it needs of them.
The driver then holds vectors and sums of one entry a dimension or step, nothing that grows with the rows. Both sides are
reorthogonalised in full, and once more where a step takes away most of a vector; the pass is repeated for that on the
left side. Where a vector vanishes, a new one orthogonal to all others goes on (B is block-diagonal there).

With B the small bidiagonal matrix of all steps, X = U B V', so the singular vectors of B turned by V are the components
and its singular values squared over n the eigenvalues. Steps end after one for each dimension, where nothing is left, or
when the components asked for stand still to rounding. As a Krylov space sees only one of several equal values, a second
sequence then starts from a vector orthogonal to the components found; only if it meets no larger value is the search over.

Rows whose vector is null, holds null or non-finite entries, or entries whose x is no long below 2 ** 52, are dropped; so are
vectors of another length than most have (of the longer, at a tie). A component without deviation (less than 1e-13 of the
largest) doesn't exist: nothing is returned for it, so equal vectors, a single one and an empty table give no rows. Repeated
rows and null ids count as rows of their own. ``deviation`` is exact; beyond a long, it is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import land

#: x = floor(SCALE * c) + SHIFT
SCALE, SHIFT = 1024, 100_000
#: Largest x, so that it is exact as a double.
LIMIT = 1 << 52
COMPONENTS = 8
#: Steps from a new vector after which components that stand still are taken as all there are.
MORE_STEPS = 10
ROWS = 8192


def whole_numbers(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, x) of the rows that can be used."""
    raw = table.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("c"))
    # Not a number is larger than any other, so it doesn't pass either.
    raw = raw.where(f"c IS NOT NULL AND forall(c, e -> e IS NOT NULL AND abs(e) < {LIMIT // SCALE - SHIFT})")
    x = F.expr(f"transform(c, e -> CAST(floor({SCALE} * e) AS BIGINT) + {SHIFT})")
    rows = land(raw.select("vec_id", x.alias("x")), "vectors")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (common["d"] if common else 0))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Whole numbers of a column of lists, one row each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def totals(rows: DataFrame, d: int, size: int, product, exact: bool = False) -> list:
    """Sum over all rows of ``product(x)``, which gives ``size`` doubles (or whole numbers) for a block of rows.

    A task sends one number a place; Spark adds them up by place.
    """
    kind, number = (np.int64, "long") if exact else (np.float64, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                total += product(matrix(batch.column(0).slice(at, ROWS), d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["place", "value"])

    parts = rows.select("x").mapInArrow(run, f"place int, value {number}")
    value = F.col("value").cast("decimal(20,0)") if exact else F.col("value")
    out = [0] * size
    for place, total in parts.groupBy("place").agg(F.sum(value)).collect():
        out[place] = int(total) if exact else total
    return out


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension; halves of x keep a task's sums within a long."""

    def product(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], (x >> 26).sum(axis=0), (x & (1 << 26) - 1).sum(axis=0)])

    n, *halves = totals(rows, d, 1 + 2 * d, product, exact=True)
    return n, [(high << 26) + low for high, low in zip(halves[:d], halves[d:], strict=True)]


def cleared(vector: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``vector`` without its part in the span of an orthonormal ``basis``; twice is enough."""
    for _ in range(2 if basis else 0):
        q = np.array(basis)
        vector = vector - q.T @ (q @ vector)
    return vector


class Bidiagonal:
    """X = U B V' step by step: ``right`` are V's columns, ``left`` the p of U's, ``alpha`` and ``beta`` B's diagonals.

    ``locked`` are right vectors that all others keep orthogonal to.
    """

    def __init__(self, rows: DataFrame, mean: np.ndarray, locked: np.ndarray, seed: int):
        self.rows, self.d, self.mean, self.locked = rows, len(mean), mean, list(locked)
        self.right: list[np.ndarray] = []
        self.left: list[np.ndarray] = []
        self.images: list[np.ndarray] = []  # X'u of each u
        self.alpha: list[float] = []
        self.beta: list[float] = []  # beta[i] stands between columns i and i + 1
        self.draws = np.random.default_rng(seed)
        self.next: tuple[np.ndarray, float] | None = None
        self.complete = False

    def products(self, p: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """t't, X't and U't for t = Xp, in one pass."""
        d, mean, left = self.d, self.mean, np.array(self.left).reshape(-1, self.d)

        def product(x: np.ndarray) -> np.ndarray:
            x = x - mean
            t = x @ p
            image = t @ x
            return np.concatenate([[t @ t], image, left @ image])

        found = np.array(totals(self.rows, d, 1 + d + len(left), product))
        return found[0], found[1 : 1 + d], found[1 + d :]

    def step(self) -> None:
        scale = max([*self.alpha, *self.beta, 0.0])
        started = self.next is None
        if started:
            v = cleared(self.draws.standard_normal(self.d), self.locked + self.right)
            self.next = v / np.linalg.norm(v), 0.0
        v, beta = self.next
        p = v - beta * self.left[-1] if self.left else v
        length, image, shares = self.products(p)
        # What earlier left vectors have of t is taken out, again if little of t stays.
        for _ in range(2):
            if not len(shares):
                break
            whole, length = length, length - shares @ shares
            p, image = p - shares @ np.array(self.left), image - shares @ np.array(self.images)
            if length > 0.99 * whole:
                break
            length, image, shares = self.products(p)
        alpha = float(np.sqrt(max(length, 0.0)))
        if alpha <= 1e-13 * scale or alpha == 0.0:
            # Nothing is left along v; if it was drawn at random, nothing at all.
            self.complete, alpha, unit = started, 0.0, 0.0
        else:
            unit = 1 / alpha
        if self.right:
            self.beta.append(beta)
        self.right.append(v)
        self.alpha.append(alpha)
        self.left.append(p * unit)
        self.images.append(image * unit)
        w = cleared(image * unit, self.locked + self.right)
        beta = float(np.linalg.norm(w))
        self.next = None if beta <= 1e-13 * max(scale, alpha) else (w / beta, beta)
        self.complete |= len(self.locked) + len(self.right) == self.d

    def singular(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Singular values, right vectors in rows, and how far each is from being X's."""
        b = np.diag(self.alpha)
        if self.beta:
            b += np.diag(self.beta, 1)
        u, s, vt = np.linalg.svd(b)
        return s, vt @ np.array(self.right), (self.next[1] if self.next else 0.0) * np.abs(u[-1])

    def stands_still(self, count: int) -> bool:
        """The largest ``count`` values and vectors won't change any more."""
        if len(self.alpha) <= count:
            return False
        s, _, off = self.singular()
        gaps = s[:count] - s[1 : count + 1]
        gaps = np.minimum(gaps, np.concatenate([[np.inf], gaps[:-1]]))
        return bool((off[:count] <= 1e-12 * gaps).all())


def components(rows: DataFrame, n: int, mean: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance, falling, and their unit vectors in rows: ``count``, or as many as there are."""
    values, vectors = np.zeros(0), np.zeros((0, len(mean)))
    while n and len(vectors) < len(mean):
        found = Bidiagonal(rows, mean, vectors, seed=len(vectors))
        while not found.complete and not found.stands_still(count):
            found.step()
            if len(vectors) >= count and len(found.alpha) >= MORE_STEPS and found.singular()[0][0] < 0.999 * values[count - 1]:
                break
        s, v, _ = found.singular()
        # Sequences after the first only matter where they hold larger values.
        larger = len(values) < count or s[0] > values[count - 1] * (1 - 1e-10)
        s, v = np.concatenate([values, s[:count]]), np.concatenate([vectors, v[:count]])
        order = np.argsort(-s, kind="stable")[:count]
        values, vectors = s[order], v[order]
        if found.complete or not larger:
            break
    keep = values**2 > 1e-13 * (values[0] ** 2 if len(values) else 0.0)
    values, vectors = values[keep], vectors[keep]
    # Either sign will do; the largest entry is positive.
    largest = np.abs(vectors).argmax(axis=1) if len(vectors) else np.zeros(0, int)
    sign = np.sign(vectors[np.arange(len(vectors)), largest])
    return values**2 / max(n, 1), vectors * sign[:, None]


def deviations(x: np.ndarray, n: int, total: list[int]) -> pa.Array:
    """Sums of (n x - S) ** 2, exact; null beyond a long."""
    about = ((x - np.array([t / n for t in total])) ** 2).sum(axis=1) * float(n) ** 2
    # Arithmetic modulo 2 ** 64 is exact for results that fit.
    y = x.astype(np.uint64) * np.uint64(n) - np.array([t % (1 << 64) for t in total], np.uint64)
    out = (y * y).sum(axis=1).astype(np.int64)
    beyond = about >= 2.0**63
    for i in np.flatnonzero(np.abs(about / 2.0**63 - 1) < 1e-6):
        beyond[i] = sum((n * int(c) - t) ** 2 for c, t in zip(x[i], total, strict=True)) >= 1 << 63
    return pa.array(out, pa.int64(), mask=beyond)


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable row and component."""
    kind = table.schema[key].dataType.simpleString()
    rows = whole_numbers(table, key, vector)
    first = rows.select(F.size("x")).first()
    d = first[0] if first else 0
    n, total = sums(rows, d) if d else (0, [])
    mean = np.array([t / n for t in total])
    values, vectors = components(rows, n, mean, count)
    k = len(values)
    turn = vectors.T / np.sqrt(values)
    explained, error = np.zeros(0), 0.0
    if k:

        def product(x: np.ndarray) -> np.ndarray:
            x = x - mean
            w = x @ turn
            return np.concatenate([[(x * x).sum()], w.sum(axis=0), (w.T @ w).ravel()])

        found = np.array(totals(rows, d, 1 + k + k * k, product)) / n
        explained, centre = values / found[0], found[1 : 1 + k]
        error = float(np.abs(found[1 + k :].reshape(k, k) - np.outer(centre, centre) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if k else ():
            for at in range(0, len(batch), ROWS):
                some = batch.slice(at, ROWS)
                x, m = matrix(some.column(1), d), len(some)
                which = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    some.column(0).take(which), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n)),
                    deviations(x, n, total).take(which), pa.array(((x - mean) @ turn).ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
                )

    return rows.select("vec_id", "x").mapInArrow(
        run,
        f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double",
    )
