"""Whitening of embeddings with exact sums: integers are split into limbs so that float64 matrix products stay exact.

A vector becomes integers, with a leading 1, so one Gram matrix holds the number of vectors, their sums and their products.
Every task splits its integers into limbs of 16 bits, multiplies limb by limb with BLAS (a product of two limbs summed over
2**20 rows stays under 2**53, so no bit is lost), recombines the products as big integers and hands on the entries as two
decimals each; Spark adds those. The covariance is formed from the integers and rounded once; the eigendecomposition
of that small matrix runs on the driver. Whitened values start from the exact difference to the mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ladderworks.llm.frames import kept, trimmed

LIMB = 16
#: Rows whose limb products may be added in float64: 2**20 * 2**16 * 2**16 = 2**52.
_FLUSH, _ROWS = 1 << 20, 1 << 13
_LOW = 62
_INT64 = (1 << 63) - 1


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """float64 matrices l with x = sum of l[k] * 2**(16 k); the last has the sign. As many as the largest entry needs."""
    out, x = [], x.astype(np.int64)
    while True:
        if not x.size or (x.min() >= -(1 << (LIMB - 1)) and x.max() < 1 << (LIMB - 1)):
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB


class Gram:
    """The exact integer matrix of sums of products of rows."""

    def __init__(self, width: int):
        self.total = np.zeros((width, width), object)
        self.parts: dict[int, np.ndarray] = {}
        self.rows = 0

    def add(self, x: np.ndarray) -> None:
        for lo in range(0, len(x), _ROWS):
            part = limbs(x[lo : lo + _ROWS])
            if self.rows + len(part[0]) > _FLUSH // len(part):
                self.recombine()
            self.rows += len(part[0])
            for a, left in enumerate(part):
                for b, right in enumerate(part):
                    product = left.T @ right
                    self.parts[a + b] = self.parts[a + b] + product if a + b in self.parts else product

    def recombine(self) -> None:
        """Adds what was summed in float64 to the big integers. Up to as many products as limbs share a shift, hence the division of _FLUSH."""
        for shift, part in self.parts.items():
            self.total += part.astype(np.int64).astype(object) * (1 << (LIMB * shift))
        self.parts, self.rows = {}, 0

    def entries(self) -> Iterator[tuple[int, int, int]]:
        self.recombine()
        for i in range(len(self.total)):
            for j in range(i, len(self.total)):
                yield i, j, int(self.total[i, j])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _grams(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    trimmed()
    gram, any_rows = Gram(width + 1), False
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("x"), width)
            gram.add(np.concatenate([np.ones((len(x), 1), np.int64), x], 1))
            any_rows = True
    if any_rows:
        rows = list(gram.entries())
        mask = (1 << _LOW) - 1
        kind = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([Decimal(r[2] >> _LOW) for r in rows], kind), pa.array([Decimal(r[2] & mask) for r in rows], kind)], ["i", "j", "high", "low"])


@dataclass
class Whitening:
    """n vectors of the fit list with sums S = quotient * n + remainder; components in columns, falling eigenvalues."""

    n: int
    quotient: np.ndarray
    remainder: np.ndarray
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    @property
    def live(self) -> np.ndarray:
        """Components with a variance that isn't rounding."""
        most = self.values.max(initial=0.0)
        return self.values > most * len(self.quotient) * np.finfo(float).eps if most > 0 else np.zeros(len(self.values), bool)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN where a component has no variance."""
        centred = self._shifted(x) - self.remainder.astype(np.float64) / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.live, 1 / np.sqrt(np.maximum(self.values, 0)), np.nan)
        return (centred @ self.components) * scale

    def _shifted(self, x: np.ndarray) -> np.ndarray:
        """x - quotient, in big integers where 64 bits don't hold it."""
        far = x.size and max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, self.quotient.tolist()), default=0) > _INT64
        return (x.astype(object) - self.quotient.astype(object)).astype(np.float64) if far else (x - self.quotient).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)**2, exact; None beyond a long."""
        bound = [int(v) for v in (x.min(initial=0), x.max(initial=0))]
        most = self.n * (max(map(abs, bound)) + max(map(abs, self.quotient.tolist()), default=0) + 1)
        if most <= _INT64:
            d = self.n * (x - self.quotient) - self.remainder
            if int(np.abs(d).max(initial=0)) ** 2 * max(1, x.shape[1]) <= _INT64:
                return (d * d).sum(1).tolist()
        d = self.n * (x.astype(object) - self.quotient.astype(object)) - self.remainder.astype(object)
        return [s if s <= _INT64 else None for s in (d * d).sum(1).tolist()]


def _fitted(fit: DataFrame, width: int, most: int) -> Whitening:
    sums = fit.mapInArrow(lambda batches: _grams(batches, width), "i int, j int, high decimal(38,0), low decimal(38,0)")
    sums = sums.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    gram = {(r.i, r.j): (int(r.high) << _LOW) + int(r.low) for r in sums.collect()}  # one row for two dimensions
    n, s = gram[0, 0], [gram[0, j + 1] for j in range(width)]
    exact = [[n * gram[min(i, j) + 1, max(i, j) + 1] - s[i] * s[j] for j in range(width)] for i in range(width)]
    # All that is exact up to here is rounded once, on division by n * n.
    values, vectors = np.linalg.eigh(np.array([[v / (n * n) for v in row] for row in exact], float).reshape(width, width))
    first = np.argsort(-values, kind="stable")[:most]
    trace = sum(exact[i][i] for i in range(width)) / (n * n)
    values, vectors = np.maximum(values[first], 0), vectors[:, first]
    explained = values / trace if trace > 0 else np.zeros(len(values))
    whole = lambda v: np.array(v, np.int64)
    return Whitening(n, whole([v // n for v in s]), whole([v % n for v in s]), vectors, values, explained)


def _moments(batches: Iterator[pa.RecordBatch], model: Whitening, width: int) -> Iterator[pa.RecordBatch]:
    """Sums and products of the whitened rows, which lie about zero; index -1 stands for the constant 1."""
    k = int(model.live.sum())
    total = np.zeros((k + 1, k + 1))
    for batch in batches:
        z = model.project(_matrix(batch.column("x"), width))[:, model.live]
        z = np.concatenate([np.ones((len(z), 1)), z], 1)
        total += z.T @ z
    i, j = np.triu_indices(k + 1)
    yield pa.RecordBatch.from_arrays([pa.array(i - 1, pa.int32()), pa.array(j - 1, pa.int32()), pa.array(total[i, j], pa.float64())], ["i", "j", "v"])


def _identity_error(fit: DataFrame, model: Whitening, width: int) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, measured on its rows."""
    if not model.live.any():
        return None
    sums = fit.mapInArrow(lambda batches: _moments(batches, model, width), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    v = {(r.i, r.j): r.v for r in sums.collect()}
    mean = {j: v[-1, j] / model.n for i, j in v if i == -1}
    return max(abs(s / model.n - mean[i] * mean[j] - (i == j)) for (i, j), s in v.items() if i >= 0)


def _rows(batches: Iterator[pa.RecordBatch], model: Whitening, width: int) -> Iterator[pa.RecordBatch]:
    k = model.components.shape[1]
    for batch in batches:
        for lo in range(0, batch.num_rows, _ROWS):
            part = batch.slice(lo, _ROWS)
            m = part.num_rows
            x = _matrix(part.column("_x"), width)
            z = model.project(x)
            at = np.repeat(np.arange(m), k)
            deviations = model.deviations(x)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_row").take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, model.n), pa.int64()),
                    pa.array([deviations[i] for i in at.tolist()], pa.int64()),
                    pa.array(z.ravel(), pa.float64(), mask=np.isnan(z.ravel())),
                    pa.array(np.tile(model.explained, m), pa.float64()),
                    pa.array([model.identity_error] * (m * k), pa.float64()),
                ],
                ["_row", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )


_NEW = T.StructType([T.StructField(n, k()) for n, k in (("component", T.IntegerType), ("n", T.LongType), ("deviation", T.LongType), ("whitened", T.DoubleType), ("explained", T.DoubleType), ("identity_error", T.DoubleType))])


def whiten(embeddings: DataFrame, vector_col: str = "embedding", components: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """The input's columns but the vector, a row for each of the first ``components`` principal components, with ``component`` (from 1),
    ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    An entry c is the integer floor(scale * c) + shift. Mean and covariance are those of the distinct integer vectors (n of
    them), the components unit eigenvectors of the covariance by falling eigenvalue. deviation: sum of (n x - S)**2, exact;
    whitened: x less the mean, on the component, over its standard deviation; explained: the eigenvalue's share of the trace;
    identity_error: the largest entry of the whitened vectors' covariance minus the identity, over components with a variance.
    The driver gets one number for each two dimensions.

    * Rows whose vector is null, or has a null entry or one that isn't finite or not under 2**56 in size, are left out; so are
      vectors that don't have the commonest number of dimensions (ties: the largest).
    * Repeated vectors count once in the fit, and each row has its own result. Rows without an id stay.
    * A component without variance (one vector only, or fewer vectors than components) has a null ``whitened``; a deviation
      beyond a long is null. Empty vectors have no components, an empty table gives an empty table.
    * Input columns of the results' names are replaced; others stay, whatever their names.
    """
    vector = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    good = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(2.0**56)))
    whole: Column = F.transform("_v", lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(shift).cast("long"))
    others = [f for f in embeddings.schema.fields if f.name != vector_col] or [T.StructField("_none", T.BooleanType())]
    rest = [F.col(f"`{f.name}`") for f in others] if len(embeddings.columns) > 1 else [F.lit(True).alias("_none")]
    rows = embeddings.select(F.struct(*rest).alias("_row"), vector.alias("_v")).where(F.col("_v").isNotNull() & good).select("_row", whole.alias("_x"))
    out = [F.col(f"_row.`{c}`").alias(c) for c in embeddings.columns if c != vector_col and c not in _NEW.names] + _NEW.names
    schema = T.StructType([T.StructField("_row", T.StructType(others)), *_NEW.fields])
    sizes = rows.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    width = sizes.d if sizes else 0
    if not width:
        return embeddings.sparkSession.createDataFrame([], schema).select(*out)
    rows = rows.where(F.size("_x") == width)
    fit = kept(rows.select(F.col("_x").alias("x")).distinct())
    model = _fitted(fit, width, components)
    model.identity_error = _identity_error(fit, model, width)
    return rows.mapInArrow(lambda batches: _rows(batches, model, width), schema).select(*out)

