"""Embedding whitening: exact covariance by upper-triangle column aggregates, LAPACK eigenvectors, projections.

Components become integers, as a fixed-point number behind an offset. One aggregation gives their number and sums, from
which each dimension gets a whole number next to its mean; a second one sums, for every pair of dimensions, the
products of what remains, as generated Spark SQL expressions. What the whole number leaves over of the mean is taken away
in exact fractions, so the covariance has no rounding but the last. Only sums come to the driver: dims * (dims + 1) / 2 numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.session import mapped

SCALE, OFFSET = 64, 1_000_000
FAR = 1 << 52  # components beyond it are moved to it: doubles hold whole numbers up to there
EXPRESSIONS = 4096  # of one aggregation; wider vectors take several


@dataclass(frozen=True)
class Whitening:
    """``n`` fitted vectors; per dimension a whole number next to the mean and the sum of what remains (n * mean = n * near + rest).

    ``values`` are the eigenvalues kept, falling; ``vectors`` has their unit eigenvectors as columns; ``trace`` is the sum of all variances.
    """

    n: int
    near: tuple[int, ...]
    rest: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dims(self) -> int:
        return len(self.near)


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """``vectors`` with x, the whole components floor(SCALE * c) + OFFSET, without rows whose vector is null, empty or holds null or non-finite entries."""
    usable = "embedding is not null and size(embedding) > 0 and not exists(embedding, c -> c is null or isnan(c) or abs(double(c)) = double('infinity'))"
    return vectors.filter(usable).withColumn("x", F.expr(f"transform(embedding, c -> greatest(least(floor({SCALE}D * double(c)), {FAR}L), -{FAR}L) + {OFFSET}L)"))


def pair_sums(rows: DataFrame, column: str, dims: int, kind: str) -> list[list]:
    """Sums of column[i] * column[j] over all rows for i <= j, as the upper triangle row by row; ``kind`` is the SQL type of the products."""
    flat = rows.selectExpr(*(f"cast({column}[{i}] as {kind}) as c{i}" for i in range(dims)))
    sums = [f"sum(c{i} * c{j}) as s{i}_{j}" for i in range(dims) for j in range(i, dims)]
    got = []
    for a in range(0, len(sums), EXPRESSIONS):
        got += flat.selectExpr(*sums[a : a + EXPRESSIONS]).first()
    ends = np.cumsum([dims - i for i in range(dims)])
    return [got[end - (dims - i) : end] for i, end in enumerate(ends)]


def fit(vectors: DataFrame, components: int = 32) -> Whitening | None:
    """The whitening of all usable rows of ``vectors`` (embedding); None where there are none.

    The fit list is of the most frequent length (of equally frequent ones the greatest); repeated rows count each.
    At most ``components`` are kept, and only those whose eigenvalue isn't zero to double precision: without any variance there are none.
    """
    usable = whole_vectors(vectors).select("x")
    lengths = usable.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if lengths is None:
        return None
    dims, n = lengths["dims"], lengths["count"]
    fitted = usable.filter(F.size("x") == dims)
    one = fitted.selectExpr(*(f"{f}(cast(x[{i}] as decimal(20,0))) as {f}{i}" for f in ("sum", "min", "max") for i in range(dims))).first()
    sums, low, high = ([int(v) for v in one[k * dims : (k + 1) * dims]] for k in range(3))
    near = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, near, strict=True)]
    far = max(max(h - m, m - lo) for lo, h, m in zip(low, high, near, strict=True))
    moved = fitted.select(F.expr(f"zip_with(x, array({', '.join(f'{m}L' for m in near)}), (c, m) -> c - m)").alias("y"))
    triangle = pair_sums(moved, "y", dims, "bigint" if far * far * n < 1 << 62 else "decimal(19,0)")
    covariance = np.zeros((dims, dims))
    for i, row in enumerate(triangle):
        for j, s in enumerate(row, i):
            covariance[i, j] = covariance[j, i] = float(Fraction(int(s) * n - rest[i] * rest[j], n * n))
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    kept = int((values[:components] > max(values[0], 0) * dims * np.finfo(float).eps).sum()) if values[0] > 0 else 0
    return Whitening(n, tuple(near), tuple(rest), values[:kept].copy(), axes[:, :kept].copy(), float(np.trace(covariance)))


def _projected(model: Whitening):
    near, rest = np.array(model.near, np.int64), np.array(model.rest, np.int64)
    axes = model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column("x").flatten().to_numpy().reshape(-1, len(near)) - near
            most = float(np.abs(y).max()) * model.n + model.n
            if most * most * len(near) < 2.0**63:
                apart = y * model.n - rest
                deviation = (apart * apart).sum(axis=1)
            else:
                apart = y.astype(object) * model.n - rest.astype(object)
                deviation = np.minimum((apart * apart).sum(axis=1), (1 << 63) - 1).astype(np.int64)
            whitened = (y - rest / model.n) @ axes
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * axes.shape[1]), pa.array(whitened.ravel()))
            columns = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "x"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(deviation, pa.int64()), lists], [*(c for c in batch.schema.names if c != "x"), "deviation", "whitened"])

    return run


def whiten(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """``vectors`` with deviation and whitened, an array of a value per component, for the rows that can take part.

    deviation is the sum over the dimensions of (n * x - sum)^2, exact, or the greatest long where it passes that. Rows whose vector is
    null, empty, of another length than the model's or holds null or non-finite entries go. Repeated rows and null ids stay; components
    beyond FAR are moved to it. Own columns named x, deviation and whitened are replaced. An empty table, or no model, gives no rows.
    """
    rows = whole_vectors(vectors.drop("deviation", "whitened"))
    own = [f for f in rows.schema.fields if f.name != "x"]
    schema = T.StructType([*own, T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    return mapped(rows.filter(F.size("x") == model.dims), _projected(model), schema)


def identity_error(whitened: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened rows minus the identity."""
    k = len(model.values)
    means = whitened.selectExpr(*(f"avg(whitened[{i}]) as m{i}" for i in range(k))).first()
    centred = whitened.select(F.expr(f"zip_with(whitened, array({', '.join(f'{m!r}D' for m in means)}), (w, m) -> w - m)").alias("w"))
    triangle = pair_sums(centred, "w", k, "double")
    return max(abs(s / model.n - (i == j)) for i, row in enumerate(triangle) for j, s in enumerate(row, i))
