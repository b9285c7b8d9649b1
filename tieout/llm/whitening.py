"""Embedding whitening on the leading components of the covariance.

Components become integers, so counts, sums and second moments are exact
whatever the order of tasks. One job sums the rows; a second centres every
row on the integers nearest the mean before it multiplies, and adds up
products per pair of dimensions with a map-side combine (what is sent is d * d
sums per task, never rows). The remainder of the centring is an exact fraction,
so each entry of the covariance is rounded once. Its leading eigenpairs come from
``spectrum`` on the driver (a matrix of d * d numbers, d the vectors' length).
A third job projects the rows and measures how far the covariance of the result
is from the identity, from sums that each task centres on its own mean and that
merge pairwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm import spectrum

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Eigenvalues up to this share of the trace are rounding and give no component.
LEAST = 1e-12
ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """A fit: rows, dimensions, their sums, eigenvalues, unit eigenvectors as columns and the trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)


def codes(vectors: DataFrame) -> DataFrame:
    """The rows of ``vectors`` that take part as vec_id, ``x`` (integers floor(SCALE * c) +
    SHIFT): a vector that is null, empty or holds a null or non-finite entry goes."""
    c = F.col("embedding").cast("array<double>")
    fine = (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.where(fine).select("vec_id", F.transform(c, lambda v: F.floor(v * SCALE).cast("bigint") + SHIFT).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of at most ROWS rows with their integer matrix."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            piece = batch.slice(at, ROWS)
            yield piece, pc.list_flatten(piece.column("x")).to_numpy().reshape(-1, dims)


def products(z: np.ndarray) -> np.ndarray:
    """Sums of products of the columns of an integer matrix, exact (Python integers)."""
    most = float(np.abs(z).max(initial=0)) ** 2
    total = np.zeros((z.shape[1],) * 2, object)
    if most >= 2**53:
        return total + z.astype(object).T @ z.astype(object)
    step = max(1, int(2**53 / max(most, 1)))
    for at in range(0, len(z), step):
        part = z[at : at + step].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The fit over ``rows`` (vec_id, x); None without rows. Vectors are of one
    length: the most frequent one (of equally frequent ones the longest)."""
    sizes = rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("dims")).first()
    if most is None:
        return None
    dims, n = most.dims, most.n
    mine = rows.where(F.size("x") == dims).select("x")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims, object)
        for _, x in _matrices(batches, dims):
            safe = float(np.abs(x).max(initial=0)) * len(x) < 2**62
            total = total + x.astype(np.int64 if safe else object).sum(axis=0).astype(object)
        yield pa.record_batch([pa.array(np.arange(dims), pa.int32()), pa.array(total.tolist(), pa.decimal128(38, 0))], ["at", "s"])

    one = mine.mapInArrow(summed, "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").alias("s"))
    sums = tuple(int(r.s) for r in one.orderBy("at").collect())  # a row per dimension
    centre = [s // n for s in sums]
    middle = np.array(centre, np.int64)

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        for _, x in _matrices(batches, dims):
            total = total + products(x - middle)
        i, j = np.triu_indices(dims)
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j].tolist(), pa.decimal128(38, 0))], ["i", "j", "p"])

    pairs = mine.mapInArrow(multiplied, "i int, j int, p decimal(38,0)").groupBy("i", "j").agg(F.sum("p").alias("p"))
    rest = [s - n * c for s, c in zip(sums, centre)]
    cov = np.zeros((dims, dims))
    for r in pairs.collect():  # dims * (dims + 1) / 2 rows
        cov[r.i, r.j] = cov[r.j, r.i] = float(Fraction(n * int(r.p) - rest[r.i] * rest[r.j], n * n))
    trace = float(np.trace(cov))
    values, vectors = spectrum.leading(cov, components) if trace > 0 else (np.zeros(0), np.zeros((dims, 0)))
    keep = values > LEAST * trace
    return Whitening(n, sums, values[keep], vectors[:, keep], trace)


def deviations(x: np.ndarray, model: Whitening) -> list[int] | np.ndarray:
    """Sum over dimensions of (n * x - S) ** 2 for each row, exact."""
    z = x - np.array([s // model.n for s in model.sums], np.int64)
    rest = [s % model.n for s in model.sums]
    if (model.n * (int(np.abs(z).max(initial=0)) + 1)) ** 2 * model.dims < 2**63:
        return ((z * model.n - np.array(rest, np.int64)) ** 2).sum(axis=1)
    return ((z.astype(object) * model.n - np.array(rest, object)) ** 2).sum(axis=1).tolist()


def projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    """(x - S / n) on each component over the root of its eigenvalue."""
    whole = np.array([s // model.n for s in model.sums], np.int64)
    part = np.array([float(Fraction(s % model.n, model.n)) for s in model.sums])
    return ((x - whole).astype(np.float64) - part) @ (model.vectors / np.sqrt(model.values))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k, dims = len(model.values), model.dims
    if not k:
        return 0.0
    shape = "n bigint, mean array<double>, m array<double>"

    def merged(parts: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
        n, mean, m = 0, np.zeros(k), np.zeros((k, k))
        for n2, mean2, m2 in parts:
            if n2:
                gap = mean2 - mean
                m = m + m2 + np.outer(gap, gap) * (n * n2 / (n + n2))
                mean = mean + gap * (n2 / (n + n2))
                n += n2
        return n, mean, m

    def row(total: tuple[int, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([total[0]]), pa.array([total[1].tolist()]), pa.array([total[2].ravel().tolist()])], ["n", "mean", "m"])

    def whitened(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        y = projected(x, model)
        centred = y - y.mean(axis=0)
        return len(y), y.mean(axis=0), centred.T @ centred

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield row(merged(whitened(x) for _, x in _matrices(batches, dims)))

    def joined(group: pa.Table) -> pa.Table:
        parts = ((n, np.array(mean), np.array(m).reshape(k, k)) for n, mean, m in zip(*(group[c].to_pylist() for c in ("n", "mean", "m"))))
        return pa.Table.from_batches([row(merged(parts))])

    # task sums meet in groups of about the square root of their number, so neither a group nor the driver holds all of them
    tasks = rows.where(F.size("x") == dims).select("x").mapInArrow(summed, shape)
    groups = max(1, round(rows.rdd.getNumPartitions() ** 0.5))
    few = tasks.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(groups))).groupBy("g").applyInArrow(lambda t: joined(t.drop_columns(["g"])), shape).collect()
    n, _, m = merged((r.n, np.array(r.mean), np.array(r.m).reshape(k, k)) for r in few)
    return float(np.abs(m / n - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector that takes part: vec_id, n, ``deviation`` (decimal, exact),
    ``whitened`` and ``explained`` (arrays over the components, largest eigenvalue
    first) and ``identity_error``.

    ``vectors`` has vec_id and embedding; null ids stay, repeated rows count as often as
    they stand. Null and empty vectors and those with null or non-finite entries
    take no part, nor do vectors that are not as long as most. Components whose
    eigenvalue is nil (fewer rows or dimensions than components, constant
    columns) are left out. An empty table gives no rows."""
    rows = codes(vectors)
    shape = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    model = fit(rows, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], shape)
    error = identity_error(rows, model)
    share, k = (model.values / model.trace).tolist() if len(model.values) else [], len(model.values)

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in _matrices(batches, model.dims):
            m = piece.num_rows
            wide = deviations(x, model)
            wide = pa.array(wide).cast(pa.decimal128(38, 0)) if isinstance(wide, np.ndarray) else pa.array(wide, pa.decimal128(38, 0))
            edges = pa.array(np.arange(0, (m + 1) * k, k, dtype=np.int32) if k else np.zeros(m + 1, np.int32))
            values = [pa.ListArray.from_arrays(edges, pa.array(v, pa.float64())) for v in (projected(x, model).ravel(), np.tile(share, m))]
            yield pa.record_batch([piece.column("vec_id"), pa.repeat(model.n, m), wide, *values, pa.repeat(error, m)], ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == model.dims).mapInArrow(applied, shape)
