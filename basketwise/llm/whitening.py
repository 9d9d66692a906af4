"""Whitening of embeddings: weighted covariance of distinct grid vectors, each whitened once and joined back."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketwise.llm.tables import materialize, small_batches

MOST = 1 << 61


@dataclass(frozen=True)
class WhiteningSpec:
    """Components of entries become x = floor(grid * c) + offset (long), clipped to about +-2**61.

    ``weights`` is "count" (every row counts, the fit list is all rows) or "one" (every distinct vector counts once).
    At most ``components`` are kept; the model that is broadcast holds that many vectors.
    """

    grid: int = 64
    offset: int = 1_000_000
    components: int = 32
    weights: str = "count"


@dataclass(frozen=True)
class Whitening:
    """``size`` x-vectors were fitted, with exact sums per dimension; ``ways`` holds one scaled component a column."""

    size: int
    sums: list[int]
    ways: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, from exact integers where n * x fits into 62 bits, else in two parts."""
        whole = np.array([s // self.size for s in self.sums], dtype=np.int64)
        part = np.array([s % self.size for s in self.sums], dtype=np.float64) / self.size
        return (x - whole).astype(np.float64) - part

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sum over dimensions of (n * x - S)**2; None where it does not fit into a long."""
        whole = np.array([s // self.size for s in self.sums], dtype=np.int64)
        rest = np.array([s % self.size for s in self.sums], dtype=np.int64)
        away = x - whole
        top = int(np.abs(away).max(initial=0)) + 1
        if len(self.sums) * (self.size * top) ** 2 < 2 * MOST:
            return ((self.size * away - rest) ** 2).sum(axis=1).tolist()
        exact = [sum((self.size * int(a) - int(r)) ** 2 for a, r in zip(row, rest)) for row in away]
        return [d if d < 1 << 63 else None for d in exact]


def _usable(vector: str) -> Column:
    inf = F.lit(float("inf"))
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < inf))
    return F.col(vector).isNotNull() & finite


def grid_vectors(vectors: DataFrame, spec: WhiteningSpec, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, x`` of the rows that take part: no null vector, no null or non-finite entry, the usual length."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v")).filter(_usable("v"))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    low, high = F.lit(-float(MOST)), F.lit(float(MOST))
    on_grid = F.transform("v", lambda c: F.floor(F.greatest(F.least(c.cast("double") * spec.grid, high), low)) + spec.offset)
    return rows.filter(F.size("v") == (usual["n"] if usual else 0)).select("vec_id", on_grid.alias("x"))


def _matrix(column: pa.ListArray, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def _moments(frame: DataFrame, vector: str, weight: Column, centred: Callable | None, dims: int) -> np.ndarray:
    """Sum of weight * y * y' over all rows, y being the centred vectors: one product of matrices per batch, one matrix
    per partition, added up by Spark cell by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            if batch.num_rows:
                y = centred(batch.column(0))
                total += (y * batch.column(1).to_numpy()[:, None]).T @ y
        i, j = np.triu_indices(dims)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "s"])

    cells = frame.select(vector, weight.cast("double").alias("w")).mapInArrow(run, "i int, j int, s double")
    out = np.zeros((dims, dims))
    for i, j, s in cells.groupBy("i", "j").agg(F.sum("s")).toLocalIterator():  # dims**2 numbers whatever the input
        out[i, j] = out[j, i] = s
    return out


def _sums(frame: DataFrame, vector: str, weight: Column, dims: int, kind: type) -> list:
    """Sum of weight * entry for every dimension; exact for integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [kind(0)] * dims
        for batch in batches:
            if batch.num_rows:
                x, w = _matrix(batch.column(0), kind), batch.column(1).to_numpy()
                if kind is int and int(np.abs(x).max()) * int(w.sum()) >= MOST:
                    x = x.astype(object)
                total = [a + b for a, b in zip(total, (x * w[:, None]).sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dims), pa.int32()), pa.array([repr(t) for t in total], pa.string())], names=["at", "s"])

    own = frame.select(vector, weight.cast("bigint").alias("w")).mapInArrow(run, "at int, s string")
    number = F.sum(F.col("s").cast("decimal(38,0)" if kind is int else "double"))
    return [kind(r[1]) for r in own.groupBy("at").agg(number).orderBy("at").collect()]  # one row a dimension


def fit(distinct: DataFrame, spec: WhiteningSpec) -> Whitening | None:
    """Model of ``distinct`` (x, copies); None without any vector or without any spread."""
    weight = F.col("copies") if spec.weights == "count" else F.lit(1).cast("bigint")
    size = distinct.agg(F.sum(weight)).first()[0]
    dims = [r[0] for r in distinct.select(F.size("x")).limit(1).collect()]
    if not size or not dims[0]:
        return None
    sums = _sums(distinct, "x", weight, dims[0], int)
    about = Whitening(int(size), sums, np.zeros((dims[0], 0)), np.zeros(0))
    v = _moments(distinct, "x", weight, lambda c: about.centred(_matrix(c, np.int64)), dims[0]) / int(size)
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1], vector[:, ::-1]
    # an eigenvalue within rounding of zero has no direction to scale
    kept = int((value > np.trace(v) * dims[0] * np.finfo(float).eps).sum())
    kept = min(spec.components, kept)
    if not kept:
        return None
    return Whitening(int(size), sums, vector[:, :kept] / np.sqrt(value[:kept]), value[:kept] / np.trace(v))


def whiten(vectors: DataFrame, spec: WhiteningSpec = WhiteningSpec(), id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """One row per remaining row and component: ``vec_id, component, n, deviation, whitened, explained,
    identity_error``.

    Dropped are rows whose vector is null or holds a null or non-finite entry, and vectors of another length than the
    most common one (of equally common lengths the longest stays). Rows without id stay (null id), repeated rows give
    repeated results, other columns are ignored. Components are numbered from 1 by falling eigenvalue (equal ones in
    the order of the solver); those whose eigenvalue is zero within rounding are left out, so an empty table, a single
    vector or vectors without any spread give no rows. ``deviation`` is null if it does not fit into a long.

    Plan: equal x-vectors are grouped first (combined before the shuffle), so a vector that a third of all rows share
    is one row with a weight in all that follows. Sums are exact integers; the covariance is one centred product of
    matrices per Arrow batch, of which only dims**2 sums reach the driver, where the small eigenproblem is solved.
    Every distinct vector is whitened once and stored; the measured covariance of these results gives
    ``identity_error``; rows meet them again by a 128-bit digest of x.
    """
    session = vectors.sparkSession
    small_batches(session)
    keyed = lambda frame: frame.withColumns(
        {"a": F.xxhash64("x"), "b": F.xxhash64(F.lit("second"), F.reverse("x"))})
    rows = grid_vectors(vectors, spec, id_col, vector_col)
    distinct = materialize(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")), "distinct")
    model = fit(distinct, spec)
    result = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    if model is None:
        return session.createDataFrame([], result)
    shared = session.sparkContext.broadcast(model)  # dims x components numbers

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), np.int64)
                z = shared.value.centred(x) @ shared.value.ways
                at = np.arange(len(x) + 1, dtype=np.int32) * z.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[1:], pa.array(shared.value.deviation(x), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(at), pa.array(z.ravel()))],
                    names=["a", "b", "copies", "deviation", "z"])

    done = materialize(keyed(distinct).select("x", "a", "b", "copies").mapInArrow(
        project, "a long, b long, copies long, deviation long, z array<double>"), "whitened")
    weight = F.col("copies") if spec.weights == "count" else F.lit(1)
    mean = np.array(_sums(done, "z", weight, len(model.explained), float)) / model.size
    cov = _moments(done, "z", weight, lambda c: _matrix(c, np.float64) - mean, len(mean)) / model.size
    error = float(np.abs(cov - np.eye(len(mean))).max())
    explained = F.array(*(F.lit(float(e)) for e in model.explained))
    return (keyed(rows).select("vec_id", "a", "b").join(done.drop("copies"), ["a", "b"])
            .select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.size).cast("bigint").alias("n"),
                    "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"),
                    F.lit(error).alias("identity_error")))
