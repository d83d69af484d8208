"""Whitening of embeddings by components that are exact until the last rounding.

Entries become integers, so the scatter matrix of the distinct vectors is an
integer matrix that Spark sums exactly.  Its characteristic polynomial is taken
modulo one prime a row of a Spark table and put together on the driver; the
polynomial's size depends on the dimension only.  Roots and eigenvectors follow
from it (``exact_spectrum``), again one eigenvalue a row.  The work of the
polynomial grows with the fifth power of the dimension: meant for up to some
hundreds of dimensions and any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import exact_spectrum, store

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Sums of products stay exact in doubles below this.
_EXACT = 1 << 53


def usable(vector: Column) -> Column:
    """Vectors that have entries, none of them null or not finite."""
    size, infinite = F.size(vector), F.lit(float("inf"))
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == infinite))
    return vector.isNotNull() & (size > 0) & ~F.coalesce(odd, F.lit(True))


def integers(vector: Column) -> Column:
    """``floor(64 * c) + 1000000`` of every entry c."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + OFFSET)


@dataclass
class Whitener:
    """What the fit list gives: its size, sums of x - 1000000 by dimension, and per component a unit vector and its eigenvalue's root."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    roots: np.ndarray
    explained: np.ndarray

    @property
    def components(self) -> int:
        return len(self.roots)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S of every row, exact."""
        small = (int(np.abs(x).max(initial=0)) + 1) * self.n < 1 << 61
        return self.n * (x if small else x.astype(object)) - np.array(self.sums, np.int64 if small else object)

    def squared(self, deviations: np.ndarray) -> np.ndarray:
        """Sum of squares of every row; beyond a long is an error."""
        most = int(np.abs(deviations).max(initial=0))
        total = (deviations if most * most * len(self.sums) < 1 << 63 else deviations.astype(object)) ** 2
        total = total.sum(axis=1)
        if total.dtype == object and max(total) >= 1 << 63:
            raise OverflowError("a deviation doesn't fit a long")
        return total.astype(np.int64)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations.astype(np.float64) / self.n) @ (self.vectors / self.roots[:, None]).T


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of x - 1000000."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and lengths.min() != lengths.max():
        raise ValueError("vectors have different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(lengths), -1) - OFFSET if len(lengths) else np.zeros((0, 0), np.int64)


def _products(x: np.ndarray) -> np.ndarray:
    """x^T x in integers."""
    most = int(np.abs(x).max(initial=0)) + 1
    if most * most > _EXACT:
        wide = x.astype(object)
        return wide.T @ wide
    rows, total = max(1, _EXACT // (most * most)), 0
    for at in range(0, len(x), rows):
        some = x[at : at + rows].astype(np.float64)
        total = total + (some.T @ some).astype(np.int64).astype(object)
    return total


def _entry_sums(fit: DataFrame, work: Callable[[np.ndarray], np.ndarray], kind: str) -> DataFrame:
    """``work`` gives a matrix for some rows of x; the sums of its entries over all rows: d, i, j, v.
    Entries of tasks are summed by Spark; the result has a row an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                part = work(x := _matrix(batch.column("x")))
                if total is not None and (total[0] != x.shape[1]):
                    raise ValueError("vectors have different lengths")
                total = (x.shape[1], part if total is None else total[1] + part)
        if total is not None:
            i, j = np.indices(total[1].shape)
            values = [str(v) for v in total[1].ravel()] if kind != "double" else total[1].ravel().tolist()
            yield pa.RecordBatch.from_pydict({"d": np.full(i.size, total[0], np.int32), "i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "v": values})

    parts = fit.select("x").mapInArrow(run, f"d int, i int, j int, v {'double' if kind == 'double' else 'string'}")
    return parts.groupBy("d", "i", "j").agg(F.sum(F.col("v").cast(kind)).alias("v"))


def fit(vectors: DataFrame, most: int = COMPONENTS) -> Whitener | None:
    """Components of the distinct vectors ``x`` of a table; none for an empty table.

    Eigenvalues of zero have no component (nothing can be divided by their
    root), so there are as many as the vectors' rank, at most ``most``.
    """
    spark = vectors.sparkSession

    def moments(x: np.ndarray) -> np.ndarray:
        return np.triu(_products(np.hstack([x, np.ones((len(x), 1), np.int64)])))

    rows = _entry_sums(vectors, moments, "decimal(38,0)").where("i <= j").collect()  # as many as the dimension squared
    if not rows:
        return None
    if len({r["d"] for r in rows}) > 1:
        raise ValueError("vectors have different lengths")
    d = rows[0]["d"]
    found = {(r["i"], r["j"]): int(r["v"]) for r in rows}
    n, sums = found[d, d], [found[i, d] for i in range(d)]
    scatter = [[n * found[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    trace = sum(scatter[i][i] for i in range(d))
    count = exact_spectrum.primes_needed(scatter)
    primes = exact_spectrum.primes(count)

    def remainders(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = frame["id"].tolist()
            yield pd.DataFrame({"id": ids, "c": [exact_spectrum.polynomial_mod(scatter, primes[i]) for i in ids]})

    cores = spark.sparkContext.defaultParallelism
    told = spark.range(0, count, 1, min(count, cores)).mapInPandas(remainders, "id long, c array<long>").collect()
    poly = exact_spectrum.combined([(primes[r["id"]], r["c"]) for r in told])
    bits, roots = exact_spectrum.largest_roots(poly, most)

    def spaces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in frame["id"].tolist():
                y, times = roots[i]
                yield pd.DataFrame({"id": i, "k": range(times), "v": [v.tolist() for v in exact_spectrum.eigenvectors(scatter, bits, y, times)]})

    basis = []
    if roots:
        basis = sorted(spark.range(0, len(roots), 1, min(len(roots), cores)).mapInPandas(spaces, "id long, k long, v array<double>").collect())[:most]
    values = [Fraction(roots[r["id"]][0], 1 << bits) for r in basis]
    return Whitener(
        n, sums, np.array([r["v"] for r in basis], np.float64).reshape(-1, d),
        np.sqrt(np.array([float(v / (n * n)) for v in values])), np.array([float(v / trace) for v in values]),
    )


def identity_error(vectors: DataFrame, by: Whitener) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, from the whitened values themselves."""
    if not by.components:
        return 0.0
    values = lambda x: by.whitened(by.deviations(x))
    mean = np.zeros(by.components)
    for r in _entry_sums(vectors, lambda x: values(x).sum(axis=0)[None], "double").collect():
        mean[r["j"]] = r["v"] / by.n

    def centred(x: np.ndarray) -> np.ndarray:
        y = values(x) - mean
        return y.T @ y

    error = -np.eye(by.components)
    for r in _entry_sums(vectors, centred, "double").collect():
        error[r["i"], r["j"]] += r["v"] / by.n
    return float(np.abs(error).max())


_SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, most: int = COMPONENTS, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row a usable vector and component: the id, component (from 1), n, deviation, whitened, explained, identity_error.

    Null and empty vectors, and those with null or non-finite entries, take no
    part.  Repeated rows each give their rows, but count once in the fit; equal
    eigenvalues share some orthonormal basis of their space, the same for all
    rows.  Vectors of different lengths are an error.  No usable vector, or one
    distinct vector only, gives no rows: there is no variance.  Further columns
    aren't carried, so their names can't clash.
    """
    spark = embeddings.sparkSession
    kind = embeddings.schema[id].dataType.simpleString()
    rows = embeddings.where(usable(F.col(vector))).select(F.col(id).alias("id"), integers(F.col(vector)).alias("x"))
    distinct = store.staged(rows.select("x").distinct(), "whitening-fit")
    by = fit(distinct, most)
    if by is None or not by.components:
        return spark.createDataFrame([], f"{id} {kind}, {_SCHEMA}")
    error, r = identity_error(distinct, by), by.components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            deviations = by.deviations(_matrix(batch.column("x")))
            n = len(deviations)
            yield pa.RecordBatch.from_pydict({
                id: batch.column("id").take(pa.array(np.repeat(np.arange(n), r))),
                "component": np.tile(np.arange(1, r + 1, dtype=np.int32), n),
                "n": np.full(n * r, by.n),
                "deviation": np.repeat(by.squared(deviations), r),
                "whitened": by.whitened(deviations).ravel(),
                "explained": np.tile(by.explained, n),
                "identity_error": np.full(n * r, error),
            })

    return rows.mapInArrow(run, f"`{id}` {kind}, {_SCHEMA}")
