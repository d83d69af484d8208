"""Approximate nearest neighbours on shifted Hilbert curves.

Every vector is projected to a few dimensions, several times with other
projections and shifts; each time its cell's place on a Hilbert curve is its
key.  A curve's keys are cut into blocks of equal size (bounds from a bounded
sample), so near keys share a block or neighbour blocks.  A query visits its
block and the blocks within ``reach`` of the curve on either side; each visit
keeps its best by exact inner product, and visits are merged.

Only distinct vectors enter the blocks, each with its ``k`` + 1 smallest ids:
more can't be among the k nearest of any query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Curves, dimensions of a projection, bits of a coordinate.
CURVES, DIMS, BITS = 6, 4, 8
#: Part of a curve that a query visits on either side of its own block.
REACH = 0.125
#: Rows of the sample that projections and bounds are fitted on.
SAMPLE = 20_000
#: Bytes of a block's vectors and of a part's queries at most, in doubles, roughly.  A query
#: is sent to a share of the blocks and a vector to all parts, so both are as large as a
#: task's memory allows: 32 768 vectors and 131 072 queries of 64 components.
BLOCK_BYTES, VISIT_BYTES = 16 << 20, 64 << 20
#: Scores that are held at a time.
SCORES = 4_194_304
#: Blocks of a curve at least, where they get that many rows each.
LEAST_BLOCKS, LEAST_ROWS = 32, 64


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows), ``bits`` bits a
    coordinate (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            turned = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(turned, x[0] ^ p, x[0] ^ swap)
            x[i] = np.where(turned, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), top
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << 1) | ((row >> b) & 1)
    return key


class Curves:
    """Projections, cell bounds, shifts and block bounds; size doesn't depend on the input."""

    def __init__(self, sample: np.ndarray, blocks: int, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, seed: int = 11):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.bits, dims = bits, min(dims, d)
        self.projections = [np.linalg.qr(rng.normal(size=(d, d)))[0][:, :dims] for _ in range(curves)]
        self.shifts = rng.integers(0, 1 << bits, (curves, dims))
        at = np.linspace(0, 1, (1 << bits) + 1)[1:-1]
        self.cell_bounds = [np.quantile(sample @ p, at, axis=0).T for p in self.projections]
        self.block_bounds = []
        for c in range(curves):
            keys = np.sort(self.key(sample, c))
            self.block_bounds.append(keys[np.arange(1, blocks) * len(keys) // blocks])

    def key(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        y = vectors @ self.projections[curve]
        cells = np.stack([np.searchsorted(b, y[:, i], "right") for i, b in enumerate(self.cell_bounds[curve])], axis=1)
        return hilbert_key(cells + self.shifts[curve], self.bits + 1)

    def block(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        return np.searchsorted(self.block_bounds[curve], self.key(vectors, curve), "right")


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part: not null,
    not zero, all components finite.  Vectors of different lengths are an error."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null and size(embedding) > 0")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return v.where(fine)


def _same_length(v: DataFrame) -> int:
    """How many vectors there are; they must have one length."""
    n, low, high = v.agg(F.count(F.lit(1)), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if low != high:
        raise ValueError(f"vectors of one table must have one length, not {low} to {high}")
    return n


def _best(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    q, x = np.stack(queries["embedding"].to_numpy()), np.stack(rows["embedding"].to_numpy())
    members = rows["members"].to_numpy()
    low = np.array([m[0] for m in members])
    ids = queries["query_id"].to_numpy(np.int64)
    step = max(1, SCORES // len(x))
    for at in range(0, len(q), step):
        asked, given, reached = [], [], []
        for i, row in enumerate(q[at : at + step] @ x.T):
            keep = min(len(row), k + 1)
            edge = np.partition(row, len(row) - keep)[len(row) - keep] - 1e-9
            near = np.flatnonzero(row >= edge)
            if len(near) > 4 * keep:  # many equal scores: the smallest ids first
                near = near[np.lexsort((low[near], -np.round(row[near], 9)))[: 4 * keep]]
            exact = np.einsum("ij,j->i", x[near], q[at + i])
            of = np.repeat(np.arange(len(near)), [len(members[n]) for n in near])
            vec = np.concatenate([members[n] for n in near])
            score = exact[of]
            other = vec != ids[at + i]
            vec, score = vec[other], score[other]
            first = np.lexsort((vec, -score))[:k]
            asked.append(np.full(len(first), ids[at + i]))
            given.append(vec[first])
            reached.append(score[first])
        yield pd.DataFrame({"query_id": np.concatenate(asked), "vec_id": np.concatenate(given), "score": np.concatenate(reached)})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, reach: float = REACH, curves: int = CURVES, blocks: int | None = None) -> DataFrame:
    """The ``k`` nearest found of every query: query_id, rank (from 1), vec_id, score.

    ``vectors`` and ``queries`` have vec_id and embedding.  Nearness is the inner
    product in double precision, ties go to the smaller vec_id, and a query's
    own id isn't among its nearest.  Vectors that ``usable`` leaves out take no
    part; a repeated vec_id counts as often as it has different vectors.
    An empty table gives no rows.
    """
    v, q = usable(vectors), usable(queries)
    n = _same_length(v)
    sample = v.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).toPandas() if n else pd.DataFrame()
    schema = "query_id long, vec_id long, score double"
    if not len(sample):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    row_bytes = 8 * len(sample["embedding"].iloc[0])
    blocks = blocks or max(1, min(LEAST_BLOCKS, n // LEAST_ROWS), -(-n * row_bytes // BLOCK_BYTES))
    side = int(np.ceil(blocks * reach))
    model = Curves(np.stack(sample["embedding"].to_numpy()), blocks, curves)
    slices = max(1, -(-_same_length(q) * row_bytes // VISIT_BYTES))

    copies = Window.partitionBy("embedding").orderBy("vec_id")
    distinct = v.distinct().withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1).groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = np.stack(frame["embedding"].to_numpy())
                for c in range(curves):
                    block = model.block(x, c)
                    for part in range(slices):
                        yield frame.assign(curve=c, block=block, part=part)

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = np.stack(frame["embedding"].to_numpy())
                for c in range(curves):
                    own = model.block(x, c)
                    for step in range(-side, side + 1):
                        inside = (own + step >= 0) & (own + step < blocks)
                        yield frame[inside].assign(curve=c, block=(own + step)[inside], part=frame["part"][inside])

    placed = distinct.mapInPandas(place, "embedding array<double>, members array<long>, curve int, block int, part int")
    asked = q.select(F.col("vec_id").alias("query_id"), "embedding", F.expr(f"int(pmod(xxhash64(vec_id), {slices}))").alias("part")).mapInPandas(visit, "query_id long, embedding array<double>, curve int, block int, part int")

    def search(key, there: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        found = list(_best(there, here, k)) if len(there) and len(here) else []
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    keys = ["curve", "block", "part"]
    met = asked.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInPandas(search, schema)
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 20) -> float:
    """Part of the true k nearest that ``found`` has, by brute force over all
    rows in blocks.  For tests and reports."""
    sent = usable(queries).toPandas()
    q = np.stack(sent["embedding"].to_numpy())
    ids = sent["vec_id"].to_numpy(np.int64)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.stack(frame["embedding"].to_numpy())
            yield from _best(pd.DataFrame({"query_id": ids, "embedding": list(q)}), pd.DataFrame({"embedding": list(x), "members": [[i] for i in frame["vec_id"]]}), k)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = usable(vectors).mapInPandas(scan, "query_id long, vec_id long, score double").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    both = true.join(found.select("query_id", "vec_id").withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
