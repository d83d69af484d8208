"""SimHash near-duplicates by a grid of segment bit counts.

A 64-bit fingerprint is embedded as the bit counts of its segments.  Flipping
one bit moves one count by one, so the Manhattan distance of two embeddings is
at most the fingerprints' Hamming distance: points further apart than
``WITHIN`` need not be compared.  Every point goes to its own grid cell and to
the cells one step away; two points at most two steps apart meet in at least
one of them, and what meets is compared bit by bit.

Only distinct fingerprints enter the grid, so exact copies cost nothing.  A
cell with more than ``CELL`` points isn't compared pair by pair: its points
meet again in the grid of one-bit segments, where whatever shares a cell is
within two bits of one another, and are linked to the cell's smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import store
from corpusloom.llm.components import components

SEED = 42
#: Segments of a fingerprint, four bits each.
SEGMENTS = 16
#: Fingerprints link at so many differing bits or fewer; the grid's one step a side is made for two.
WITHIN = 2
#: Points of a cell that are compared pair by pair.
CELL = 64
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str, shingle: int = 3) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words of a text, in order.

    Words are runs of anything but ASCII white space, A-Z lower-cased.  Fewer
    words than a shingle has: the whole sequence; none: no hash.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    first = [0, *(ends[: n - 1] + 1).tolist()]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, n)


def fingerprint(text: str, shingle: int = 3) -> int:
    """SimHash of a text's word shingles as an unsigned 64-bit integer.

    Words are runs of anything but ASCII white space, A-Z lower-cased.  Fewer
    words than a shingle has: the whole sequence; none: zero.
    """
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; none of no hashes."""
    n = len(hashes)
    if not n:
        return 0
    octets = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    counts = np.concatenate([np.bincount(octets[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, *keys: str) -> DataFrame:
    """doc_id (or the columns named by ``keys``) and fp (the fingerprint as a signed long) of every row; null text: no words."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).astype(np.int64))

    return docs.select(*(keys or ("doc_id",)), simhash(store.null_safe_text()).alias("fp"))


def cells_of(points: np.ndarray) -> np.ndarray:
    """Grid cells of unsigned fingerprints: own cell, then one step along every
    segment; a step that leaves the grid gives the own cell again."""
    shifts = np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(4)
    nibbles = (points[:, None] >> shifts) & np.uint64(15)
    counts = np.bitwise_count(nibbles).astype(np.int64)
    places = np.int64(1) << (3 * np.arange(SEGMENTS, dtype=np.int64))
    own = (counts * places).sum(1)
    up = np.where(counts < 4, own[:, None] + places, own[:, None])
    down = np.where(counts > 0, own[:, None] - places, own[:, None])
    return np.concatenate([own[:, None], up, down], axis=1)


def _spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        cells = cells_of(frame["fp"].to_numpy(np.int64).view(np.uint64))
        keep = np.ones(cells.shape, bool)
        keep[:, 1:] = cells[:, 1:] != cells[:, :1]
        row, col = np.nonzero(keep)
        yield pd.DataFrame({"cell": cells[row, col], "fp": frame["fp"].to_numpy()[row], "node": frame["node"].to_numpy()[row]})


def _meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by cell. Gives links (hot false) and the points of crowded cells (hot true)."""
    hot_cell, carry = None, None

    def settled(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        cell, fp, node = (frame[c].to_numpy(np.int64) for c in ("cell", "fp", "node"))
        _, begin, size = np.unique(cell, return_index=True, return_counts=True)
        crowded = np.repeat(size > CELL, size)
        if crowded.any():
            yield pd.DataFrame({"a": fp[crowded], "b": node[crowded], "hot": True})
            cell, fp, node = cell[~crowded], fp[~crowded], node[~crowded]
        for d in range(1, CELL):
            same = np.flatnonzero(cell[d:] == cell[:-d])
            if not len(same):
                break
            near = same[np.bitwise_count((fp[same] ^ fp[same + d]).view(np.uint64)) <= WITHIN]
            if len(near):
                yield pd.DataFrame({"a": np.minimum(node[near], node[near + d]), "b": np.maximum(node[near], node[near + d]), "hot": False})

    for frame in frames:
        frame = frame if carry is None else pd.concat([carry, frame], ignore_index=True)
        if not len(frame):
            continue
        if hot_cell is not None:
            still = frame["cell"] == hot_cell
            if still.any():
                yield pd.DataFrame({"a": frame["fp"][still], "b": frame["node"][still], "hot": True})
                frame = frame[~still].reset_index(drop=True)
            if not len(frame):
                carry = None
                continue
            hot_cell = None
        last = frame["cell"].to_numpy() == frame["cell"].iloc[-1]
        carry = frame[last].reset_index(drop=True)
        yield from settled(frame[~last])
        if len(carry) > CELL:
            hot_cell = carry["cell"].iloc[0]
            yield pd.DataFrame({"a": carry["fp"], "b": carry["node"], "hot": True})
            carry = None
    if carry is not None and len(carry):
        yield from settled(carry)


def links(points: DataFrame) -> DataFrame:
    """Links a, b (nodes, a < b) that connect exactly what fingerprints at
    ``WITHIN`` or fewer differing bits connect.

    ``points``: distinct fp (long) with a node (long) each.  Pairs in crowded
    cells may be linked through a third point that is linked to both.
    """
    grid = points.select("fp", "node").mapInPandas(store.tidy(_spread), "cell long, fp long, node long")
    met = store.staged(grid.repartition("cell").sortWithinPartitions("cell", "fp").mapInPandas(store.tidy(_meet), "a long, b long, hot boolean"), "simhash-met")
    crowd = met.where("hot").select(F.col("a").alias("fp"), F.col("b").alias("node")).distinct()
    one_bit = F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))"))
    fine = crowd.select("node", one_bit.alias("cell")).withColumn("low", F.min("node").over(Window.partitionBy("cell")))
    return met.where("not hot").select("a", "b").union(fine.where("low < node").select(F.col("low").alias("a"), F.col("node").alias("b"))).distinct()


def _found(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_hash and fp of every row, and every fp with its group (root) and the group's ``first`` row.

    Groups are made of fingerprints, so rows that share a doc_id but not the
    text stay apart.
    """
    fps = store.staged(fingerprints(docs.select("doc_id", "text", text_hash()), shingle, "doc_id", "text_hash"), "simhash")
    points = store.staged(fps.groupBy("fp").agg(first_row().alias("first")), "simhash-points")
    return fps, grouped(points, components(links(points.select("fp", F.col("fp").alias("node")))))


def text_hash() -> Column:
    return F.xxhash64(store.null_safe_text()).alias("text_hash")


def first_row() -> Column:
    """Aggregate: the row with the smallest doc_id, null last; then by the text's hash."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id").cast("long").alias("doc_id"), "text_hash"))


def grouped(points: DataFrame, roots: DataFrame) -> DataFrame:
    """fp, root and first of points (fp, first); roots: node (an fp), root; first is the whole group's."""
    named = points.join(roots, points["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    return named.drop("first").join(named.groupBy("root").agg(F.min("first").alias("first")), "root")


def near_groups(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable by links of two or
    fewer bits, itself included) of every row.

    Documents without words have fingerprint zero and link like any other.  Rows
    that repeat a doc_id with other text belong to the group of their own
    text; a null doc_id names a group only if no other does.  An empty table
    gives no rows.
    """
    fps, groups = _found(docs, shingle)
    return fps.join(groups.select("fp", F.col("first.doc_id").alias("component_id")), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Of every group of ``near_groups`` one row: that with the smallest doc_id (null last).

    Rows are told apart by doc_id and text, so rows that repeat a doc_id are
    kept or dropped by their own text, and of rows that repeat both one stays.
    All columns stay as they are.  An empty table gives no rows.
    """
    return only_first(docs, *_found(docs, shingle))


def only_first(docs: DataFrame, rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The first row of every group. ``rows``: doc_id and text_hash of every row; ``groups``: fp, root, first."""
    wanted = groups.select("first").distinct().select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash"))
    repeated = rows.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    same = wanted["__id"].eqNullSafe(repeated["doc_id"]) & (wanted["__hash"] == repeated["text_hash"])
    hashed = docs.withColumn("__text_hash", F.xxhash64(store.null_safe_text()))

    def those(keys: DataFrame) -> DataFrame:
        return hashed.join(keys, hashed["doc_id"].eqNullSafe(keys["__id"]) & (hashed["__text_hash"] == keys["__hash"]), "left_semi")

    once, again = those(wanted.join(repeated, same, "left_anti")), those(wanted.join(repeated, same, "left_semi"))
    return once.unionByName(again.dropDuplicates(["doc_id", "__text_hash"])).drop("__text_hash")
