"""Near copies by SimHash, and by minimum hashes where it can't reach, verified exactly by the Jaccard similarity of word shingles.

1. Points.  Texts with equal sets of shingle hashes are one point, so exact
   copies cost nothing.
2. SimHash.  Operator 5's fingerprint of each point's set and its links: all
   points at two or fewer differing bits are candidates, by the same grid.
3. Beyond its reach.  At a similarity of 0.8 fingerprints lie about ten bits
   apart, so more candidates come from ``BANDS`` bands of ``ROWS`` minimum hashes
   each; points that share a band are linked to the band's smallest.  At the
   similarity asked for two points share no band once in 20 000 pairs; they may
   still meet through a third.  What the links of both steps connect is a cluster.
4. Verification.  Every pair of a cluster meets in one task, which compares
   shingle sets and links what is similar.  Large clusters are dealt as pairs of
   blocks of bounded size.  A task walks from point to point and compares each
   only with points that it hasn't reached yet: first by bit sets of the
   commonest shingles, which bound what two sets can share, then exactly.

Only which pairs steps 2 and 3 find is approximate; groups never hold what step 4 didn't verify.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import simhash, store
from corpusloom.llm.components import components

SHINGLE = 5
#: Pairs link at this intersection over union or more, as numerator and denominator.
SIMILAR = (4, 5)
#: Bands and minimum hashes of each.
BANDS, ROWS = 25, 5
#: Points and shingles of a block of a large cluster.
BLOCK_POINTS, BLOCK_SHINGLES = 4_000, 500_000
_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Ascending distinct hashes of a text's word shingles."""
    return np.unique(simhash.shingle_hashes(text, shingle))


def band_hashes(shingles: np.ndarray) -> np.ndarray:
    """One hash for each band; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 1024):
        low = np.minimum(low, (shingles[at : at + 1024, None] * _FACTORS).min(0))
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _bit_sets(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sets of shingle numbers (one after another): their members among the
    commonest shingles as bits, and how many other members other sets may have, too."""
    times = np.bincount(ids)
    width = int(min(len(times), 64 * max(4, -(-2 * int(np.median(sizes)) // 64))))
    common = np.argpartition(-times, width - 1)[:width] if width < len(times) else np.arange(len(times))
    column = np.full(len(times), -1, np.int64)
    column[common] = np.arange(len(common))
    row, at = np.repeat(np.arange(len(sizes)), sizes), column[ids]
    inside = at >= 0
    bits = np.zeros((len(sizes), -(-width // 64)), np.uint64)
    np.bitwise_or.at(bits, (row[inside], at[inside] >> 6), np.uint64(1) << (at[inside] & 63).astype(np.uint64))
    return bits, np.bincount(row[~inside & (times[ids] > 1)], minlength=len(sizes))


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of positions that connect what all similar pairs of ``sets`` connect."""
    over, under = SIMILAR
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    order, sizes = order[sizes > 0], sizes[sizes > 0]
    if len(order) < 2:
        return []
    ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    bits, others = _bit_sets(ids, sizes)
    marked = np.zeros(int(ids.max()) + 1, bool)
    rest, links = np.arange(len(order)), []  # not reached yet, by size
    ahead: list[int] = []
    while len(rest):
        if not ahead:
            ahead.append(int(rest[0]))
            rest = rest[1:]
        p = ahead.pop()
        # Only sizes within the similarity of one another can be similar.
        lo, hi = np.searchsorted(sizes[rest] * under, sizes[p] * over), np.searchsorted(sizes[rest] * over, sizes[p] * under, "right")
        near = rest[lo:hi]
        if len(near):
            least = over * (sizes[p] + sizes[near])
            most = np.bitwise_count(bits[near] & bits[p]).sum(1, dtype=np.int64) + np.minimum(others[near], others[p])
            near = near[most * (over + under) >= least]
        if len(near):
            own = ids[bounds[p] : bounds[p + 1]]
            marked[own] = True
            n = sizes[near]
            inside = np.repeat(bounds[near] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.add.reduceat(marked[ids[inside]], np.cumsum(n) - n, dtype=np.int64)
            marked[own] = False
            near = near[both * (over + under) >= over * (sizes[p] + n)]
        if len(near):
            links += [(int(order[p]), int(order[q])) for q in near]
            ahead += near.tolist()
            rest = np.setdiff1d(rest, near, assume_unique=True)
    return links


def _fps(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s.tobytes(), simhash.SEED) for s in sets], np.uint64).view(np.int64)


def _sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        sets = [shingle_set(t) for t in frame["text"]]
        yield pd.DataFrame({"doc_id": frame["doc_id"], "text_hash": frame["text_hash"], "fp": _fps(sets), "size": [len(s) for s in sets], "simhash": np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64), "bands": [band_hashes(s) for s in sets]})


def _sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each point once, though its row may be repeated."""
    seen: set[int] = set()
    for frame in frames:
        for part in store.slices(frame[~frame["node"].isin(seen)].drop_duplicates("node"), "text"):
            seen.update(part["node"].tolist())
            yield part.drop(columns=["text"]).assign(shingles=[shingle_set(t).tobytes() for t in part["text"]])


def _verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by root, i and j."""
    held: list[pd.DataFrame] = []

    def settled() -> pd.DataFrame:
        rows = pd.concat(held) if len(held) > 1 else held[0]
        node = rows["node"].to_numpy(np.int64)
        links = forest([np.frombuffer(s, np.uint64) for s in rows["shingles"]])
        return pd.DataFrame({"a": [node[p] for p, _ in links], "b": [node[q] for _, q in links]}, dtype=np.int64)

    key = None
    for frame in frames:
        keys = frame[["root", "i", "j"]].to_numpy(np.int64)
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for a, b in zip([0, *cut], [*cut, len(frame)], strict=True):
            if b > a:
                if held and tuple(keys[a]) != key:
                    yield settled()
                    held.clear()
                key = tuple(keys[a])
                held.append(frame.iloc[a:b])
    if held:
        yield settled()


def simhash_links(points: DataFrame) -> DataFrame:
    """Links a, b (fps) that connect what SimHashes at ``simhash.WITHIN`` or fewer differing bits connect. ``points``: fp, simhash."""
    lows = points.groupBy("simhash").agg(F.min("fp").alias("low"))
    near = simhash.links(lows.select(F.col("simhash").alias("fp"), F.col("low").alias("node")))
    return near.union(points.join(lows, "simhash").where("low < fp").select(F.col("low").alias("a"), F.col("fp").alias("b")))


def band_links(points: DataFrame) -> DataFrame:
    """Links a, b (fps) that connect points which share a band. ``points``: fp, bands."""
    cells = points.select(F.col("fp").alias("node"), F.explode("bands").alias("cell"))
    shared = cells.groupBy("cell").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return cells.join(shared, "cell").where("low < node").select(F.col("low").alias("a"), F.col("node").alias("b"))


def links(texts: DataFrame, points: DataFrame) -> DataFrame:
    """Links a, b (fps) of verified pairs. ``points``: fp, first, size, simhash, bands; ``texts``: doc_id, text_hash, text."""
    met = simhash_links(points).union(band_links(points))  # components writes them
    sized = points.select(F.col("fp").alias("node"), "size", F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash")).join(components(met), "node")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_POINTS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    members = sized.join(sized.groupBy("root").agg(blocks.alias("blocks")), "root").select("node", "__id", "__hash", "root", "blocks", F.expr("int(pmod(xxhash64(node), blocks))").alias("block"))
    members = store.staged(members, "near-members").hint("shuffle_hash")
    found = texts.join(members, texts["doc_id"].eqNullSafe(members["__id"]) & (texts["text_hash"] == members["__hash"]))
    sets = found.select("root", "blocks", "block", "node", "text").mapInPandas(store.tidy(_sets), "root long, blocks int, block int, node long, shingles binary")
    # Block by block each pair of blocks meets once; a pair of points of one block meets with every other block.
    others = F.expr("if(blocks = 1, array(0), filter(sequence(0, blocks - 1), o -> o <> block))")
    dealt = sets.withColumn("other", F.explode(others)).select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "shingles")
    dealt = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return dealt.mapInPandas(store.tidy(_verify), "a long, b long").distinct()


def _found(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_hash and fp of every row, and every fp with its group, as in ``simhash``."""
    texts = docs.select("doc_id", simhash.text_hash(), store.null_safe_text().alias("text"))
    rows = store.staged(texts.mapInPandas(store.tidy(_sketch), "doc_id long, text_hash long, fp long, size int, simhash long, bands array<long>"), "shingle-bands")
    points = rows.groupBy("fp").agg(simhash.first_row().alias("first"), F.first("size").alias("size"), F.first("simhash").alias("simhash"), F.first("bands").alias("bands"))
    points = store.staged(points, "shingle-points")
    return rows, simhash.grouped(points, components(links(texts, points)))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable by similar pairs, itself included) of every row.

    Texts without words are equal to one another and similar to nothing else.
    Repeated and null doc_ids: as in ``simhash.near_groups``.
    """
    rows, groups = _found(docs)
    return rows.join(groups.select("fp", F.col("first.doc_id").alias("component_id")), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """Of every group of ``near_groups`` one row, as ``simhash.deduplicate`` has it."""
    return simhash.only_first(docs, *_found(docs))
