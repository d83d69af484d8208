"""Document fingerprints from closed syncmers.

A run of ``K`` bytes is a closed syncmer if the smallest hash among its
``S``-byte substrings is the first or the last.  Whether a run is one depends
on the run alone, so an edit moves no anchor but those that touch it, and equal
passages carry equal anchors at equal distances.  A fingerprint is the ``KEEP``
smallest distinct syncmer hashes, in hex; two fingerprints' likeness is the
share of common hashes among the smallest of both.  Two texts are also matched
by position: ``aligned`` is the share of one's anchors that the other has at one
common displacement, which tells a passage that was kept whole from anchors
that are met here and there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import store

K, S, KEEP = 32, 12, 64
_BASE = 0x2545F4914F6CDD1D


def _hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` bytes, by doubling: equal runs have equal hashes."""
    out, have, at = np.zeros(max(0, len(data) - n + 1), np.uint64), 0, 0
    level, span = data.astype(np.uint64) + np.uint64(1), 1
    while have < n:
        if n & span:
            out = out * np.uint64(pow(_BASE, span, 1 << 64)) + level[at : at + len(out)]
            have += span
            at += span
        if have >= n or 2 * span > len(data):
            break
        level = level[: len(level) - span] * np.uint64(pow(_BASE, span, 1 << 64)) + level[span:]
        span *= 2
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9FB21C651E98DF25)
    return out ^ (out >> np.uint64(28))


def syncmers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the closed syncmers of a byte array."""
    if len(data) < K:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    small, width = _hashes(data, S), K - S + 1
    low, span = small, 1
    while span < width:
        step = min(span, width - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    at = np.flatnonzero((low == small[: len(low)]) | (low == small[width - 1 :]))
    return at, _hashes(data, K)[at]


def sketches(texts: list[bytes]) -> list[np.ndarray]:
    """Ascending smallest syncmer hashes of every text. A text that has no
    syncmer has the hash of its whole, an empty text none."""
    return [s for s, _, _ in sketches_and_anchors(texts)]


def sketches_and_anchors(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of every text its sketch, and the places (in bytes) and hashes of its distinct anchors by hash, each at its first place."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for some in _groups(texts, 2_000_000):
        data = np.frombuffer(b"".join(some), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))
        at, value = syncmers(data)
        of = np.searchsorted(ends, at, "right")
        whole = at + K <= ends[np.minimum(of, len(ends) - 1)]
        of, value, at = of[whole], value[whole], at[whole]
        order = np.lexsort((value, of))
        of, value, at = of[order], value[order], at[order]
        new = np.concatenate([[True], (np.diff(of) != 0) | (value[1:] != value[:-1])]) if len(of) else np.zeros(0, bool)
        of, value, at = of[new], value[new], at[new]
        at = at - np.concatenate([[0], ends])[of]
        cut = np.searchsorted(of, np.arange(len(some) + 1))
        for text, a, b in zip(some, cut[:-1], cut[1:], strict=True):
            sketch = np.frombuffer(hashlib.sha256(text).digest()[:8], "<u8") if a == b and text else value[a : min(b, a + KEEP)]
            out.append((sketch, at[a:b], value[a:b]))
    return out


def _groups(texts: list[bytes], most: int) -> Iterator[list[bytes]]:
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > most:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common hashes among the smallest of both, 0 to 1; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[: min(KEEP, max(len(a), len(b)))]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def aligned(at: np.ndarray, value: np.ndarray, other_at: np.ndarray, other_value: np.ndarray) -> float:
    """Share of the anchors (places and ascending distinct hashes) that the
    others have at the commonest displacement, 0 to 1; 1 for two empty ones."""
    if not len(value) or not len(other_value):
        return float(len(value) == len(other_value))
    there = np.minimum(np.searchsorted(other_value, value), len(other_value) - 1)
    same = other_value[there] == value
    moved = np.sort(other_at[there[same]] - at[same])
    if not len(moved):
        return 0.0
    begin = np.flatnonzero(np.concatenate([[True], moved[1:] != moved[:-1]]))
    return float(np.diff(np.append(begin, len(moved))).max() / len(value))


def to_text(sketch: np.ndarray) -> str:
    """Sixteen hex digits a hash."""
    return sketch.astype(">u8").tobytes().hex()


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row; null text counts as empty (empty fingerprint). An empty table gives no rows."""

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([to_text(s) for s in sketches([t.encode("utf-8", "surrogatepass") for t in texts])], dtype="object")

    return docs.select("doc_id", made(store.null_safe_text()).alias("fingerprint"))


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, place (in bytes) and anchor (hash) of every closed syncmer, for positional matching.

    Null and short texts have none; an empty table gives no rows.
    """

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                at, value = syncmers(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))
                yield pd.DataFrame({"doc_id": [doc_id] * len(at), "place": at, "anchor": value.view(np.int64)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", store.null_safe_text().alias("text")).mapInPandas(found, f"doc_id {kind}, place long, anchor long")


def with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows dealt so that every row's successor in ascending doc_id order is at hand.

    One shuffle of the texts: rows go to the range of ids they are in, sorted,
    and the first row of every range also goes, marked ``last``, to the end of
    the range before (of the first range: to the end of the last).  Only the
    first ids of the ranges, one for each partition, come to the driver.
    Columns: range, last, doc_id, text.  Null ids come first, equal ids by text.
    """
    spark = docs.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"))
    dealt = ids.repartitionByRange(parts, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("first"))
    firsts = np.array(sorted({r["first"] for r in dealt.collect()}), np.int64)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(firsts, keys.to_numpy(np.int64), "right") - 1, dtype="int32")

    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select("doc_id", store.null_safe_text().alias("text"), key.alias("key")).withColumn("range", range_of("key"))
    is_first = F.col("key").isin(firsts.tolist())
    before = F.pmod(F.col("range") - 1, F.lit(max(1, len(firsts))))
    places = F.when(is_first, F.array(F.struct("range", F.lit(False).alias("last")), F.struct(before.alias("range"), F.lit(True).alias("last")))).otherwise(F.array(F.struct("range", F.lit(False).alias("last"))))
    spread = rows.withColumn("place", F.explode(places))
    return spread.select(F.col("place.range").alias("range"), F.col("place.last").alias("last"), "doc_id", "text")


def compare_with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of every text, of the text with its second half replaced by
    the next document's first half, and how alike they are.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next (likeness of fingerprints), aligned_edited,
    aligned_next (positional, of all anchors).  The edit replaces the last n_chars // 2 code points
    by as many of the next document's first, or all it has.  A table of one row
    is its own next.  Null text counts as empty.
    """
    spread = with_next(docs, partitions)
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # rows that still wait for their next
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            for part in _overlapping(frame):
                yield from _compared(part)
            held = frame.iloc[-1:]

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, aligned_edited double, aligned_next double"
    ordered = spread.repartitionById(parts, "range").sortWithinPartitions("range", "last", F.col("doc_id").asc_nulls_first(), "text")
    return ordered.mapInPandas(store.tidy(compare), schema)


def _overlapping(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Cuts of a frame that share their end rows."""
    begin = 0
    for part in store.slices(frame, "text", 1_000_000):
        end = begin + len(part)
        if len(piece := frame.iloc[begin : end + 1]) > 1:
            yield piece
        begin = end


def _compared(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of a sorted frame against the row after them, within a range; the last row is only a next."""
    ranges, last, texts = frame["range"].to_numpy(), frame["last"].to_numpy(bool), frame["text"].tolist()
    ok = np.flatnonzero((ranges[:-1] == ranges[1:]) & ~last[:-1])
    if not len(ok):
        return
    edited = []
    for i in ok.tolist():
        half = len(texts[i]) // 2
        edited.append((texts[i][: len(texts[i]) - half] + texts[i + 1][:half]).encode("utf-8", "surrogatepass"))
    needed = np.union1d(ok, ok + 1)
    own = dict(zip(needed.tolist(), sketches_and_anchors([texts[i].encode("utf-8", "surrogatepass") for i in needed.tolist()]), strict=True))
    new = sketches_and_anchors(edited)
    yield pd.DataFrame({
        "doc_id": frame["doc_id"].iloc[ok],
        "n_chars": [len(texts[i]) for i in ok],
        "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
        "fingerprint": [to_text(own[i][0]) for i in ok.tolist()],
        "edited_fingerprint": [to_text(s[0]) for s in new],
        "near_edited": [likeness(own[i][0], s[0]) for i, s in zip(ok.tolist(), new, strict=True)],
        "near_next": [likeness(own[i][0], own[i + 1][0]) for i in ok.tolist()],
        "aligned_edited": [aligned(*own[i][1:], *s[1:]) for i, s in zip(ok.tolist(), new, strict=True)],
        "aligned_next": [aligned(*own[i][1:], *own[i + 1][1:]) for i in ok.tolist()],
    })
