"""Removal of word runs that occur more than once, by FM-indexes over shards.

A window is ``window`` consecutive words of one document.  The jobs:

1. Anchors.  Every window has an anchor: the smallest hash of its ``GRAM``-word
   runs.  Equal windows have equal anchors.  Consecutive windows with one
   anchor form a run; runs are listed as (anchor, doc_id, first window, windows).
2. Anchors that only one run has, once, are dropped with their windows: nothing
   equal exists.  (Counting is a partial aggregate before the shuffle; a run whose
   document has the anchor again counts twice.)
3. Segments.  The words under each run that is left are cut out of the text,
   and equal segments are counted, so copies cost one segment.  Anchors with
   more than ``HOT`` runs or ``HOT_WORDS`` words (in periodic text a run is as
   long as the document) are cut into single windows, dealt by the window's
   own words.  Equal windows of a batch are found there and then: their words
   are marked, and one of them goes on with their number.
4. Shards.  Segments with one anchor meet in one task, which groups anchors
   into shards of bounded size, builds a compressed FM-index of each (wavelet
   matrix over the Burrows-Wheeler transform of the words) and streams the
   shard's documents through it: backward search gives the matching statistic
   at every place, up to ``window`` words, over what occurs at least twice.
5. Intervals of ``window`` or more go back to their documents.

Jobs 1 to 3 end in a table of segments, 4 and 5 in one of intervals.  When one
is written, the shuffle files of its jobs are deleted, and the runs with the first.

Hashes only choose what meets; a window is removed because the index holds its
words twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import store

WINDOW = 35
#: Words of the runs that are hashed to anchors.
GRAM = 8
#: Runs of one anchor beyond which it is dealt by whole windows.
HOT = 8_000
#: Words under the runs of one anchor beyond which it is dealt so, too.
HOT_WORDS = 150_000
#: Words in one index.
SHARD = 400_000
#: Symbols by which an index is ordered at least; longer than a window.
ORDER = 36

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def split_words(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept by each worker."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        tables = []
        for factor in (_BASE, inverse):
            table = np.full(size, factor, np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table))
        _powers = tables[0], tables[1]
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(words: list[bytes], gram: int) -> np.ndarray:
    """64-bit hash of every run of ``gram`` words; equal runs have equal hashes."""
    joined = np.frombuffer(b" ".join(words), np.uint8).astype(np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    up, down = _power_tables(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined + np.uint64(1)) * up[:-1], out=sums[1:])
    h = (sums[ends[gram - 1 :]] - sums[starts[: len(words) - gram + 1]]) * down[starts[: len(words) - gram + 1]]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchor_runs(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor, first window and number of windows of every run, and whether the
    document has the anchor again (so that the run may repeat in itself)."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    low, span, width = gram_hashes(words, gram), 1, window - gram + 1
    ordered = np.sort(low)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    while span < width:
        step = min(span, width - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    return low[first], first, np.diff(np.append(first, len(low))), np.isin(low[first], twice)


class WaveletMatrix:
    """Symbols in bit planes of packed words with counts before each word: rank in log2(sigma) steps."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.words, self.ones, self.zeros = [], [], []
        current = symbols
        for level in range(bits - 1, -1, -1):
            plane = (current >> level) & 1
            packed = np.packbits(plane.astype(np.uint8), bitorder="little")
            words = np.zeros(self.n // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.zeros(len(words) + 1, np.int32)
            np.cumsum(np.bitwise_count(words), out=ones[1:])
            self.words.append(words)
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            current = np.concatenate([current[plane == 0], current[plane == 1]])
        every = np.arange(1 << bits)
        self.begin = self._descend(every, np.zeros(len(every), np.int64))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._descend(symbol, at) - self.begin[symbol]

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a place before which ``symbol`` is counted ends up in the last plane's order."""
        for plane in range(self.bits):
            bit = (symbol >> (self.bits - 1 - plane)) & 1 == 1
            ones = self._ones(plane, at)
            at = np.where(bit, self.zeros[plane] + ones, at - ones)
        return at

    def _ones(self, plane: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        inside = self.words[plane][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.ones[plane][word] + np.bitwise_count(inside)


class FMIndex:
    """FM-index of integer symbols, ordered by ``ORDER`` or more symbols.

    That order is enough for backward search of patterns up to ``ORDER``
    symbols, the only kind asked here.  ``deep[d]`` gives for every row of the index the
    begin and end of the rows that share their first d symbols.
    """

    def __init__(self, text: np.ndarray, depths: tuple[int, ...]):
        n = len(text)
        sigma = int(text.max()) + 1
        # The first sort takes as many symbols as fit one key; every later one doubles the span.
        wide = (sigma + 1).bit_length()
        span = max(1, min(depths[0], 62 // wide))
        key = np.zeros(n + span, np.int64)
        key[:n] = text + 1
        key = sum(key[i : n + i] << (wide * (span - 1 - i)) for i in range(span))
        # What stays are places and ranks, below 2**31: a task holds several shard-sized columns beside the executor's heap.
        ranks: dict[int, np.ndarray] = {}
        while True:
            order = np.argsort(key)
            key = key[order]
            rank = np.empty(n, np.int32)
            rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1], dtype=np.int32)])
            ranks[span] = rank
            if span >= ORDER:
                break
            key = rank.astype(np.int64) << 32
            key[: max(0, n - span)] |= rank[span:] + 1
            span *= 2
        del key
        self.order = order.astype(np.int32)
        del order
        self.count = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.tree = WaveletMatrix(text[self.order - 1], max(1, (sigma - 1).bit_length()))
        self.n, self.text = n, text
        self.deep = {d: self._classes(ranks, d) for d in depths}

    def _classes(self, ranks: dict[int, np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
        """By two overlapping sorted spans that together cover ``depth`` symbols."""
        span = max(s for s in ranks if s <= depth)
        there = self.order
        other = np.minimum(there + depth - span, self.n - 1)
        first, second = ranks[span][there], ranks[span][other]
        new = np.concatenate([[True], (np.diff(first) != 0) | (np.diff(second) != 0)])
        begin = np.flatnonzero(new).astype(np.int32)
        of = np.cumsum(new, dtype=np.int32) - 1
        return begin[of], np.append(begin[1:], np.int32(self.n))[of]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that begin with symbol and then what rows low to high begin with."""
        both = self.count[symbol] - self.tree.begin[symbol]
        low, high = np.split(self.tree._descend(np.concatenate([symbol, symbol]), np.concatenate([low, high])), 2)
        return both + low, both + high


def repeated_windows(text: np.ndarray, begins: np.ndarray, ends: np.ndarray, copies: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Marks of the places of ``text`` where a window starts that occurs at least twice.

    ``text`` holds the segments, each followed by a separator (symbol 0);
    ``begins`` and ``ends`` are their bounds, ``copies`` how often each stands
    in the corpus.  All segments are searched at once: from its right end every
    one extends its match to the left while the match occurs twice.  A match of
    ``window`` words is reported and loses its last word; one that ends before
    the segment does is cut at its first 16 words, which often rules out all
    later windows at once, and starts anew.
    """
    half = 16
    index = FMIndex(text, (half, window - 1))
    several = copies > 1
    edges = np.zeros(len(text) + 1, np.int32)
    edges[begins] = several
    edges[ends] -= several
    weight = np.cumsum(edges[:-1], dtype=np.int32)
    many = np.concatenate([np.zeros(1, np.int32), np.cumsum(weight[index.order], dtype=np.int32)])  # rows that stand for several copies

    def twice(low, high):
        return (high - low >= 2) | (many[high] - many[low] >= 1)

    found = np.zeros(len(text), bool)
    (half_low, half_high), (rest_low, rest_high) = index.deep[half], index.deep[window - 1]
    at, end = ends.copy(), ends.copy()  # the match is text[at:end]
    low, high = np.zeros(len(begins), np.int64), np.full(len(begins), len(text), np.int64)
    live = np.flatnonzero(ends - begins >= window)
    while len(live):
        symbol = text[at[live] - 1]
        new_low, new_high = index.extend(symbol, low[live], high[live])
        ok = twice(new_low, new_high)
        good, bad = live[ok], live[~ok]
        low[good], high[good] = new_low[ok], new_high[ok]
        at[good] -= 1
        full = good[end[good] - at[good] == window]
        found[at[full]] = True
        end[full] -= 1
        low[full], high[full] = rest_low[low[full]], rest_high[low[full]]
        far = bad[end[bad] - at[bad] > half]
        if len(far):
            f_low, f_high = index.extend(text[at[far] - 1], half_low[low[far]], half_high[low[far]])
            alone = ~twice(f_low, f_high)
            end[far[alone]] = at[far[alone]] + half
        near = np.setdiff1d(bad, far[alone]) if len(far) else bad
        end[near] -= 1
        at[bad] = end[bad]
        low[bad], high[bad] = 0, len(text)
        live = live[end[live] - begins[live] >= window]
        live = live[at[live] > begins[live]]
    return found


def _spans(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Union of the windows that start at the given ascending places."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.concatenate([[True], np.diff(starts) > window]))
    last = np.append(new[1:], len(starts)) - 1
    return list(zip(starts[new].tolist(), (starts[last] + window).tolist(), strict=True))


def _search_shard(frame: pd.DataFrame, window: int) -> pd.DataFrame:
    """Answers of one shard; takes the words out of ``frame``."""
    lengths = np.fromiter((t.count(b" ") + 1 for t in frame["words"]), np.int64, len(frame))
    flat = pd.factorize(np.array(b" ".join(frame.pop("words")).split(b" "), object))[0] + 1
    begins = np.cumsum(lengths + 1) - (lengths + 1)
    text = np.zeros(int((lengths + 1).sum()), np.int32)
    text[np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(flat))] = flat
    del flat
    found = np.flatnonzero(repeated_windows(text, begins, begins + lengths, frame["copies"].to_numpy(np.int64), window))
    cut = np.searchsorted(found, np.append(begins, len(text)))
    spans = [[{"lo": a, "hi": b} for a, b in _spans(found[i:j] - begin, window)] for i, j, begin in zip(cut[:-1], cut[1:], begins, strict=True)]
    out = pd.DataFrame({"anchor": frame["anchor"].to_numpy(), "seg": frame["seg"].to_numpy(), "spans": spans})
    return out[out["spans"].map(len) > 0]


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, hot_words: int = HOT_WORDS) -> DataFrame:
    """doc_id and spans: per document the word intervals [lo, hi) that repeated windows cover.

    Documents without such a window aren't listed.  Intervals may touch or
    overlap.  Null text has no words.  ``docs`` needs unique doc_ids that aren't
    null; ``without_repeats`` gives it such.
    """
    text = docs.select("doc_id", store.null_safe_text().alias("text"))

    def anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [anchor_runs(split_words(t), window, gram) for t in frame["text"]]
            n = [len(f[0]) for f in found]
            if sum(n):
                anchor, first, windows, again = (np.concatenate([f[k] for f in found]) for k in range(4))
                yield pd.DataFrame({"anchor": anchor.view(np.int64), "doc_id": frame["doc_id"].repeat(n), "place": first << 32 | windows, "weight": again + 1})

    runs = store.staged(text.mapInPandas(store.tidy(anchors), "anchor long, doc_id long, place long, weight byte"), "anchor-runs")
    words_under = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)) + (window - 1)
    often = runs.groupBy("anchor").agg(F.sum("weight").alias("n"), F.sum(words_under).alias("words")).where("n > 1")
    often = often.select("anchor", ((F.col("n") > hot) | (F.col("words") > hot_words)).alias("hot"))
    held = runs.drop("weight").join(often, "anchor").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "place", "hot")).alias("runs"))

    def cut_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Segments (hi negative) and, of single windows that a batch has several
        times, the words that they cover (first to hi): these are found already, so
        one of them goes on with their number, and none asks for the answer."""
        rows, size, windows = [], 0, {}

        def batch() -> pd.DataFrame:
            covered: dict[int, list[int]] = {}
            for digest, (anchor, piece, places) in windows.items():
                rows.append((anchor, *places[0], digest, piece, len(places), len(places) > 1, -1))
                if len(places) > 1:
                    for doc_id, at in places:
                        covered.setdefault(doc_id, []).append(at)
            for doc_id, starts in covered.items():
                rows.extend((0, doc_id, lo, None, None, 0, True, hi) for lo, hi in _spans(np.unique(starts), window))
            return pd.DataFrame(rows, columns=["anchor", "doc_id", "first", "seg", "words", "copies", "found", "hi"])

        for frame in frames:
            for doc_id, whole, own in zip(frame["doc_id"], frame["text"], frame["runs"], strict=True):
                words = split_words(whole)
                for run in own:
                    first, n = run["place"] >> 32, run["place"] & 0xFFFFFFFF
                    if not run["hot"]:
                        piece = b" ".join(words[first : first + n + window - 1])
                        rows.append((run["anchor"], doc_id, first, hashlib.md5(piece).digest(), piece, 1, False, -1))
                        size += 64 + len(piece)
                    for at in range(first, first + n) if run["hot"] else ():
                        piece = b" ".join(words[at : at + window])
                        digest = hashlib.md5(piece).digest()
                        if digest in windows:
                            windows[digest][2].append((doc_id, at))
                            size += 64
                        else:
                            windows[digest] = (int.from_bytes(digest[:8], "little", signed=True), piece, [(doc_id, at)])
                            size += 64 + len(piece)
                    if size > 8_000_000:
                        yield batch()
                        rows, size, windows = [], 0, {}
        if size:
            yield batch()

    cut = text.join(held.hint("shuffle_hash"), "doc_id").mapInPandas(store.tidy(cut_out), "anchor long, doc_id long, first int, seg binary, words binary, copies long, found boolean, hi int")
    with store.shuffles_freed(docs.sparkSession):
        pieces = store.staged(cut, "segments")
    store.drop_staged(runs)
    segments = pieces.where("hi < 0")

    def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Count equal segments of a sorted partition before they are shuffled."""
        for frame in frames:
            anchor, seg = frame["anchor"].to_numpy(), frame["seg"].to_numpy()
            new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (seg[1:] != seg[:-1])])) if len(frame) else []
            yield frame.iloc[new].assign(copies=np.add.reduceat(frame["copies"].to_numpy(np.int64), new) if len(frame) else [])

    # Equal segments are counted on either side of one shuffle by anchor, which the shards need anyway.
    combined = segments.select("anchor", "seg", "words", "copies").sortWithinPartitions("anchor", "seg").mapInPandas(store.tidy(combine), "anchor long, seg binary, words binary, copies long")
    distinct = combined.repartition("anchor").groupBy("anchor", "seg").agg(F.sum("copies").alias("copies"), F.first("words").alias("words"))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by anchor; shards end where an anchor does, if they can."""
        held: list[pd.DataFrame] = []
        size = 0
        for frame in frames:
            while len(frame):
                words = np.cumsum(frame["words"].map(lambda b: b.count(b" ") + 2).to_numpy(np.int64))
                i = int(np.searchsorted(words, SHARD - size, "right"))
                if i >= len(frame):
                    held.append(frame)
                    size += int(words[-1])
                    break
                anchor = frame["anchor"].to_numpy()
                i = max(i, 1)
                while i < len(frame) and anchor[i] == anchor[i - 1]:
                    i += 1
                held.append(frame.iloc[:i])
                size += int(words[i - 1])
                frame = frame.iloc[i:]
                if len(frame):
                    yield _search_shard(pd.concat(held), window)
                    held, size = [], 0
                    store.give_back()
        if held:
            yield _search_shard(pd.concat(held), window)

    spans = distinct.sortWithinPartitions("anchor").mapInPandas(store.tidy(search), "anchor long, seg binary, spans array<struct<lo:int,hi:int>>")
    back = segments.where("not found").select("anchor", "seg", "doc_id", "first").join(spans, ["anchor", "seg"])
    moved = F.expr("transform(spans, s -> struct(s.lo + first as lo, s.hi + first as hi))")
    already = pieces.where("hi >= 0").select("doc_id", F.array(F.struct(F.col("first").alias("lo"), "hi")).alias("spans"))
    found = back.select("doc_id", moved.alias("spans")).unionByName(already).groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    with store.shuffles_freed(docs.sparkSession):
        return store.staged(found, "repeats")


def _kept(text: str, spans) -> tuple[int, int, str]:
    """Words, those that go, and the rest as one string: a batch holds no lists of words."""
    words = split_words(text)
    if spans is None or not len(spans):
        return len(words), 0, b" ".join(words).decode("utf-8", "surrogatepass")
    gone = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        gone[s["lo"]] += 1
        gone[s["hi"]] -= 1
    stay = np.cumsum(gone[:-1]) == 0
    return len(words), int((~stay).sum()), b" ".join(compress(words, stay.tolist())).decode("utf-8", "surrogatepass")


def without_repeats(docs: DataFrame, window: int = WINDOW, changed_only: bool = False, **how) -> DataFrame:
    """All rows and columns of ``docs`` with __n_words, __n_removed and __kept (the
    words that stay, joined by one space; null text gives an empty one).

    A word goes if a window covers it whose words also start anywhere else;
    windows are judged on the input.  Rows are told apart by their place in the
    files that ``docs`` is read from (it is written first if it isn't a plain scan),
    so null or repeated doc_ids are rows like others: repeated rows are copies of
    one another, and their windows go from all.  An empty table gives no rows.

    ``changed_only``: of rows that lose no word the text doesn't go through Python;
    their __n_words and __n_removed are 0, their __kept is empty.
    """
    spark_id, names, docs = "__row", docs.columns, store.steady(docs)
    numbered = docs.withColumn(spark_id, F.monotonically_increasing_id())
    found = repeats(numbered.select(F.col(spark_id).alias("doc_id"), "text"), window, **how).withColumnRenamed("doc_id", spark_id)
    joined = numbered.join(found.withColumnRenamed("spans", "__spans").hint("shuffle_hash"), spark_id, "left")

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def keep(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = [_kept(t, s) for t, s in zip(text, spans, strict=True)]
        store.give_back()
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

    text = store.null_safe_text()
    if changed_only:
        text = F.when(F.col("__spans").isNotNull(), text).otherwise(F.lit(""))
    done = joined.withColumn("__out", keep(text, "__spans"))
    return done.select(*[F.col(f"`{c}`") for c in names], F.col("__out.n_words").alias("__n_words"), F.col("__out.n_removed").alias("__n_removed"), F.col("__out.kept").alias("__kept"))
