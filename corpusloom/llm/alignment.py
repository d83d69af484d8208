"""Alignment of two tokenizers over a corpus, counted outside of memory.

Both tokenizers spell the same bytes of a document.  Where tokens of both end
together, the document is cut into groups; every A token of a group is linked to
every B token of it.  A pair of ids counts as often as documents hold it linked.

1. **Runs.**  Tasks encode documents and gather (pair, document) records in
   blocks of bounded size.  A block's records are sorted by pair, A id first,
   dealt by the A id's radix and written as zstd runs, with the block's own
   pair counts beside them, into one Parquet table.
2. **Counts.**  Pair counts of each radix are merged, a bounded number of
   blocks at a time in as many rounds as needed: a heap of the runs' frames gives
   the least pair that all open frames reach, up to which everything is summed.
   Only sums are shuffled, so a pair that every document holds costs one record a block.
3. **Contributions.**  Each radix's runs, some blocks at a time, meet its
   counts.  In A's order the largest count of every A id is at hand once its
   pairs are read; every run's records then give their documents' sums, which go
   back to the run's block, one row a run, and from there to the documents.

A block has at most about ``LINKS`` records and ``DOCS`` documents, or one document.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import store, subwords

LINKS, DOCS = 4_000_000, 16_384
#: Runs are dealt by the A id modulo this.
RADIX = 64
#: Blocks whose counts are merged at once, and blocks whose runs meet the counts in one task.
FAN_IN = 64
#: Records in a zstd frame, the unit in which runs are read.
FRAME = 65_536
#: Groups with more links than this are counted by their distinct ids.
LARGE = 4096
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


# Runs: frames of columns, each frame its own zstd frame.


def _planes(values: np.ndarray) -> bytes:
    """64-bit integers by byte planes, which compress well where high bytes are zero."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def put_run(*columns: np.ndarray) -> bytes:
    """Equally long integer columns, the first ascending, as one binary."""
    import zstandard

    pack, out = zstandard.ZstdCompressor(level=3), []
    for at in range(0, len(columns[0]), FRAME):
        some = [c[at : at + FRAME] for c in columns]
        some[0] = np.diff(some[0], prepend=0)
        data = pack.compress(b"".join(_planes(c) for c in some))
        out.append(struct.pack("<II", len(data), len(some[0])) + data)
    return b"".join(out)


def frames(run: bytes, columns: int) -> Iterator[list[np.ndarray]]:
    """Frames of a run in order, one unpacked at a time."""
    import zstandard

    unpack, at = zstandard.ZstdDecompressor(), 0
    while at < len(run):
        size, n = struct.unpack_from("<II", run, at)
        raw = np.frombuffer(unpack.decompress(run[at + 8 : at + 8 + size], max_output_size=8 * n * columns), np.uint8)
        some = [np.ascontiguousarray(raw[8 * n * c : 8 * n * (c + 1)].reshape(8, n).T).view("<i8").ravel() for c in range(columns)]
        some[0] = np.cumsum(some[0])
        yield some
        at += 8 + size


def get_run(run: bytes, columns: int) -> list[np.ndarray]:
    found = list(frames(run, columns))
    return [np.concatenate([np.zeros(0, np.int64), *(f[c] for f in found)]) for c in range(columns)]


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their values' sums."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[first], np.add.reduceat(values, first)


def merged(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sums of the runs' (key, count) records by key, in order of keys.

    The heap has every open run by the last key of its frame.  Up to the least
    of these every run is read, so all smaller records can be summed and given
    out; only that run goes on to its next frame.
    """
    sources = [frames(r, 2) for r in runs]
    open_, heap = {}, []
    for i, source in enumerate(sources):
        if (frame := next(source, None)) is not None:
            open_[i] = frame
            heap.append((int(frame[0][-1]), i))
    heapq.heapify(heap)
    while heap:
        reach, _ = heap[0]
        keys, counts = [], []
        for i, (k, c) in list(open_.items()):
            n = int(np.searchsorted(k, reach, "right"))
            keys.append(k[:n])
            counts.append(c[:n])
            open_[i] = [k[n:], c[n:]]
        yield _summed(np.concatenate(keys), np.concatenate(counts))
        while heap and heap[0][0] == reach:
            _, i = heapq.heappop(heap)
            if (frame := next(sources[i], None)) is None:
                del open_[i]
            else:
                open_[i] = frame
                heapq.heappush(heap, (int(frame[0][-1]), i))


# Tokens of both sides.


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: visible
    Latin-1 characters are their own, all others follow from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted({*range(256)} - {*own})
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Encodes texts by both files and cuts them where tokens of both end."""

    def __init__(self, json_file: str, model_file: str):
        import sentencepiece

        self.a = subwords.UnitEncoder(json_file, "spaced")
        byte = _byte_of()
        self.a_bytes = [b""] * self.a.vocab_size
        special = self.a.tokenizer.get_added_tokens_decoder()
        for token, i in self.a.tokenizer.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = special[i].content.encode() if i in special else bytes(byte[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_length, self.b_length = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        ids_a, ids_b = [str(i) for i in range(len(self.a_bytes))], [str(i) for i in range(n)]
        # An id's text as it stands inside a group, and at its side's end.
        self.names = np.array([*(x + "," for x in ids_a), *(x + "|" for x in ids_a), *(x + "," for x in ids_b), *(x + ";" for x in ids_b)], object)

    def _spelled(self, table: list[bytes], lengths: np.ndarray, ids: np.ndarray, begin: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Which texts the tokens spell."""
        joined = b"".join(map(table.__getitem__, ids.tolist()))
        ends = np.concatenate([[0], np.cumsum(lengths[ids])])[begin]
        return np.array([joined[s:e] == r for s, e, r in zip(ends[:-1].tolist(), ends[1:].tolist(), raw, strict=True)], bool)

    def align(self, texts: list[str]) -> Aligned:
        """Texts must not be empty."""
        raw = [(" " + t).encode() for t in texts]
        a, a_begin = self.a.encode(texts)
        lists = self.b.encode(texts, num_threads=1)
        b_begin = np.cumsum([0, *map(len, lists)], dtype=np.int64)
        b = np.fromiter((i for ids in lists for i in ids), np.int64, int(b_begin[-1]))
        a = a.astype(np.int64)
        fine = self._spelled(self.a_bytes, self.a_length, a, a_begin, raw) & self._spelled(self.b_bytes, self.b_length, b, b_begin, raw)
        n_a, n_b = np.diff(a_begin), np.diff(b_begin)
        if not fine.all():
            a, b = a[np.repeat(fine, n_a)], b[np.repeat(fine, n_b)]
        return Aligned(self, a, b, np.where(fine, n_a, 0), np.where(fine, n_b, 0))


class Aligned:
    """Tokens and groups of some texts, one after another; groups never span texts, since both sides end with each."""

    def __init__(self, of: Aligner, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
        self.of, self.a, self.b, self.n_a, self.n_b = of, a, b, n_a, n_b
        a_ends, b_ends = np.cumsum(of.a_length[a]), np.cumsum(of.b_length[b])
        self.a_last, self.b_last = np.isin(a_ends, b_ends, assume_unique=True), np.isin(b_ends, a_ends, assume_unique=True)
        self.a_group, self.b_group = np.cumsum(self.a_last) - self.a_last, np.cumsum(self.b_last) - self.b_last
        n = int(self.a_last.sum())
        self.p, self.q = np.bincount(self.a_group, minlength=n), np.bincount(self.b_group, minlength=n)
        self.a_from, self.b_from = np.cumsum(self.p) - self.p, np.cumsum(self.q) - self.q
        text_of_a = np.repeat(np.arange(len(n_a)), n_a)
        self.text_of = text_of_a[self.a_last]
        self.n_groups = np.bincount(self.text_of, minlength=len(n_a))
        self.n_links = np.zeros(len(n_a), np.int64)
        np.add.at(self.n_links, self.text_of, self.p * self.q)

    def texts(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of every text."""
        n, m = len(self.of.a_bytes), len(self.of.b_bytes)
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[np.arange(len(self.a)) + self.b_from[self.a_group]] = self.a + n * self.a_last
        b = self.b_group
        code[np.arange(len(self.b)) + self.a_from[b] + self.p[b]] = 2 * n + self.b + m * self.b_last
        names = self.of.names[code].tolist()
        ends = np.cumsum([0, *(self.n_a + self.n_b)]).tolist()
        return ["".join(names[s:e])[:-1] for s, e in zip(ends[:-1], ends[1:], strict=True)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys (A id times the number of B ids, plus B id), texts and links of every pair of every text.

        A group's links are written out one by one where they are few, else by
        its distinct ids: a long stretch without a common end has few of them.
        """
        m, links = len(self.of.b_bytes), self.p * self.q
        small = links <= LARGE
        at = np.flatnonzero(small[self.a_group])
        g = self.a_group[at]
        reps = self.q[g]
        before = np.cumsum(reps) - reps
        b_at = np.repeat(self.b_from[g] - before, reps) + np.arange(int(reps.sum()))
        keys, texts = np.repeat(self.a[at], reps) * m + self.b[b_at], np.repeat(self.text_of[g], reps)
        order = np.lexsort((texts, keys))
        keys, texts = keys[order], texts[order]
        first = np.flatnonzero((np.diff(keys, prepend=-1) != 0) | (np.diff(texts, prepend=-1) != 0))
        n = np.diff(np.append(first, len(keys)))
        keys, texts = keys[first], texts[first]
        large = np.flatnonzero(~small)
        if not len(large):
            return keys, texts, n
        more = [(keys, texts, n)]
        for i in large.tolist():
            x, nx = np.unique(self.a[self.a_from[i] : self.a_from[i] + self.p[i]], return_counts=True)
            y, ny = np.unique(self.b[self.b_from[i] : self.b_from[i] + self.q[i]], return_counts=True)
            more.append(((x[:, None] * m + y).ravel(), np.full(len(x) * len(y), self.text_of[i]), np.outer(nx, ny).ravel()))
        keys, texts, n = (np.concatenate(c) for c in zip(*more, strict=True))
        order = np.lexsort((texts, keys))
        keys, texts, n = keys[order], texts[order], n[order]
        first = np.flatnonzero((np.diff(keys, prepend=-1) != 0) | (np.diff(texts, prepend=-1) != 0))
        return keys[first], texts[first], np.add.reduceat(n, first)


def aligner(json_file: str, model_file: str) -> Aligner:
    """One for each Python worker; workers are used again by later tasks."""
    if (json_file, model_file) not in _ALIGNERS:
        _ALIGNERS[json_file, model_file] = Aligner(json_file, model_file)
    return _ALIGNERS[json_file, model_file]


_TABLE = pa.schema([
    ("part", pa.int32()), ("block", pa.int64()), ("idx", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("run", pa.binary()), ("counts", pa.binary()),
])
_TABLE_DDL = "part int, block long, idx int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, run binary, counts binary"


class _Block:
    """Records of some documents, until they are dealt out as runs."""

    def __init__(self, number: int, columns: int):
        self.number, self.columns, self.docs, self.held, self.kept = number, columns, 0, 0, []

    def add(self, keys: np.ndarray, texts: np.ndarray, links: np.ndarray, n: int) -> None:
        self.kept.append((keys, texts + self.docs, links))
        self.docs += n
        self.held += len(keys)

    def rows(self) -> pa.RecordBatch | None:
        keys, docs, links = (np.concatenate(c) for c in zip(*self.kept, strict=True))
        radix = keys // self.columns % RADIX
        order = np.lexsort((docs, keys, radix))
        keys, docs, links, radix = keys[order], docs[order], links[order], radix[order]
        cuts = np.searchsorted(radix, np.arange(RADIX + 1))
        out = []
        for part, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if e > s:
                own = keys[s:e]
                first = np.flatnonzero(np.diff(own, prepend=-1))
                counts = put_run(own[first], np.diff(np.append(first, e - s)))
                out.append({"part": part, "block": self.number, "run": put_run(own, docs[s:e], links[s:e]), "counts": counts})
        return pa.RecordBatch.from_pylist(out, _TABLE) if out else None


def _runs(docs: DataFrame, json_file: str, model_file: str, digest: bool) -> DataFrame:
    """A row a document (part -1) and a row a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, block, task = aligner(json_file, model_file), None, 0
        for batch in batches:
            task = batch.column("task")[0].as_py() if len(batch) else task
            for at, texts in subwords.slices(batch.column("text"), 1_500_000):
                values = texts.to_pylist()
                full = [i for i, t in enumerate(values) if t]
                got = of.align([values[i] for i in full])
                if block is None or (block.docs and block.docs + len(values) > DOCS):
                    if block is not None and (rows := block.rows()):
                        yield rows
                    block = _Block(task << 24 if block is None else block.number + 1, len(of.b_bytes))
                began = block.docs
                keys, which, links = got.pairs()
                where = np.array(full, np.int64)
                block.add(keys, where[which] if len(which) else which, links, len(values))
                told = [np.zeros(len(values), np.int64) for _ in range(4)]
                for column, found in zip(told, (got.n_a, got.n_b, got.n_groups, got.n_links), strict=True):
                    column[where] = found
                groups = [""] * len(values)
                for i, text, n in zip(full, got.texts(), got.n_a.tolist(), strict=True):
                    groups[i] = hashlib.sha256(text.encode()).hexdigest() if digest and n else text
                n = len(values)
                nothing = pa.nulls(n, pa.binary())
                columns = [pa.array(np.full(n, -1, np.int32)), pa.array(np.full(n, block.number)), pa.array(np.arange(began, began + n, dtype=np.int32)), batch.column("doc_id").slice(at, n)]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, told), pa.array(groups, pa.string()), nothing, nothing], schema=_TABLE)
                if block.held >= LINKS:
                    if rows := block.rows():
                        yield rows
                    block = _Block(block.number + 1, len(of.b_bytes))
        if block is not None and block.kept and (rows := block.rows()):
            yield rows

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), store.null_safe_text().alias("text"), F.spark_partition_id().cast("long").alias("task"))
    return texts.mapInArrow(store.tidy(run), _TABLE_DDL)


def _merge_counts(frame: pd.DataFrame) -> pd.DataFrame:
    runs = [put_run(k, c) for k, c in merged(frame["counts"].tolist())]
    return pd.DataFrame({"part": frame["part"].iloc[:1], "block": frame["block"].iloc[:1], "counts": [b"".join(runs)]})


def _contributions(columns: int):
    """A function of one radix's runs, some blocks, and its counts: per run its documents' sums."""

    def run(_, runs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        if not len(runs):
            return pd.DataFrame({"block": [], "sums": []})
        keys, count = get_run(counts["counts"].iloc[0], 2)
        side = np.flatnonzero(np.diff(keys // columns, prepend=-1))
        best = count == np.repeat(np.maximum.reduceat(count, side), np.diff(np.append(side, len(keys))))
        out = []
        for block, data in zip(runs["block"].tolist(), runs["run"].tolist(), strict=True):
            n_best, total = np.zeros(DOCS, np.int64), np.zeros(DOCS, np.int64)
            for some, docs, links in frames(data, 3):
                if (most := int(docs.max())) >= len(total):
                    n_best, total = (np.concatenate([x, np.zeros(most + 1, np.int64)]) for x in (n_best, total))
                at = np.searchsorted(keys, some)
                np.add.at(n_best, docs, links * best[at])
                np.add.at(total, docs, links * count[at])
            held = np.flatnonzero(total)
            out.append((block, put_run(held, n_best[held], total[held])))
        return pd.DataFrame(out, columns=["block", "sums"])

    return run


def _block_sums(frame: pd.DataFrame) -> pd.DataFrame:
    found = [get_run(x, 3) for x in frame["sums"].tolist()]
    docs, n_best, total = (np.concatenate(c) for c in zip(*found, strict=True))
    held, best = _summed(docs, n_best)
    return pd.DataFrame({"block": frame["block"].iloc[0], "idx": held.astype(np.int32), "n_best": best, "count_sum": _summed(docs, total)[1]})


def align(docs: DataFrame, json_file: str, model_file: str, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents and pair counts.

    Documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups (``a1,a2|b1;a3|b2,b3``; its SHA-256 if ``digest``).  Null and empty
    texts, and those that either side doesn't spell, have zeros and an empty
    string.  Every row is a document of its own, repeated ones and null doc_ids
    too; other columns aren't carried.  Empty tables give empty tables.

    Pairs: a, b, count, is_best (no other b of this a counts more).
    """
    spark = docs.sparkSession
    columns = len(aligner(json_file, model_file).b_bytes)
    table = store.staged(_runs(docs, json_file, model_file, digest), "alignment-runs")
    told = table.where("part < 0").select("block", "idx", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")
    runs = table.where("part >= 0")
    left = told.where("idx = 0").count()
    counts = runs.select("part", "block", "counts")
    while True:
        left = max(1, -(-left // FAN_IN))
        counts = counts.groupBy("part", F.expr(f"pmod(xxhash64(block), {left})")).applyInPandas(_merge_counts, "part int, block long, counts binary")
        if left == 1:
            break
    counts = store.staged(counts, "alignment-counts")
    slices = max(1, -(-told.where("idx = 0").count() // FAN_IN))
    slice_of = F.expr(f"pmod(xxhash64(block), {slices})").cast("int")
    by_slice = counts.select("part", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "counts")
    sums = runs.select("part", slice_of.alias("slice"), "block", "run").groupBy("part", "slice").cogroup(by_slice.groupBy("part", "slice")).applyInPandas(_contributions(columns), "block long, sums binary")
    of_docs = sums.groupBy("block").applyInPandas(_block_sums, "block long, idx int, n_best long, count_sum long")
    zero = F.lit(0).cast("long")
    documents = told.join(of_docs, ["block", "idx"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups")

    def pairs(frames_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames_:
            for data in frame["counts"]:
                keys, count = get_run(data, 2)
                side = np.flatnonzero(np.diff(keys // columns, prepend=-1))
                most = np.repeat(np.maximum.reduceat(count, side), np.diff(np.append(side, len(keys))))
                yield pd.DataFrame({"a": keys // columns, "b": keys % columns, "count": count, "is_best": count == most})

    return documents, counts.select("counts").mapInPandas(pairs, "a long, b long, count long, is_best boolean")
