"""Token ids in files of fixed-width bit fields.

File layout (all integers little endian):

* ``CLTB0001``;
* blocks of ``block`` ids (the last may have fewer), every id in ``width``
  bits, ``width`` being what the largest id of the vocabulary needs; a block
  is a whole number of 64-bit words, so the place of any id follows from its
  position;
* the index: per document its id, whether that id is null, and the position of
  its first id in the file; then the byte offset of every block;
* a trailer: number of documents, of ids, of blocks, ids per block, width, and
  the index's byte offset, six 64-bit integers.

Documents stand in ascending ``doc_id`` order (null first, equal ids by text),
each file holds one range of them, and files are numbered in the same order.
A file is written under another name and moved when complete, so a repeated
task leaves one whole file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import store, subwords

MAGIC = b"CLTB0001"
BLOCK = 4096


def bit_width(vocab_size: int) -> int:
    """Bits that hold every id below ``vocab_size``."""
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> np.ndarray:
    """Ids as 64-bit words, ``width`` bits an id, lowest bits first."""
    rows = -(-len(ids) // 64)
    grid = np.zeros((rows, 64), np.uint64)
    grid.ravel()[: len(ids)] = ids
    words = np.zeros((rows, width), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        words[:, word] |= grid[:, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= grid[:, j] >> np.uint64(64 - shift)
    return words.ravel()[: -(-len(ids) * width // 64)]


def unpack(words: np.ndarray, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of ``words`` as unsigned 32-bit integers."""
    rows = -(-n // 64)
    grid = np.zeros((rows, width), np.uint64)
    grid.ravel()[: len(words)] = words
    out, mask = np.empty((rows, 64), np.uint32), np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        value = grid[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (grid[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = value & mask
    return out.ravel()[:n]


class _Writer:
    """Packs ids into blocks as they come; keeps only an open block and the index."""

    def __init__(self, stream, width: int, block: int):
        self.stream, self.width, self.block = stream, width, block
        self.docs, self.nulls, self.starts, self.offsets = [], [], [], []
        self.n, self.rest, self.at = 0, np.zeros(0, np.uint32), len(MAGIC)
        stream.write(MAGIC)

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width).tobytes()
        self.offsets.append(self.at)
        self.at += len(data)
        self.stream.write(data)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, starts: np.ndarray) -> None:
        self.docs.append(doc_ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False))
        self.nulls.append(doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
        self.starts.append(self.n + starts)
        self.n += len(ids)
        held = np.concatenate([self.rest, ids.astype(np.uint32)])
        whole = len(held) - len(held) % self.block
        for at in range(0, whole, self.block):
            self._put(held[at : at + self.block])
        self.rest = held[whole:]

    def close(self) -> None:
        if len(self.rest):
            self._put(self.rest)
        docs = np.concatenate([np.zeros(0, np.int64), *self.docs])
        for part in (docs, np.concatenate([np.zeros(0, np.uint8), *self.nulls]), np.concatenate([np.zeros(0, np.int64), *self.starts]), np.array(self.offsets, np.int64)):
            self.stream.write(part.tobytes())
        self.stream.write(np.array([len(docs), self.n, len(self.offsets), self.block, self.width, self.at], np.int64).tobytes())


class TokenFile:
    """Random access to a file: any document or any span of ids."""

    def __init__(self, uri: str):
        filesystem, path = store.open_fs(uri)
        self.stream = filesystem.open_input_file(path)
        size = self.stream.size()
        self.n_docs, self.n, n_blocks, self.block, self.width, index = np.frombuffer(self.stream.read_at(48, size - 48), np.int64).tolist()
        raw = self.stream.read_at(size - 48 - index, index)
        if self.stream.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} isn't a token file")
        d = self.n_docs
        self.doc_ids = np.frombuffer(raw, np.int64, d)
        self.nulls = np.frombuffer(raw, np.uint8, d, 8 * d).astype(bool)
        self.starts = np.append(np.frombuffer(raw, np.int64, d, 9 * d), self.n)
        self.offsets = np.append(np.frombuffer(raw, np.int64, n_blocks, 17 * d), index)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids at positions ``begin`` to ``end`` of the file; reads only their blocks. A span beyond the file is an error."""
        if begin < 0 or end > self.n:
            raise IndexError(f"the file has {self.n} ids, not those from {begin} to {end}")
        if end <= begin:
            return np.zeros(0, np.uint32)
        first, last = begin // self.block, -(-end // self.block)
        raw = self.stream.read_at(int(self.offsets[last] - self.offsets[first]), int(self.offsets[first]))
        words = np.frombuffer(raw, np.uint64)
        if self.block % 64 == 0:  # then full blocks follow one another without gaps
            got = unpack(words, self.width, min(last * self.block, self.n) - first * self.block)
        else:
            per = -(-self.block * self.width // 64)
            got = np.concatenate([unpack(words[i * per : (i + 1) * per], self.width, min(self.block, self.n - (first + i) * self.block)) for i in range(last - first)])
        return got[begin - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def runs(self, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """Documents in order, as many at once as have ``most`` ids together, or one."""
        i = 0
        while i < self.n_docs:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + most, "right")) - 1)
            j = min(j, self.n_docs)
            yield i, j, self.ids(int(self.starts[i]), int(self.starts[j]))
            i = j


def write_tokens(docs: DataFrame, path: str, tokenizer: str, kind: str, end_id: int, block: int = BLOCK, partitions: int | None = None) -> DataFrame:
    """Encode ``text`` (null: empty), append ``end_id`` to every document, and
    write token files below ``path``.

    Returns the manifest, one row a file: shard, path, n_docs, n_ids.  It is
    written to ``path``/manifest too.  Files come from a range partitioning by
    doc_id, so the files together are one ascending sequence; texts go through
    one shuffle.  Rows that repeat a doc_id each keep a row, ordered by text; null
    doc_ids come first.  An empty table gives no file.
    """
    spark = docs.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", store.null_safe_text().alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").withColumn("shard", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = subwords.encoder(tokenizer, kind)
        width = bit_width(max(enc.vocab_size, end_id + 1))
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return
        shard = first.column("shard")[0].as_py()
        uri, told = f"{path}/shard-{shard:06d}.tokens", []

        def fill(stream) -> None:
            out = _Writer(stream, width, block)
            for batch in (b for some in ([first], batches) for b in some):
                for at, texts in subwords.slices(batch.column("text")):
                    ids, starts = enc.encode(texts)
                    whole = np.insert(ids, starts[1:], end_id)
                    out.add(batch.column("doc_id").slice(at, len(texts)), whole, starts[:-1] + np.arange(len(texts)))
            out.close()
            told.append({"shard": shard, "path": uri, "n_docs": sum(map(len, out.docs)), "n_ids": out.n})

        store.put_whole(uri, fill)
        yield pa.RecordBatch.from_pylist(told, pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    manifest = ordered.mapInArrow(store.tidy(write, "encoders"), "shard int, path string, n_docs long, n_ids long")
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files below ``path``: doc_id, start (ids of all
    documents before it), n_tokens, ids (little-endian unsigned 32-bit).

    One task a file; the only table that is put in order is the manifest.
    """
    manifest = spark.read.schema("shard int, path string, n_docs long, n_ids long").parquet(f"{path}/manifest")
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("base", before).repartition(max(1, manifest.count()))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri, base in zip(frame["path"], frame["base"], strict=True):
                file = TokenFile(uri)
                for i, j, ids in file.runs():
                    starts = file.starts[i : j + 1]
                    data, cut = ids.astype("<u4").tobytes(), 4 * (starts - starts[0])
                    yield pd.DataFrame({
                        "doc_id": pd.array(file.doc_ids[i:j], "Int64").copy() if not file.nulls[i:j].any() else pd.Series(file.doc_ids[i:j]).astype("Int64").mask(file.nulls[i:j]),
                        "start": base + starts[:-1],
                        "n_tokens": np.diff(starts),
                        "ids": [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)],
                    })

    return files.mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")
