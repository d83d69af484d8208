"""Packing documents into training sequences by powers of two.

A document of n tokens is cut into n // limit pieces of ``limit`` tokens and
one piece for every set bit of the rest, longest first.  A piece is a sequence
of its own, put into the bucket of its length: every bucket holds sequences of
one length, batches need no padding, and no sequence crosses documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import store, subwords


def cut(tokens: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of documents of so many tokens: which document each is of, and its length. ``limit`` is a power of two."""
    full, rest = tokens // limit, tokens % limit
    row, bit = np.nonzero((rest[:, None] >> np.arange(limit.bit_length() - 2, -1, -1)) & 1)
    count = full + np.bincount(row, minlength=len(tokens))
    owner = np.repeat(np.arange(len(tokens)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    length = np.full(len(owner), limit, np.int64)
    length[place >= full[owner]] = limit >> (bit + 1)
    return owner, length


def pack(docs: DataFrame, tokenizer: str, kind: str, end_id: int, limit: int = 1024) -> DataFrame:
    """Pieces of all documents (null text: empty, so its one piece is the end id).

    Columns: doc_id, start (the document's tokens before the piece), length,
    doc_tokens, ids (little-endian unsigned 32-bit), bucket (log2 of length),
    sequence_id and offset (always 0).  One pass, no shuffle: pieces are cut
    where the text is encoded, and Spark's row ids number the sequences.
    Rows with a repeated or null doc_id each give their own sequences; an empty table gives none.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = subwords.encoder(tokenizer, kind)
        for batch in batches:
            for at, texts in subwords.slices(batch.column("text")):
                ids, starts = enc.encode(texts)
                ids = np.insert(ids, starts[1:], end_id).astype("<u4")
                tokens = np.diff(starts) + 1
                owner, length = cut(tokens, limit)
                ends = np.cumsum(length)
                offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(texts)).take(pa.array(owner)),
                        pa.array(ends - length - (np.cumsum(tokens) - tokens)[owner]),
                        pa.array(length),
                        pa.array(tokens[owner]),
                        pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "ids"],
                )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, doc_tokens long, ids binary"
    found = docs.select("doc_id", store.null_safe_text().alias("text")).mapInArrow(store.tidy(pieces, "encoders"), schema)
    return found.withColumns({"bucket": F.log2("length").cast("int"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write sequences as Parquet, one folder for each length, so that whoever trains reads batches of one length.

    Rows are dealt by length into files of about the session's advisory partition size, large lengths into as many as they
    need, so there are few small files whatever the number of tasks.  Sequences keep the number that ``pack`` gave them.
    """
    packed.drop("offset").hint("rebalance", "bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """The sequences of all buckets. ``kind``: the type of doc_id."""
    schema = f"doc_id {kind}, start long, length long, doc_tokens long, ids binary, sequence_id long, bucket int"
    return spark.read.schema(schema).parquet(path).withColumn("offset", F.lit(0).cast("long"))
