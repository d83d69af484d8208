"""Byte-level BPE by a local rank file: encoding and decoding with the tiktoken library.

Texts of up to ``CHUNK`` characters are given to the library whole.  A longer
one is cut first, at places where the pattern ends a match whatever stands
before or behind: after a visible ASCII character that a blank or a line feed
follows; where a stretch has none, after a letter that no letter follows, a
digit that no digit follows, anything visible before white space, or before the
last of several blanks.  A single match (a word or a run of blanks of any
length) is never cut, so the ids are those of the whole text, and the library's
memory grows with the longest match, not with the text.  A run of blanks of
more than ``CHUNK`` is known to be one match; it is given to the library as
such, since the pattern's look-ahead would exhaust the matcher's stack.

Decoding gives raw bytes: ids of half a character decode to half a character.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import store, subwords

CHUNK = 100_000
#: The place behind it ends a match for every pattern of words with at most one blank before them.
_VISIBLE = re.compile(r"[!-~](?=[ \n])")
_ENCODERS: dict[tuple[str, str], RankEncoder] = {}


class RankEncoder:
    """Encodes and decodes; ``path`` has a base64 token and its rank a line."""

    def __init__(self, path: str, pattern: str, chunk: int = CHUNK):
        import regex
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        self.library = tiktoken.Encoding("local ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.one_match = tiktoken.Encoding("local ranks, one match", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.chunk = chunk
        self.change = regex.compile(r"\p{L}(?!\p{L})|\p{N}(?!\p{N})|\S(?=\s)|\s(?=\s\S)")
        self.blank = regex.compile(r"\s+")

    def pieces(self, text: str) -> Iterator[str]:
        """Parts of a text whose ids, one after another, are the text's."""
        at = 0
        while len(text) - at > self.chunk:
            near = at + self.chunk
            found = _VISIBLE.search(text, near, near + self.chunk) or self.change.search(text, near)
            end = found.end() if found else len(text)
            if end - at > 2 * self.chunk:  # a long match: it begins at the last place before
                before = [m.end() for m in self.change.finditer(text, at, near + 1) if m.end() <= near]
                if before:
                    yield text[at : before[-1]]
                    at = before[-1]
            yield text[at:end]
            at = end
        if at < len(text):
            yield text[at:]

    def _ids(self, piece: str) -> np.ndarray:
        library = self.one_match if len(piece) > self.chunk and self.blank.fullmatch(piece) else self.library
        return library.encode_to_numpy(piece, disallowed_special=())

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, special tokens' names being plain text."""
        found = [self._ids(p) for p in self.pieces(text)]
        return found[0] if len(found) == 1 else np.concatenate([np.zeros(0, np.uint32), *found])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for; an id without a rank is an error."""
        return self.library.decode_bytes(ids.tolist())


def encoder(path: str, pattern: str) -> RankEncoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = RankEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Per row: doc_id and ids (array of int) of its whole ``text``.

    Null text counts as empty and has no ids; repeated rows and null doc_ids
    each keep their row; further columns of ``docs`` are not carried, so their
    names can't clash.  An empty table gives an empty one.  No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks, pattern)
        for batch in batches:
            for at, texts in subwords.slices(batch.column("text")):
                found = [enc.encode(t) for t in texts.to_pylist()]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int64)
                flat = pa.array(np.concatenate([np.zeros(0, np.uint32), *found]).astype(np.int32))
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), ids], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", store.null_safe_text().alias("text")).mapInArrow(store.tidy(run), f"doc_id {kind}, ids array<int>")


def decode(tokens: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``tokens`` (doc_id, ids) with the bytes ``decoded``; null ids give null bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks, pattern)
        for batch in batches:
            lists = batch.column("ids")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            missing = lists.is_null().to_numpy(zero_copy_only=False)
            found = [None if no else enc.decode(flat[a:b]) for a, b, no in zip(ends[:-1], ends[1:], missing, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(found, pa.binary())], ["doc_id", "ids", "decoded"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(store.tidy(run), f"doc_id {kind}, ids array<int>, decoded binary")


def decimal_text(ids: str):
    """Ids as decimal numbers with single blanks between them."""
    return F.array_join(F.col(ids).cast("array<string>"), " ")
