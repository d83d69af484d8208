"""Exact token counts of a sentencepiece BPE model, in bounded memory.

A text of up to ``chunk`` characters is encoded whole.  A longer one is read in
chunks that overlap.  Two encodings are spliced at a token that both have, with
the same begin and end, inside the overlap and off its edges: BPE makes a
sequence of tokens out of a text exactly when every two neighbours are what
their own text gives, the shared token stands in such a pair on both sides, so
the spliced sequence is the encoding of the whole.  If no token is shared, the
overlap is widened, in the end to the whole text.
"""

from __future__ import annotations

import re
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import store

_MODELS: dict[str, TokenCounter] = {}
_BYTE = re.compile(r"<0x[0-9A-F]{2}>")
#: Tokens at a chunk's cut edge that may differ in the whole text, so aren't used to splice.
EDGE = 4


class TokenCounter:
    """Counts tokens with the library; ``chunk`` and ``overlap`` in characters."""

    def __init__(self, path: str, chunk: int = 50_000, overlap: int = 400):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = np.array([1 if _BYTE.fullmatch(p) else len(p.replace("▁", " ").encode()) for p in pieces], np.int64)
        self.odd = np.array([self.model.is_unknown(i) or self.model.is_control(i) for i in range(len(pieces))])

    def count_all(self, texts: list[str]) -> list[int]:
        """Token counts of many texts."""
        short = [t for t in texts if len(t) <= self.chunk]
        found = iter([len(x) for x in self.model.encode(short, num_threads=1)] if short else [])
        return [next(found) if len(t) <= self.chunk else self.count_long(t) for t in texts]

    def _tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and their end offsets in bytes; None if tokens don't spell the text."""
        ids = np.array(self.model.encode(text), np.int64)
        ends = np.cumsum(self.bytes_of[ids]) - 1  # the library puts one space before a text
        ok = not self.odd[ids].any() and len(ids) and ends[-1] == len(text.encode())
        return (ids, ends) if ok else None

    def count_long(self, text: str) -> int:
        """Token count of a long text by chunks; whole where chunks can't be aligned."""
        overlap = self.overlap
        while overlap * 2 < self.chunk:
            n = self._spliced(text, overlap)
            if n is not None:
                return n
            overlap *= 4
        return len(self.model.encode(text))

    def _spliced(self, text: str, overlap: int) -> int | None:
        begin = base = 0  # of the chunk, in characters and in bytes
        total = skipped = 0
        left = None  # ids of the chunk before, and their ends counted from the text's begin
        while True:
            end = min(len(text), begin + self.chunk)
            got = self._tokens(text[begin:end])
            if got is None:
                return None
            ids, ends = got[0], got[1] + base
            if left is not None:
                at = self._shared(left, (ids, ends))
                if at is None:
                    return None
                total += at[0] - skipped
                skipped = at[1]
            if end == len(text):
                return total + len(ids) - skipped
            left = (ids, ends)
            base += len(text[begin : end - overlap].encode())
            begin = end - overlap

    @staticmethod
    def _shared(left, right) -> tuple[int, int] | None:
        """A token that both have at the same place: how many tokens of either end with it."""
        (a, a_ends), (b, b_ends) = left, right
        a_keys, b_keys = a_ends[: len(a) - EDGE], b_ends[EDGE:]
        both, i, j = np.intersect1d(a_keys, b_keys, assume_unique=False, return_indices=True)
        j = j + EDGE
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if x and y and a[x] == b[y] and a_ends[x - 1] == b_ends[y - 1]:
                return x + 1, y + 1
        return None


def counter(path: str) -> TokenCounter:
    if path not in _MODELS:
        _MODELS[path] = TokenCounter(path)
    return _MODELS[path]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens (without begin and end), over_limit.

    Null text counts as empty (0 bytes, 0 tokens).  No shuffle; repeated rows
    each keep their row.
    """

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series(counter(model).count_all(texts.tolist()), dtype="int64")

    text = store.null_safe_text()
    found = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)

