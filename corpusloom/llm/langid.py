"""Language identification: averaged hashed subword embeddings, linear softmax.

A text's letters, lower-cased, with one mark for whatever stands between words,
give character runs of two to four; each run is hashed to a row of an embedding
table, the rows are averaged, and a linear layer with softmax scores the
languages.  Table and layer are trained together by stochastic gradient descent
in numpy.  For prediction the two are multiplied into one table of scores.

The training rows are a bounded sample (``PER_LANGUAGE`` of each language, the
smallest hashes of doc_id and text), so the model's size and training time
don't depend on the input.  A training text of up to ``SPANS`` times
``SPAN_CHARS`` characters is used whole, a longer one by that many spans spread
evenly from its begin to its end.  Every row is scored whole.

Calibration: on a fifth of the sample the softmax temperature is fitted, and
the rejection threshold is the score that all but ``REJECTED`` of the rightly
labelled calibration texts reach, less a margin, and never over 0.5.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import store

BUCKETS, DIM, SIZES = 1 << 15, 16, (2, 3, 4)
#: Bound of the training sample: rows of each language, and languages, those with the most labelled rows.
PER_LANGUAGE, LANGUAGES = 600, 200
#: Spans used of a longer training text and characters of each.
SPANS, SPAN_CHARS = 16, 500
REJECTED = 0.001
UNKNOWN = "und"


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text with every run of non-letters as one
    space, a space at both ends; empty if there is no letter."""
    lower = text.lower()
    points = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter(points)
    if not letter.any():
        return np.zeros(0, np.uint32)
    kept = np.where(letter, points, np.uint32(32))
    keep = np.concatenate([[True], letter[1:] | letter[:-1]])
    return np.concatenate([[32], kept[keep], [32]]).astype(np.uint32)


def _is_letter(points: np.ndarray) -> np.ndarray:
    global _table
    if _table is None:
        _table = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _table[np.minimum(points, 0x10FFFF)]


_table: np.ndarray | None = None


def features(text: str) -> np.ndarray:
    """Hash buckets of all character runs of a text."""
    points = letters(text).astype(np.uint64)
    out = []
    for n in SIZES:
        if len(points) >= n:
            h = np.full(len(points) - n + 1, n, np.uint64)
            for j in range(n):
                h = (h ^ points[j : j + len(h)]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
            out.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of ``features`` and how often each occurs, in 6 bytes a bucket: the sample lies in the driver."""
    seen, times = np.unique(features(text), return_counts=True)
    return seen.astype(np.uint16), times.astype(np.uint32)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    """Languages, one score table (bucket by language), bias, temperature and threshold."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0):
        self.languages, self.table, self.bias, self.temperature, self.threshold = languages, table, bias, temperature, threshold

    def logits(self, buckets: np.ndarray) -> np.ndarray:
        counts = np.bincount(buckets, minlength=BUCKETS)
        return counts @ self.table / len(buckets) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated score; ``und`` and 0 for null or a text without letters."""
        buckets = features(text) if text else np.zeros(0, np.int64)
        if not len(buckets) or not self.languages:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(buckets) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def fit(texts: list[str], langs: list[str], epochs: int = 5, rate: float = 0.5, seed: int = 5) -> Model:
    """Train on texts with their languages. Texts without letters are left out."""
    rows = [(f, lang) for t, lang in zip(texts, langs, strict=True) if len((f := counted(t))[0])]
    languages = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    if not rows:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    number = {lang: i for i, lang in enumerate(languages)}
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5] if len(rows) >= 50 else order[:0]
    train = order[len(held) :]
    embed = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    layer, bias = np.zeros((DIM, len(languages))), np.zeros(len(languages))
    steps, step = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            (seen, times), lang = rows[i]
            share = times / times.sum()
            mean = share @ embed[seen]
            wrong = _softmax(mean @ layer + bias)
            wrong[number[lang]] -= 1
            now = rate * (1 - step / steps)
            step += 1
            pull = layer @ wrong
            layer -= now * np.outer(mean, wrong)
            bias -= now * 0.1 * wrong
            embed[seen] -= (now * 20 * share)[:, None] * pull
    model = Model(languages, embed @ layer, bias)
    return _calibrated(model, [rows[i] for i in held], number)


def _calibrated(model: Model, rows: list, number: dict[str, int]) -> Model:
    if not rows:
        return model
    logits = np.array([model.logits(np.repeat(seen.astype(np.int64), times)) for (seen, times), _ in rows])
    truth = np.array([number[lang] for _, lang in rows])
    at = np.arange(len(rows))

    def loss(t: float) -> float:
        return -np.log(_softmax(logits / t)[at, truth] + 1e-12).mean()

    model.temperature = min(np.geomspace(0.05, 20, 60).tolist(), key=loss)
    p = _softmax(logits / model.temperature)
    right = p.argmax(1) == truth
    if right.any():
        model.threshold = float(min(0.5, 0.9 * np.quantile(p.max(1)[right], REJECTED)))
    return model


def spans(text: Column) -> Column:
    """The text, or of a longer one ``SPANS`` spans from its begin to its end."""
    n = F.length(text)
    at = F.transform(F.sequence(F.lit(0), F.lit(SPANS - 1)), lambda i: F.substring(text, F.floor(i * (n - SPAN_CHARS) / (SPANS - 1)).cast("int") + 1, F.lit(SPAN_CHARS)))
    return F.when(n <= SPANS * SPAN_CHARS, text).otherwise(F.array_join(at, "\n"))


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> DataFrame:
    """A bounded sample (lang, text, h): of each of the ``languages`` with the most labelled rows (ties by name) the rows with the smallest hashes.

    So at most ``languages`` times ``per_language`` rows; labels beyond are too rare to be learned, like junk
    in the column, and are never predicted.  Counts by language and the hash's first 12 bits tell which rows can
    be in the sample, so little more than it is shuffled; what is broadcast is one row for each learned language.
    """
    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    rows = rows.withColumn("cell", F.shiftright("h", 52))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = rows.groupBy("lang", "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before)
    last = cells.groupBy("lang").agg(F.max(F.when(F.col("before") < per_language, F.col("cell"))).alias("last"), F.sum("n").alias("n"))
    last = last.orderBy(F.desc("n"), "lang").limit(languages).select("lang", "last")
    near = rows.join(F.broadcast(last), "lang").where("cell <= last").select("lang", spans(F.col("text")).alias("text"), "h")
    first = Window.partitionBy("lang").orderBy("h")
    return near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language).drop("n")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on a bounded sample of the labelled rows of ``docs``; the sample comes to the driver."""
    sample = training_rows(docs, per_language).orderBy("h").toPandas()
    model = fit(sample["text"].tolist(), sample["lang"].tolist())
    del sample
    store.give_back()
    return model


def predict(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred, score and accepted.

    lang_pred is ``und`` (score 0, not accepted) for null text and texts without
    a letter, and everywhere if nothing was learned.  accepted: the score
    reaches the calibrated threshold.  Columns of ``docs`` with these three names
    (after ``prefix``) are replaced.  Rows with repeated or null doc_ids are rows
    like others; an empty table gives none.
    """

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def made(texts: pd.Series) -> pd.DataFrame:
        found = [model.predict(t) for t in texts]
        store.give_back()
        return pd.DataFrame({"lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "accepted": [f[0] != UNKNOWN and f[1] >= model.threshold for f in found]})

    with_out = docs.withColumn("__langid", made(F.col("text").cast("string")))
    added = [F.col(f"__langid.{c}").alias(prefix + c) for c in ("lang_pred", "score", "accepted")]
    return with_out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in {prefix + x for x in ("lang_pred", "score", "accepted")}], *added)


def with_letters(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a letter."""

    @F.pandas_udf("boolean")
    def lettered(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(t) and len(letters(t)) > 0 for t in texts], dtype=bool)

    return docs.where(lettered(F.col("text").cast("string")))
