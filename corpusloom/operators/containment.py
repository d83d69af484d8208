"""Which of many patterns each text contains, for patterns of any length at any place.

A pattern table of checked size is one automaton in every Python worker: each
text is read once, whatever the number of patterns.  A larger one is joined on
runs of characters: a pattern's first 2, 4, 8 or 16 characters (as many as it
has) against all runs of that length in the texts, then ``contains``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of all patterns together that an automaton may have.
MOST_CHARS = 8_000_000
_LENGTHS = (16, 8, 4, 2, 1)
_built: dict[str, ahocorasick.Automaton] = {}


def contained(texts: DataFrame, patterns: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """text_id and pattern, once for every pattern that a text contains.

    ``texts``: text_id (unique), text (null: nothing); ``patterns``: pattern
    (null and empty ones match nothing; repeats don't matter).
    """
    wanted = patterns.select(F.col("pattern").cast("string")).where("pattern <> ''").distinct()
    chars = wanted.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()[0]
    texts = texts.select("text_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return _by_automaton(texts, wanted) if chars <= most_chars else _by_runs(texts, wanted)


def _by_automaton(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    key = uuid.uuid4().hex
    sent = texts.sparkSession.sparkContext.broadcast(sorted(r["pattern"] for r in patterns.collect()))

    def automaton() -> ahocorasick.Automaton:
        if key not in _built:
            _built.clear()
            made = ahocorasick.Automaton()
            for p in sent.value:
                made.add_word(p, p)
            made.make_automaton()
            _built[key] = made
        return _built[key]

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = automaton()
        for frame in frames:
            ids, found = [], []
            if len(made):
                for text_id, text in zip(frame["text_id"], frame["text"], strict=True):
                    hits = {p for _, p in made.iter(text)}
                    ids.extend([text_id] * len(hits))
                    found.extend(hits)
            yield pd.DataFrame({"text_id": pd.Series(ids, dtype=frame["text_id"].dtype), "pattern": pd.Series(found, dtype=object)})

    return texts.mapInPandas(search, f"text_id {texts.schema['text_id'].dataType.simpleString()}, pattern string")


def _by_runs(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    length = F.coalesce(*[F.when(F.length("pattern") >= n, n) for n in _LENGTHS])
    keyed = patterns.withColumn("n", length).withColumn("run", F.substring("pattern", F.lit(1), F.col("n")))
    lengths = [r["n"] for r in keyed.select("n").distinct().collect()]  # at most five
    letters = texts.select("text_id", F.split("text", "").alias("c"))

    def runs_of(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("c") - n + 1))
        return F.transform(places, lambda i: F.array_join(F.slice("c", i, F.lit(n)), ""))

    if not lengths:
        return texts.select("text_id", F.lit("").alias("pattern")).limit(0)
    runs = letters.select("text_id", F.explode(F.array_distinct(F.concat(*map(runs_of, lengths)))).alias("run"))
    near = runs.join(keyed.select("run", "pattern"), "run").select("text_id", "pattern").distinct()
    return near.join(texts, "text_id").where(F.contains("text", "pattern")).select("text_id", "pattern")
