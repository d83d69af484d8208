"""Periodic text: one line through whole documents puts all windows under one anchor."""

import random

from pyspark.sql import functions as F

from corpusloom.llm import store, substrings
from tests.llm.test_operators import brute_repeats, make


def test_no_anchor_holds_more_than_a_bounded_number_of_words(spark, monkeypatch):
    line = " ".join(f"line{i}" for i in range(9))
    texts = [" ".join([line] * (600 + 7 * i) + [f"end{i}"]) for i in range(16)] + ["same " * 3000, "same " * 40 + "once"]
    staged, seen = substrings.store.staged, {}
    monkeypatch.setattr(substrings.store, "staged", lambda df, label: seen.setdefault(label, staged(df, label)))
    rows = {r["doc_id"]: r for r in substrings.without_repeats(store.staged(make(spark, texts).repartition(3), "docs")).collect()}
    for i, want in enumerate(brute_repeats(texts, 35)):
        assert (rows[i]["__n_words"], rows[i]["__n_removed"], rows[i]["__kept"]) == want
    words = seen["segments"].where("words is not null").dropDuplicates(["anchor", "seg"]).groupBy("anchor").agg(F.sum(F.size(F.split(F.col("words").cast("string"), " "))).alias("n"))
    assert words.agg(F.max("n")).first()[0] <= substrings.HOT_WORDS
    assert seen["segments"].agg(F.sum(F.length("words"))).first()[0] < 3 * sum(map(len, texts))


def test_copies_in_other_batches_are_found(spark):
    """Anchors are whole 64-bit numbers in every batch, whether or not it has windows that it found itself."""
    r = random.Random(6)
    shared = [" ".join(f"v{r.randrange(10**6)}" for _ in range(60)) for _ in range(30)]
    line = " ".join(f"line{i}" for i in range(9))
    texts = [*shared, *[f"{line} " * 300 + t for t in shared[:15]], *shared[15:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8, "doc_id")
    rows = {x["doc_id"]: x for x in substrings.without_repeats(store.staged(docs, "docs"), hot=20, hot_words=2000).collect()}
    for i, want in enumerate(brute_repeats(texts, 35)):
        assert (rows[i]["__n_words"], rows[i]["__n_removed"], rows[i]["__kept"]) == want
