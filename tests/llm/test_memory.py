"""What a Python worker holds beside its executor's heap."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import store, substrings, subwords
from tests.llm.test_operators import brute_repeats


def _peak(work) -> tuple[object, int]:
    tracemalloc.start()
    out = work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_a_batch_of_kept_texts_holds_no_lists_of_words():
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(100)}" for _ in range(400)) for _ in range(400)]
    spans = [[{"lo": 10, "hi": 50}] if i % 2 else None for i in range(len(texts))]
    rows, peak = _peak(lambda: [substrings._kept(t, s) for t, s in zip(texts, spans, strict=True)])
    assert peak < 3 * sum(map(len, texts))
    words = [t.split() for t in texts]
    assert [x[:2] for x in rows] == [(400, 40 if i % 2 else 0) for i in range(len(texts))]
    assert rows[0][2] == texts[0] and rows[1][2] == " ".join(words[1][:10] + words[1][50:])


def test_the_index_of_a_shard_holds_narrow_columns():
    r = np.random.default_rng(5)
    segments = [b" ".join(b"v%d" % x for x in r.integers(0, 20_000, 60)) for _ in range(1_500)]
    segments[7] = segments[900][: segments[900].rindex(b" ")]
    frame = pd.DataFrame({"anchor": 0, "seg": [b"%d" % i for i in range(len(segments))], "words": segments, "copies": [1] * 1_499 + [2]})
    n = sum(s.count(b" ") + 2 for s in segments)
    found, peak = _peak(lambda: substrings._search_shard(frame, 35))
    assert peak < 150 * n
    assert dict(zip(found["seg"], found["spans"], strict=True)) == {b"7": [{"lo": 0, "hi": 59}], b"900": [{"lo": 0, "hi": 59}], b"1499": [{"lo": 0, "hi": 60}]}


def test_tasks_of_other_operators_drop_the_encoders():
    subwords.encoder(public_tokenizers.path("byte_bpe_50k.json"), "bytes")
    assert list(store.tidy(lambda batches: batches, "encoders")([1])) == [1] and subwords._ENCODERS
    assert list(store.tidy(lambda batches: batches)([2])) == [2] and not subwords._ENCODERS


def test_texts_without_repeats_stay_out_of_python(spark, tmp_path, monkeypatch):
    """The stage cuts what repeats; the texts that it hands to Python are those alone."""
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"a{i}  b{i} \n" + (passage if i % 5 == 0 else f"c{i}") for i in range(30)] + [None, "", passage]
    rows = [(i, t, None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/docs")
    docs, seen = spark.read.parquet(f"{tmp_path}/docs"), []
    made = substrings.without_repeats
    monkeypatch.setattr(substrings, "without_repeats", lambda *a, **b: seen.append(made(*a, **b)) or seen[-1])
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    for (i, text, n), (_, gone, kept) in zip(rows, brute_repeats([t or "" for t in texts], 35), strict=True):
        assert got[i] == ((kept, len(kept)) if gone else (text, n))
    assert seen[0].where("__n_removed = 0").agg(F.sum("__n_words"), F.max("__kept")).first()[:] == (0, "")
