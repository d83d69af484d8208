"""The pipeline's stages, one after another, against plain Python on a small corpus."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from corpusloom.llm import langid, subwords
from corpusloom.llm import queries as llm_queries
from tests.llm.test_operators import brute_repeats, brute_simhash, reshared

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(1)
    words = {"en": ["the", "house", "with", "things", "and", "over"], "fr": ["le", "maison", "avec", "chose", "et", "sur"], "de": ["das", "haus", "mit", "ding", "und", "am"]}
    rows = []
    passage = " ".join(f"shared{i}" for i in range(60))
    for i in range(240):
        lang = r.choice(list(words))
        text = " ".join(r.choice(words[lang]) + (r.choice("xyz") if r.random() < 0.1 else "") for _ in range(r.randint(3, 150)))
        if i % 17 == 0:
            text += " " + passage
        if i % 23 == 5:
            text = rows[i - 3][1]
        if i % 61 == 7:
            text = r.choice([None, "", "1234 !!"])
        rows.append((i, text, lang, "hot" if i % 3 == 0 else r.choice(["a", "b", None]), None if text is None else len(text)))
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def as_dicts(df):
    return [r.asDict() for r in df.collect()]


def test_stages(spark, folder, tmp_path):
    docs, frames = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        frames.append((as_dicts(docs), as_dicts(spark.read.parquet(f"{tmp_path}/{name}"))))
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS

    before, after = frames[0]
    model = langid.train(spark.read.parquet(f"{folder}/documents.parquet"))
    stay = {d["doc_id"] for d in before if (p := model.predict(d["text"]))[0] != "und" and p[1] >= model.threshold}
    assert {d["doc_id"] for d in after} == stay
    assert all(d["doc_id"] in stay for d in before if d["text"] and len(d["text"]) > 40)  # clean documents stay

    before, after = frames[1]
    ids = sorted(d["doc_id"] for d in before)
    fps = {d["doc_id"]: brute_simhash(d["text"]) for d in before}
    root = {i: i for i in ids}
    for _ in ids:
        root = {i: min(root[j] for j in ids if (fps[i] ^ fps[j]).bit_count() <= 2) for i in ids}
    assert sorted(d["doc_id"] for d in after) == sorted({i for i in ids if root[i] == i})
    assert len(after) < len(before)

    before, after = frames[2]
    order = [d["doc_id"] for d in before]
    want = dict(zip(order, brute_repeats([d["text"] for d in before], 35), strict=True))
    text = {d["doc_id"]: d["text"] for d in before}
    assert sum(w[1] for w in want.values()) > 0
    for d in after:
        n, removed, kept = want[d["doc_id"]]
        assert d["text"] == (kept if removed else text[d["doc_id"]]) and d["n_chars"] == len(d["text"])

    before, after = frames[3]
    sources = [*sorted({d["source"] for d in before} - {None}), *([None] if any(d["source"] is None for d in before) else [])]
    size = {d["doc_id"]: len(d["text"].split()) for d in before}
    total = [sum(size[d["doc_id"]] for d in before if d["source"] == s) for s in sources]
    expected = Counter()
    for s, t, target in zip(sources, total, reshared(total, [(5, 2, 1)[i % 3] for i in range(len(sources))]), strict=True):
        key = "7:" + ("null" if s is None else "s" + s)
        offset = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) / 2**32
        for k, d in enumerate(sorted((d for d in before if d["source"] == s), key=lambda d: (size[d["doc_id"]], d["doc_id"])), 1):
            expected[d["doc_id"]] += min(2, math.floor(k * target / t + offset) - math.floor((k - 1) * target / t + offset))
    assert Counter(d["doc_id"] for d in after) == +expected

    before, after = frames[4]
    tokenizer = subwords.encoder(public_tokenizers.path("byte_bpe_50k.json"), "bytes").tokenizer
    pieces = Counter()
    for d in before:
        ids = np.array([*tokenizer.encode(d["text"], add_special_tokens=False).ids, 0], "<u4")
        at = 0
        while at < len(ids):
            n = 1024 if len(ids) - at >= 1024 else 1 << ((len(ids) - at).bit_length() - 1)
            pieces[d["doc_id"], at, ids[at : at + n].tobytes()] += 1
            at += n
    assert Counter((d["doc_id"], d["start"], bytes(d["ids"])) for d in after) == pieces


def test_run_is_the_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and {r["length"] for r in rows} <= {1 << b for b in range(11)}


def test_every_operator_has_a_query():
    names = list(llm_queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(llm_queries.ORACLE_SQL) <= set(names)
