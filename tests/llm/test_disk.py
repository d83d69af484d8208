"""What an operator leaves on disk while the next of its jobs runs."""

import os
import random
import time

from corpusloom.llm import store, substrings
from tests.llm.test_operators import brute_repeats, make


def _shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = {files.apply(i).getName() for i in range(files.size())}
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def test_repeats_leave_no_shuffle_files_and_no_runs(spark, monkeypatch):
    r = random.Random(4)
    shared = " ".join(f"s{i}" for i in range(50))
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(40)) + f" {shared} end{i}" for i in range(60)]
    docs = store.staged(make(spark, texts).repartition(3), "docs")
    staged, seen = store.staged, {}

    def noted(df, label):
        out = staged(df, label)
        seen[label] = {os.path.dirname(f.removeprefix("file://")) for f in out.inputFiles()}
        return out

    monkeypatch.setattr(store, "staged", noted)
    before = _shuffle_files(spark)
    spans = substrings.repeats(docs)
    end = time.time() + 10
    while (left := _shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.1)
    assert not left
    assert seen["anchor-runs"] and not any(map(os.path.exists, seen["anchor-runs"]))
    assert spark.conf.get(store._FREES) == "false"
    assert spans.count() == len(texts)
    rows = {x["doc_id"]: x for x in substrings.without_repeats(docs).collect()}
    for i, want in enumerate(brute_repeats(texts, 35)):
        assert (rows[i]["__n_words"], rows[i]["__n_removed"], rows[i]["__kept"]) == want
