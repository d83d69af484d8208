"""Bounds and numbers that must hold whatever the table: rare labels, stored sequence numbers, rows after a shuffle."""

import glob
import random
import tracemalloc

import public_tokenizers
from pyspark.sql import functions as F

from corpusloom.llm import langid, mixing, packing, store, substrings


def test_junk_labels_dont_grow_the_sample(spark):
    rows = [(i, f"word{i} text", "en" if i % 2 else "de") for i in range(40)] + [(100 + i, "junk text", f"junk{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = langid.training_rows(docs, per_language=5, languages=3).collect()
    assert len(kept) <= 15 and {"en", "de"} < {r["lang"] for r in kept} and len({r["lang"] for r in kept}) == 3


def test_training_holds_counts_not_runs():
    """The sample lies in the driver: 400 texts of 7500 characters have 9 million character runs, 72 MB as numbers."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(200)]
    texts = [" ".join(r.choice(words) for _ in range(1500)) for _ in range(400)]
    tracemalloc.start()
    langid.fit(texts, [("en", "de")[i % 2] for i in range(400)], epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6


def test_sequence_numbers_are_stored(spark, tmp_path):
    docs = spark.createDataFrame([(i, "some words " * (i % 40)) for i in range(300)], "doc_id long, text string").repartition(6)
    docs = store.staged(docs, "docs")
    packing.write_buckets(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), "bytes", end_id=0), f"{tmp_path}/p")
    seen = []
    for size in ("128m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found = packing.read_buckets(spark, f"{tmp_path}/p").select("doc_id", "start", "length", "sequence_id").collect()
        seen.append(sorted(map(tuple, found)))
        assert len({r["sequence_id"] for r in found}) == len(found)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1]
    # Six tasks write no file each for every length.
    assert len(glob.glob(f"{tmp_path}/p/bucket=*/*.parquet")) <= len(glob.glob(f"{tmp_path}/p/bucket=*")) + 2


def test_rows_after_a_shuffle_are_written_first(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 50, "a") for i in range(20)], "doc_id long, text string, source string")
    files = store.staged(docs, "docs")
    assert store.steady(files) is files and (plain := files.where("doc_id > 3").select("doc_id", "text")) is store.steady(plain)
    for moved in (files.repartition(3), files.orderBy("doc_id"), files.groupBy("doc_id").agg(F.first("text").alias("text")), files.join(files.select("doc_id"), "doc_id")):
        assert store.steady(moved) is not moved
    shuffled = files.repartition(5, "text")
    want = sorted((r["doc_id"], r["__n_removed"], r["__kept"]) for r in substrings.without_repeats(files.select("doc_id", "text")).collect())
    assert sorted((r["doc_id"], r["__n_removed"], r["__kept"]) for r in substrings.without_repeats(shuffled.select("doc_id", "text")).collect()) == want
    assert sorted((r["doc_id"], r["__copies"]) for r in mixing.mix(shuffled).collect()) == sorted((r["doc_id"], r["__copies"]) for r in mixing.mix(files).collect())
