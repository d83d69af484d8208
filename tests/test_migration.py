"""Migration of a sealed store: a known answer, damage, wrong keys, targets that exist, empty tables."""

import base64
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import migration as M

KEY = bytes([7]) * 32
BOX = "ciphertext string, iv string, tag string"
SCHEMAS = {
    "books": "book_id string, book_name string",
    "chapters": f"book_id string, chapter_index int, title string, content_hmac string, {BOX}",
    "runs": f"id string, prompt_ciphertext string, prompt_iv string, prompt_tag string, {BOX}",
    "parts": f"analysis_id string, part_key string, stage string, {BOX}",
    "facts": f"id bigint, book_id string, chapter_index int, source_hmac string, {BOX}",
    "routes": "book_id string, chapter_index int, summary string, source_hmac string",
}
ONE, TWO = "Snow fell on the lane.\nEine Straße, ein Tor.", "Nobody came."


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def box(spark):
    def seal(text, aad, key=KEY):
        iv = F.lit(hashlib.md5(aad.encode()).digest()[:12])
        row = spark.range(1).select(*M.sealed(F.lit(text), key, F.lit(aad), iv)).first()
        return tuple(row)

    return seal


@pytest.fixture(scope="module")
def store(spark, box):
    prompt = {"analysis_mode": "l2_query", "l2_query": {"query": "who has the sword?"}, "index_group_keys": ["swords"], "source_review_budget": 3}
    none = (None, None, None)
    long_key = "  " + "k" * 300
    rows = {
        "books": [("a", "Lanes")],
        "chapters": [("a", 1, "Snow", "x", *box(ONE, "chapter:a:1")), ("a", 2, "None", "y", *box(TWO, "chapter:a:2"))],
        "runs": [
            ("good", *box(json.dumps(prompt), "analysis-prompt:good"), *box("# Answer", "analysis-final:good")),
            ("plain", *box('{"analysis_mode":"l2_query","query":"short","index_group_keys":"none"}', "analysis-prompt:plain"), *none),
            ("other", *box('{"analysis_mode":"chapters"}', "analysis-prompt:other"), *box("secret", "analysis-final:other")),
            ("swapped", *box(json.dumps(prompt), "analysis-prompt:good"), *box("secret", "analysis-final:swapped")),
            ("text", *box("no json", "analysis-prompt:text"), *none),
            ("bare", *none, *none),
            ("lost", *box(json.dumps(prompt), "analysis-prompt:lost"), *box("x", "analysis-final:good")),
        ],
        "parts": [("good", "p1", "text", *box("part", "analysis-summary-part:good:p1")), ("good", long_key, "text", *box("long", "analysis-summary-part:good:" + "k" * 240)),
                  ("good", "p3", "text", *none), ("lost", "p1", "text", *box("x", "analysis-summary-part:good:p1")), ("other", "p1", "text", *box("x", "analysis-summary-part:other:p1"))],
        "facts": [(1, "a", 1, "h", *box(json.dumps({"fact": "A sword.", "evidence": ["she takes it"], "review_note": "seen"}), "l2-fact:1")), (2, "a", 9, "h", *box('{"evidence":"one"}', "l2-fact:2")), (3, "a", 2, "h", *box("{}", "l2-fact:1")),
                  (4, "a", 2, "h", *none), (5, "a", 2, "h", "not base64!", "AAAA", "=")],
        "routes": [("a", 1, "first", "h"), ("b", 1, "elsewhere", "h")],
    }
    return {n: spark.createDataFrame(r, SCHEMAS[n]) for n, r in rows.items()}


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_known_answer(spark, store, tmp_path):
    m = M.migrate(spark, store, KEY, str(tmp_path / "plain"))
    assert {r.tbl: r.n for r in m.counts().collect()} == {"books": 1, "chapters": 2, "runs": 3, "runs_skipped": 4, "parts": 4, "facts": 5, "routes": 2}
    chapters = by(m.table("chapters"), "chapter_index")
    assert (chapters[1].content, chapters[1].content_length, chapters[1].content_hash, chapters[2].content) == (ONE, len(ONE), sha(ONE), TWO)
    for name in store:
        assert not {"ciphertext", "iv", "tag", "content_hmac", "source_hmac", "prompt_ciphertext"} & set(m.table(name).columns)
    runs = by(m.table("runs"), "id")
    assert sorted(runs) == ["good", "lost", "plain"]
    assert json.loads(runs["good"].prompt_snapshot) == {"analysis_mode": "l2_query", "query": "who has the sword?", "index_group_keys": ["swords"]}
    assert json.loads(runs["plain"].prompt_snapshot) == {"analysis_mode": "l2_query", "query": "short", "index_group_keys": []}
    assert (runs["good"].result, runs["plain"].result, runs["lost"].result) == ("# Answer", None, None)
    parts = {(k[0], k[1].strip()[:2]): r.result for k, r in by(m.table("parts"), "analysis_id", "part_key").items()}
    assert parts == {("good", "p1"): "part", ("good", "kk"): "long", ("good", "p3"): None, ("lost", "p1"): None}
    facts = {i: (r.fact, r.evidence, r.review_note, r.source_hash) for i, r in by(m.table("facts"), "id").items()}
    assert facts == {1: ("A sword.", ["she takes it"], "seen", sha(ONE)), 2: ("", [], "", ""), 3: ("", [], "", sha(TWO)), 4: ("", [], "", sha(TWO)), 5: ("", [], "", sha(TWO))}
    assert {r.book_id: r.source_hash for r in m.table("routes").collect()} == {"a": sha(ONE), "b": ""}
    said = sorted((r.tbl, r.key, r.message.split(",")[0]) for r in m.warnings().collect())
    assert said == [("facts", "3", "fact can't be read"), ("facts", "5", "fact can't be read"), ("parts", "lost/p1", "result can't be read"), ("runs", "lost", "result can't be read"), ("runs", "swapped", "prompt can't be read"), ("runs", "text", "prompt can't be read")]


def test_no_text_of_a_run_that_stays_behind_is_kept(spark, store, tmp_path):
    folder = str(tmp_path / "plain")
    M.migrate(spark, store, KEY, folder)
    left = spark.read.parquet(f"{folder}/runs").where("not __migrated")
    assert left.count() == 4 and left.where("prompt_snapshot is not null or result is not null").count() == 0


@pytest.mark.parametrize("key", [bytes([8]) * 32, b"short"])
def test_a_wrong_key_leaves_nothing(spark, store, tmp_path, key):
    with pytest.raises(M.MigrationError, match="key"):
        M.migrate(spark, store, key, str(tmp_path / "plain"))
    assert not os.path.exists(tmp_path / "plain")


def test_a_target_isnt_overwritten(spark, store, tmp_path):
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "mine").write_text("x")
    with pytest.raises(M.MigrationError, match="exists"):
        M.migrate(spark, store, KEY, str(tmp_path / "plain"))
    assert (tmp_path / "plain" / "mine").read_text() == "x"


def test_a_plain_store_is_refused(spark, store, tmp_path):
    with pytest.raises(M.MigrationError, match="chapters.ciphertext"):
        M.migrate(spark, {**store, "chapters": store["chapters"].drop("ciphertext")}, KEY, str(tmp_path / "plain"))
    assert not os.path.exists(tmp_path / "plain")


def test_what_isnt_finished_isnt_read(spark, store, tmp_path):
    store["books"].write.parquet(str(tmp_path / "plain" / "books"))
    with pytest.raises(M.MigrationError, match="no finished"):
        M.Migrated(spark, str(tmp_path / "plain")).table("books")


def test_empty_tables(spark, store, tmp_path):
    m = M.migrate(spark, {n: t.limit(0) for n, t in store.items()}, KEY, str(tmp_path / "plain"))
    assert {r.n for r in m.counts().collect()} == {0}
    assert m.table("facts").collect() == [] and m.warnings().collect() == []


def test_sealing_is_the_layout_of_aes_gcm(spark, box):
    """Sizes of the three pieces, and an empty text."""
    c, iv, tag = (base64.b64decode(x) for x in box("äb", "chapter:a:1"))
    assert (len(c), len(iv), len(tag)) == (3, 12, 16)
    empty = spark.createDataFrame([box("", "k")], BOX)
    assert empty.select(M.unsealed(F.col("ciphertext"), F.col("iv"), F.col("tag"), KEY, F.lit("k"))).first()[0] == ""
