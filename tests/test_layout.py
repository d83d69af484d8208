"""Stored tables: what a change touches, what it leaves, and what a failed one leaves."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import layout as L
from corpusloom.operators import upsert as U

KEYS = ["book_id", "chapter_index"]


def files(folder):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.select("book_id", "chapter_index", "text").collect()), key=str)


@pytest.fixture
def stored(spark, tmp_path):
    old = spark.createDataFrame([(b, c, f"{b}{c}") for b in ("a", "b", "", "ü/x") for c in range(1, 41)] + [(None, 3, "none")], "book_id string, chapter_index int, text string")
    return old, L.store(old, str(tmp_path / "table"), buckets=8, span=10)


def test_an_upsert_rewrites_only_its_partitions(spark, stored):
    old, table = stored
    before = files(table.folder)
    assert rows(table.read()) == rows(old)
    new = spark.createDataFrame([("a", 5, "first", 1), ("a", 5, "last", 2), ("a", 12, "x", 1), ("c", 7, "added", 1)], "book_id string, chapter_index int, text string, pos int")
    table.upsert(new, KEYS)
    assert rows(table.read()) == rows(U.latest(old, new, KEYS))
    after = files(table.folder)
    kept = {f for f, t in before.items() if after.get(f) == t}
    places = {os.path.dirname(f) for f in before} | {os.path.dirname(f) for f in after}
    changed = {os.path.dirname(f) for f in set(before) - kept} | {os.path.dirname(f) for f in set(after) - kept}
    assert len(changed) == 3 and len(places) - len(changed) >= 10
    assert not any(os.path.dirname(f) in changed for f in kept)


def test_a_partition_that_loses_its_last_row_is_empty(spark, stored):
    old, table = stored
    gone = old.where("book_id = 'b' and chapter_index between 10 and 19").select(*KEYS)
    table.change(table.touched(gone), lambda held: U.without(held, gone, KEYS))
    assert rows(table.read()) == rows(U.without(old, gone, KEYS))
    table.upsert(spark.createDataFrame([("b", 11, "again", 1)], "book_id string, chapter_index int, text string, pos int"), KEYS)
    assert ("b", 11, "again") in rows(table.read()) and ("b", 12, "b12") not in rows(table.read())


def test_a_failed_write_leaves_the_old_state(spark, stored):
    old, table = stored
    before = files(table.folder)
    places = table.touched(old.where("book_id = 'a'"))
    broken = F.when(F.col("chapter_index") == 37, F.raise_error(F.lit("killed"))).otherwise(F.lit("new"))
    with pytest.raises(Exception, match="killed"):
        table.change(places, lambda held: held.withColumn("text", broken))
    assert files(table.folder) == before and rows(table.read()) == rows(old)


def test_replacing_and_marking_chapters(spark, tmp_path):
    scope = ["book_id", "chapter_index"]
    facts = spark.createDataFrame([(b, c, f"{b}{c}{k}", "completed") for b in "ab" for c in range(1, 31) for k in range(2)], "book_id string, chapter_index int, text string, status string")
    status = facts.select(*scope).distinct().withColumns({"status": F.lit("completed"), "source_hash": F.lit("old"), "facts_count": F.lit(2)})
    stored = [L.store(t, str(tmp_path / n), buckets=4, span=10) for t, n in ((facts, "facts"), (status, "status"))]
    untouched = {f: t for n in ("facts", "status") for f, t in files(tmp_path / n).items()}
    built = spark.createDataFrame([("a", 3, "completed", "new")], "book_id string, chapter_index int, status string, source_hash string")
    new = spark.createDataFrame([("a", 3, "fresh", False), ("a", 3, "maybe", True)], "book_id string, chapter_index int, text string, candidate boolean")
    L.replace(*stored, built, new, scope)
    want = U.replaced(facts, status, built, new, scope)
    plain = lambda df: sorted(str(sorted(r.asDict().items())) for r in df.collect())
    assert [plain(t.read()) for t in stored] == [plain(t) for t in want]
    changes = spark.createDataFrame([("b", c, "pending", "x") for c in range(1, 31)], built.schema)
    L.mark(*stored, changes, scope)
    assert [plain(t.read()) for t in stored] == [plain(t) for t in U.marked(*want, changes, scope)]
    after = {f: t for n in ("facts", "status") for f, t in files(tmp_path / n).items()}
    assert sum(after.get(f) == t for f, t in untouched.items()) == 6  # the three ranges of a that weren't built, in both tables
