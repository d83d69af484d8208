"""Build coverage and work lists: chapters against stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, by: str, order: str, name: str, stretch: int = 65_536) -> DataFrame:
    """Rows with their number (from 1, column ``name``) within ``by``, ascending by the integer column ``order``.

    Rows are numbered within stretches of ``order`` values, and stretches, of
    which a narrow table holds the counts, are summed up; so no group is one
    task.  Null is a group, and a value before all others; ties get any order.
    """
    cut = F.coalesce(F.floor(F.col(order) / stretch), F.lit(-(1 << 62)))
    rows = rows.withColumn("__cut", cut)
    counts = rows.groupBy(by, "__cut").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(by).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1))
    begun = counts.select(F.col(by).alias("__by"), F.col("__cut").alias("__there"), F.coalesce(before, F.lit(0)).alias("__before"))
    inside = rows.withColumn("__inside", F.row_number().over(Window.partitionBy(by, "__cut").orderBy(order)))
    joined = inside.join(begun, inside[by].eqNullSafe(begun["__by"]) & (inside["__cut"] == begun["__there"]))
    return joined.withColumn(name, (F.col("__before") + F.col("__inside")).cast("int")).drop("__cut", "__by", "__there", "__before", "__inside")


def with_status(chapters: DataFrame, status: DataFrame) -> DataFrame:
    """Chapters with their stored status, and whether it is fresh (completed on the text as it is now)."""
    s = status.select("book_id", "chapter_index", "status", "source_hash", "facts_count")
    joined = chapters.select("book_id", "chapter_index", "content_hash").join(s, ["book_id", "chapter_index"], "left")
    return joined.withColumn("fresh", F.coalesce((F.col("status") == "completed") & (F.col("source_hash") == F.col("content_hash")), F.lit(False)))


def route_coverage(chapters: DataFrame, status: DataFrame) -> DataFrame:
    """Counts by book; an outdated chapter counts as outdated only."""
    bucket = F.when(F.col("status").isNull(), "missing").when((F.col("status") == "completed") & ~F.col("fresh"), "outdated").otherwise(F.col("status"))
    return with_status(chapters, status).withColumn("bucket", bucket).groupBy("book_id").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("bucket") == b).alias(b) for b in ("completed", "failed", "missing", "outdated")])


def fact_coverage(chapters: DataFrame, status: DataFrame) -> DataFrame:
    """Counts by book; an outdated chapter also counts as completed. Failed and empty chapters are listed."""
    done = F.col("status") == "completed"
    empty = done & (F.col("facts_count") == 0)

    def listed(which):
        return F.array_join(F.array_sort(F.collect_list(F.when(which, F.col("chapter_index")))), ",")

    return with_status(chapters, status).groupBy("book_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status").isNull()).alias("missing"), F.count_if(done & ~F.col("fresh")).alias("outdated"),
        F.count_if(empty).alias("empty"), F.coalesce(F.sum("facts_count"), F.lit(0)).cast("long").alias("facts"),
        listed(F.col("status") == "failed").alias("failed_chapters"), listed(empty).alias("empty_chapters"))


def work_list(chapters: DataFrame, status: DataFrame, mode: str, force: bool = False) -> DataFrame:
    """Chapters to build: ``all`` (what isn't fresh, or everything with force),
    ``retry_failed``, ``retry_empty`` (completed without facts) or ``missing``."""
    return work_lists(chapters, status, (mode,), force).select("book_id", "chapter_index")


def work_lists(chapters: DataFrame, status: DataFrame, modes: tuple[str, ...], force: bool = False) -> DataFrame:
    """mode, book_id, chapter_index of several work lists, by one join."""
    wanted = {
        "all": F.lit(True) if force else ~F.col("fresh"),
        "retry_failed": F.coalesce(F.col("status") == "failed", F.lit(False)),
        "retry_empty": F.coalesce((F.col("status") == "completed") & (F.col("facts_count") == 0), F.lit(False)),
        "missing": F.col("status").isNull(),
    }
    hit = F.array_compact(F.array(*[F.when(wanted[m], m) for m in modes]))
    return with_status(chapters, status).select(F.explode(hit).alias("mode"), "book_id", "chapter_index")


def resolved_groups(groups: DataFrame, books: DataFrame, named: DataFrame) -> DataFrame:
    """book_id, group_key, outcome of the groups that runs on ``books`` use.

    Named groups (book_id, group_key; base doesn't count) are taken as they are,
    unknown ones are errors; a book without named ones gets its enabled groups
    other than base, or, if it has none, all enabled.
    """
    asked = named.where("group_key <> 'base'").distinct()
    there = groups.select("book_id", "group_key", F.lit(True).alias("__there")).distinct()
    explicit = asked.join(there, ["book_id", "group_key"], "left").select("book_id", "group_key", F.when(F.col("__there"), "ok").otherwise("unknown group").alias("outcome"))
    special = groups.where("enabled and group_key <> 'base'").select("book_id").distinct().withColumn("__special", F.lit(True))
    left = books.distinct().join(asked.select("book_id").distinct(), "book_id", "left_anti")
    default = groups.where("enabled").join(left, "book_id", "left_semi").join(special, "book_id", "left").where("__special is null or group_key <> 'base'")
    return explicit.unionByName(default.select("book_id", "group_key", F.lit("ok").alias("outcome")))


def ledger(books: DataFrame, coverage: DataFrame, groups: DataFrame, live: DataFrame) -> DataFrame:
    """Books with total, completed, failed and facts (of ``coverage``), groups and live tasks; zeros and false where a book has none."""
    out = books.distinct().join(coverage.select("book_id", "total", "completed", "failed", "facts"), "book_id", "left").join(groups, "book_id", "left").join(live, "book_id", "left")
    return out.withColumns({**{c: F.coalesce(c, F.lit(0)) for c in ("total", "completed", "failed", "facts", "groups")}, **{c: F.coalesce(c, F.lit(False)) for c in ("import_live", "l1_live", "l2_live")}})


def journey(has_content: Column, l1_done: Column, groups: Column, import_live: Column, l1_live: Column, l2_live: Column) -> Column:
    """The next step of a book; the first that applies. The one basic group that every book has doesn't count."""
    return F.when(import_live, "importing").when(~has_content, "import").when(l1_live, "indexing").when(~l1_done, "index").when(l2_live, "extracting").when(groups <= 1, "groups").otherwise("ask")


def batches(ranges: DataFrame, size: int = 10) -> DataFrame:
    """Cut start_chapter to end_chapter into batches of ``size`` (1 to 50)."""
    size = max(1, min(50, size))
    first = F.explode(F.sequence(F.col("start_chapter"), F.col("end_chapter"), F.lit(size)))
    return ranges.withColumn("batch_start", first).withColumn("batch_end", F.least(F.col("batch_start") + size - 1, "end_chapter"))
