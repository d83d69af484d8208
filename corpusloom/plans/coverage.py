"""Queries of coverage, planning, joins and counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import coverage as V
from corpusloom.plans import bind as B
from corpusloom.plans.registry import query

_JOINED = f"""WITH {B.WITH_STATUS}, j AS (
    SELECT c.book_id, c.chapter_index, s.status, s.facts_count, coalesce(s.status = 'completed' AND s.source_hash = c.content_hash, false) AS fresh
    FROM chapters c LEFT JOIN status s USING (book_id, chapter_index))"""
_L1 = """SELECT book_id, count(*) AS total, count(*) FILTER (WHERE status = 'completed' AND fresh) AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
    count(*) FILTER (WHERE status IS NULL) AS missing, count(*) FILTER (WHERE status = 'completed' AND NOT fresh) AS outdated FROM j GROUP BY book_id"""
_L2 = """SELECT book_id, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
    count(*) FILTER (WHERE status IS NULL) AS missing, count(*) FILTER (WHERE status = 'completed' AND NOT fresh) AS outdated,
    count(*) FILTER (WHERE status = 'completed' AND facts_count = 0) AS empty, CAST(coalesce(sum(facts_count), 0) AS BIGINT) AS facts,
    coalesce(string_agg(CAST(chapter_index AS VARCHAR), ',' ORDER BY chapter_index) FILTER (WHERE status = 'failed'), '') AS failed_chapters,
    coalesce(string_agg(CAST(chapter_index AS VARCHAR), ',' ORDER BY chapter_index) FILTER (WHERE status = 'completed' AND facts_count = 0), '') AS empty_chapters FROM j GROUP BY book_id"""


@query("agg_l1_cov", f"{_JOINED} {_L1}")
def agg_l1_cov(spark, sf):
    return V.route_coverage(*B.covered(spark, sf))


@query("agg_l2_cov", f"{_JOINED} {_L2}")
def agg_l2_cov(spark, sf):
    return V.fact_coverage(*B.covered(spark, sf))


@query("jn_l1_cov", f"{_JOINED} SELECT book_id, chapter_index, coalesce(status, 'missing') AS status, fresh FROM j WHERE chapter_index BETWEEN 5 AND 30")
def jn_l1_cov(spark, sf):
    c, status = B.covered(spark, sf)
    return V.with_status(c.where("chapter_index between 5 and 30"), status).select("book_id", "chapter_index", F.coalesce("status", F.lit("missing")).alias("status"), "fresh")


@query("jn_l2_cov", f"{_JOINED} SELECT book_id, chapter_index, coalesce(status, 'missing') AS status, facts_count FROM j")
def jn_l2_cov(spark, sf):
    return V.with_status(*B.covered(spark, sf)).select("book_id", "chapter_index", F.coalesce("status", F.lit("missing")).alias("status"), "facts_count")


@query("jn_l1_plan", f"{_JOINED} SELECT book_id, chapter_index FROM j WHERE NOT fresh")
def jn_l1_plan(spark, sf):
    return V.work_list(*B.covered(spark, sf), "all")


_MODES = {"all": "NOT fresh", "retry_failed": "status = 'failed'", "retry_empty": "status = 'completed' AND facts_count = 0", "missing": "status IS NULL"}


@query("jn_l2_plan", _JOINED + " UNION ALL ".join(f" SELECT '{m}' AS mode, book_id, chapter_index FROM j WHERE {w}" for m, w in _MODES.items()))
def jn_l2_plan(spark, sf):
    """The work lists of all modes by one join."""
    return V.work_lists(*B.covered(spark, sf), tuple(_MODES)).select("mode", "book_id", "chapter_index")


@query("agg_cov_percent", f"{_JOINED}, v AS ({_L2}) SELECT book_id, CAST(round(completed * 100.0::DOUBLE / total) AS INT) AS pct, completed || '/' || total || ' chapters' AS label FROM v")
def agg_cov_percent(spark, sf):
    v = agg_l2_cov(spark, sf)
    return v.select("book_id", F.round(F.col("completed") * 100.0 / F.col("total")).cast("int").alias("pct"), F.format_string("%d/%d chapters", "completed", "total").alias("label"))


@query("agg_cov_groups", f"{_JOINED}, v AS ({_L2}) SELECT substr(book_id, 1, 4) AS shelf, string_agg(book_id || ' ' || completed || '/' || total, '; ' ORDER BY book_id) AS coverage FROM v GROUP BY 1")
def agg_cov_groups(spark, sf):
    v = agg_l2_cov(spark, sf).withColumn("text", F.concat("book_id", F.lit(" "), "completed", F.lit("/"), "total"))
    listed = F.array_sort(F.collect_list(F.struct("book_id", "text")))
    return v.groupBy(F.substring("book_id", 1, 4).alias("shelf")).agg(F.array_join(F.transform(listed, lambda x: x["text"]), "; ").alias("coverage"))


@query("jn_books", f"WITH {B.WITH_CHAPTERS}, b AS (SELECT DISTINCT book_id FROM chapters UNION SELECT 'empty-book') SELECT b.book_id, count(c.chapter_index) AS chapters, min(c.chapter_index) AS first_chapter, max(c.chapter_index) AS last_chapter FROM b LEFT JOIN chapters c USING (book_id) GROUP BY 1")
def jn_books(spark, sf):
    c = B.chapters(spark, sf).select("book_id", "chapter_index")
    stats = c.groupBy("book_id").agg(F.count("chapter_index").alias("chapters"), F.min("chapter_index").alias("first_chapter"), F.max("chapter_index").alias("last_chapter"))
    books = c.select("book_id").distinct().union(spark.createDataFrame([("empty-book",)], "book_id string"))
    return books.join(stats, "book_id", "left").withColumn("chapters", F.coalesce("chapters", F.lit(0)))


@query("prj_chapter_meta", f"WITH {B.WITH_CHAPTERS} SELECT book_id, chapter_index, title, content_length, content_hash FROM chapters")
def prj_chapter_meta(spark, sf):
    return B.chapters(spark, sf).select("book_id", "chapter_index", "title", "content_length", "content_hash")


@query("flt_range", f"WITH {B.WITH_STATUS} SELECT book_id, chapter_index, status FROM status WHERE chapter_index BETWEEN 3 AND 20")
def flt_range(spark, sf):
    return B.status(spark, sf).where("chapter_index between 3 and 20").select("book_id", "chapter_index", "status")


@query("flt_point", "SELECT o_orderkey, CAST(o_orderkey % 1500 AS BIGINT) AS doc_id, d.source, d.doc_id IS NOT NULL AS found FROM orders o LEFT JOIN documents d ON d.doc_id = o_orderkey % 1500")
def flt_point(spark, sf):
    keys = B.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 1500).alias("doc_id"))
    docs = B.table(spark, sf, "documents").select("doc_id", "source", F.lit(True).alias("found"))
    return keys.join(docs, "doc_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


@query("flt_chapter_search", f"WITH {B.WITH_CHAPTERS} SELECT book_id, chapter_index, title FROM chapters WHERE contains(CAST(chapter_index AS VARCHAR), '12') OR contains(title, 'the')")
def flt_chapter_search(spark, sf):
    c = B.chapters(spark, sf).select("book_id", "chapter_index", "title")
    return c.where(F.col("chapter_index").cast("string").contains("12") | F.col("title").contains("the"))


@query("jn_chapter_browse", f"WITH {B.WITH_STATUS}, m AS (SELECT book_id, chapter_index, title FROM chapters WHERE doc_id % 3 <> 0) SELECT coalesce(m.book_id, s.book_id) AS book_id, coalesce(m.chapter_index, s.chapter_index) AS chapter_index, coalesce(m.title, '') AS title, coalesce(s.status, 'missing') AS status FROM m FULL JOIN status s ON m.book_id = s.book_id AND m.chapter_index = s.chapter_index")
def jn_chapter_browse(spark, sf):
    meta = B.chapters(spark, sf).where("doc_id % 3 <> 0").select("book_id", "chapter_index", "title")
    joined = meta.join(B.status(spark, sf).select("book_id", "chapter_index", "status"), ["book_id", "chapter_index"], "full_outer")
    return joined.select("book_id", "chapter_index", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("status", F.lit("missing")).alias("status"))


@query("jn_hash_backfill", f"WITH {B.WITH_CHAPTERS} SELECT l.doc_id, coalesce(c.content_hash, '') AS source_hash FROM labels l LEFT JOIN (SELECT * FROM chapters WHERE chapter_index > 10) c USING (doc_id)")
def jn_hash_backfill(spark, sf):
    c = B.chapters(spark, sf).where("chapter_index > 10").select("doc_id", "content_hash")
    return B.table(spark, sf, "labels").select("doc_id").join(c, "doc_id", "left").select("doc_id", F.coalesce("content_hash", F.lit("")).alias("source_hash"))


@query("jn_range_default", f"WITH {B.WITH_CHAPTERS}, b AS (SELECT book_id, min(chapter_index) AS lo, max(chapter_index) AS hi FROM chapters GROUP BY 1) SELECT o_orderkey, book_id, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 7 ELSE lo END AS INT) AS start_chapter, CAST(CASE WHEN o_orderkey % 2 = 0 THEN greatest(7, o_custkey % 30) ELSE hi END AS INT) AS end_chapter FROM orders JOIN b ON book_id = 'src' || (o_custkey % 20)")
def jn_range_default(spark, sf):
    bounds = B.chapters(spark, sf).groupBy("book_id").agg(F.min("chapter_index").alias("lo"), F.max("chapter_index").alias("hi"))
    o = B.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("src"), F.col("o_custkey") % 20).alias("book_id"), F.when(F.col("o_orderkey") % 2 == 0, 7).alias("a"), F.when(F.col("o_orderkey") % 2 == 0, F.greatest(F.lit(7), F.col("o_custkey") % 30)).alias("z"))
    return o.join(bounds, "book_id").select("o_orderkey", "book_id", F.coalesce("a", "lo").cast("int").alias("start_chapter"), F.coalesce("z", "hi").cast("int").alias("end_chapter"))


@query("jn_selection", f"WITH {B.WITH_CHAPTERS}, w AS (SELECT DISTINCT 'src' || (o_custkey % 20) AS book_id, CAST(o_orderkey % 80 AS INT) AS chapter_index FROM orders) SELECT w.book_id, w.chapter_index, CASE WHEN w.chapter_index NOT BETWEEN 1 AND 60 THEN 'outside range' WHEN c.doc_id IS NULL THEN 'missing' ELSE 'selected' END AS outcome FROM w LEFT JOIN chapters c USING (book_id, chapter_index)")
def jn_selection(spark, sf):
    wanted = B.table(spark, sf, "orders").select(F.concat(F.lit("src"), F.col("o_custkey") % 20).alias("book_id"), (F.col("o_orderkey") % 80).cast("int").alias("chapter_index")).distinct()
    joined = wanted.join(B.chapters(spark, sf).select("book_id", "chapter_index", "doc_id"), ["book_id", "chapter_index"], "left")
    return joined.select("book_id", "chapter_index", F.when(~F.col("chapter_index").between(1, 60), "outside range").when(F.col("doc_id").isNull(), "missing").otherwise("selected").alias("outcome"))


_ASKED = "a AS (SELECT 'b' || (o_custkey % 7) AS book_id, CASE WHEN o_orderkey % 9 = 0 THEN 'no-such' ELSE 'brand-' || (o_orderkey % 30) END AS group_key, o_custkey % 4 > 0 AS explicit FROM orders WHERE o_custkey < 60)"


@query("jn_groups", f"""WITH {B.WITH_GROUPS}, {_ASKED}, x AS (SELECT DISTINCT book_id, group_key FROM a WHERE explicit AND book_id IN ('b0', 'b1', 'b5')), w AS (SELECT DISTINCT book_id FROM a),
    n AS (SELECT g.*, count(*) FILTER (WHERE enabled AND group_key <> 'base') OVER (PARTITION BY book_id) AS special FROM groups g)
    SELECT x.book_id, x.group_key, CASE WHEN g.book_id IS NULL THEN 'unknown group' ELSE 'ok' END AS outcome FROM x LEFT JOIN groups g USING (book_id, group_key)
    UNION ALL SELECT n.book_id, n.group_key, 'ok' FROM n JOIN w USING (book_id) WHERE n.book_id NOT IN (SELECT book_id FROM x) AND enabled AND (group_key <> 'base' OR special = 0)""")
def jn_groups(spark, sf):
    """Groups that runs name, an error for unknown ones; of books without named groups all enabled special ones, else all enabled."""
    a = B.table(spark, sf, "orders").where("o_custkey < 60").select(
        F.concat(F.lit("b"), F.col("o_custkey") % 7).alias("book_id"), F.when(F.col("o_orderkey") % 9 == 0, "no-such").otherwise(F.concat(F.lit("brand-"), F.col("o_orderkey") % 30)).alias("group_key"), (F.col("o_custkey") % 4 > 0).alias("explicit"))
    named = a.where("explicit and book_id in ('b0', 'b1', 'b5')").select("book_id", "group_key")
    return V.resolved_groups(B.groups(spark, sf), a.select("book_id"), named)


@query("win_groups_order", f"WITH {B.WITH_GROUPS} SELECT book_id, group_key, row_number() OVER (PARTITION BY book_id ORDER BY CASE WHEN contains(name, '1') THEN 0 ELSE 1 END, updated_at DESC) AS place FROM groups")
def win_groups_order(spark, sf):
    order = Window.partitionBy("book_id").orderBy(F.when(F.col("name").contains("1"), 0).otherwise(1), F.desc("updated_at"))
    return B.groups(spark, sf).select("book_id", "group_key", F.row_number().over(order).cast("long").alias("place"))


_GROUP_STATS = f"WITH {B.WITH_FACTS}, g AS (SELECT DISTINCT book_id, index_group_key FROM facts UNION SELECT 'b0', 'empty'), f AS (SELECT book_id, index_group_key, count(*) AS n, count(DISTINCT chapter_index) AS built, count(DISTINCT CASE WHEN status = 'candidate' THEN chapter_index END) AS failed FROM facts GROUP BY 1, 2) SELECT book_id, index_group_key, coalesce(n, 0) AS facts_count, coalesce(built, 0) AS built, coalesce(failed, 0) AS failed FROM g LEFT JOIN f USING (book_id, index_group_key)"


@query("jn_group_stats", _GROUP_STATS)
def jn_group_stats(spark, sf):
    f = B.facts(spark, sf).select("book_id", "index_group_key", "chapter_index", "status")
    stats = f.groupBy("book_id", "index_group_key").agg(F.count(F.lit(1)).alias("facts_count"), F.count_distinct("chapter_index").alias("built"), F.count_distinct(F.when(F.col("status") == "candidate", F.col("chapter_index"))).alias("failed"))
    groups = f.select("book_id", "index_group_key").distinct().union(spark.createDataFrame([("b0", "empty")], "a string, b string"))
    return groups.join(stats, ["book_id", "index_group_key"], "left").na.fill(0, ["facts_count", "built", "failed"])


@query("agg_group_stats", f"WITH {B.WITH_FACTS} SELECT index_group_key, count(*) AS facts_count, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'candidate') AS candidates FROM facts GROUP BY 1")
def agg_group_stats(spark, sf):
    return B.facts(spark, sf).groupBy("index_group_key").agg(F.count(F.lit(1)).alias("facts_count"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "candidate").alias("candidates"))


_TOTALS = ("documents", "pages", "labels", "events", "conversations", "benchmark", "embeddings", "part")


@query("agg_totals", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TOTALS))
def agg_totals(spark, sf):
    out = None
    for t in _TOTALS:
        n = B.table(spark, sf, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
        out = n if out is None else out.union(n)
    return out


@query("agg_status", f"WITH {B.WITH_STATUS} SELECT 'l2' AS name, status, count(*) AS n FROM status GROUP BY 2 UNION ALL SELECT 'tasks', coalesce(nullif(event_type, ''), 'unknown'), count(*) FROM events GROUP BY 2")
def agg_status(spark, sf):
    l2 = B.status(spark, sf).select(F.lit("l2").alias("name"), "status")
    tasks = B.table(spark, sf, "events").select(F.lit("tasks").alias("name"), F.coalesce(F.nullif("event_type", F.lit("")), F.lit("unknown")).alias("status"))
    return l2.union(tasks).groupBy("name", "status").agg(F.count(F.lit(1)).alias("n"))


@query("agg_status_book", f"WITH {B.WITH_STATUS} SELECT coalesce(book_id, '*') AS book_id, coalesce(status, '*') AS status, count(*) AS n FROM status GROUP BY GROUPING SETS ((book_id, status), (book_id), ())")
def agg_status_book(spark, sf):
    """Counts by book and status, by book, and in all."""
    sets = [[F.col("book_id"), F.col("status")], [F.col("book_id")], []]
    counted = B.status(spark, sf).groupingSets(sets, "book_id", "status").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.coalesce("book_id", F.lit("*")).alias("book_id"), F.coalesce("status", F.lit("*")).alias("status"), "n")


@query("agg_import_status", "SELECT source AS book_id, count(*) AS total, count(*) FILTER (WHERE n_chars < 200) AS failed, CASE WHEN count(*) FILTER (WHERE n_chars < 200) = 0 THEN 'completed' WHEN count(*) FILTER (WHERE n_chars < 200) = count(*) THEN 'failed' ELSE 'completed_with_errors' END AS status FROM documents GROUP BY 1")
def agg_import_status(spark, sf):
    d = B.table(spark, sf, "documents").groupBy(F.col("source").alias("book_id")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.expr("n_chars < 200")).alias("failed"))
    return d.withColumn("status", F.when(F.col("failed") == 0, "completed").when(F.col("failed") == F.col("total"), "failed").otherwise("completed_with_errors"))


@query("agg_progress", f"WITH {B.WITH_RUNS}, r AS (SELECT run_id, CASE WHEN stage = 'user' AND part > 3 THEN 'running' ELSE status END AS status FROM runs) SELECT run_id, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'running') AS running FROM r GROUP BY 1")
def agg_progress(spark, sf):
    r = B.runs(spark, sf).withColumn("status", F.when((F.col("stage") == "user") & (F.col("part") > 3), "running").otherwise(F.col("status")))
    return r.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == x).alias(x) for x in ("completed", "failed", "running")])


@query("agg_count_values", "SELECT event_type AS value, count(*) AS n FROM events WHERE trim(event_type, ' ') <> '' GROUP BY 1")
def agg_count_values(spark, sf):
    return B.table(spark, sf, "events").where("trim(event_type) <> ''").groupBy(F.col("event_type").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_summary_sum", "SELECT user_id, count(*) AS total FROM events GROUP BY 1")
def agg_summary_sum(spark, sf):
    kinds = B.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = kinds.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("win_count_entries", "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY n DESC, event_type) AS entries FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def win_count_entries(spark, sf):
    kinds = B.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "event_type", "n")))
    return kinds.groupBy("user_id").agg(F.array_join(F.transform(listed, lambda x: F.concat(x["event_type"], F.lit("="), x["n"])), ",").alias("entries"))


@query("src_batches", f"WITH {B.WITH_CHAPTERS}, r AS (SELECT book_id, min(chapter_index) AS a, max(chapter_index) AS z FROM chapters GROUP BY 1) SELECT book_id, CAST(s AS INT) AS batch_start, CAST(least(s + 9, z) AS INT) AS batch_end FROM (SELECT book_id, z, unnest(range(a, z + 1, 10)) AS s FROM r)")
def src_batches(spark, sf):
    r = B.chapters(spark, sf).groupBy("book_id").agg(F.min("chapter_index").alias("start_chapter"), F.max("chapter_index").alias("end_chapter"))
    return V.batches(r).select("book_id", "batch_start", "batch_end")


_MISSING = f"WITH {B.WITH_STATUS}, r AS (SELECT book_id, unnest(range(1, max(chapter_index) + 1)) AS chapter_index FROM chapters GROUP BY book_id), m AS (SELECT book_id, CAST(chapter_index AS INT) AS chapter_index FROM r WHERE NOT EXISTS (SELECT 1 FROM status s WHERE s.book_id = r.book_id AND s.chapter_index = r.chapter_index))"


def _missing(spark, sf, force=False):
    """Requested chapters that aren't stored (with force all of them); labelled documents are the stored ones."""
    r = B.chapters(spark, sf).groupBy("book_id").agg(F.max("chapter_index").alias("z"))
    asked = r.select("book_id", F.explode(F.sequence(F.lit(1), "z")).alias("chapter_index"))
    return asked if force else asked.join(B.status(spark, sf).select("book_id", "chapter_index"), ["book_id", "chapter_index"], "left_anti")


@query("src_missing", f"{_MISSING} SELECT book_id, chapter_index, false AS force FROM m UNION ALL SELECT book_id, CAST(unnest(range(1, max(chapter_index) + 1)) AS INT), true FROM chapters GROUP BY book_id")
def src_missing(spark, sf):
    """What isn't stored, and with force everything that is asked for."""
    return _missing(spark, sf).withColumn("force", F.lit(False)).unionByName(_missing(spark, sf, force=True).withColumn("force", F.lit(True)))


@query("src_fetch_span", f"{_MISSING} SELECT book_id, CAST((chapter_index - 1) // 10 AS INT) AS batch, min(chapter_index) AS first, max(chapter_index) AS last, count(*) AS n FROM m GROUP BY 1, 2")
def src_fetch_span(spark, sf):
    m = _missing(spark, sf).withColumn("batch", F.floor((F.col("chapter_index") - 1) / 10).cast("int"))
    return m.groupBy("book_id", "batch").agg(F.min("chapter_index").alias("first"), F.max("chapter_index").alias("last"), F.count(F.lit(1)).alias("n"))


@query("src_range_guard", "SELECT o_orderkey, CAST(a AS INT) AS start_chapter, CAST(greatest(a, z) AS INT) AS end_chapter, CASE WHEN a < 1 THEN 'bad start' WHEN greatest(a, z) - a + 1 > 100 THEN 'too many' ELSE 'ok' END AS outcome FROM (SELECT o_orderkey, o_orderkey % 50 AS a, o_custkey % 300 AS z FROM orders)")
def src_range_guard(spark, sf):
    a, z = F.col("o_orderkey") % 50, F.greatest(F.col("o_orderkey") % 50, F.col("o_custkey") % 300)
    return B.table(spark, sf, "orders").select("o_orderkey", a.cast("int").alias("start_chapter"), z.cast("int").alias("end_chapter"), F.when(a < 1, "bad start").when(z - a + 1 > 100, "too many").otherwise("ok").alias("outcome"))


_LIVE = "lv AS (SELECT 'src' || (user_id % 25) AS book_id, max(CASE WHEN event_type = 'error' AND user_id < 30 THEN 1 ELSE 0 END) > 0 AS import_live, max(CASE WHEN event_type = 'signup' AND user_id < 60 THEN 1 ELSE 0 END) > 0 AS l1_live, max(CASE WHEN event_type = 'view' AND user_id BETWEEN 60 AND 80 THEN 1 ELSE 0 END) > 0 AS l2_live FROM events GROUP BY 1), gr AS (SELECT 'src' || (p_size % 15) AS book_id, count(DISTINCT p_brand) AS groups FROM part GROUP BY 1)"


def _ledger(spark, sf):
    """Books with their chapters, built chapters, facts, groups and live tasks by type; some books have no chapters."""
    e = B.table(spark, sf, "events")
    one = lambda kind, low, high: F.max(F.when((F.col("event_type") == kind) & F.col("user_id").between(low, high), 1).otherwise(0)) > 0
    live = e.groupBy(F.concat(F.lit("src"), F.col("user_id") % 25).alias("book_id")).agg(one("error", 0, 29).alias("import_live"), one("signup", 0, 59).alias("l1_live"), one("view", 60, 80).alias("l2_live"))
    groups = B.table(spark, sf, "part").groupBy(F.concat(F.lit("src"), F.col("p_size") % 15).alias("book_id")).agg(F.count_distinct("p_brand").alias("groups"))
    return V.ledger(live.select("book_id"), agg_l2_cov(spark, sf), groups, live)


_BOOKS = f"{_JOINED}, v AS ({_L2}), {_LIVE}, bk AS (SELECT lv.*, coalesce(total, 0) AS total, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed, coalesce(facts, 0) AS facts, coalesce(gr.groups, 0) AS groups FROM lv LEFT JOIN v USING (book_id) LEFT JOIN gr USING (book_id))"


@query("jn_journey", f"{_BOOKS} SELECT book_id, CASE WHEN import_live THEN 'importing' WHEN total = 0 THEN 'import' WHEN l1_live THEN 'indexing' WHEN completed = 0 OR failed > completed THEN 'index' WHEN l2_live THEN 'extracting' WHEN groups <= 1 THEN 'groups' ELSE 'ask' END AS step FROM bk")
def jn_journey(spark, sf):
    """The next step of every book: the first rule that holds. One group is the basic one and doesn't count."""
    done = (F.col("completed") > 0) & (F.col("failed") <= F.col("completed"))
    return _ledger(spark, sf).select("book_id", V.journey(F.col("total") > 0, done, F.col("groups"), F.col("import_live"), F.col("l1_live"), F.col("l2_live")).alias("step"))


@query("jn_ledger", f"""{_BOOKS} SELECT book_id, total, CASE WHEN l1_live THEN 'running ' || CAST(CASE WHEN total > 0 THEN round(completed * 100.0::DOUBLE / total) ELSE 0 END AS INT) || '%' WHEN completed = 0 THEN 'none' WHEN completed < total THEN completed || '/' || total ELSE 'done' END AS l1_cell,
    CASE WHEN l2_live THEN 'running' WHEN groups = 0 THEN '0 groups' ELSE groups || ' groups, ' || facts || ' facts' END AS l2_cell, row_number() OVER (ORDER BY CASE WHEN import_live OR l1_live OR l2_live THEN 0 ELSE 1 END, book_id) AS place FROM bk""")
def jn_ledger(spark, sf):
    """Books with the state of both indexes, those with a live task first."""
    b = _ledger(spark, sf)
    live = F.col("import_live") | F.col("l1_live") | F.col("l2_live")
    percent = F.when(F.col("total") > 0, F.round(F.col("completed") * 100.0 / F.col("total"))).otherwise(0).cast("int")
    l1 = F.when(F.col("l1_live"), F.concat(F.lit("running "), percent, F.lit("%"))).when(F.col("completed") == 0, "none").when(F.col("completed") < F.col("total"), F.concat("completed", F.lit("/"), "total")).otherwise("done")
    l2 = F.when(F.col("l2_live"), "running").when(F.col("groups") == 0, "0 groups").otherwise(F.concat("groups", F.lit(" groups, "), "facts", F.lit(" facts")))
    # One row a book, the end of a report: the order is over all of them.
    place = F.row_number().over(Window.orderBy(F.when(live, 0).otherwise(1), "book_id"))
    return b.select("book_id", "total", l1.alias("l1_cell"), l2.alias("l2_cell"), place.cast("long").alias("place"))