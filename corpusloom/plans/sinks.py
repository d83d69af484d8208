"""Queries of upserts, replacements and deletions: each gives the table as it is afterwards."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import tables
from corpusloom.operators import groups as G
from corpusloom.operators import layout as L
from corpusloom.operators import packing as K
from corpusloom.operators import upsert as U
from corpusloom.plans import bind as B
from corpusloom.plans.registry import query


@query("sink_chapter_upsert", f"WITH {B.WITH_CHAPTERS} SELECT book_id, chapter_index, CASE WHEN doc_id % 7 = 0 THEN length(content || '!') ELSE content_length END AS content_length, CASE WHEN doc_id % 7 = 0 THEN sha256(content || '!') ELSE content_hash END AS content_hash FROM chapters")
def sink_chapter_upsert(spark, sf):
    c = B.chapters(spark, sf)
    old = c.select("book_id", "chapter_index", "content_length", "content_hash")
    text = F.concat("content", F.lit("!"))
    changed = c.where("doc_id % 7 = 0").select("book_id", "chapter_index", F.length(text).cast("long").alias("content_length"), F.sha2(text, 256).alias("content_hash"))
    new = changed.withColumn("pos", F.lit(2)).unionByName(changed.withColumns({"pos": F.lit(1), "content_hash": F.lit("older")}))
    stored = L.store(old, tables.new_folder(spark, "chapters"))
    stored.upsert(new, ["book_id", "chapter_index"])
    return stored.read()


@query("sink_l1_upsert", f"WITH {B.WITH_CHAPTERS} SELECT book_id, chapter_index, CASE WHEN doc_id % 5 = 0 AND doc_id % 2 = 0 THEN quality + 10 ELSE quality END AS quality, CAST(doc_id AS BIGINT) AS created_at FROM labels JOIN chapters USING (doc_id)")
def sink_l1_upsert(spark, sf):
    """Route rows of some chapters come again; when they were first made stays."""
    old = B.chapters(spark, sf).select("doc_id", "book_id", "chapter_index").join(B.table(spark, sf, "labels"), "doc_id").select("book_id", "chapter_index", "quality", F.col("doc_id").alias("created_at"))
    old = tables.staged(old, "l1")
    stored = L.store(old, tables.new_folder(spark, "routes"))
    stored.upsert(old.where("created_at % 10 = 0").select("book_id", "chapter_index", (F.col("quality") + 10).alias("quality"), F.lit(-1).cast("long").alias("created_at"), F.lit(1).alias("pos")), ["book_id", "chapter_index"], keep=("created_at",))
    return stored.read()


_F = "id, book_id, index_group_key, chapter_index, fact, status"


_SCOPE = ["book_id", "index_group_key", "chapter_index"]
_GROUP_STATUS = "gs AS (SELECT book_id, index_group_key, chapter_index, 'completed' AS status, 'old' AS source_hash, CAST(count(*) AS INT) AS facts_count FROM facts GROUP BY 1, 2, 3)"


def _group_status(f):
    return f.groupBy(*_SCOPE).agg(F.count(F.lit(1)).cast("int").alias("facts_count")).withColumns({"status": F.lit("completed"), "source_hash": F.lit("old")}).select(*_SCOPE, "status", "source_hash", "facts_count")


@query("sink_l2_replace", f"""WITH {B.WITH_FACTS}, {_GROUP_STATUS}, nf AS (SELECT * FROM facts WHERE chapter_index = 3 AND index_group_key = 'g1' AND fact_type <> 'click')
    SELECT 'fact' AS kind, {_F.replace("fact, status", "fact AS value, status")} FROM facts WHERE NOT (chapter_index = 3 AND index_group_key = 'g1')
    UNION ALL SELECT 'fact', -id, book_id, index_group_key, chapter_index, upper(fact), CASE WHEN fact_type = 'error' THEN 'candidate' ELSE 'completed' END FROM nf
    UNION ALL SELECT 'status', CASE WHEN chapter_index = 3 AND index_group_key = 'g1' THEN (SELECT count(*) FROM nf WHERE nf.book_id = gs.book_id AND fact_type <> 'error') ELSE facts_count END, book_id, index_group_key, chapter_index, CASE WHEN chapter_index = 3 AND index_group_key = 'g1' THEN 'new' ELSE source_hash END, status FROM gs""")
def sink_l2_replace(spark, sf):
    """Facts of rebuilt chapters are replaced, candidates among them aren't counted; the status row says how many there are."""
    f = B.facts(spark, sf)
    old = f.select(*_F.split(", "))
    scope = (F.col("chapter_index") == 3) & (F.col("index_group_key") == "g1")
    new = f.where(scope & (F.col("fact_type") != "click")).withColumns({"id": -F.col("id"), "fact": F.upper("fact"), "candidate": F.col("fact_type") == "error"})
    built = f.where(scope).select(*_SCOPE).distinct().withColumns({"status": F.lit("completed"), "source_hash": F.lit("new")})
    facts, status = (L.store(t, tables.new_folder(spark, name), span=10) for t, name in ((old, "facts"), (_group_status(f), "status")))
    L.replace(facts, status, built, new, _SCOPE)
    return _both(facts.read(), status.read())


def _both(facts, status):
    return facts.select(F.lit("fact").alias("kind"), "id", *_SCOPE, F.col("fact").alias("value"), "status").unionByName(status.select(F.lit("status").alias("kind"), F.col("facts_count").cast("long").alias("id"), *_SCOPE, F.col("source_hash").alias("value"), "status"))


@query("sink_l2_append", f"WITH {B.WITH_FACTS} SELECT id, book_id, 'index' AS review_source FROM facts UNION ALL SELECT -id - 1, book_id, 'historical_rescan' FROM facts WHERE id % 10 = 0")
def sink_l2_append(spark, sf):
    f = B.facts(spark, sf).select("id", "book_id", F.lit("index").alias("review_source"))
    return f.unionByName(f.where("id % 10 = 0").select((-F.col("id") - 1).alias("id"), "book_id", F.lit("historical_rescan").alias("review_source")))


@query("sink_l2_status", f"""WITH {B.WITH_FACTS}, {_GROUP_STATUS}, ch AS (SELECT *, CASE WHEN book_id < 'b15' THEN 'failed' ELSE 'pending' END AS next FROM gs WHERE chapter_index IN (2, 4))
    SELECT 'fact' AS kind, f.id, f.book_id, f.index_group_key, f.chapter_index, f.fact AS value, f.status FROM facts f LEFT JOIN ch USING (book_id, index_group_key, chapter_index) WHERE coalesce(ch.next, 'failed') = 'failed'
    UNION ALL SELECT 'status', CASE WHEN ch.next IS NULL THEN gs.facts_count ELSE 0 END, gs.book_id, gs.index_group_key, gs.chapter_index, CASE WHEN ch.next IS NULL THEN gs.source_hash ELSE 'new' END, coalesce(ch.next, gs.status) FROM gs LEFT JOIN ch USING (book_id, index_group_key, chapter_index)""")
def sink_l2_status(spark, sf):
    """A status without facts: its count is 0, and the chapter's facts go, unless it says failed."""
    f = B.facts(spark, sf)
    status = _group_status(f)
    changes = status.where("chapter_index in (2, 4)").select(*_SCOPE, F.when(F.col("book_id") < "b15", "failed").otherwise("pending").alias("status"), F.lit("new").alias("source_hash"))
    facts, stored = (L.store(t, tables.new_folder(spark, name), span=10) for t, name in ((f.select(*_F.split(", ")), "facts"), (status, "status")))
    L.mark(facts, stored, changes, _SCOPE)
    return _both(facts.read(), stored.read())


@query("sink_subject_clear", f"WITH {B.WITH_FACTS}, s AS (SELECT DISTINCT book_id, index_group_key, entity FROM facts) SELECT * FROM s WHERE NOT (index_group_key = 'g1' AND book_id IN ('b1', 'b2'))")
def sink_subject_clear(spark, sf):
    s = B.facts(spark, sf).select("book_id", "index_group_key", "entity").distinct()
    forced = spark.createDataFrame([("b1", "g1"), ("b2", "g1")], "book_id string, index_group_key string")
    return U.without(s, forced, ["book_id", "index_group_key"])


@query("sink_parts_upsert", f"WITH {B.WITH_RUNS}, r AS (SELECT *, text || text || text AS long FROM (SELECT *, result AS text FROM runs)) SELECT run_id, part, stage, substr(long, 1, 1000) AS input_summary, CAST(least(12000, length(repeat(text, 20))) AS BIGINT) AS trace_chars, CASE WHEN stage = 'assistant' THEN 'completed' ELSE status END AS status FROM r")
def sink_parts_upsert(spark, sf):
    """Parts with a clipped input and trace; those that come again are replaced."""
    r = B.runs(spark, sf).select("run_id", "part", "stage", F.concat("result", "result", "result").alias("input"), F.repeat("result", F.lit(20)).alias("trace"), "status")
    r = r.select("run_id", "part", "stage", F.substring("input", 1, 1000).alias("input_summary"), F.length(F.substring("trace", 1, 12000)).cast("long").alias("trace_chars"), "status")
    return U.latest(r, r.where("stage = 'assistant'").withColumns({"status": F.lit("completed"), "pos": F.lit(1)}), ["run_id", "part"])


@query("sink_group_upsert", f"""WITH {B.WITH_GROUPS}, g AS (SELECT book_id, group_key, name, enabled FROM groups UNION ALL SELECT DISTINCT book_id, 'base', 'Base', true FROM groups), c AS (SELECT book_id, group_key AS wanted, name FROM groups WHERE contains(name, '1')),
    f AS (SELECT c.*, wanted || '-' || (SELECT min(n) FROM range(2, 1000) t(n) WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.book_id = c.book_id AND g.group_key = c.wanted || '-' || n)) AS group_key FROM c)
    SELECT book_id, group_key, CASE WHEN group_key <> 'base' AND contains(name, '2') THEN name || ' (new)' ELSE name END AS name, CASE WHEN group_key <> 'base' AND contains(name, '3') THEN false ELSE enabled END AS enabled FROM g UNION ALL SELECT book_id, group_key, name || ' again', true FROM f""")
def sink_group_upsert(spark, sf):
    """Groups created under a free key, updated field by field, or disabled; the base group can't be changed so."""
    g = B.groups(spark, sf).select("book_id", "group_key", "name", "enabled")
    every = g.unionByName(g.select("book_id").distinct().select("book_id", F.lit("base").alias("group_key"), F.lit("Base").alias("name"), F.lit(True).alias("enabled")))
    updates = every.where(F.col("name").contains("2")).select("book_id", "group_key", F.concat("name", F.lit(" (new)")).alias("name"), F.lit(None).cast("boolean").alias("enabled"))
    off = every.where(F.col("name").contains("3") | (F.col("group_key") == "base")).select("book_id", "group_key", F.lit(None).cast("string").alias("name"), F.lit(False).alias("enabled"))
    asked = updates.unionByName(off).where("group_key <> 'base'").withColumn("pos", F.lit(1))
    changed = U.merged(every, asked.where("name is not null"), ["book_id", "group_key"], ("name",))
    changed = U.merged(changed, asked.where("enabled is not null"), ["book_id", "group_key"], ("enabled",))
    created = G.free_keys(every.select("book_id", "group_key"), g.where(F.col("name").contains("1")).select("book_id", "group_key", F.concat("name", F.lit(" again")).alias("name")))
    return changed.select("book_id", "group_key", "name", "enabled").unionByName(created.select("book_id", F.col("free_key").alias("group_key"), "name", F.lit(True).alias("enabled")))


@query("sink_prompt_upsert", """SELECT 'global' AS scope, -1 AS book, 'rule of AFRICA' AS l1, 'default l2' AS l2 UNION ALL
    SELECT 'book', n_nationkey, CASE WHEN n_regionkey = 1 THEN 'default l1' WHEN n_regionkey = 2 THEN 'new ' || n_name ELSE n_name END, CASE WHEN n_regionkey = 3 THEN 'new ' || n_name ELSE n_comment END FROM (SELECT n_nationkey, n_regionkey, n_name, n_name || ' facts' AS n_comment FROM nation)""")
def sink_prompt_upsert(spark, sf):
    """Rules of all books and of each: only what is given is replaced, a blank falls back to the default."""
    n = B.table(spark, sf, "nation")
    old = n.select(F.lit("book").alias("scope"), F.col("n_nationkey").cast("int").alias("book"), F.col("n_name").alias("l1"), F.concat("n_name", F.lit(" facts")).alias("l2"))
    old = old.unionByName(n.limit(1).select(F.lit("global").alias("scope"), F.lit(-1).alias("book"), F.lit("first").alias("l1"), F.lit("second").alias("l2")))
    r, name = F.col("n_regionkey"), F.col("n_name")
    none = F.lit(None).cast("string")
    new = n.where("n_regionkey in (1, 2, 3)").select(F.lit("book").alias("scope"), F.col("n_nationkey").cast("int").alias("book"), F.when(r == 1, "  ").when(r == 2, F.concat(F.lit("new "), name)).alias("l1"), F.when(r == 3, F.concat(F.lit("new "), name)).alias("l2"), F.lit(1).alias("pos"))
    new = new.unionByName(B.table(spark, sf, "region").where("r_name = 'AFRICA'").select(F.lit("global").alias("scope"), F.lit(-1).alias("book"), F.concat(F.lit("rule of "), "r_name").alias("l1"), F.lit("").alias("l2"), F.lit(1).alias("pos")))
    return U.merged(old, new.withColumn("l1", F.coalesce("l1", none)), ["scope", "book"], ("l1", "l2"), {"l1": "default l1", "l2": "default l2"})


@query("sink_base_group", "SELECT n_name AS book_id, 'base' AS group_key, CASE WHEN n_regionkey = 0 THEN 'own rule ' || n_nationkey WHEN n_regionkey = 1 THEN n_name || ' rule' ELSE n_name || ' rule' END AS rule, CASE WHEN n_regionkey = 1 THEN 'kept' WHEN n_regionkey = 2 THEN 'inserted' ELSE 'updated' END AS action FROM nation")
def sink_base_group(spark, sf):
    """Every book has a base group with the book's rule: missing ones are inserted, differing ones updated."""
    n = B.table(spark, sf, "nation")
    r = F.col("n_regionkey")
    books = n.select(F.col("n_name").alias("book_id"), F.when(r == 0, F.concat(F.lit("own rule "), "n_nationkey")).otherwise(F.concat("n_name", F.lit(" rule"))).alias("rule"))
    stored = n.where("n_regionkey <> 2").select(F.col("n_name").alias("book_id"), F.lit("base").alias("group_key"), F.when(r == 1, F.concat("n_name", F.lit(" rule"))).otherwise("older").alias("rule"))
    return G.base_groups(books, stored)


@query("sink_group_delete", f"""WITH {B.WITH_FACTS}, {_GROUP_STATUS}, gone AS (SELECT 'b3' AS book_id, 'g1' AS index_group_key UNION ALL SELECT 'b4', 'g1'), gr AS (SELECT DISTINCT book_id, index_group_key FROM facts), su AS (SELECT DISTINCT book_id, index_group_key, entity FROM facts)
    SELECT 'groups' AS name, book_id, index_group_key, count(*) AS n FROM gr WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.book_id = gr.book_id AND gone.index_group_key = gr.index_group_key) GROUP BY ALL
    UNION ALL SELECT 'status', book_id, index_group_key, count(*) FROM gs WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.book_id = gs.book_id AND gone.index_group_key = gs.index_group_key) GROUP BY ALL
    UNION ALL SELECT 'facts', book_id, index_group_key, count(*) FROM facts WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.book_id = facts.book_id AND gone.index_group_key = facts.index_group_key) GROUP BY ALL
    UNION ALL SELECT 'subjects', book_id, index_group_key, count(*) FROM su WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.book_id = su.book_id AND gone.index_group_key = su.index_group_key) GROUP BY ALL""")
def sink_group_delete(spark, sf):
    """A deleted group goes with its statuses, facts and subjects; the base group can't be deleted."""
    f = B.facts(spark, sf)
    asked = f.where("book_id in ('b3', 'b4') and index_group_key in ('g1', 'base')").select("book_id", "index_group_key").where("index_group_key <> 'base'")
    tables = {"groups": f.select("book_id", "index_group_key").distinct(), "status": _group_status(f), "facts": f, "subjects": f.select("book_id", "index_group_key", "entity").distinct()}
    return _counted(U.cascade(tables, asked, ["book_id", "index_group_key"]), ["book_id", "index_group_key"])


def _counted(tables, by):
    out = [t.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name)) for name, t in tables.items()]
    every = out[0]
    for t in out[1:]:
        every = every.unionByName(t)
    return every.select("name", *by, "n")


@query("sink_book_delete", f"WITH {B.WITH_STATUS}, r AS (SELECT 'src' || (run_id % 20) AS book_id, run_id, part FROM (SELECT conv_id AS run_id, turn AS part FROM conversations)) " + " UNION ALL ".join(f"SELECT '{n}' AS name, book_id, count(*) AS n FROM ({t}) WHERE book_id <> 'src3' GROUP BY 2" for n, t in {"books": "SELECT DISTINCT book_id FROM chapters", "chapters": "SELECT * FROM chapters", "status": "SELECT * FROM status", "runs": "SELECT DISTINCT book_id, run_id FROM r", "parts": "SELECT * FROM r"}.items()))
def sink_book_delete(spark, sf):
    """A deleted book goes with everything that is keyed by it, runs with their parts."""
    c = B.chapters(spark, sf)
    parts = B.runs(spark, sf).select(F.concat(F.lit("src"), F.col("run_id") % 20).alias("book_id"), "run_id", "part")
    tables = {"books": c.select("book_id").distinct(), "chapters": c.select("book_id"), "status": B.status(spark, sf).select("book_id"), "runs": parts.select("book_id", "run_id").distinct(), "parts": parts}
    gone = c.where("book_id = 'src3'").select("book_id").distinct()
    return _counted(U.cascade(tables, gone, ["book_id"]), ["book_id"])


@query("sink_book_bind", "WITH b AS (SELECT source AS book_id, doc_id, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE lang END AS name FROM documents), f AS (SELECT book_id, arg_min(name, doc_id) FILTER (WHERE trim(name, ' ') <> '') AS book_name FROM b GROUP BY 1) SELECT b.book_id, f.book_name, b.name AS asked, b.doc_id FROM b JOIN f USING (book_id) WHERE trim(b.name, ' ') <> '' AND b.name <> f.book_name UNION ALL SELECT book_id, book_name, NULL, NULL FROM f")
def sink_book_bind(spark, sf):
    """The first name that isn't empty stays; another one is a conflict row."""
    asked = B.table(spark, sf, "documents").select(F.col("source").alias("book_id"), "doc_id", F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang")).alias("asked"))
    books, conflicts = G.bound(asked, "book_id", "asked", "doc_id")
    return books.select("book_id", "book_name", F.lit(None).cast("string").alias("asked"), F.lit(None).cast("long").alias("doc_id")).unionByName(conflicts.select("book_id", "book_name", "asked", "doc_id"))


@query("sink_run_insert", f"WITH {B.WITH_RUNS} SELECT run_id, substr(CASE WHEN stage = 'assistant' THEN 'given ' || run_id WHEN part = 0 THEN substr(trim(result, ' ' || chr(10)), 1, 24) ELSE 'book ' || part || '-' || (part + 9) END, 1, 120) AS name, part FROM runs")
def sink_run_insert(spark, sf):
    """The given name, else the question's begin, else book and range; at most 120 characters."""
    given = F.when(F.col("stage") == "assistant", F.concat(F.lit("given "), "run_id")).otherwise("  ")
    question = F.when(F.col("part") == 0, F.substring(F.regexp_replace("result", r"^\s+|\s+$", ""), 1, 24))
    name = F.coalesce(F.nullif(F.trim(given), F.lit("")), F.nullif(question, F.lit("")), F.concat(F.lit("book "), "part", F.lit("-"), F.col("part") + 9))
    return B.runs(spark, sf).select("run_id", F.substring(name, 1, 120).alias("name"), "part")


@query("sink_run_update", f"WITH {B.WITH_RUNS} SELECT run_id, max(part) AS last_part, CASE WHEN run_id % 2 = 0 THEN 'completed' ELSE 'running' END AS status FROM runs WHERE run_id % 10 <> 9 GROUP BY run_id")
def sink_run_update(spark, sf):
    r = B.runs(spark, sf).groupBy("run_id").agg(F.max("part").alias("last_part")).withColumn("status", F.lit("running"))
    done = r.where("run_id % 2 = 0").withColumns({"status": F.lit("completed"), "pos": F.lit(1)})
    return U.without(U.latest(r, done, ["run_id"]), r.where("run_id % 10 = 9"), ["run_id"])


@query("sink_import_status", "SELECT source AS book_id, count(*) AS chapters, CASE WHEN count(*) FILTER (WHERE n_chars < 300) = 0 THEN 'completed' WHEN count(*) FILTER (WHERE n_chars < 300) = count(*) THEN 'failed' ELSE 'completed_with_errors' END AS last_import_status FROM (SELECT CASE WHEN doc_id % 50 = 7 THEN 'short' || doc_id ELSE source END AS source, n_chars FROM documents) GROUP BY 1")
def sink_import_status(spark, sf):
    """Imported, imported with errors, or failed in all chapters."""
    book = F.when(F.col("doc_id") % 50 == 7, F.concat(F.lit("short"), "doc_id")).otherwise(F.col("source"))
    d = B.table(spark, sf, "documents").select(book.alias("book_id"), "n_chars")
    bad = F.count_if(F.col("n_chars") < 300)
    state = d.groupBy("book_id").agg(F.when(bad == 0, "completed").when(bad == F.count(F.lit(1)), "failed").otherwise("completed_with_errors").alias("last_import_status"))
    return d.groupBy("book_id").agg(F.count(F.lit(1)).alias("chapters")).join(state, "book_id", "left")


@query("jn_follow_runs", f"WITH {B.WITH_RUNS} SELECT run_id, part FROM runs WHERE run_id IN (SELECT run_id FROM runs WHERE part = 0 AND length(result) > 150)")
def jn_follow_runs(spark, sf):
    r = B.runs(spark, sf)
    return r.select("run_id", "part").join(r.where("part = 0 and length(result) > 150").select("run_id"), "run_id", "left_semi")


_KEYS = ["content_hash", "prompt_hash", "schema_hash", "model", "effort"]


@query("jn_reuse", f"""WITH {B.WITH_RUNS}, x AS (SELECT *, sha256(stage) AS prompt_hash, CASE WHEN part % 2 = 0 THEN 'md' ELSE 'json' END AS schema_hash, 'm' || (part % 3) AS model, 'low' AS effort FROM runs)
    SELECT run_id, part, CASE WHEN status = 'completed' AND length(result) > 120 AND stage = 'user' THEN 'hit' ELSE 'miss' END AS outcome FROM x""")
def jn_reuse(spark, sf):
    """A cached part counts if it is completed, has a result, and five keys are equal; others of the cache differ in one of them."""
    r = B.runs(spark, sf).withColumns({"prompt_hash": F.sha2("stage", 256), "schema_hash": F.when(F.col("part") % 2 == 0, "md").otherwise("json"), "model": F.concat(F.lit("m"), F.col("part") % 3), "effort": F.lit("low"), "text": F.col("result"), "own_hash": F.sha2(F.concat_ws("-", "content_hash", "run_id", "part"), 256)})
    r = r.withColumn("content_hash", F.col("own_hash"))
    good = r.where("stage = 'user'").withColumn("result", F.when(F.length("text") > 120, F.col("text")).otherwise(""))
    wrong = r.where("stage <> 'user'")
    cache = good.unionByName(wrong.withColumn("effort", F.lit("high"))).unionByName(wrong.withColumn("model", F.lit("other"))).unionByName(wrong.withColumn("schema_hash", F.lit("x"))).unionByName(wrong.withColumn("status", F.lit("failed")))
    found = K.reused(r.drop("result"), cache.select(*_KEYS, "status", "result"), _KEYS)
    return found.select("run_id", "part", F.when(F.col("result").isNotNull(), "hit").otherwise("miss").alias("outcome"))


@query("sink_run_delete", f"WITH {B.WITH_RUNS} SELECT 'runs' AS name, count(DISTINCT run_id) AS n FROM runs WHERE run_id % 7 <> 0 UNION ALL SELECT 'parts', count(*) FROM runs WHERE run_id % 7 <> 0")
def sink_run_delete(spark, sf):
    """A run goes with its parts."""
    parts = B.runs(spark, sf).select("run_id", "part")
    every = parts.select("run_id").distinct()
    gone = every.where("run_id % 7 = 0")
    out = [U.without(t, gone, ["run_id"]).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n, t in (("runs", every), ("parts", parts))]
    return out[0].union(out[1])
