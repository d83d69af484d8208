"""Queries of fact tables: filters, normal forms, lineage counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom import tables
from corpusloom.functions import columns as C
from corpusloom.operators import facts as O
from corpusloom.operators import routes
from corpusloom.plans import bind as B
from corpusloom.plans.registry import query
from corpusloom.sources import envelopes as N

_W = f"WITH {B.WITH_FACTS}"
_RANKED = "row_number() OVER (PARTITION BY book_id ORDER BY importance DESC, confidence DESC, chapter_index, id) AS n"


def _like(fields, terms):
    lists = " OR ".join(f"contains(lower(x), '{t}')" for t in terms)
    values = ", ".join(c if c not in ("entity", "fact_type") else f"[{c}]" for c in fields)
    return f"len(list_filter(list_concat({values}), lambda x: {lists})) > 0"


_CHAPTERS = (2, 3, 5, 8, 9, 12, 17, 20, 24, 25, 40)


@query("flt_facts", f"{_W} SELECT id, fact FROM (SELECT *, {_RANKED} FROM facts WHERE status = 'completed' AND chapter_index BETWEEN 2 AND 25 AND index_group_key IN ('base', 'g1') AND chapter_index IN {_CHAPTERS} AND category IN ('item', 'event') AND {_like(O.SEARCHED, ('r_7', 'k9', 'urch'))}) WHERE n <= 500")
def flt_facts(spark, sf):
    return O.matching(B.facts(spark, sf), 2, 25, ("base", "g1"), _CHAPTERS, ("item", "event"), ("R_7", " k9 ", "urch", "k9")).select("id", "fact")


@query("flt_facts_meta", f"{_W} SELECT id, book_id, chapter_index, category FROM (SELECT *, {_RANKED} FROM facts WHERE status = 'completed' AND chapter_index BETWEEN 1 AND 31 AND index_group_key = 'base' AND {_like(O.SEARCHED_META, ('k1',))}) WHERE n <= 500")
def flt_facts_meta(spark, sf):
    f = O.matching(B.facts(spark, sf).drop("fact", "evidence"), 1, 31, terms=("k1",), fields=O.SEARCHED_META)
    return f.select("id", "book_id", "chapter_index", "category")


_RAW = "raw AS (SELECT *, CASE WHEN fact_type = 'signup' THEN '' ELSE '  ' || entity || repeat('x', 130) END AS name, CASE WHEN fact_type = 'signup' OR fact_type = 'click' THEN ' ' ELSE fact END AS told FROM facts)"


@query("prj_fact_norm", f"""{_W}, {_RAW} SELECT id, CASE fact_type WHEN 'error' THEN 'other' ELSE category END AS category, substr(trim(name, ' '), 1, 120) AS entity, trim(told, ' ') AS fact, CASE fact_type WHEN 'view' THEN category ELSE fact_type END AS fact_type,
    round(greatest(0, least(1, importance * 2 - 0.5)), 9) AS importance, array_to_string(tags, ',') AS tags, CAST(12 AS INT) AS aliases, CAST(8 AS INT) AS evidence, CAST(1000 AS INT) AS note, CASE fact_type WHEN 'click' THEN 'source_review' ELSE 'index' END AS review_source
    FROM raw WHERE trim(told, ' ') <> '' OR trim(name, ' ') <> ''""")
def prj_fact_norm(spark, sf):
    f, t = B.facts(spark, sf), F.col("fact_type")
    many = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit("n"), i.cast("string")))
    raw = f.withColumns({
        "entity": F.when(t == "signup", "").otherwise(F.concat(F.lit("  "), "entity", F.lit("x" * 130))), "fact": F.when(t.isin("signup", "click"), " ").otherwise(F.col("fact")), "category": F.when(t == "error", "odd").otherwise(F.concat(F.lit(" "), F.upper("category"))),
        "importance": F.col("importance") * 2 - 0.5, "aliases": many, "evidence": many, "review_note": F.lit("z" * 1200), "review_source": F.when(t == "click", "source_review").otherwise("elsewhere"), "fact_type": F.when(t == "view", " ").otherwise(t)})
    n = O.normal(raw, B.CATEGORIES)
    return n.select("id", "category", "entity", "fact", "fact_type", F.round("importance", 9).alias("importance"), F.array_join("tags", ",").alias("tags"), F.size("aliases").alias("aliases"), F.size("evidence").alias("evidence"), F.length("review_note").alias("note"), "review_source")


_LONG = "fact || ' ' || repeat(fact || ' ', 30)"


@query("prj_evidence", f"{_W} SELECT id, chapter_index, entity AS subject, CASE WHEN length(t) > 260 THEN substr(t, 1, 257) || '...' ELSE t END AS content, related_entities[1] AS related, array_to_string(tags, ',') AS tags, CAST(2 AS INT) AS evidence, 'l2_fact' AS source_type FROM (SELECT *, trim({_LONG}, ' ') AS t FROM facts)")
def prj_evidence(spark, sf):
    f = B.facts(spark, sf).withColumns({"fact": F.concat("fact", F.lit(" "), F.repeat(F.concat("fact", F.lit(" ")), F.lit(30))), "evidence": F.array("fact", "fact", "entity"), "review_source": F.lit("index")})
    p = f.select("id", O.packet().alias("p"))
    return p.select("id", "p.chapter_index", "p.subject", "p.content", F.get("p.related_subjects", F.lit(0)).alias("related"), F.array_join("p.tags", ",").alias("tags"), F.size("p.evidence").alias("evidence"), "p.source_type")


@query("prj_compact_fact", f"{_W}, t AS (SELECT *, trim({_LONG}, ' ') AS t FROM facts) SELECT id, size, array_to_string(tags, ',') AS tags, CASE WHEN length(t) > size THEN substr(t, 1, size - 3) || '...' ELSE t END AS fact, CASE WHEN size >= 200 THEN substr(evidence[1], 1, CASE size WHEN 420 THEN 80 ELSE 48 END) ELSE '' END AS evidence FROM t, (SELECT CAST(unnest([420, 220, 120, 60]) AS INT) AS size)")
def prj_compact_fact(spark, sf):
    """Every rung of the ladder that a fact is shortened by."""
    f = B.facts(spark, sf).withColumn("fact", F.concat("fact", F.lit(" "), F.repeat(F.concat("fact", F.lit(" ")), F.lit(30))))
    rungs = F.array(*[F.struct(F.lit(n).alias("size"), O.compact(n, items, chars).alias("c")) for n, items, chars in ((420, 1, 80), (220, 1, 48), (120, 0, 0), (60, 0, 0))])
    return f.select("id", F.explode(rungs).alias("r")).select("id", "r.size", F.array_join("r.c.tags", ",").alias("tags"), "r.c.fact", F.array_join("r.c.evidence", "|").alias("evidence"))


_KNOWN = ", ".join(repr(c) for c in B.CATEGORIES)


@query("prj_l1_scores", f"{_W}, s AS (SELECT book_id, chapter_index, category, max(importance) AS strength, CAST(max(confidence) AS DOUBLE) / 2 AS raw FROM facts GROUP BY 1, 2, 3), k AS (SELECT DISTINCT book_id, chapter_index, c FROM s, (SELECT unnest([{_KNOWN}]) AS c)) SELECT k.book_id, k.chapter_index, k.c AS category, round(coalesce(greatest(CASE WHEN k.c = 'event' THEN 0 ELSE s.raw END, s.strength), 0.0), 9) AS score FROM k LEFT JOIN s ON s.book_id = k.book_id AND s.chapter_index = k.chapter_index AND s.category = k.c")
def prj_l1_scores(spark, sf):
    """Score of every known category of a chapter: its raw score or its strongest signal, whichever is larger."""
    s = B.facts(spark, sf).groupBy("book_id", "chapter_index", "category").agg(F.max("importance").alias("strength"), (F.max("confidence") / 2).alias("raw"))
    g = s.groupBy("book_id", "chapter_index").agg(F.collect_list(F.struct("category", "strength")).alias("signals"), F.map_from_entries(F.collect_list(F.struct("category", F.when(F.col("category") == "event", float("nan")).otherwise(F.col("raw"))))).alias("raw"))
    m = g.select("book_id", "chapter_index", F.explode(routes.scores(F.col("raw"), F.col("signals"), B.CATEGORIES)).alias("category", "score"))
    return m.withColumn("score", F.round("score", 9))


@query("prj_l1_major", f"{_W} SELECT book_id, chapter_index, max(importance) >= 0.1 OR max(confidence) >= 0.98 AS major FROM facts GROUP BY 1, 2")
def prj_l1_major(spark, sf):
    """A strong signal, or a high score of a category; the thresholds are parameters, the given numbers are small."""
    s = B.facts(spark, sf).groupBy("book_id", "chapter_index", "category").agg(F.max("importance").alias("strength"), F.max("confidence").alias("score"))
    m = s.groupBy("book_id", "chapter_index").agg(F.collect_list(F.struct("strength")).alias("signals"), F.map_from_entries(F.collect_list(F.struct("category", "score"))).alias("scores"))
    return m.select("book_id", "chapter_index", routes.major(F.col("signals"), F.col("scores"), 0.1, 0.98).alias("major"))


@query("flt_category_list", """SELECT event_id, array_to_string(list_filter([CASE WHEN event_type = 'view' THEN 'view' WHEN event_type = 'click' THEN 'other' END, 'item', CASE WHEN event_type = 'error' THEN NULL ELSE NULL END], lambda x: x IS NOT NULL), ',') AS categories FROM events""")
def flt_category_list(spark, sf):
    """Unknown names are dropped; other stays where it is asked for."""
    asked = F.concat(F.when(F.col("event_type") == "click", " OTHER").otherwise(F.col("event_type")), F.lit(",item , Item"))
    return B.table(spark, sf, "events").select("event_id", F.array_join(O.category_list(asked, ("item", "event", "view")), ",").alias("categories"))


_PART = "packets AS (SELECT book_id, index_group_key, id AS pos, chapter_index, category, entity AS subject, related_entities[1] AS related, fact_type, fact, importance, CASE WHEN importance >= 0.05 THEN 'source_review' ELSE 'l2_fact' END AS source_type, 'user_1' AS target FROM facts)"


def _first(col, most, name):
    return f"{name} AS (SELECT book_id, index_group_key, string_agg(v, ',' ORDER BY seen) AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY book_id, index_group_key ORDER BY seen) AS n FROM (SELECT book_id, index_group_key, {col} AS v, min(pos) AS seen FROM packets GROUP BY 1, 2, 3)) WHERE n <= {most} GROUP BY 1, 2)"


def _counts(col, name):
    return f"{name} AS (SELECT book_id, index_group_key, string_agg(v || '=' || n, ',' ORDER BY v) AS {name} FROM (SELECT book_id, index_group_key, {col} AS v, count(*) AS n FROM packets GROUP BY 1, 2, 3) GROUP BY 1, 2)"


_TRACE = f"""{_W}, {_PART}, {_counts('category', 'categories')}, {_counts('source_type', 'source_types')}, {_counts('fact_type', 'fact_types')}, {_first('subject', 12, 'subjects')}, {_first('related', 8, 'related')},
    c AS (SELECT book_id, index_group_key, list_sort(list_distinct(list(chapter_index))) AS v, count(*) AS packets, count(*) FILTER (WHERE contains(lower(concat_ws(' ', source_type, category, subject, fact_type, fact, related)), target)) AS target_packets FROM packets GROUP BY 1, 2),
    traces AS (SELECT book_id, index_group_key, packets, target_packets, CAST(len(v) AS INT) AS chapter_count, v[1] AS first_chapter, v[-1] AS last_chapter, CASE WHEN len(v) <= 16 THEN v ELSE list_concat(v[1:8], v[-8:]) END AS sample, categories, source_types, fact_types, subjects, related
               FROM c JOIN categories USING (book_id, index_group_key) JOIN source_types USING (book_id, index_group_key) JOIN fact_types USING (book_id, index_group_key) JOIN subjects USING (book_id, index_group_key) JOIN related USING (book_id, index_group_key))"""


def _packets(spark, sf):
    """A part is a book's group; facts over a threshold count as reviewed at the source."""
    f = B.facts(spark, sf).withColumn("review_source", F.when(F.col("importance") >= 0.05, "source_review").otherwise("index"))
    return f.select("book_id", "index_group_key", F.col("id").alias("pos"), O.packet().alias("p"), F.lit("user_1").alias("target")).select("book_id", "index_group_key", "pos", "target", "p.*").drop("tags", "evidence").withColumns({"tags": F.array().cast("array<string>"), "evidence": F.array().cast("array<string>")})


def _traces(spark, sf):
    return O.trace(_packets(spark, sf), ["book_id", "index_group_key"])


def _shown(t):
    maps = {c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",") for c in ("categories", "source_types", "fact_types") if c in t.columns}
    return t.withColumns({**maps, **{c: F.array_join(c, ",") for c in ("subjects", "related", "sample") if c in t.columns}})


@query("agg_trace", f"{_TRACE} SELECT * REPLACE (array_to_string(sample, ',') AS sample) FROM traces")
def agg_trace(spark, sf):
    return _shown(_traces(spark, sf))


@query("agg_trace_public", f"{_TRACE}, big AS (SELECT DISTINCT book_id, index_group_key FROM facts WHERE importance >= 0.05) SELECT f.book_id, f.index_group_key, t.packets, t.categories, '' AS subjects FROM (SELECT DISTINCT book_id, index_group_key FROM facts) f JOIN traces t USING (book_id, index_group_key) WHERE t.target_packets > 0 OR EXISTS (SELECT 1 FROM big b WHERE b.book_id = f.book_id AND b.index_group_key = f.index_group_key)")
def agg_trace_public(spark, sf):
    """Traces of parts with a reviewed packet or the target; the others count as empty. Missing lists become empty ones."""
    t = _traces(spark, sf).withColumn("subjects", F.lit(None).cast("array<string>"))
    reviewed = F.coalesce(F.col("source_types")["source_review"], F.lit(0)) > 0
    return _shown(O.public(t.withColumn("packets", F.when(reviewed | (F.col("target_packets") > 0), F.col("packets")).otherwise(0)))).select("book_id", "index_group_key", "packets", "categories", "subjects")


@query("agg_trace_summary", f"""{_TRACE}, ch AS (SELECT book_id, list_sort(list_distinct(list(c))) AS v FROM (SELECT book_id, unnest(list_concat(sample, [first_chapter, last_chapter])) AS c FROM traces) GROUP BY 1),
    m AS (SELECT book_id, string_agg(category || '=' || n, ',' ORDER BY category) AS categories FROM (SELECT book_id, category, count(*) AS n FROM packets GROUP BY 1, 2) GROUP BY 1), z AS (SELECT book_id, string_agg(source_type || '=' || n, ',' ORDER BY source_type) AS source_types FROM (SELECT book_id, source_type, count(*) AS n FROM packets GROUP BY 1, 2) GROUP BY 1),
    t AS (SELECT book_id, count(*) AS parts, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(target_packets) AS BIGINT) AS target_packets FROM traces GROUP BY 1)
    SELECT book_id, parts, packets, target_packets, categories, source_types, CAST(len(v) AS INT) AS chapter_count, v[1] AS first_chapter, v[-1] AS last_chapter FROM t JOIN m USING (book_id) JOIN z USING (book_id) JOIN ch USING (book_id)""")
def agg_trace_summary(spark, sf):
    """The traces of a book's parts as one."""
    t = tables.staged(_traces(spark, sf), "traces").withColumn("pos", F.when(F.col("index_group_key") == "base", 0).otherwise(1))
    return _shown(O.merged(t, ["book_id"])).drop("subjects", "sample")


@query("agg_source_stats", f"{_W}, r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY importance DESC, id) AS n FROM facts WHERE importance >= 0.02) SELECT book_id, count(*) AS candidates, count(DISTINCT (chapter_index - 1) // 120) AS windows, (SELECT count(*) FROM r WHERE r.book_id = f.book_id) AS scored, (SELECT count(*) FROM r WHERE r.book_id = f.book_id AND n <= 40) AS recalled, (SELECT count(*) FROM r WHERE r.book_id = f.book_id AND n > 40) AS dropped, (SELECT count(*) FROM r WHERE r.book_id = f.book_id AND n <= 40 AND contains(entity, '_1')) AS targets, (SELECT string_agg(DISTINCT chapter_index, ',' ORDER BY chapter_index) FROM r WHERE r.book_id = f.book_id AND n <= 40) AS chapters FROM facts f GROUP BY 1")
def agg_source_stats(spark, sf):
    """Candidates, windows, scored, recalled (at most 40 of a book here), dropped and target facts, and the chapters of what is recalled."""
    f = B.facts(spark, sf)
    place = F.row_number().over(Window.partitionBy("book_id", F.col("importance") >= 0.02).orderBy(F.desc("importance"), "id"))
    scored = F.col("importance") >= 0.02
    f = f.withColumn("n", F.when(scored, place))
    kept = F.coalesce(F.col("n") <= 40, F.lit(False))
    return f.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_distinct(F.floor((F.col("chapter_index") - 1) / 120)).alias("windows"), F.count("n").alias("scored"), F.count_if(kept).alias("recalled"), F.count_if(F.col("n") > 40).alias("dropped"),
        F.count_if(kept & F.contains("entity", F.lit("_1"))).alias("targets"), F.array_join(F.array_sort(F.collect_set(F.when(kept, F.col("chapter_index")))), ",").alias("chapters"))


# What a message says when all further calls would fail, too.
FATAL = "(?i)成本保护|rate limit|quota|insufficient_quota|billing|429"
# What a message says when another attempt may succeed.
TRANSPORT = ("aborted", "timeout", "timed out", "fetch failed", "network", "网络连接失败", "unexpected end of json input", "不是合法 json")

_MESSAGE = "CASE event_type WHEN 'error' THEN 'Rate LIMIT reached' WHEN 'view' THEN 'Fetch Failed: socket' WHEN 'click' THEN 'status 4' || k WHEN 'signup' THEN 'Unexpected end of JSON input' ELSE 'bad key' END"


def _messages(spark, sf):
    e = B.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    t = F.col("event_type")
    message = F.when(t == "error", "Rate LIMIT reached").when(t == "view", "Fetch Failed: socket").when(t == "click", F.concat(F.lit("status 4"), "k")).when(t == "signup", "Unexpected end of JSON input").otherwise("bad key")
    return e.select("event_id", "k", message.alias("message"))


@query("flt_fatal", f"SELECT event_id, regexp_matches({_MESSAGE}, '(?i)rate limit|quota|billing|429') AS fatal FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)")
def flt_fatal(spark, sf):
    return _messages(spark, sf).select("event_id", F.col("message").rlike(FATAL).alias("fatal"))


@query("flt_retryable", f"SELECT event_id, 400 + CAST(k AS INT) * 2 = 429 OR 400 + CAST(k AS INT) * 2 >= 500 OR 401 + CAST(k AS INT) = 429 OR regexp_matches({_MESSAGE}, '(?i)fetch failed|end of json') AS retryable FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)")
def flt_retryable(spark, sf):
    """A status of 429 or from 500 on, or a message that speaks of the transport."""
    m = _messages(spark, sf)
    k = F.col("k").cast("int")
    status = F.when(k == 28, 429).otherwise(400 + k * 2)
    words = F.exists(F.array(*map(F.lit, TRANSPORT)), lambda w: F.contains(F.lower("message"), w))
    return m.select("event_id", ((status == 429) | (status >= 500) | words).alias("retryable"))


@query("flt_useful", "SELECT conv_id, turn, turn % 5 < 3 OR turn % 8 IN (0, 2, 4, 5, 7) AS useful FROM conversations")
def flt_useful(spark, sf):
    """Texts, placeholders, and objects with useful, empty and only listed values; few sources accept all."""
    shapes = ["text", "' N/A '", """concat('{"summary":"', role, '"}')""", """'{"summary":"none","title":" ","items":[]}'""", """'{"items":[1]}'""", """concat('{"failed_chapters":[3],"facts":[{"a":{"b":["', role, '"]}},"null"]}')""", """'{"facts":[" ",{"a":"无"}],"note":""}'""", """'{"note":0}'"""]
    result = F.expr("CASE turn % 8 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(shapes)) + " END")
    c = B.table(spark, sf, "conversations").select("conv_id", "turn", N.parsed(result).alias("v"))
    return c.select("conv_id", "turn", O.useful(F.col("v"), F.col("turn") % 5).alias("useful"))


@query("flt_question", "SELECT conv_id, turn, CASE WHEN trim(text, ' ') = '' THEN 'blank' WHEN conv_id % 9 = 0 THEN 'no groups' ELSE 'ok' END AS outcome FROM conversations")
def flt_question(spark, sf):
    return B.table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.trim("text") == "", "blank").when(F.col("conv_id") % 9 == 0, "no groups").otherwise("ok").alias("outcome"))


_SNAPSHOT = "length(min_by(result, part)) > 150"


@query("flt_can_resume", f"WITH {B.WITH_RUNS} SELECT run_id, length(arg_min(result, part)) > 150 AND count(*) FILTER (WHERE stage = 'tool') = 0 AND count(*) FILTER (WHERE status = 'completed') < count(*) AS resumable FROM runs GROUP BY run_id")
def flt_can_resume(spark, sf):
    """Resumable: a snapshot is there (a long first part), no result, not completed."""
    r = B.runs(spark, sf).groupBy("run_id").agg(F.expr(_SNAPSHOT).alias("snapshot"), F.count_if(F.col("stage") == "tool").alias("results"), F.count_if(F.col("status") == "completed").alias("done"), F.count(F.lit(1)).alias("n"))
    return r.select("run_id", (F.col("snapshot") & (F.col("results") == 0) & (F.col("done") < F.col("n"))).alias("resumable"))


@query("flt_resume_error", f"WITH {B.WITH_RUNS}, r AS (SELECT run_id, count(*) AS n FROM runs GROUP BY 1) SELECT k AS run_id, CASE WHEN r.run_id IS NULL THEN 'not found' WHEN n > 5 THEN 'has a result' WHEN k % 4 = 0 THEN 'no snapshot' ELSE 'ok' END AS outcome FROM (SELECT DISTINCT o_custkey % 150 AS k FROM orders) LEFT JOIN r ON r.run_id = k")
def flt_resume_error(spark, sf):
    r = B.runs(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    k = B.table(spark, sf, "orders").select((F.col("o_custkey") % 150).alias("run_id")).distinct()
    return k.join(r, "run_id", "left").select("run_id", F.when(F.col("n").isNull(), "not found").when(F.col("n") > 5, "has a result").when(F.col("run_id") % 4 == 0, "no snapshot").otherwise("ok").alias("outcome"))


@query("prj_run_public", f"""WITH {B.WITH_RUNS}, r AS (SELECT run_id, min(part) AS a, max(part) AS z, count(*) AS n FROM runs GROUP BY 1) SELECT run_id, CASE WHEN n > 5 THEN 'named ' || run_id ELSE 'book ' || a || '-' || z END AS name, CASE WHEN n % 3 = 0 THEN 'picked' WHEN n % 3 = 1 THEN 'indexes' ELSE 'range' END AS mode,
    CASE WHEN n % 3 = 2 THEN array_to_string(range(a, z + 1), ',') ELSE a || ',' || z END AS selection, n AS scored FROM r""")
def prj_run_public(spark, sf):
    """Selection and statistics are parsed; a run without them gets its range, and a name of its own."""
    r = B.runs(spark, sf).groupBy("run_id").agg(F.min("part").alias("a"), F.max("part").alias("z"), F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    pick = F.to_json(F.struct(F.when(n % 3 == 0, "picked").alias("mode"), F.array("a", "z").alias("chapter_indexes")))
    r = r.withColumns({"selection": F.when(n % 3 == 2, "{broken").otherwise(pick), "stats": F.to_json(F.struct(n.alias("scored"))), "name": F.when(n > 5, F.concat(F.lit("named "), "run_id"))})
    v = F.try_parse_json("selection")
    listed = F.try_variant_get(v, "$.chapter_indexes", "array<int>")
    r = r.withColumns({"listed": listed, "mode": F.try_variant_get(v, "$.mode", "string")})
    there = F.coalesce(F.size("listed"), F.lit(0)) > 0
    return r.select("run_id", F.coalesce("name", F.concat(F.lit("book "), "a", F.lit("-"), "z")).alias("name"), F.when(there, F.coalesce("mode", F.lit("indexes"))).otherwise("range").alias("mode"),
                    F.array_join(F.when(there, F.col("listed")).otherwise(F.sequence("a", "z").cast("array<int>")), ",").alias("selection"), F.try_variant_get(F.try_parse_json("stats"), "$.scored", "long").alias("scored"))


@query("prj_part_meta", f"WITH {B.WITH_RUNS} SELECT run_id, part, stage, status, length(result) > 0 AS has_result FROM runs")
def prj_part_meta(spark, sf):
    return B.runs(spark, sf).select("run_id", "part", "stage", "status", (F.length("result") > 0).alias("has_result"))


def _l1_rows(spark, sf):
    """Labelled documents as route rows: good ones have route fields, the others only the older ones (or none at all, if toxic)."""
    d = B.table(spark, sf, "documents").join(B.table(spark, sf, "labels"), "doc_id")
    good, none = F.col("quality") == 1, F.array().cast("array<string>")
    w = F.split("text", "[ \\n]+")
    old = ~good & (F.col("toxic") == 0)
    entity = F.struct(F.concat(F.lit(" "), F.get(w, F.lit(0))).alias("name"), F.lit("x").alias("type"), none.alias("aliases"), F.lit("").alias("role"), F.lit(" note ").alias("note"))
    nobody = F.array().cast("array<struct<name:string,type:string,aliases:array<string>,role:string,note:string>>")
    signal = F.struct(F.lit("event").alias("category"), F.lit(0.9).alias("strength"), none.alias("entities"), F.array("lang").alias("keywords"), F.lit("seen").alias("reason"))
    silent = F.array().cast("array<struct<category:string,strength:double,entities:array<string>,keywords:array<string>,reason:string>>")
    return d.select(
        "doc_id", "lang", F.lit("").alias("route_schema_version"), F.when(good, F.array(entity)).otherwise(nobody).alias("route_entities"), F.when(good, F.array("lang")).otherwise(none).alias("route_keywords"), F.when(good, F.array(signal)).otherwise(silent).alias("signals"),
        F.when(old, F.array(entity)).otherwise(nobody).alias("entities"), F.when(old, F.array("lang")).otherwise(none).alias("keywords"), F.when(old, F.slice(w, 1, 10)).otherwise(none).alias("key_events"), F.when(old, F.array(F.lit("what then"))).otherwise(none).alias("open_questions"), F.when(old, F.array("source")).otherwise(none).alias("items_places_orgs"), F.when(good, F.lit("in short")).otherwise("").alias("summary"))


@query("prj_route_compact", r"""SELECT doc_id, CASE WHEN quality = 1 THEN 'l1-route-v1' ELSE 'legacy-l1-compatible' END AS schema, CASE WHEN quality = 1 THEN ' ' || w[1] WHEN toxic = 0 AND w[1] <> '' THEN w[1] ELSE '' END AS entity,
    CASE WHEN quality = 1 THEN lang WHEN toxic = 0 THEN array_to_string(list_slice(list_filter(list_concat([lang], w[1:10], [source], ['what then']), lambda x: x <> ''), 1, 24), ',') ELSE '' END AS keywords,
    CASE WHEN quality = 1 THEN 'event:0.9' WHEN toxic = 0 THEN 'character:0.6,event:0.6,foreshadowing:0.6' ELSE '' END AS signals FROM (SELECT *, regexp_split_to_array(text, '[ 
]+') AS w FROM documents JOIN labels USING (doc_id))""")
def prj_route_compact(spark, sf):
    """The route as it is, or derived from the older fields."""
    c = _l1_rows(spark, sf).select("doc_id", routes.compact().alias("c"))
    shown = F.array_join(F.transform("c.signals", lambda s: F.concat(s["category"], F.lit(":"), s["strength"].cast("string"))), ",")
    return c.select("doc_id", "c.schema", F.coalesce(F.get("c.entities", F.lit(0))["name"], F.lit("")).alias("entity"), F.array_join("c.keywords", ",").alias("keywords"), shown.alias("signals"))


@query("prj_chapter_clues", r"""SELECT doc_id, CASE WHEN quality = 1 THEN 'seen' WHEN toxic = 0 THEN array_to_string(w[1:10], '|') ELSE '' END AS events, CASE WHEN quality = 0 AND toxic = 0 THEN 'what then' ELSE '' END AS hooks, CASE WHEN quality = 0 AND toxic = 0 THEN source ELSE '' END AS deltas,
    CASE WHEN quality = 1 OR toxic = 0 THEN w[1] ELSE '' END AS entities, CASE WHEN quality = 1 OR toxic = 0 THEN lang ELSE '' END AS keywords FROM (SELECT *, regexp_split_to_array(text, '[ 
]+') AS w FROM documents JOIN labels USING (doc_id))""")
def prj_chapter_clues(spark, sf):
    """Events, hooks, changes, entities and keywords, each from the first source that has some."""
    c = _l1_rows(spark, sf).select("doc_id", routes.clues().alias("c"))
    return c.select("doc_id", F.array_join("c.events", "|").alias("events"), F.array_join("c.hooks", "|").alias("hooks"), F.array_join("c.deltas", "|").alias("deltas"), F.trim(F.coalesce(F.get("c.entities", F.lit(0))["name"], F.lit(""))).alias("entities"), F.array_join("c.keywords", "|").alias("keywords"))


def _route_values(spark, sf):
    """Parts as route entities: a third as bare strings, a third as objects, a third without a name."""
    obj = F.to_json(F.struct(F.concat(F.lit("  "), "p_name").alias("name"), F.col("p_type").alias("type"), F.split("p_name", " ").alias("aliases")))
    item = F.when(F.col("p_partkey") % 3 == 0, F.to_json(F.array("p_name"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("["), obj, F.lit("]"))).otherwise('[{"type":"x"}]')
    return B.table(spark, sf, "part").select("p_partkey", F.expr("1").alias("one"), item.alias("body")).withColumn("values", F.try_variant_get(F.try_parse_json("body"), "$", "array<variant>"))


@query("prj_l1_entities", "SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 3 = 1 THEN p_type ELSE '' END AS type, CASE WHEN p_partkey % 3 = 1 THEN replace(p_name, ' ', '|') ELSE '' END AS aliases FROM part WHERE p_partkey % 3 <> 2")
def prj_l1_entities(spark, sf):
    e = _route_values(spark, sf).select("p_partkey", F.explode(routes.entities(F.col("values"))).alias("e"))
    return e.select("p_partkey", "e.name", "e.type", F.array_join("e.aliases", "|").alias("aliases"))


def _signals(spark, sf):
    raw = F.array(F.struct(
        F.when(F.col("event_id") % 4 == 0, " Item ").otherwise(F.col("event_type")).alias("category"), (F.col("value") / 100).alias("strength"),
        F.array().cast("array<string>").alias("entities"), F.when(F.col("event_id") % 5 == 0, F.array(F.lit(" "))).otherwise(F.array("event_type")).alias("keywords"), F.lit("").alias("reason")))
    return B.table(spark, sf, "events").select("event_id", routes.signals(raw, B.CATEGORIES).alias("signals"))


@query("prj_l1_signals", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'item' ELSE 'other' END AS category, round(greatest(0, least(1, value / 100)), 9) AS strength FROM events WHERE event_id % 5 <> 0")
def prj_l1_signals(spark, sf):
    s = _signals(spark, sf).select("event_id", F.explode("signals").alias("s"))
    return s.select("event_id", "s.category", F.round("s.strength", 9).alias("strength"))


@query("prj_l1_norm", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN 1 ELSE 0 END AS signals, CASE WHEN event_id % 5 <> 0 THEN round(greatest(0, least(1, value / 100)), 9) ELSE 0 END AS top_score, event_type AS keyword, 'l1-route-v1' AS schema, CAST(24 AS INT) AS keywords, event_id % 5 <> 0 AND (value / 100 >= 0.72 OR value / 100 >= 0.8) AS major FROM events")
def prj_l1_norm(spark, sf):
    """A route value with its caps: keywords, signals, scores out of both, and whether it is a major one."""
    s = _signals(spark, sf).join(B.table(spark, sf, "events").select("event_id", "event_type"), "event_id")
    many = F.concat(F.array(F.concat(F.lit(" "), "event_type"), F.lit(" ")), F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: i.cast("string")))
    s = s.withColumns({"keywords": C.string_array(many, 24, 80), "scores": routes.scores(F.create_map().cast("map<string,double>"), F.col("signals"), B.CATEGORIES)})
    return s.select("event_id", F.size("signals").alias("signals"), F.round(F.array_max(F.map_values("scores")), 9).alias("top_score"), F.get("keywords", F.lit(0)).alias("keyword"), F.lit("l1-route-v1").alias("schema"), F.size("keywords").alias("keywords"), routes.major(F.col("signals"), F.col("scores")).alias("major"))
