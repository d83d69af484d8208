"""The driver tables as the engine's model tables, in Spark and in SQL.

``WITH_*`` are the same tables as common table expressions for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom import tables
from corpusloom.functions import questions as Q
from corpusloom.operators import coverage as V

#: The closed list of fact categories.
CATEGORIES = ("character", "relationship", "cultivation", "force", "item", "magical_creature", "location", "event", "foreshadowing", "other")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chapters(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chapters: a book is a source, chapters are numbered by doc_id.

    Title, hash and length are computed before the numbering, so a query that
    doesn't ask for the content doesn't shuffle it.  Numbering is by stretches
    of doc_ids, so a book with most of the documents isn't one task.
    """
    d = table(spark, sf, "documents").select(
        F.col("source").alias("book_id"), "doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"),
        F.col("n_chars").alias("content_length"), F.sha2("text", 256).alias("content_hash"))
    return V.numbered(d, "book_id", "doc_id", "chapter_index")


WITH_CHAPTERS = """chapters AS (
    SELECT source AS book_id, doc_id, split_part(text, chr(10), 1) AS title, text AS content, n_chars AS content_length,
           sha256(text) AS content_hash, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS chapter_index
    FROM documents)"""


def status_of(c: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels as build results of chapters; a toxic chapter's stored hash is stale."""
    return c.select("book_id", "chapter_index", "doc_id", "content_hash").join(labels, "doc_id").select(
        "book_id", "chapter_index", "doc_id",
        F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("status"),
        F.when(F.col("toxic") == 1, "").otherwise(F.col("content_hash")).alias("source_hash"),
        F.when(F.col("quality") == 1, F.col("doc_id") % 4).otherwise(0).cast("int").alias("facts_count"))


def status(spark: SparkSession, sf: str) -> DataFrame:
    return status_of(chapters(spark, sf), table(spark, sf, "labels"))


def covered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Chapters without their texts, and their status. Texts are hashed and chapters numbered once, into a narrow table that both read."""
    c = tables.staged(chapters(spark, sf).select("book_id", "doc_id", "chapter_index", "content_hash"), "chapters")
    return c, status_of(c, table(spark, sf, "labels"))


WITH_STATUS = WITH_CHAPTERS + """, status AS (
    SELECT book_id, chapter_index, doc_id, CASE quality WHEN 1 THEN 'completed' ELSE 'failed' END AS status,
           CASE WHEN toxic = 1 THEN '' ELSE content_hash END AS source_hash,
           CAST(CASE WHEN quality = 1 THEN doc_id % 4 ELSE 0 END AS INT) AS facts_count
    FROM chapters JOIN labels USING (doc_id))"""


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as facts."""
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = F.create_map(*[F.lit(x) for pair in (("signup", "character"), ("view", "location"), ("click", "event"), ("purchase", "item"), ("error", "foreshadowing")) for x in pair])
    user = F.concat(F.lit("user_"), F.col("user_id"))
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("b"), F.col("user_id") % 20).alias("book_id"),
        F.when(F.col("event_id") % 3 == 0, "base").otherwise("g1").alias("index_group_key"),
        F.dayofmonth("ts").alias("chapter_index"), F.when(F.col("event_type") == "error", "candidate").otherwise("completed").alias("status"),
        kind[F.col("event_type")].alias("category"), user.alias("entity"),
        F.array(F.concat(F.lit("u"), F.col("user_id"))).alias("aliases"), F.array("event_type", F.concat(F.lit("k"), "k")).alias("tags"),
        F.array(F.concat(F.lit("user_"), (F.col("user_id") + 1) % 150)).alias("related_entities"), F.col("event_type").alias("fact_type"),
        F.concat(user, F.lit(" "), "event_type", F.lit(" k"), "k").alias("fact"), F.array(F.concat(F.lit("seen "), "event_type")).alias("evidence"),
        F.least(F.lit(1.0), F.col("value") / 500).alias("importance"), (F.col("k").cast("double") / 100).alias("confidence"), "user_id", "event_id", "ts")


WITH_FACTS = """facts AS (
    SELECT event_id AS id, 'b' || (user_id % 20) AS book_id, CASE WHEN event_id % 3 = 0 THEN 'base' ELSE 'g1' END AS index_group_key,
           CAST(extract(day FROM ts) AS INT) AS chapter_index, CASE event_type WHEN 'error' THEN 'candidate' ELSE 'completed' END AS status,
           CASE event_type WHEN 'signup' THEN 'character' WHEN 'view' THEN 'location' WHEN 'click' THEN 'event' WHEN 'purchase' THEN 'item' WHEN 'error' THEN 'foreshadowing' END AS category,
           'user_' || user_id AS entity, ['u' || user_id] AS aliases, [event_type, 'k' || json_extract_string(props, '$.k')] AS tags,
           ['user_' || ((user_id + 1) % 150)] AS related_entities, event_type AS fact_type,
           'user_' || user_id || ' ' || event_type || ' k' || json_extract_string(props, '$.k') AS fact, ['seen ' || event_type] AS evidence,
           least(1.0::DOUBLE, value / 500) AS importance, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS confidence, user_id, event_id, ts
    FROM events)"""


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of documents as facts without fields: doc_id, pos, fact, importance, confidence."""
    d = tables.spread(table(spark, sf, "documents").select("doc_id", "source", "text")).select("doc_id", F.col("source").alias("book_id"), F.posexplode(F.split("text", "[.!?\\n]+")).alias("pos", "fact"))
    d = d.withColumn("fact", F.trim("fact")).where("length(fact) >= 2")
    return d.withColumns({"importance": (F.length("fact") % 8).cast("double") / 8, "confidence": (F.col("pos") % 4).cast("double") / 4})


WITH_SENTENCES = """sentences AS (
    SELECT doc_id, book_id, CAST(pos AS INT) AS pos, trim(p, ' ') AS fact, CAST(length(trim(p, ' ')) % 8 AS DOUBLE) / 8 AS importance, CAST(pos % 4 AS DOUBLE) / 4 AS confidence
    FROM (SELECT doc_id, source AS book_id, unnest(parts) AS p, generate_subscripts(parts, 1) - 1 AS pos
          FROM (SELECT doc_id, source, regexp_split_to_array(text, '[.!?\\n]+') AS parts FROM documents))
    WHERE length(trim(p, ' ')) >= 2)"""


#: The given texts are in Latin letters: words of up to four letters tell nothing apart, marks at the end don't belong to a term.
VOCABULARY = Q.Vocabulary(leading=r"[(\"']", trailing="[.,!?]+", stop="[a-zà-öø-ÿœ]{1,4}")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as questions: their terms, and as target the longest term, if it has nine characters or more.

    Of every fifth question the target is possessive: its first term owns its second.
    """
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), Q.terms(F.col("text"), VOCABULARY).alias("terms"))
    longest = F.array_max(F.transform(F.filter("terms", lambda t: F.length(t) >= 9), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))
    both = (F.col("query_id") % 5 == 0) & (F.size("terms") > 1)
    names = F.concat(F.get("terms", F.lit(0)), F.lit("的"), F.get("terms", F.lit(1)))
    owner, thing = Q.possessive(names)
    none = F.array().cast("array<string>")
    return q.select(
        "query_id", "query", "terms", F.when(both, names).otherwise(longest["t"]).alias("target"),
        F.when(both, F.array(owner)).otherwise(none).alias("owners"), F.when(both, F.array(thing)).otherwise(none).alias("descriptors"))


#: How a term is cleaned, in SQL; {0} is the term.
SQL_CLEAN = """trim(regexp_replace(regexp_replace(trim({0}), '^([("''])+', ''), '([.,!?]+)$', ''))"""
SQL_FINE = """length({0}) BETWEEN 2 AND 18 AND NOT regexp_matches(lower({0}), '^([a-zà-öø-ÿœ]{{1,4}}|[0-9]+)$')"""
_SPLIT = """list_concat(regexp_extract_all(text, '[《“「『‘（("]([^》”」』’）)"]{1,24})[》”」』’）)"]', 1), regexp_split_to_array(text, '[，。；;、：:/｜|《》“”「」『』‘’（）()\\s]+'))"""
WITH_QUESTIONS = f"""questions AS (
    SELECT *, CASE WHEN query_id % 5 = 0 AND len(terms) > 1 THEN terms[1] || '的' || terms[2] ELSE list_max(list_transform(list_filter(terms, lambda x: length(x) >= 9), lambda x: {{'n': length(x), 't': x}})).t END AS target,
           CASE WHEN query_id % 5 = 0 AND len(terms) > 1 THEN terms[1] END AS owner, CASE WHEN query_id % 5 = 0 AND len(terms) > 1 THEN terms[2] END AS object
    FROM (SELECT item_id AS query_id, text AS query, list_slice(list_filter(list_transform(w, lambda x, i: CASE WHEN list_position(w, x) = i THEN x END), lambda x: x IS NOT NULL), 1, 48) AS terms
          FROM (SELECT item_id, text, list_filter(list_transform({_SPLIT}, lambda x: {SQL_CLEAN.format('x')}), lambda x: {SQL_FINE.format('x')}) AS w FROM benchmark)))"""


def recall_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences as facts for recall: the first word is the entity; the second, third and last are alias, tag and related entity.

    Those of every fifth document have no id of their own: equal ones of a chapter are the same.
    """
    s = sentences(spark, sf)
    w = F.split("fact", " ")
    entity, last = F.get(w, F.lit(0)), F.element_at(w, -1)
    fields = F.array(entity, F.coalesce(F.get(w, F.lit(1)), F.lit("")), F.coalesce(F.get(w, F.lit(2)), F.lit("")), last)
    chapter = (F.floor(F.col("doc_id") / 20) + 1).cast("int")
    return s.select(F.concat_ws("-", "doc_id", "pos").alias("fact_id"), F.lower(F.concat_ws(" ", "fact", F.array_join(fields, " "))).alias("text"), "fact", entity.alias("entity"),
                    "importance", "confidence", chapter.alias("chapter_index"), fields.alias("fields"), F.lit("").alias("evidence"), F.when(F.col("doc_id") % 5 == 0, F.concat_ws("|", chapter, "fact")).alias("same"))


WITH_RECALL = """f AS (
    SELECT *, lower(fact || ' ' || array_to_string(fields, ' ')) AS low, lower(fact) AS content, lower(fields[1]) AS entity, CASE WHEN doc_id % 5 = 0 THEN chapter_index || '|' || fact ELSE '#' || fact_id END AS same
    FROM (SELECT doc_id, doc_id || '-' || pos AS fact_id, fact, importance, confidence, CAST(doc_id // 20 + 1 AS INT) AS chapter_index, [w[1], coalesce(w[2], ''), coalesce(w[3], ''), w[-1]] AS fields
          FROM (SELECT *, string_split(fact, ' ') AS w FROM sentences)))"""


def groups(spark: SparkSession, sf: str) -> DataFrame:
    """Part brands as index groups of the books b0 to b4."""
    p = table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("k"), F.max("p_size").alias("size"))
    return p.select(F.concat(F.lit("b"), F.col("k") % 5).alias("book_id"), F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]+", "-")).alias("group_key"), F.col("p_brand").alias("name"), (F.col("k") % 3 != 0).alias("enabled"), F.col("k").alias("updated_at"))


WITH_GROUPS = """groups AS (
    SELECT 'b' || (k % 5) AS book_id, lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '-', 'g')) AS group_key, p_brand AS name, k % 3 <> 0 AS enabled, k AS updated_at
    FROM (SELECT p_brand, min(p_partkey) AS k FROM part GROUP BY p_brand))"""


def _with_counters(log: DataFrame) -> DataFrame:
    """A log with time, progress counters and a total."""
    seq = F.col("seq")
    return log.withColumns({"at": F.col("ts").cast("timestamp"), "completed": seq % 12, "failed": seq % 3, "skipped": seq % 2, "total": F.lit(60).cast("long")})


_COUNTERS = "ts AS at, event_id % 12 AS completed, event_id % 3 AS failed, event_id % 2 AS skipped, 60 AS total"


def as_task_events(events: DataFrame) -> DataFrame:
    """Events as a task log, a task a user: signup creates, purchase completes, error fails, the rest is progress."""
    e = F.col("event_type")
    event = F.when(e == "signup", "created").when(e == "purchase", "completed").when(e == "error", "failed").otherwise("progress")
    return _with_counters(events.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), "ts", event.alias("event"), "value"))


def task_events(spark: SparkSession, sf: str) -> DataFrame:
    return as_task_events(table(spark, sf, "events"))


WITH_TASKS = f"""task_events AS (
    SELECT user_id AS task_id, event_id AS seq, ts, value,
           CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'progress' END AS event, {_COUNTERS}
    FROM events)"""
_LOG_EVENT = """CASE WHEN event_type = 'signup' THEN 'created' WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'completed' WHEN event_type = 'error' AND event_id % 4 = 1 THEN 'failed'
    WHEN event_type = 'error' AND event_id % 4 = 2 THEN 'cancelled' WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'paused' WHEN event_type = 'view' AND event_id % 5 = 1 THEN 'running' ELSE 'progress' END"""


def as_task_log(events: DataFrame) -> DataFrame:
    """Twelve events in a row as a task's log, with all kinds of events."""
    return _with_counters(events.select(F.expr("event_id div 12").alias("task_id"), F.col("event_id").alias("seq"), "ts", F.expr(_LOG_EVENT).alias("event")))


def task_log(spark: SparkSession, sf: str) -> DataFrame:
    return as_task_log(table(spark, sf, "events"))


WITH_LOG = f"task_log AS (SELECT event_id // 12 AS task_id, event_id AS seq, ts, {_LOG_EVENT} AS event, {_COUNTERS} FROM events)"


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as parts of analysis runs."""
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("part"), F.col("role").alias("stage"), F.col("text").alias("result"),
                    F.when(F.col("turn") % 3 == 2, "failed").otherwise("completed").alias("status"), F.sha2("text", 256).alias("content_hash"))


WITH_RUNS = """runs AS (
    SELECT conv_id AS run_id, turn AS part, role AS stage, text AS result, CASE WHEN turn % 3 = 2 THEN 'failed' ELSE 'completed' END AS status, sha256(text) AS content_hash
    FROM conversations)"""
