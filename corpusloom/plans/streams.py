"""Queries of task logs and incremental builds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom import tables
from corpusloom.operators import upsert as U
from corpusloom.plans import bind as B
from corpusloom.plans.registry import query
from corpusloom.sources import enrich as E
from corpusloom.streaming import tasks as T



def _state_sql(log: str) -> str:
    """CTEs of the fold of a log, and its rows as ``state``."""
    return f"""en AS (SELECT task_id, min(seq) FILTER (WHERE event = 'cancelled') AS c, min(seq) FILTER (WHERE event IN ('completed', 'failed')) AS d, arg_min(event, seq) FILTER (WHERE event IN ('completed', 'failed')) AS k, max(seq) AS last_seq FROM {log} GROUP BY 1),
    li AS (SELECT task_id, arg_max(completed, seq) FILTER (WHERE event = 'progress') AS done, arg_max(failed, seq) FILTER (WHERE event = 'progress') AS bad, arg_max(skipped, seq) FILTER (WHERE event = 'progress') AS left_out, max(seq) FILTER (WHERE event = 'progress') AS p,
           arg_max(event, seq) FILTER (WHERE event IN ('created', 'running', 'paused')) AS s, max(seq) FILTER (WHERE event IN ('created', 'running', 'paused')) AS sp FROM {log} JOIN en USING (task_id) WHERE (c IS NULL OR seq < c) AND (d IS NULL OR seq < d) GROUP BY 1),
    state AS (SELECT task_id, CASE WHEN c IS NOT NULL AND coalesce(k, '') <> 'completed' THEN 'cancelled' WHEN k IS NOT NULL THEN k WHEN s = 'paused' THEN 'paused' WHEN s = 'created' AND (p IS NULL OR p < sp) THEN 'queued' ELSE 'running' END AS state,
           coalesce(done, 0) AS completed, coalesce(bad, 0) AS failed, coalesce(left_out, 0) AS skipped, coalesce(done, 0) + coalesce(bad, 0) + coalesce(left_out, 0) AS processed, last_seq FROM en LEFT JOIN li USING (task_id))"""


def _eta_sql(log: str) -> str:
    """CTEs of elapsed and remaining time at every event of a log, as ``eta``."""
    return f"""g AS (SELECT task_id, seq, epoch(ts) AS tm, event, coalesce(epoch(ts) - lag(epoch(ts)) OVER w, 0) AS gap, coalesce(lag(event) OVER w = 'paused', false) AS p FROM {log} WINDOW w AS (PARTITION BY task_id ORDER BY seq)),
    su AS (SELECT *, sum(CASE WHEN p THEN gap ELSE 0 END) OVER u AS paused, sum(CASE WHEN event = 'progress' THEN 1 ELSE 0 END) OVER u AS done, tm - first_value(tm) OVER u AS since FROM g WINDOW u AS (PARTITION BY task_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    du AS (SELECT task_id, seq, tm - lag(tm) OVER (PARTITION BY task_id ORDER BY seq) AS took FROM g WHERE event = 'progress'),
    me AS (SELECT task_id, seq, avg(took) FILTER (WHERE took > 0) OVER (PARTITION BY task_id ORDER BY seq ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS mean FROM du),
    jo AS (SELECT su.*, last_value(me.mean IGNORE NULLS) OVER (PARTITION BY su.task_id ORDER BY su.seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mean FROM su LEFT JOIN me ON me.task_id = su.task_id AND me.seq = su.seq),
    eta AS (SELECT task_id, seq, round(since - paused, 2) AS elapsed, CASE WHEN greatest(0, 60 - done) = 0 THEN 0.0 ELSE round(coalesce(mean, CASE WHEN done > 0 THEN round(since - paused, 2) / done END) * greatest(0, 60 - done), 2) END AS remaining FROM jo)"""


_STATE = f"WITH {B.WITH_TASKS}, {_state_sql('task_events')}"


@query("st_task_state", f"WITH {B.WITH_LOG}, {_state_sql('task_log')} SELECT * FROM state")
def st_task_state(spark, sf):
    """State of every task of a log, with the counters of its last progress."""
    return T.fold(B.task_log(spark, sf))


def _events_stream(spark, sf):
    """The given events as a file stream, read where they are."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")


@query("st_task_stream", f"""WITH {B.WITH_LOG}, {_state_sql('task_log')}, {_eta_sql('task_log')}, r AS (SELECT task_id, string_agg(seq || ':' || event, ' ' ORDER BY seq) AS recent FROM task_log GROUP BY 1)
    SELECT s.*, e.elapsed, e.remaining, r.recent FROM state s JOIN eta e ON e.task_id = s.task_id AND e.seq = s.last_seq JOIN r ON r.task_id = s.task_id""")
def st_task_stream(spark, sf):
    """The stateful stream over the log, each event twice: of each task its last update."""
    out = tables.new_folder(spark, "stream")
    log = B.as_task_log(_events_stream(spark, sf))
    twice = log.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).drop("again")
    sink = T.fold_stream(twice).writeStream.outputMode("update").option("checkpointLocation", f"{out}/state")
    sink.foreachBatch(lambda df, epoch: T.deliver(df, epoch, f"{out}/rows")).trigger(availableNow=True).start().awaitTermination()
    last = T.delivered(spark, f"{out}/rows", T.STATE).groupBy("task_id").agg(F.max_by(F.struct("*"), "epoch").alias("x")).select("x.*").drop("epoch")
    return last.withColumn("recent", F.array_join(F.transform("recent", lambda x: F.concat(x["seq"], F.lit(":"), x["event"])), " "))


@query("st_recent", f"WITH {B.WITH_TASKS}, r AS (SELECT task_id, seq, event, row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) AS n FROM task_events) SELECT task_id, seq, event, n <= 80 AS published FROM r WHERE n <= 200")
def st_recent(spark, sf):
    """The last 200 events of a task are kept, the last 80 published."""
    return T.recent(B.task_events(spark, sf))


@query("st_eta", f"WITH {B.WITH_TASKS}, e AS (SELECT task_id, seq, ts, CASE WHEN event = 'created' THEN 'paused' ELSE event END AS event FROM task_events), {_eta_sql('e')} SELECT * FROM eta")
def st_eta(spark, sf):
    """Elapsed time without pauses, and what remains by the mean of the last six units."""
    e = B.task_events(spark, sf).withColumns({"at": F.unix_micros("at").cast("double") / 1e6, "event": F.when(F.col("event") == "created", "paused").otherwise(F.col("event"))})
    return T.durations(e)


@query("st_list", f"{_STATE}, x AS (SELECT * FROM state), k AS (SELECT user_id AS task_id, arg_min(event_type, event_id) AS type FROM events GROUP BY 1) SELECT task_id, last_seq, type, row_number() OVER (PARTITION BY type, state ORDER BY last_seq DESC) AS place FROM x JOIN k USING (task_id) WHERE state = 'failed' AND type IN ('view', 'click')")
def st_list(spark, sf):
    """Tasks of some types and one status, newest first."""
    kind = B.table(spark, sf, "events").groupBy(F.col("user_id").alias("task_id")).agg(F.min_by("event_type", "event_id").alias("type"))
    t = T.fold(B.task_events(spark, sf)).join(kind, "task_id").where("state = 'failed' and type in ('view', 'click')")
    place = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("last_seq")))
    return t.select("task_id", "last_seq", "type", place.cast("long").alias("place"))


@query("st_payload", f"WITH {B.WITH_TASKS} SELECT task_id, seq, event FROM task_events")
def st_payload(spark, sf):
    return B.task_events(spark, sf).select("task_id", "seq", "event")


_KINDS = "k AS (SELECT user_id AS task_id, arg_min(event_type, event_id) AS type FROM events GROUP BY 1)"


@query("agg_task_diag", f"{_STATE}, x AS (SELECT * FROM state), {_KINDS} SELECT 'status' AS kind, state AS value, count(*) AS n FROM x GROUP BY 2 UNION ALL SELECT 'type', type, count(*) FROM k GROUP BY 2 UNION ALL SELECT 'live', '', count(*) FROM x WHERE state = 'running' UNION ALL SELECT 'recent', CAST(task_id AS VARCHAR), last_seq FROM (SELECT * FROM x ORDER BY last_seq DESC, task_id LIMIT 12)")
def agg_task_diag(spark, sf):
    """Tasks by status and by type, how many are live, and the twelve most recent."""
    x = T.fold(B.task_events(spark, sf))
    kind = B.table(spark, sf, "events").groupBy(F.col("user_id").alias("task_id")).agg(F.min_by("event_type", "event_id").alias("type"))
    n = F.count(F.lit(1)).alias("n")
    recent = x.orderBy(F.desc("last_seq"), "task_id").limit(12).select(F.lit("recent").alias("kind"), F.col("task_id").cast("string").alias("value"), F.col("last_seq").alias("n"))
    status = x.groupBy(F.col("state").alias("value")).agg(n).select(F.lit("status").alias("kind"), "value", "n")
    types = kind.groupBy(F.col("type").alias("value")).agg(n).select(F.lit("type").alias("kind"), "value", "n")
    return status.unionByName(types).unionByName(x.where("state = 'running'").agg(n).select(F.lit("live").alias("kind"), F.lit("").alias("value"), "n")).unionByName(recent)


@query("st_subscribe", f"WITH {B.WITH_TASKS}, old AS (SELECT * FROM task_events WHERE seq <= 200), {_state_sql('old')} SELECT 'message' AS kind, task_id, seq, event AS value, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS place FROM task_events WHERE seq > 200 UNION ALL SELECT 'snapshot', task_id, last_seq, state, 0 FROM state")
def st_subscribe(spark, sf):
    """A subscriber gets the state of all tasks as it is, then one message an event that comes later, in order within a task.

    Every batch is delivered twice here, as after a crash; each message still comes once.
    """
    out = tables.new_folder(spark, "subscribe")
    snapshot = T.fold(B.task_events(spark, sf).where("seq <= 200")).select(F.lit("snapshot").alias("kind"), "task_id", F.col("last_seq").alias("seq"), F.col("state").alias("value"), F.lit(0).cast("long").alias("place"))

    def send(df, epoch):
        for _ in range(2):
            T.deliver(df.select("task_id", "seq", "event"), epoch, f"{out}/messages")

    later = B.as_task_events(_events_stream(spark, sf)).where("seq > 200")
    later.writeStream.option("checkpointLocation", f"{out}/state").foreachBatch(send).trigger(availableNow=True).start().awaitTermination()
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("seq")).cast("long")
    sent = T.delivered(spark, f"{out}/messages", "task_id long, seq long, event string")
    return sent.select(F.lit("message").alias("kind"), "task_id", "seq", F.col("event").alias("value"), place.alias("place")).unionByName(snapshot)


@query("st_increment", rf"""WITH {B.WITH_STATUS}, w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(content, ''), '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]{{3,}}')) AS w FROM chapters), n AS (SELECT doc_id, list_filter(list_transform(w, lambda x, i: CASE WHEN list_position(w, x) = i THEN x END), lambda x: x IS NOT NULL) AS items FROM w)
    SELECT c.doc_id, o.outcome, c.content_hash AS source_hash, CASE WHEN o.outcome = 'built' THEN array_to_string(n.items, ',') END AS items, CASE WHEN o.outcome = 'built' THEN len(n.items) END AS n_items
    FROM chapters c LEFT JOIN status s USING (doc_id) JOIN n USING (doc_id), LATERAL (SELECT CASE WHEN s.status = 'completed' AND s.source_hash = c.content_hash THEN 'kept' ELSE 'built' END AS outcome) o""")
def st_increment(spark, sf):
    """Chapters are imported as a stream; those whose stored row isn't completed on the same text go on to the
    extractor, and what it finds is stored with their rows. A batch that runs again calls for nothing again and stores nothing twice."""
    out = tables.new_folder(spark, "increment")
    stored = B.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("now")).join(B.table(spark, sf, "labels"), "doc_id")
    stored = tables.staged(stored.select("doc_id", F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("status"), F.when(F.col("toxic") == 1, "").otherwise(F.col("now")).alias("source_hash")), "stored")

    def build(df, epoch):
        come = df.select("doc_id", "text", F.sha2("text", 256).alias("content_hash"))
        fresh = stored.where("status = 'completed'").select("doc_id", F.col("source_hash").alias("content_hash"))
        work = come.join(fresh, ["doc_id", "content_hash"], "left_anti")
        made = E.enrich(work, "names", "doc_id", "text", f"{out}/answers").join(come.select("doc_id", "content_hash"), "doc_id")
        T.deliver(made.select("doc_id", F.when(F.col("ok"), "completed").otherwise("failed").alias("status"), F.col("content_hash").alias("source_hash"), "items"), epoch, f"{out}/rows")

    stream = spark.readStream.schema(B.table(spark, sf, "documents").schema).parquet(f"{sf}/documents.parquet*")
    stream.writeStream.option("checkpointLocation", f"{out}/state").foreachBatch(build).trigger(availableNow=True).start().awaitTermination()
    new = T.delivered(spark, f"{out}/rows", "doc_id long, status string, source_hash string, items array<string>").withColumnRenamed("epoch", "pos")
    after = U.latest(stored.withColumns({"outcome": F.lit("kept"), "items": F.lit(None).cast("array<string>")}), new.withColumn("outcome", F.lit("built")), ["doc_id"])
    return after.select("doc_id", "outcome", "source_hash", F.array_join("items", ",").alias("items"), F.when(F.col("items").isNotNull(), F.size("items")).cast("long").alias("n_items"))
