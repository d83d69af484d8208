"""Queries of packing and summarising."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import tables
from corpusloom.functions import columns as C
from corpusloom.functions import questions as Q
from corpusloom.operators import packing as P
from corpusloom.operators import recall as R
from corpusloom.operators import summaries as S
from corpusloom.plans import bind as B
from corpusloom.plans.questions import _SCORED, _best, _facts, _terms
from corpusloom.plans.registry import query
from corpusloom.sources import enrich as E


#: Forms of a fact, longest to shortest: characters of the fact and of its evidence (0: without evidence).
_FORMS = ((420, 80), (220, 48), (120, 0), (60, 0))
#: A chunk's budget: small, so that the given sentences are shortened, too; and one prompt's, beyond which a question is answered in chunks.
_BUDGET, _DIRECT = 640, 24_000


def _entries(spark, sf):
    """The 120 best facts of every question with the sizes of their forms as JSON; written once, they are used several times."""
    facts = _facts(spark, sf)
    top = R.ranked(_best(spark, sf, 120), 120).select("query_id", "fact_id", "place", "chapter_index")
    e = top.join(facts.select("fact_id", "fact", "fields", "importance", "confidence"), "fact_id")
    overhead = B.questions(spark, sf).select("query_id", (100 + F.length("query") % 50).cast("long").alias("overhead"))
    forms = F.array(*[C.clip(F.col("fact"), n) for n, _ in _FORMS])

    def size(n: int, chars: int):
        evidence = C.string_array(F.array("fact"), 1, chars) if chars else F.array().cast("array<string>")
        return F.length(F.to_json(F.struct("chapter_index", F.get("fields", F.lit(0)).alias("entity"), F.col("fields").alias("tags"), C.clip(F.col("fact"), n).alias("fact"), evidence.alias("evidence"), "importance", "confidence")))

    e = e.withColumns({"forms": forms, "sizes": F.array(*[size(*f) for f in _FORMS])}).join(overhead, "query_id")
    return tables.staged(e.withColumn("size", F.get("sizes", F.lit(0))).select("query_id", "fact_id", "place", "chapter_index", "fact", "forms", "sizes", "size", "overhead"), "entries")


_FORM = r"CASE WHEN length(t) > {n} THEN substr(t, 1, {n} - 3) || '...' ELSE t END"


def _json(n: int, chars: int) -> str:
    evidence = f"[substr(trim(fact, ' '), 1, {chars})]" if chars else "CAST([] AS VARCHAR[])"
    return f"length(CAST(json_object('chapter_index', chapter_index, 'entity', fields[1], 'tags', fields, 'fact', {_FORM.format(n=n)}, 'evidence', {evidence}, 'importance', importance, 'confidence', confidence) AS VARCHAR))"


_ENTRIES = _SCORED + r""", e AS (SELECT *, s[1] AS size FROM (SELECT query_id, fact_id, place, chapter_index, fact, overhead, [""" + ", ".join(_FORM.format(n=n) for n, _ in _FORMS) + "] AS forms, [" + ", ".join(_json(*f) for f in _FORMS) + r"""] AS s
    FROM (SELECT r.query_id, r.fact_id, CAST(r.place AS INT) AS place, r.chapter_index, f.fact, f.fields, f.importance, f.confidence, 100 + length(q.query) % 50 AS overhead, trim(regexp_replace(f.fact, '[ 	

]+', ' ', 'g'), ' ') AS t FROM ranked r JOIN f USING (fact_id) JOIN questions q ON q.query_id = r.query_id WHERE r.place <= 120)))"""


def _prompt(overhead: str, listed: str, n: str) -> str:
    return f"({overhead} + length(CAST({n} AS VARCHAR)) + 2 + {listed} + greatest({n} - 1, 0))"


_BESIDE = f"(q.n > 0 AND {_prompt('e.overhead', 'q.held + e.s[1]', '(q.n + 1)')} <= {_BUDGET})"
_NEXT = f"list_position(list_transform(e.s, lambda z: e.overhead + 3 + z <= {_BUDGET}), true)"
_CHUNKS = _ENTRIES.replace("WITH ", "WITH RECURSIVE ", 1) + f""", q AS (
        SELECT query_id, CAST(0 AS INT) AS place, CAST(0 AS INT) AS chunk, CAST(0 AS INT) AS n, CAST(0 AS BIGINT) AS held, CAST(0 AS INT) AS rung, false AS omitted FROM e WHERE place = 1
        UNION ALL
        SELECT e.query_id, e.place, CASE WHEN {_BESIDE} OR coalesce({_NEXT}, 0) = 0 THEN q.chunk ELSE q.chunk + 1 END,
               CASE WHEN {_BESIDE} THEN q.n + 1 WHEN coalesce({_NEXT}, 0) = 0 THEN 0 ELSE 1 END,
               CASE WHEN {_BESIDE} THEN q.held + e.s[1] WHEN coalesce({_NEXT}, 0) = 0 THEN 0 ELSE e.s[{_NEXT}] END,
               CASE WHEN {_BESIDE} THEN 0 WHEN coalesce({_NEXT}, 0) = 0 THEN NULL ELSE {_NEXT} - 1 END, NOT {_BESIDE} AND coalesce({_NEXT}, 0) = 0
        FROM q JOIN e ON e.query_id = q.query_id AND e.place = q.place + 1),
    p AS (SELECT query_id, place, CASE WHEN NOT omitted THEN chunk END AS chunk, rung FROM q WHERE place > 0)"""


@query("pk_length", f"{_ENTRIES} SELECT query_id, CAST({_prompt('max(overhead)', 'sum(size)', 'count(*)')} AS BIGINT) AS chars FROM e GROUP BY 1")
def pk_length(spark, sf):
    """Length of the whole prompt of a question with all its facts."""
    chars = P.prompt_chars(F.max("overhead"), F.sum("size"), F.count(F.lit(1)))
    return _entries(spark, sf).groupBy("query_id").agg(chars.alias("chars"))


@query("pk_chunks", f"{_CHUNKS} SELECT query_id, place, CAST(chunk AS INT) AS chunk, CAST(rung AS INT) AS rung FROM p")
def pk_chunks(spark, sf):
    return P.chunk_numbers(_entries(spark, sf), _BUDGET)


@query("pk_trim", f"""{_CHUNKS}, pt AS (SELECT query_id, max(chunk) AS total FROM p GROUP BY 1), pu AS (SELECT p.query_id, p.place, p.chunk, pt.total, e.overhead, count(*) OVER w AS n, CAST(sum(e.s[p.rung + 1]) OVER w AS BIGINT) AS listed FROM p JOIN e ON e.query_id = p.query_id AND e.place = p.place JOIN pt ON pt.query_id = p.query_id WHERE p.chunk IS NOT NULL WINDOW w AS (PARTITION BY p.query_id, p.chunk ORDER BY p.place))
    SELECT query_id, place, CAST(chunk AS INT) AS chunk, {_prompt('overhead + length(CAST(chunk AS VARCHAR)) + length(CAST(total AS VARCHAR))', 'listed', 'n')} <= {_BUDGET} AS kept FROM pu""")
def pk_trim(spark, sf):
    """What each chunk keeps when its prompt also has its number and how many there are."""
    e = _entries(spark, sf)
    packed = P.chunk_numbers(e, _BUDGET).where("chunk is not null").join(e.select("query_id", "place", "sizes", "overhead"), ["query_id", "place"])
    return P.trimmed(packed.withColumn("size", F.get("sizes", F.col("rung"))), _BUDGET).select("query_id", "place", "chunk", "kept")


_FLAT = r"trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')"


@query("pk_fit_one", f"SELECT doc_id, CASE WHEN least(length(t), 420) + 80 <= 300 THEN length(t) WHEN least(length(t), 220) + 48 <= 300 THEN least(length(t), 220) END AS n, CASE WHEN length(t) + 80 <= 300 THEN 80 WHEN least(length(t), 220) + 48 <= 300 THEN 48 END AS evidence FROM (SELECT doc_id, {_FLAT} AS t FROM documents)")
def pk_fit_one(spark, sf):
    """The longest form of a text and its evidence that fits into 300 characters."""
    d = B.table(spark, sf, "documents").withColumn("evidence", F.array(F.lit("e" * 100)))
    forms = F.array(*[F.struct(C.clip(F.col("text"), n).alias("fact"), F.array_join(C.string_array(F.col("evidence"), items, chars), "").alias("evidence")) for n, items, chars in ((420, 1, 80), (220, 1, 48), (120, 0, 0), (60, 0, 0))])
    fit = F.get(F.filter(forms, lambda f: F.length(f["fact"]) + F.length(f["evidence"]) <= 300), F.lit(0))
    return d.withColumn("fit", fit).select("doc_id", F.length("fit.fact").cast("long").alias("n"), F.length("fit.evidence").alias("evidence"))


def _compact(n: str, text: str, **fields: str) -> str:
    listed = ", ".join(f"'{k}', {v}" for k, v in fields.items())
    return f"CAST(json_object({listed}, 'markdown', {_FORM.format(n=n)}) AS VARCHAR)".replace("length(t)", f"length({text})").replace("substr(t,", f"substr({text},").replace("ELSE t END", f"ELSE {text} END")


_LADDER = f"(SELECT unnest([{', '.join(map(str, S.LADDER))}]) AS step)"
_RUN_FIELDS = {"batch": "part", "total": "total", "chapters": "[part]", "fact_count": "1"}
_RUN_TEXT = r"trim(regexp_replace(result, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')"
_MERGE_BUDGET = 900


@query("pk_merge_fit", f"""WITH {B.WITH_RUNS}, r AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS total, {_RUN_TEXT} AS t FROM runs), s AS (SELECT run_id, step, 50 + 2 + sum(length({_compact("step", "t", **_RUN_FIELDS)})) + count(*) - 1 AS chars FROM r, {_LADDER} GROUP BY 1, 2)
    SELECT run_id, CAST(coalesce(max(step) FILTER (WHERE chars <= {_MERGE_BUDGET}), 40) AS INT) AS step, CAST(coalesce(max(chars) FILTER (WHERE chars <= {_MERGE_BUDGET}), min(chars)) AS BIGINT) AS chars FROM s GROUP BY 1""")
def pk_merge_fit(spark, sf):
    """The largest clip at which all parts of a run fit together, with all that stands around them, and the input's length then."""
    r = B.runs(spark, sf)
    r = r.join(r.groupBy("run_id").agg(F.count(F.lit(1)).alias("total")), "run_id")
    r = r.select("run_id", F.col("part").alias("batch"), "total", F.array("part").alias("chapters"), F.lit(1).alias("fact_count"), F.col("result").alias("markdown"))
    return S.steps(r, ["run_id"], _MERGE_BUDGET, F.lit(50))


@query("pk_mode", f"""{_CHUNKS}, r AS (SELECT query_id, regexp_matches(lower(query), 'there') AND regexp_matches(lower(query), 'an') AND regexp_matches(lower(query), 'th') AS many FROM questions)
    SELECT e.query_id, CASE WHEN r.many THEN 'collection_' ELSE '' END || CASE WHEN sum(e.size) <= 24000 THEN 'direct' ELSE 'chunked' END AS mode, CASE WHEN sum(e.size) <= 24000 THEN 0 ELSE count(*) FILTER (WHERE p.chunk IS NULL) END AS omitted, CAST(CASE WHEN sum(e.size) <= 24000 THEN 1 ELSE coalesce(max(p.chunk), 0) END AS INT) AS chunks
    FROM e JOIN p ON p.query_id = e.query_id AND p.place = e.place JOIN r ON r.query_id = e.query_id GROUP BY e.query_id, r.many""")
def pk_mode(spark, sf):
    """Direct where all facts fit together, else in chunks; collection questions by their own modes; what no chunk takes is omitted."""
    v = Q.Vocabulary(leading="-", trailing="-", stop="-", asks=(("there", "list"),), many="an", subjects="th")
    e = _entries(spark, sf)
    both = e.select("query_id", "place", "size").join(P.chunk_numbers(e, _BUDGET), ["query_id", "place"])
    n = both.groupBy("query_id").agg(F.sum("size").alias("size"), F.count_if(F.col("chunk").isNull()).alias("omitted"), F.coalesce(F.max("chunk"), F.lit(0)).alias("chunks"))
    q = B.questions(spark, sf).select("query_id", Q.collection_reason(F.col("query"), v).alias("reason"))
    fits = F.col("size") <= _DIRECT
    mode = F.concat(F.when(F.col("reason") != "", "collection_").otherwise(""), F.when(fits, "direct").otherwise("chunked"))
    return n.join(q, "query_id").select("query_id", mode.alias("mode"), F.when(fits, 0).otherwise(F.col("omitted")).cast("long").alias("omitted"), F.when(fits, 1).otherwise(F.col("chunks")).alias("chunks"))


@query("pk_budget_guard", f"WITH {B.WITH_RUNS} SELECT run_id, CAST(sum(length(result)) AS BIGINT) AS chars FROM runs GROUP BY 1 HAVING sum(length(result)) > 2000")
def pk_budget_guard(spark, sf):
    return B.runs(spark, sf).groupBy("run_id").agg(F.sum(F.length("result")).alias("chars")).where("chars > 2000")


_MD = f"{_CHUNKS}, m AS (SELECT p.query_id, p.chunk, string_agg('- [' || e.chapter_index || '] ' || e.forms[p.rung + 1], chr(10) ORDER BY e.place) AS body FROM p JOIN e ON e.query_id = p.query_id AND e.place = p.place WHERE p.chunk IS NOT NULL GROUP BY 1, 2)"


def _markdown(spark, sf):
    e = _entries(spark, sf)
    rows = P.chunk_numbers(e, _BUDGET).where("chunk is not null").join(e.select("query_id", "place", "chapter_index", "forms"), ["query_id", "place"])
    line = F.format_string("- [%d] %s", "chapter_index", F.get("forms", F.col("rung")))
    listed = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    return rows.groupBy("query_id", "chunk").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("body"), F.collect_set("chapter_index").alias("chapters"), F.count(F.lit(1)).alias("fact_count"))


@query("pk_md_batch", f"{_MD} SELECT query_id, CAST(chunk AS INT) AS chunk, body FROM m")
def pk_md_batch(spark, sf):
    return _markdown(spark, sf).select("query_id", "chunk", "body")


@query("pk_md_merge", f"{_MD} SELECT query_id, string_agg('## Part ' || chunk || chr(10) || body, chr(10) || chr(10) ORDER BY chunk) AS answer FROM m GROUP BY 1")
def pk_md_merge(spark, sf):
    part = F.format_string("## Part %d\n%s", "chunk", "body")
    listed = F.array_sort(F.collect_list(F.struct("chunk", part.alias("part"))))
    return _markdown(spark, sf).groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: x["part"]), "\n\n").alias("answer"))


@query("pk_md_direct", f"{_ENTRIES} SELECT query_id, string_agg('- ' || substr(fact, 1, 40), chr(10) ORDER BY place) AS answer FROM e WHERE place <= 5 GROUP BY 1")
def pk_md_direct(spark, sf):
    listed = F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("- "), F.substring("fact", 1, 40)).alias("line"))))
    return _entries(spark, sf).where("place <= 5").groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("answer"))


@query("pk_md_empty", f"{_SCORED} SELECT q.query_id, CASE WHEN count(s.fact_id) = 0 THEN 'Nothing was recalled.' ELSE 'recalled ' || count(s.fact_id) END AS answer FROM questions q LEFT JOIN scored s USING (query_id) GROUP BY 1")
def pk_md_empty(spark, sf):
    n = R.score(_facts(spark, sf), _terms(spark, sf)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    q = B.questions(spark, sf).select("query_id").join(n, "query_id", "left")
    return q.select("query_id", F.when(F.col("n").isNull(), "Nothing was recalled.").otherwise(F.concat(F.lit("recalled "), "n")).alias("answer"))


_ERROR = "CASE event_type WHEN 'error' THEN 'Model x is UNAVAILABLE' WHEN 'view' THEN 'socket timed out' WHEN 'click' THEN 'returned Empty Text' WHEN 'signup' THEN 'upstream timeout' ELSE 'bad key' END"


@query("pk_fallback", f"SELECT event_id, CASE event_type WHEN 'error' THEN 'model_unavailable' WHEN 'view' THEN 'transport_unavailable' WHEN 'click' THEN 'empty_text' WHEN 'signup' THEN 'model_unavailable' ELSE '' END AS reason FROM events")
def pk_fallback(spark, sf):
    return B.table(spark, sf, "events").select("event_id", P.fallback_reason(F.expr(_ERROR)).alias("reason"))


_SUMMARY_FIELDS = {"batch": "chunk", "total": "total", "chapters": "chapters", "fact_count": "fact_count"}
_SUMMARY_BUDGET = _DIRECT


@query("pk_summarise", f"""{_MD}, u AS (SELECT p.query_id, p.chunk, list_sort(list_distinct(list(e.chapter_index))) AS v, count(*) AS fact_count FROM p JOIN e ON e.query_id = p.query_id AND e.place = p.place WHERE p.chunk IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT m.*, u.fact_count, CASE WHEN len(v) <= 10 THEN v ELSE list_concat(v[1:5], v[-5:]) END AS chapters, max(chunk) OVER (PARTITION BY query_id) AS total, trim(regexp_replace('## Facts ' || body, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS t FROM m JOIN u USING (query_id, chunk)),
    h AS (SELECT query_id, 'Question: ' || query || chr(10) AS head FROM questions),
    s AS (SELECT query_id, step, max(length(head)) + 2 + sum(length({_compact("step", "t", **_SUMMARY_FIELDS)})) + count(*) - 1 AS chars FROM r JOIN h USING (query_id), {_LADDER} GROUP BY 1, 2),
    fit AS (SELECT query_id, coalesce(max(step) FILTER (WHERE chars <= {_SUMMARY_BUDGET}), 40) AS step FROM s GROUP BY 1)
    SELECT query_id, count(*) AS parts, count(*) FILTER (WHERE length(body) % 3 = 0) AS reused, CAST(max(step) AS INT) AS step, '## Facts' || chr(10) || max(head) || '[' || string_agg({_compact("step", "t", **_SUMMARY_FIELDS)}, ',' ORDER BY chunk) || ']' AS answer, 'merged' AS how FROM r JOIN fit USING (query_id) JOIN h USING (query_id) GROUP BY 1""")
def pk_summarise(spark, sf):
    """Chunks through the summariser, but those that an earlier run has done with equal keys, then one merge call a question, its input clipped until it fits.

    The earlier run here has a third of the parts, each also failed, with another
    prompt, another model and without a result, none of which counts.
    """
    parts = _markdown(spark, sf).withColumns({"content_hash": F.sha2("body", 256), "prompt_hash": F.lit("p"), "schema_hash": F.lit(""), "model": F.lit("m"), "effort": F.lit("low")})
    parts = tables.staged(parts, "parts")
    keys = ["content_hash", "prompt_hash", "schema_hash", "model", "effort"]
    third = parts.where("length(body) % 3 = 0").withColumns({"status": F.lit("completed"), "result": F.concat(F.lit("## Facts\n"), "body")})
    wrong = F.lit("not this one")
    rest = parts.withColumns({"status": F.lit("completed"), "result": wrong})
    others = [rest.withColumn("status", F.lit("failed")), rest.withColumn("prompt_hash", F.lit("q")), rest.withColumn("model", F.lit("n")), rest.withColumn("effort", F.lit("high")), rest.withColumn("result", F.lit(""))]
    cache = third
    for o in others:
        cache = cache.unionByName(o)
    found = P.reused(parts, cache, keys)
    hits = found.where("result is not null").select("query_id", "chunk", "result", F.lit(True).alias("hit"))
    made = E.summarise(found.where("result is null"), "excerpt", ["query_id", "chunk"], "body").where("ok").select("query_id", "chunk", "result", F.lit(False).alias("hit"))
    every = hits.unionByName(made)
    counts = every.groupBy("query_id").agg(F.count(F.lit(1)).alias("parts"), F.count_if("hit").alias("reused"), F.max("chunk").cast("int").alias("total"))
    about = parts.select("query_id", "chunk", "chapters", "fact_count")
    results = every.join(about, ["query_id", "chunk"]).join(counts.select("query_id", "total"), "query_id").join(B.questions(spark, sf).select("query_id", "query"), "query_id")
    results = tables.staged(results.withColumnsRenamed({"chunk": "batch", "result": "markdown"}), "results")
    answers = S.merged(results, ["query_id"], "excerpt", _SUMMARY_BUDGET, F.concat(F.lit("Question: "), "query", F.lit("\n")))
    return answers.join(counts, "query_id").select("query_id", "parts", "reused", "step", "answer", "how")
