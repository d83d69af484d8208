"""Queries of answer normalisation and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import tables
from corpusloom.operators import export as X
from corpusloom.operators import migration as M
from corpusloom.plans import bind as B
from corpusloom.plans.registry import query
from corpusloom.sources import enrich as E
from corpusloom.sources import envelopes as N


def _envelopes(spark, sf):
    """Conversation turns as answers: a text under result, text, output or data, JSON in a fence amid text, an object under a wrapper, a bare text."""
    c = B.table(spark, sf, "conversations")
    inner = F.to_json(F.struct("role", "turn"))
    wrapped = F.when(F.col("turn") % 7 == 4, F.concat(F.lit("Here it is:\n```json\n"), inner, F.lit("\n```\ndone")))
    for i, k in enumerate(N.WRAPPERS):
        wrapped = wrapped.when(F.col("turn") % 7 == i, F.to_json(F.struct(F.lit(1).alias("id"), F.col("text").alias(k))))
    wrapped = wrapped.when(F.col("turn") % 7 == 5, F.concat(F.lit('{"text":null,"output":'), inner, F.lit("}"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", "role", "text", wrapped.alias("payload"))


_INNER = """'{"role":"' || role || '","turn":' || turn || '}'"""


@query("src_envelope", f"SELECT conv_id, turn, CASE WHEN turn % 7 IN (4, 5) THEN {_INNER} ELSE trim(text, ' ' || chr(10)) END AS answer FROM conversations")
def src_envelope(spark, sf):
    return N.opened(_envelopes(spark, sf), F.col("payload"), "v").select("conv_id", "turn", N.plain(F.col("v")).alias("answer"))


@query("src_strip_fence", "SELECT conv_id, turn, trim(text, ' ' || chr(10)) AS body, conv_id AS trusted_id FROM conversations")
def src_strip_fence(spark, sf):
    fenced = F.concat(F.lit("```\n"), "text", F.lit("\n```"))
    return B.table(spark, sf, "conversations").select("conv_id", "turn", N.strip_fence(fenced).alias("body"), F.col("conv_id").alias("trusted_id"))


_BATCH = "SELECT *, doc_id // 50 AS batch, row_number() OVER (PARTITION BY source, doc_id // 50 ORDER BY doc_id) - 1 AS n FROM documents"


def _payloads(spark, sf):
    """Documents of a source and 50 doc_ids as one payload, under each of the keys that a chapter may have."""
    i, t = F.col("doc_id"), F.col("text")
    shapes = [
        F.struct(i.alias("chapterIndex"), t.alias("chapterContent"), F.lit("one").alias("title")), F.struct(F.concat(i, F.lit("th")).alias("sort_id"), t.alias("text")), F.struct(t.alias("content")),
        F.struct(i.alias("index"), t.alias("chapter_content"), F.lit("partial").alias("status")), F.struct(F.lit("none").alias("chapter_index"), t.alias("content"))]
    item = F.coalesce(*[F.when(i % 5 == k, F.to_json(s)) for k, s in enumerate(shapes)])
    d = B.table(spark, sf, "documents").groupBy(F.col("source").alias("book_id"), F.floor(i / 50).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item")))).alias("items"))
    key = F.element_at(F.array(*map(F.lit, N.CONTAINERS)), (F.col("batch") % 5 + 1).cast("int"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit("]"))
    return d.select(F.struct("book_id", "batch").alias("key"), F.concat(F.lit('{"'), key, F.lit('":'), listed, F.lit("}")).alias("payload"), F.lit(1000).alias("start"))


@query("src_chapters_norm", f"SELECT source AS book_id, batch, CAST(CASE WHEN doc_id % 5 IN (2, 4) THEN 1000 + n ELSE doc_id END AS INT) AS chapter_index, CASE WHEN doc_id % 5 = 0 THEN 'one' ELSE '' END AS title, sha256(text) AS content_hash, CASE WHEN doc_id % 5 = 3 THEN 'partial' ELSE 'ok' END AS fetch_status FROM ({_BATCH})")
def src_chapters_norm(spark, sf):
    """Whole chapter texts out of payloads of bounded size."""
    c = N.chapters(_payloads(spark, sf), "key", "payload", "start")
    return c.select("key.book_id", "key.batch", "chapter_index", "title", F.sha2("content", 256).alias("content_hash"), "fetch_status")


@query("src_chapter_wrap", "SELECT doc_id, length(text) AS content_length, CASE WHEN length(text) = 0 THEN 'empty' ELSE 'ok' END AS fetch_status FROM documents")
def src_chapter_wrap(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("content_length"), F.when(F.length("text") == 0, "empty").otherwise("ok").alias("fetch_status"))


@query("src_chapters_collect", """SELECT source AS book_id, doc_id // 50 AS batch, count(*) FILTER (WHERE lang = 'en') AS skipped, '{"chapters":[' || coalesce(string_agg('{"chapter_index":' || doc_id || ',"content_length":' || length(text) || '}', ',' ORDER BY doc_id) FILTER (WHERE lang <> 'en'), '') || ']}' AS payload FROM documents GROUP BY 1, 2""")
def src_chapters_collect(spark, sf):
    """Item texts of a batch as one payload; those that don't parse (of one language here) are counted and left out."""
    item = F.to_json(F.struct(F.col("doc_id").alias("chapter_index"), F.length("text").alias("content_length")))
    d = B.table(spark, sf, "documents").select(F.col("source").alias("book_id"), F.floor(F.col("doc_id") / 50).alias("batch"), "doc_id", F.when(F.col("lang") == "en", F.concat(F.lit("<"), item)).otherwise(item).alias("item"))
    fine = F.try_parse_json("item").isNotNull()
    listed = F.array_sort(F.collect_list(F.when(fine, F.struct("doc_id", "item"))))
    return d.groupBy("book_id", "batch").agg(F.count_if(~fine).alias("skipped"), F.concat(F.lit('{"chapters":['), F.array_join(F.transform(listed, lambda x: x["item"]), ","), F.lit("]}")).alias("payload"))


@query("src_l1_norm", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'v2' ELSE 'l1-route-v1' END AS schema, p_name || ':' || p_type || ':' || replace(p_name, ' ', '|') AS entity, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS keyword,
    CASE WHEN p_size % 2 = 0 THEN 'item' ELSE 'other' END AS signal, CAST(least(1, p_size / 40.0::DOUBLE) AS DOUBLE) AS strength, CAST(p_size / 100.0::DOUBLE AS DOUBLE) AS item_score, 0.0::DOUBLE AS force_score, CAST(1 AS BIGINT) AS event_score, CAST(10 AS INT) AS scores FROM part""")
def src_l1_norm(spark, sf):
    """Snake and camel keys, numbers as text, entities without a name, categories in any case."""
    size = F.col("p_size")
    entity = F.array(F.struct(F.concat(F.lit(" "), "p_name").alias("name"), F.col("p_type").alias("type"), F.split("p_name", " ").alias("aliases")), F.struct(F.lit(" ").alias("name"), F.lit("x").alias("type"), F.array(F.lit("y")).alias("aliases")))
    signal = F.array(F.struct(F.when(size % 2 == 0, " ITEM ").otherwise("things").alias("category"), (size / 40.0).alias("strength"), F.lit("why").alias("reason")))
    scores = F.struct((size / 100.0).cast("string").alias("item"), F.lit(7).alias("event"), F.lit("much").alias("force"))
    snake = F.to_json(F.struct(entity.alias("route_entities"), F.array("p_brand", F.lit(" ")).alias("route_keywords"), signal.alias("signals"), scores.alias("category_scores"), F.when(size % 3 == 0, "v2").alias("route_schema_version")))
    camel = F.to_json(F.struct(entity.alias("routeEntities"), F.array("p_type").alias("keywords"), signal.alias("signals"), scores.alias("categoryScores"), F.when(size % 3 == 0, "v2").alias("routeSchemaVersion")))
    body = F.when(size % 2 == 0, F.to_json(F.struct(snake.alias("result")))).otherwise(camel)
    r = N.routes(tables.spread(B.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")).select("p_partkey", body.alias("body")), "body", B.CATEGORIES)
    one = lambda a: F.get(a, F.lit(0))
    e, g = one(F.col("entities")), one(F.col("signals"))
    return r.where("size(entities) = 1").select(
        "p_partkey", "schema", F.concat_ws(":", e["name"], e["type"], F.array_join(e["aliases"], "|")).alias("entity"), one(F.col("keywords")).alias("keyword"), g["category"].alias("signal"), g["strength"].alias("strength"),
        F.col("scores")["item"].alias("item_score"), F.col("scores")["force"].alias("force_score"), F.col("scores")["event"].cast("long").alias("event_score"), F.size("scores").alias("scores"))


@query("src_l2_norm", f"""WITH {B.WITH_FACTS} SELECT id, chapter_index AS answer_chapter, CASE WHEN event_type = 'click' THEN 'other' ELSE category END AS category, entity, array_to_string(aliases, ',') AS aliases, array_to_string(tags, ',') AS tags, array_to_string(related_entities, ',') AS related_entities, fact_type, fact, array_to_string(evidence, ',') AS evidence,
    importance, CASE WHEN event_type = 'view' THEN 0 ELSE confidence END AS confidence, event_type = 'purchase' AS scope_eligible, event_type AS scope_basis, event_type = 'purchase' AS transformation_eligible, event_type <> 'view' AS scope_fields_complete,
    entity AS creature_type, fact_type AS original_form, fact AS qualification_evidence, CASE WHEN event_type = 'view' THEN '' ELSE entity END AS subject_key, CASE WHEN event_type = 'view' THEN '' ELSE 'current_chapter' END AS identity_basis FROM (SELECT *, fact_type AS event_type FROM facts)""")
def src_l2_norm(spark, sf):
    """All nineteen fields, in snake and camel case; only the boolean true is a flag, a text isn't."""
    t = F.col("fact_type")
    base = ["entity", "aliases", "tags", "evidence", "importance", "fact"]
    shared = [*base, F.when(t == "click", "CLICKED").otherwise(F.upper("category")).alias("category"), t.alias("scope_basis")]
    snake = F.to_json(F.struct(*shared, "related_entities", "fact_type", F.col("confidence").cast("string").alias("confidence"), F.lit(True).alias("scope_eligible"), F.lit(True).alias("transformation_eligible"), F.col("entity").alias("creature_type"), F.col("fact_type").alias("original_form"), F.array("fact").alias("qualification_evidence"), F.col("entity").alias("subject_key"), F.lit("current_chapter").alias("identity_basis")))
    camel = F.to_json(F.struct(*shared, F.col("related_entities").alias("relatedEntities"), t.alias("factType"), F.lit("sure").alias("confidence"), F.lit("true").alias("scope_eligible"), F.lit(1).alias("transformation_eligible"), F.col("entity").alias("creatureType"), t.alias("originalForm"), F.array("fact").alias("qualificationEvidence")))
    texts = F.regexp_replace(F.regexp_replace(snake, '"scope_eligible":true', '"scope_eligible":"true"'), '"transformation_eligible":true', '"transformation_eligible":"true"')
    one = F.when(t == "view", camel).when(t == "purchase", snake).otherwise(texts)
    payload = F.when(t == "view", F.concat(F.lit('{"items":['), one, F.lit(',"no fact"],"chapterIndex":"'), "chapter_index", F.lit('th"}'))).otherwise(F.concat(F.lit('{"output":{"facts":['), one, F.lit('],"chapter_index":'), "chapter_index", F.lit("}}")))
    n = N.facts(B.facts(spark, sf).select("id", payload.alias("payload")), "id", "payload", B.CATEGORIES)
    lists = {c: F.array_join(c, ",") for c in ("aliases", "tags", "related_entities", "evidence", "qualification_evidence")}
    return n.withColumns(lists).drop("pos", "answer_title")


@query("src_summary_text", "SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE trim(text, ' ' || chr(10)) END AS summary, turn % 4 = 3 AS failed FROM conversations")
def src_summary_text(spark, sf):
    """The first text among the keys that isn't empty; an empty answer is an error row."""
    t, blank = F.col("text"), F.lit("  ")
    shapes = [F.concat(F.lit('{"result":'), F.to_json(F.struct(blank.alias("text"), blank.alias("result"), t.alias("output"), F.lit("later").alias("content"))), F.lit("}")), F.to_json(F.struct(F.lit(3).alias("content"), t.alias("data"))), t, F.concat(F.lit('{"output":'), F.to_json(F.struct(blank.alias("text"))), F.lit("}"))]
    answer = F.coalesce(*[F.when(F.col("turn") % 4 == k, s) for k, s in enumerate(shapes)])
    c = N.opened(B.table(spark, sf, "conversations"), answer, "v").select("conv_id", "turn", N.summary_text(F.col("v")).alias("summary"))
    return c.withColumn("failed", F.col("summary").isNull())


@query("src_summary_json", """SELECT conv_id, turn, '{"summary":"' || role || '"}' AS one, CASE WHEN turn % 2 = 0 THEN '{"summary":"' || role || '"}' ELSE '{"title":"' || role || '"}' END AS needed, CASE WHEN turn % 2 = 0 THEN '{"summary":"' || role || '"}' END AS none FROM conversations""")
def src_summary_json(spark, sf):
    """A bare value goes under the only property, or the only required one; an object stays; without a schema a bare value is an error."""
    answer = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.to_json(F.struct(F.col("role").alias("summary"))).alias("output")))).otherwise(F.concat(F.lit('"'), "role", F.lit('"')))
    c, v = N.opened(B.table(spark, sf, "conversations"), answer, "v"), F.col("v")
    return c.select("conv_id", "turn", N.summary_object(v, ("summary",)).alias("one"), N.summary_object(v, ("title", "items", "x"), ("title", "other")).alias("needed"), N.summary_object(v, ("title", "items")).alias("none"))


@query("src_enrich", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]{3,}')) AS w FROM documents)
    SELECT doc_id, true AS ok, 'ok' AS outcome, array_to_string(list_filter(list_transform(w, lambda x, i: CASE WHEN list_position(w, x) = i THEN x END), lambda x: x IS NOT NULL), ',') AS items FROM w""")
def src_enrich(spark, sf):
    """What the extractor finds in every document, each name once in order of sight."""
    e = E.enrich(B.table(spark, sf, "documents"), "names", "doc_id", "text")
    return e.select("doc_id", "ok", "outcome", F.array_join("items", ",").alias("items"))


_KEY = b"0123456789abcdef0123456789abcdef"


def _migrated(spark, sf):
    """Documents as chapters, conversations as runs and turns as their parts, events as facts: all sealed, some badly; then migrated.

    A quarter of the runs is of another mode, a seventh has a damaged prompt, a fifth a damaged result; so has a sixth of the parts;
    a tenth of the facts is bound to something else.
    """
    def sealed(rows, text, aad, bad, prefix=""):
        vector = F.unhex(F.substring(F.sha2(aad, 256), 1, 24))
        columns = M.sealed(text, _KEY, F.when(bad, F.concat(aad, F.lit("!"))).otherwise(aad), vector)
        return rows.withColumns({prefix + n: c for n, c in zip(("ciphertext", "iv", "tag"), columns)})

    d = B.table(spark, sf, "documents").select(F.concat(F.lit("b"), F.col("doc_id") % 20).alias("book_id"), F.col("doc_id").alias("chapter_index"), F.coalesce("text", F.lit("")).alias("text"))
    chapters = sealed(d, F.col("text"), M.bound(M.CHAPTER_BOUND, F.col("book_id"), F.col("chapter_index")), F.lit(False)).drop("text")
    turns = B.table(spark, sf, "conversations")
    r = turns.groupBy(F.col("conv_id").alias("id")).agg(F.min_by("text", "turn").alias("text"), F.count(F.lit(1)).alias("turns"))
    prompt = F.to_json(F.struct(F.when(F.col("id") % 4 == 0, "chapters").otherwise(M.MODE).alias("analysis_mode"), F.struct(F.concat(F.lit("q"), "id").alias("query")).alias("l2_query"), F.array(F.lit("base"), F.concat(F.lit("g"), "turns")).alias("index_group_keys"), F.lit(True).alias("use_l1_context")))
    r = sealed(r, prompt, M.bound(M.PROMPT_BOUND, F.col("id")), F.col("id") % 7 == 3, "prompt_")
    runs = sealed(r, F.when(F.col("id") % 3 > 0, F.col("text")), M.bound(M.RESULT_BOUND, F.col("id")), F.col("id") % 5 == 2).drop("text", "turns")
    p = turns.select(F.col("conv_id").alias("analysis_id"), F.concat(F.lit(" turn."), "turn", F.lit(" ")).alias("part_key"), "turn", "text")
    parts = sealed(p, F.col("text"), M.bound(M.PART_BOUND, F.col("analysis_id"), M.part_key(F.col("part_key"))), (F.col("analysis_id") + F.col("turn")) % 6 == 1).drop("text", "turn")
    chapter = F.col("id") % 3000
    f = B.facts(spark, sf).select("id", F.concat(F.lit("b"), chapter % 20).alias("book_id"), chapter.alias("chapter_index"), F.to_json(F.struct("fact", "evidence", F.lit(7).alias("review_note"))).alias("text"))
    facts = sealed(f, F.col("text"), M.bound(M.FACT_BOUND, F.col("id")), F.col("id") % 10 == 0).drop("text")
    return M.migrate(spark, {"chapters": chapters, "runs": runs, "parts": parts, "facts": facts, "labels": B.table(spark, sf, "labels")}, _KEY, tables.new_folder(spark, "migrated"))


_MIGRATED = f"""WITH {B.WITH_FACTS}, kept AS (SELECT conv_id AS id, min_by(text, turn) AS text, count(*) AS turns FROM conversations WHERE conv_id % 4 <> 0 AND conv_id % 7 <> 3 GROUP BY 1),
    parts AS (SELECT c.*, (conv_id + turn) % 6 = 1 AS bad FROM conversations c WHERE conv_id IN (SELECT id FROM kept))"""


@query("src_migrate", f"""{_MIGRATED}
    SELECT 'chapters' AS tbl, 'b' || (doc_id % 20) || '/' || doc_id AS key, sha256(coalesce(text, '')) AS body, length(coalesce(text, '')) || '' AS more FROM documents
    UNION ALL SELECT 'runs', id || '', coalesce(CASE WHEN id % 3 > 0 AND id % 5 <> 2 THEN sha256(text) END, '-'), '{{"analysis_mode":"l2_query","query":"q' || id || '","index_group_keys":["base","g' || turns || '"]}}' FROM kept
    UNION ALL SELECT 'parts', conv_id || '/ turn.' || turn || ' ', CASE WHEN bad THEN '-' ELSE sha256(text) END, '' FROM parts
    UNION ALL SELECT 'facts', f.id || '', CASE WHEN f.id % 10 = 0 THEN '//' ELSE fact || '/' || evidence[1] || '/7' END, coalesce(d.hash, '') FROM facts f LEFT JOIN (SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents) d ON d.doc_id = f.id % 3000
    UNION ALL SELECT 'labels', doc_id || '', quality || '', toxic || '' FROM labels
    UNION ALL SELECT 'warnings', 'runs/' || id, 'prompt can''t be read, run left out', '' FROM (SELECT DISTINCT conv_id AS id FROM conversations) WHERE id % 7 = 3
    UNION ALL SELECT 'warnings', 'runs/' || id, 'result can''t be read, left empty', '' FROM kept WHERE id % 3 > 0 AND id % 5 = 2
    UNION ALL SELECT 'warnings', 'parts/' || conv_id || '/ turn.' || turn || ' ', 'result can''t be read, left empty', '' FROM parts WHERE bad
    UNION ALL SELECT 'warnings', 'facts/' || id, 'fact can''t be read, left empty', '' FROM facts WHERE id % 10 = 0""")
def src_migrate(spark, sf):
    """A sealed store of five tables in plain: texts, hashes of their chapters, and what couldn't be read."""
    m, said = _migrated(spark, sf), lambda c: F.coalesce(c, F.lit("-"))

    def rows(name, key, body, more, source=None):
        return (m.table(name) if source is None else source).select(F.lit(name).alias("tbl"), key.cast("string").alias("key"), body.cast("string").alias("body"), more.cast("string").alias("more"))

    hashed = said(F.sha2("result", 256))
    each = [
        rows("chapters", F.concat_ws("/", "book_id", "chapter_index"), F.col("content_hash"), F.col("content_length")), rows("runs", F.col("id"), hashed, F.col("prompt_snapshot")),
        rows("parts", F.concat_ws("/", "analysis_id", "part_key"), hashed, F.lit("")), rows("facts", F.col("id"), F.concat_ws("/", "fact", F.array_join("evidence", "|"), "review_note"), F.col("source_hash")),
        rows("labels", F.col("doc_id"), F.col("quality"), F.col("toxic")), rows("warnings", F.concat_ws("/", "tbl", "key"), F.col("message"), F.lit(""), m.warnings())]
    found = each[0]
    for e in each[1:]:
        found = found.unionByName(e)
    return found


@query("src_migrate_counts", f"""{_MIGRATED} SELECT 'chapters' AS tbl, count(*) AS n FROM documents UNION ALL SELECT 'runs', count(*) FROM kept UNION ALL SELECT 'runs_skipped', count(DISTINCT conv_id) - (SELECT count(*) FROM kept) FROM conversations
    UNION ALL SELECT 'parts', count(*) FROM parts UNION ALL SELECT 'facts', count(*) FROM facts UNION ALL SELECT 'labels', count(*) FROM labels""")
def src_migrate_counts(spark, sf):
    """Rows of every migrated table, counted while they were written."""
    return _migrated(spark, sf).counts()


def _exported(spark, sf):
    """Turns as results: a user's text as it is, an assistant's as an object with a table and a nested object; every sixth has no table."""
    r = B.runs(spark, sf)
    part = F.col("part")
    item = F.concat(F.lit('{"part":'), part, F.lit(',"half":'), (part / 2).cast("string"), F.lit(',"done":'), (part % 3 < 2).cast("string"), F.lit(',"Run":"r'), "run_id", F.lit('"}'))
    body = F.concat(F.lit('{"title":"t","items":['), item, F.lit(',"bare"],"place":{"at":{"run":'), "run_id", F.lit("}}}"))
    result = F.when(F.col("stage") == "user", F.col("result")).when(part % 6 == 5, F.lit('{"items":[]}')).otherwise(body)
    folder = tables.new_folder(spark, "export")
    X.write(r.select(F.struct("run_id", "part").alias("key"), F.concat(F.lit("Run: "), "run_id").alias("name"), result.alias("result")), folder)
    return folder


_EXPORTED = f"WITH {B.WITH_RUNS}, o AS (SELECT * FROM runs WHERE stage <> 'user' AND part % 6 <> 5)"


@query("sink_export", f"""{_EXPORTED} SELECT run_id, part, 'markdown' AS kind, '' AS t, 0 AS row, 'Run: ' || run_id AS field, sha256(result) AS value FROM runs WHERE stage = 'user' AND result IS NOT NULL
    UNION ALL SELECT run_id, part, 'json', '', 0, '', '{{"items":[]}}' FROM runs WHERE stage <> 'user' AND part % 6 = 5
    UNION ALL SELECT run_id, part, 'sheet', 'items', 0, unnest(['part', 'half', 'done', 'Run']), unnest([part || '', CAST(part / 2 AS VARCHAR), CAST(part % 3 < 2 AS VARCHAR), 'r' || run_id]) FROM o
    UNION ALL SELECT run_id, part, 'sheet', 'items', 1, 'value', 'bare' FROM o UNION ALL SELECT run_id, part, 'sheet', 'place', 0, 'at / run', run_id || '' FROM o""")
def sink_export(spark, sf):
    """Results exported and read back: Markdown files, cells of typed sheets, and JSON without a table."""
    folder, key = _exported(spark, sf), ["key.run_id", "key.part"]
    row = F.lit(0).alias("row")
    texts = X.texts(spark, folder).select(*key, F.lit("markdown").alias("kind"), F.lit("").alias("t"), row, F.col("name").alias("field"), F.sha2("body", 256).alias("value"))
    sheets = X.cells(spark, folder).select(*key, F.lit("sheet").alias("kind"), "t", "row", "field", "value")
    other = X.untabled(spark, folder, "struct<run_id:bigint,part:bigint>").select(*key, F.lit("json").alias("kind"), F.lit("").alias("t"), row, F.lit("").alias("field"), F.col("body").alias("value"))
    return texts.unionByName(sheets).unionByName(other)


@query("sink_export_sheets", f"""{_EXPORTED}, k AS (SELECT unnest(['Run', 'done', 'half', 'part', 'value', 'at / run']) AS field, unnest(['string', 'boolean', 'double', 'bigint', 'string', 'bigint']) AS kind, unnest([0, 1, 2, 3, 4, 0]) AS position)
    SELECT CASE field WHEN 'at / run' THEN 1 ELSE 0 END AS sheet, CASE field WHEN 'at / run' THEN 'place' ELSE 'items' END AS t, position, field, kind FROM k WHERE EXISTS (SELECT 1 FROM o)""")
def sink_export_sheets(spark, sf):
    """The sheets' columns and their types, told from all values."""
    return X.catalogue(spark, _exported(spark, sf)).select("sheet", "t", "position", "field", "kind")
