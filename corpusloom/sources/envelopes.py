"""Normal forms of service answers: envelopes, fences, chapter lists, routes, facts, summaries.

Answers are text; everything here is a variant column until a field is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import columns as C

# Keys of the answers' formats, in order of preference.
WRAPPERS = ("result", "text", "output", "data")
CONTAINERS = ("chapters", "data", "items", "result", "records")
INDEX = ("chapter_index", "chapterIndex", "index", "sortid", "sort_id")
CONTENT = ("content", "text", "chapter_content", "chapterContent")
TITLE = ("chapter_title", "title")
STATUS = ("fetch_status", "status")
SUMMARY = ("text", "result", "output", "content", "data")
SCOPE = ("scope_eligible", "scope_basis", "transformation_eligible", "creature_type", "original_form", "subject_key", "identity_basis")

_FENCED = r"(?is)```(?:json)?\s*(.*?)```"


def strip_fence(c: Column) -> Column:
    """Without a Markdown code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[a-z]*\s*", ""), r"\s*```$", ""))


def text_variant(c: Column) -> Column:
    """A text as a variant string."""
    return F.try_variant_get(F.parse_json(F.to_json(F.array(c))), "$[0]", "variant")


def parsed(c: Column) -> Column:
    """JSON as it is, else the JSON of the first code fence in the text, else the trimmed text."""
    flat = C.trimmed(F.coalesce(c, F.lit("")))
    return F.coalesce(F.try_parse_json(flat), F.try_parse_json(F.trim(F.nullif(F.regexp_extract(flat, _FENCED, 1), F.lit("")))), text_variant(flat))


def is_a(v: Column, kind: str) -> Column:
    """The variant is an OBJECT, ARRAY, STRING or BOOLEAN."""
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def present(v: Column, *keys: str) -> Column:
    """The first of the object's keys that is there and not null, as a variant."""
    return F.coalesce(*[F.when(~F.is_variant_null(x), x) for k in keys for x in [F.try_variant_get(v, f"$.{k}", "variant")]])


def _taken(v: Column, kind: str, *keys: str) -> Column:
    """The first present key's value as another type, else null; each value is read once where that says the same."""
    if kind == "string" or len(keys) == 1:  # whatever is there is a text, and null is null in any type
        return F.coalesce(*[F.try_variant_get(v, f"$.{k}", kind) for k in keys])
    return F.try_variant_get(present(v, *keys), "$", kind)


def kept(rows: DataFrame, **named: Column) -> DataFrame:
    """rows with columns that are computed here, once a row: a filter on them isn't pushed below, where it
    would be computed from the payload, anew for every mention of a column in a column."""
    others = [c for c in rows.columns if c not in named]
    held = rows.withColumns(named).select(*others, F.explode(F.array(F.struct(*named))).alias("__kept"))
    return held.select(*others, *[F.col("__kept")[n].alias(n) for n in named])


def opened(rows: DataFrame, payload: Column, name: str) -> DataFrame:
    """rows with what an answer holds as variant column ``name``: under one of ``WRAPPERS`` if
    it is an object with one (text there is parsed again), else itself.

    Each step is a column of its own: as one expression the answer would be parsed for every mention.
    """
    rows = rows.withColumn("__parsed", parsed(payload))
    rows = rows.withColumn("__inner", F.when(is_a(F.col("__parsed"), "OBJECT"), present(F.col("__parsed"), *WRAPPERS)))
    rows = rows.withColumn("__text", F.when(is_a(F.col("__inner"), "STRING"), F.try_variant_get("__inner", "$", "string")))
    again = F.when(F.col("__text").isNotNull(), parsed(F.col("__text")))
    return kept(rows, **{name: F.coalesce(again, "__inner", "__parsed")}).drop("__parsed", "__inner", "__text")


def plain(v: Column) -> Column:
    """A variant as text: a string as it is, anything else as JSON."""
    return F.when(is_a(v, "STRING"), F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))


def string(v: Column, *keys: str, default: str = "") -> Column:
    """Trimmed text of the first present key; empty: the default."""
    text = C.trimmed(F.coalesce(_taken(v, "string", *keys), F.lit("")))
    return F.when(text == "", F.lit(default)).otherwise(text) if default else text


def strings(v: Column, *keys: str) -> Column:
    """Trimmed non-empty texts of an array; anything else gives none."""
    found = _taken(v, "array<variant>", *keys)
    texts = F.transform(F.coalesce(found, F.array().cast("array<variant>")), lambda x: C.trimmed(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit(""))))
    return F.filter(texts, lambda t: t != "")


def number(v: Column, *keys: str) -> Column:
    """0 to 1; anything that isn't a finite number is 0."""
    return C.clamp01(_taken(v, "double", *keys))


def integer(v: Column, *keys: str) -> Column:
    """The whole number that the first present key's text begins with, else null."""
    return F.nullif(F.regexp_extract(_taken(v, "string", *keys), r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("int")


def true(v: Column, key: str) -> Column:
    """The boolean true; a text that says so isn't."""
    x = present(v, key)
    return F.coalesce(is_a(x, "BOOLEAN") & F.try_variant_get(x, "$", "boolean"), F.lit(False))


def objects(v: Column, *keys: str) -> Column:
    """The first of the keys that is an array, as an array of variants; else an empty one."""
    # What isn't an array gives null; asking for its kind would walk through all that it holds.
    return F.coalesce(*[F.try_variant_get(v, f"$.{k}", "array<variant>") for k in keys], F.array().cast("array<variant>"))


def chapters(rows: DataFrame, id_column: str, payload: str, start: str) -> DataFrame:
    """Chapters of payloads: a list (bare or under one of ``CONTAINERS``), one object with a text, or a bare text.

    Columns: id, chapter_index (an ``INDEX`` key's leading number, else the start
    plus the place), title, content (a ``CONTENT`` key, may be empty), fetch_status (default ok).
    """
    v = opened(rows, F.col(payload), "__v").select(id_column, start, "__v")
    whole = F.try_variant_get("__v", "$", "array<variant>")
    one = F.when(is_a(F.col("__v"), "STRING") | is_a(F.try_variant_get("__v", "$.content", "variant"), "STRING") | is_a(F.try_variant_get("__v", "$.text", "variant"), "STRING"), F.array("__v"))
    inside = objects(F.col("__v"), *CONTAINERS)
    listed = F.when(is_a(F.col("__v"), "ARRAY"), whole).when(F.size(inside) > 0, inside).otherwise(one)
    each = v.select(id_column, start, F.posexplode(listed).alias("__pos", "__item"))
    item = F.col("__item")

    def text(*keys: str) -> Column:
        return F.coalesce(F.try_variant_get(present(item, *keys), "$", "string"), F.lit(""))

    content = F.when(is_a(item, "STRING"), F.try_variant_get(item, "$", "string")).otherwise(text(*CONTENT))
    status = F.when(present(item, *STATUS).isNull(), "ok").otherwise(text(*STATUS))
    return each.select(id_column, F.coalesce(integer(item, *INDEX), F.col(start) + F.col("__pos")).cast("int").alias("chapter_index"), text(*TITLE).alias("title"), content.alias("content"), status.alias("fetch_status"))


def routes(rows: DataFrame, payload: str, categories: tuple[str, ...]) -> DataFrame:
    """rows with their route answer as columns: schema, entities, keywords, signals, and the scores of all categories."""
    rows, v = opened(rows, F.col(payload), "__v").withColumn("__scores", present(F.col("__v"), "category_scores", "categoryScores")), F.col("__v")
    entity = F.transform(objects(v, "route_entities", "routeEntities", "entities"), lambda e: F.struct(
        string(e, "name").alias("name"), string(e, "type").alias("type"), strings(e, "aliases").alias("aliases"), string(e, "role").alias("role"), string(e, "note").alias("note")))
    signal = F.transform(F.filter(objects(v, "signals"), lambda s: is_a(s, "OBJECT")), lambda s: F.struct(
        C.category(string(s, "category"), categories).alias("category"), number(s, "strength").alias("strength"), strings(s, "entities").alias("entities"), strings(s, "keywords").alias("keywords"), string(s, "reason").alias("reason")))
    return kept(rows, **{
        "schema": string(v, "route_schema_version", "routeSchemaVersion", default="l1-route-v1"), "entities": F.filter(entity, lambda e: e["name"] != ""),
        "keywords": strings(v, "route_keywords", "routeKeywords", "keywords"), "signals": signal,
        "scores": F.map_from_arrays(F.array(*map(F.lit, categories)), F.array(*[number(F.col("__scores"), k) for k in categories]))}).drop("__v", "__scores")


def facts(rows: DataFrame, id_column: str, payload: str, categories: tuple[str, ...]) -> DataFrame:
    """Facts of answers (list under facts or items): id, pos, chapter and the nineteen fields.

    Flags are true only for the boolean; scope_fields_complete says that all keys of ``SCOPE`` are there.
    """
    v = opened(rows, F.col(payload), "__v").select(id_column, "__v")
    head = (F.coalesce(integer(F.col("__v"), "chapter_index", "chapterIndex"), F.lit(0)).alias("answer_chapter"), string(F.col("__v"), "chapter_title", "chapterTitle", "title").alias("answer_title"))
    each = v.select(id_column, *head, F.posexplode(F.filter(objects(F.col("__v"), "facts", "items"), lambda x: is_a(x, "OBJECT"))).alias("pos", "__f"))
    f = F.col("__f")
    keys = F.map_keys(F.try_variant_get(f, "$", "map<string,variant>"))
    return each.select(
        id_column, "pos", "answer_chapter", "answer_title", C.category(string(f, "category"), categories).alias("category"), string(f, "entity").alias("entity"), strings(f, "aliases").alias("aliases"), strings(f, "tags").alias("tags"),
        strings(f, "related_entities", "relatedEntities").alias("related_entities"), string(f, "fact_type", "factType").alias("fact_type"), string(f, "fact").alias("fact"), strings(f, "evidence").alias("evidence"),
        number(f, "importance").alias("importance"), number(f, "confidence").alias("confidence"), true(f, "scope_eligible").alias("scope_eligible"), string(f, "scope_basis").alias("scope_basis"), true(f, "transformation_eligible").alias("transformation_eligible"),
        F.forall(F.array(*map(F.lit, SCOPE)), lambda k: F.array_contains(keys, k)).alias("scope_fields_complete"),
        string(f, "creature_type", "creatureType").alias("creature_type"), string(f, "original_form", "originalForm").alias("original_form"), strings(f, "qualification_evidence", "qualificationEvidence").alias("qualification_evidence"),
        string(f, "subject_key", "subjectKey").alias("subject_key"), string(f, "identity_basis", "identityBasis").alias("identity_basis"))


def summary_object(v: Column, properties: tuple[str, ...] = (), required: tuple[str, ...] = ()) -> Column:
    """Opened summary as a JSON object: an object stays; anything else goes under the
    only property, or the only required one of several; null if that can't be told."""
    matched = [k for k in required if k in properties]
    key = properties[0] if len(properties) == 1 else matched[0] if len(matched) == 1 else None
    wrapped = F.concat(F.lit('{"' + key + '":'), F.to_json(v), F.lit("}")) if key else F.lit(None).cast("string")
    return F.when(is_a(v, "OBJECT"), F.to_json(v)).otherwise(wrapped)


def summary_text(v: Column) -> Column:
    """Opened summary as text: a text, or the first non-empty text under ``SUMMARY``; null: the answer is empty."""
    own = F.when(is_a(v, "STRING"), F.nullif(C.trimmed(F.try_variant_get(v, "$", "string")), F.lit("")))
    texts = [F.when(is_a(x, "STRING"), F.nullif(C.trimmed(F.try_variant_get(x, "$", "string")), F.lit(""))) for k in SUMMARY for x in [F.try_variant_get(v, f"$.{k}", "variant")]]
    return F.coalesce(own, *texts)
