"""Queries of scalar and array rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import columns as C
from corpusloom.functions import questions as Q
from corpusloom.operators import json_views as J
from corpusloom.plans import bind as B
from corpusloom.plans.registry import query


@query("fn_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def fn_hash(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("fn_rule_hash", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'l2-default' ELSE sha256('l2' || chr(10) || p_name) END AS rule_hash, CASE WHEN p_size % 4 = 0 THEN 'l2-default' ELSE sha256('l2:' || p_brand || chr(10) || p_name) END AS group_hash FROM part")
def fn_rule_hash(spark, sf):
    rule = F.when(F.col("p_size") % 4 == 0, "  ").otherwise(F.col("p_name"))
    default = "Extract all facts."
    return B.table(spark, sf, "part").select("p_partkey", C.rule_hash(rule, default, "l2").alias("rule_hash"), C.rule_hash(rule, default, "l2", F.col("p_brand")).alias("group_hash"))


@query("fn_run_hash", f"WITH {B.WITH_RUNS} SELECT run_id, part, sha256('l2_query' || chr(10) || result || chr(10) || stage) AS run_hash FROM runs")
def fn_run_hash(spark, sf):
    return B.runs(spark, sf).select("run_id", "part", F.sha2(F.concat_ws("\n", F.lit("l2_query"), "result", "stage"), 256).alias("run_hash"))


@query("fn_signature", "SELECT p_partkey, lower(split_part(p_brand, '#', 1)) || ':' || p_type || ':' || p_size AS signature FROM part")
def fn_signature(spark, sf):
    return B.table(spark, sf, "part").select("p_partkey", F.concat_ws(":", F.lower(F.split_part("p_brand", F.lit("#"), F.lit(1))), "p_type", "p_size").alias("signature"))


@query("fn_stable_hash", """SELECT c_custkey, sha256('{"a":[1,"x"],"name":"' || c_name || '","nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '"}') AS stable_hash FROM customer""")
def fn_stable_hash(spark, sf):
    """The hash doesn't depend on the order in which an object has its keys."""
    flip = F.col("c_custkey") % 2 == 0
    fields = [F.col("c_mktsegment").alias("segment"), F.array(F.lit("1"), F.lit("x")).alias("a"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")]
    body = F.regexp_replace(F.when(flip, F.to_json(F.struct(*fields))).otherwise(F.to_json(F.struct(*reversed(fields)))), '"1"', "1")
    return B.table(spark, sf, "customer").select("c_custkey", C.stable_hash(body).alias("stable_hash"))


_KEY_SQL = "substr(regexp_replace(regexp_replace(regexp_replace(lower(trim({0}, ' ')), '[^a-z0-9_-]+', '-', 'g'), '-+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g'), 1, 64)"


@query("fn_key", f"SELECT doc_id, CASE WHEN k = '' THEN 'base' ELSE k END AS group_key FROM (SELECT doc_id, {_KEY_SQL.format('split_part(text, chr(10), 1)')} AS k FROM documents)")
def fn_key(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", C.key(F.substring_index("text", "\n", 1)).alias("group_key"))


@query("fn_slugify", "SELECT p_partkey, regexp_replace(replace(replace(lower(p_type), 'standard', 'std'), 'economy', 'eco'), '[^a-z0-9]+', '-', 'g') AS slug FROM part")
def fn_slugify(spark, sf):
    s = F.lower("p_type")
    for word, short in (("standard", "std"), ("economy", "eco")):
        s = F.replace(s, F.lit(word), F.lit(short))
    return B.table(spark, sf, "part").select("p_partkey", F.regexp_replace(s, "[^a-z0-9]+", "-").alias("slug"))


@query("fn_clamp01", "SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(0, least(1, l_quantity / 30 - 0.25)), 9) AS score FROM lineitem")
def fn_clamp01(spark, sf):
    return B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(C.clamp01(F.col("l_quantity") / 30 - 0.25), 9).alias("score"))


@query("fn_str_array", "SELECT doc_id, array_to_string(list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: substr(trim(x, ' '), 1, 20)), lambda x: x <> ''), 1, 5), '|') AS items FROM documents")
def fn_str_array(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", F.array_join(C.string_array(F.split("text", "\n"), 5, 20), "|").alias("items"))


@query("fn_clip", r"""SELECT doc_id, CASE WHEN length(t) > 80 THEN substr(t, 1, 77) || '...' ELSE t END AS clipped
    FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS t FROM documents)""")
def fn_clip(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", C.clip(F.col("text"), 80).alias("clipped"))


@query("fn_redact", r"""SELECT doc_id, substr(regexp_replace(regexp_replace(text, '\b(app-|sk-|cg_)[A-Za-z0-9_-]{6,}', '\1***', 'g'), '(?i)(bearer)[ \t\n\x0B\f\r]+[A-Za-z0-9._~+/=-]+', '\1 ***', 'g'), 1, 1200) AS redacted FROM documents""")
def fn_redact(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", C.redact(F.col("text")).alias("redacted"))


@query("fn_search_text", f"WITH {B.WITH_FACTS} SELECT id, lower(category || ' ' || entity || ' ' || fact_type || ' ' || fact || ' ' || aliases[1] || ' ' || array_to_string(tags, ' ') || ' ' || related_entities[1] || ' ' || evidence[1]) AS query_text, lower(entity || ' ' || fact_type || ' ' || fact || ' ' || aliases[1] || ' ' || array_to_string(tags, ' ') || ' ' || related_entities[1] || ' ' || evidence[1]) AS fact_text, lower('l2_fact ' || category || ' ' || entity || ' ' || fact_type || ' ' || fact || ' ' || related_entities[1] || ' ' || array_to_string(tags, ' ') || ' ' || evidence[1]) AS packet_text FROM facts")
def fn_search_text(spark, sf):
    """The three sets of fields: of a question's recall, of a fact, of an evidence packet."""
    lists = ("aliases", "tags", "related_entities", "evidence")
    sets = {"query_text": ("category", "entity", "fact_type", "fact", *lists), "fact_text": ("entity", "fact_type", "fact", *lists), "packet_text": ("source", "category", "entity", "fact_type", "fact", "related_entities", "tags", "evidence")}
    f = B.facts(spark, sf).withColumn("source", F.lit("l2_fact"))
    return f.select("id", *[C.search_text(*map(F.col, cols)).alias(name) for name, cols in sets.items()])


#: A small Latin vocabulary: the driver's texts have no other.
LATIN = Q.Vocabulary(
    leading="the|that|and", trailing="tion|ing", stop="on|in|of|to", dictionary=("the", "ing", "tion", "zzz", "on the"),
    asks=(("the", "list"), ("and", "rank")), many="all|und|et|y ", subjects="the|die|les|los", extra=(("th.n", "thing"), ("er[a-z]", "era"), ("Q", "queue")), domain="hes|ble$")


@query("fn_term_clean", """SELECT item_id, term FROM (SELECT item_id, trim(regexp_replace(regexp_replace(lower(w), '^(the|that|and)+', ''), '(tion|ing)$', ''), ' ') AS term
    FROM (SELECT item_id, unnest(regexp_split_to_array(text, '[ \n]')) AS w FROM benchmark)) WHERE length(term) BETWEEN 2 AND 18 AND NOT regexp_matches(term, '^(on|in|of|to|[0-9]+)$')""")
def fn_term_clean(spark, sf):
    w = B.table(spark, sf, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), "[ \n]")).alias("w"))
    return w.select("item_id", Q.term_clean(F.col("w"), LATIN).alias("term")).where("term is not null")


@query("fn_sub_terms", """SELECT item_id, array_to_string(list_concat(w, list_filter(['the', 'ing', 'tion', 'zzz', 'on the'], lambda x: contains(lower(text), x) AND NOT list_contains(w, x))), ',') AS sub_terms
    FROM (SELECT item_id, text, list_filter(list_transform(v, lambda x, i: CASE WHEN list_position(v, x) = i THEN x END), lambda x: x IS NOT NULL) AS w FROM (SELECT item_id, text, list_filter(regexp_extract_all(text, '[\\x{4e00}-\\x{9fa5}A-Za-z0-9]{2,8}', 0), lambda x: regexp_matches(x, 'hes|ble$')) AS v FROM benchmark))""")
def fn_sub_terms(spark, sf):
    """Words that a domain pattern hits, in order, then the dictionary's words that the text contains."""
    return B.table(spark, sf, "benchmark").select("item_id", F.array_join(Q.sub_terms(F.col("text"), LATIN), ",").alias("sub_terms"))


@query("fn_terms", f"WITH {B.WITH_QUESTIONS} SELECT query_id, array_to_string(terms, ' ') AS terms, CAST(len(terms) AS INT) AS n FROM questions")
def fn_terms(spark, sf):
    return B.questions(spark, sf).select("query_id", F.array_join("terms", " ").alias("terms"), F.size("terms").alias("n"))


_ABOUT, _SUFFIXED, _GAZETTE = r"(?:^|[ \n])(?:and|un|y) ([a-zà-öø-ÿœß]{4,12})", r"(?:^|[ \n])([a-zà-öø-ÿœß]{3,10}(?:ment|tion))", "eaux|heit|ción"


@query("fn_entities", f"""SELECT conv_id, turn, array_to_string(list_slice(list_filter(list_transform(v, lambda x, i: CASE WHEN list_position(v, x) = i THEN x END), lambda x: x IS NOT NULL), 1, 6), ',') AS entities
    FROM (SELECT conv_id, turn, list_filter(list_concat(regexp_extract_all(text, '{_ABOUT}', 1), regexp_extract_all(text, '{_SUFFIXED}', 1), regexp_extract_all(text, '{_GAZETTE}', 0)), lambda x: NOT regexp_matches(x, '^(tion|json)')) AS v FROM conversations)""")
def fn_entities(spark, sf):
    """What stands after certain words, what ends in certain ways, and known names; first seen first, at most six."""
    found = Q.entities(F.col("text"), (_ABOUT, _SUFFIXED), _GAZETTE, "^(tion|json)")
    return B.table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(found, ",").alias("entities"))


_REASON = """CASE WHEN label <> '' AND many AND subjects THEN label ELSE '' END"""
_REASONED = """(SELECT *, regexp_matches(lower(text), 'the|die|les|los') AS subjects, regexp_matches(lower(text), 'all|und|et|y ') AS many,
           array_to_string(list_filter([CASE WHEN contains(lower(text), 'the') THEN 'list' END, CASE WHEN contains(lower(text), 'and') THEN 'rank' END], lambda x: x IS NOT NULL), ' / ') AS label
    FROM conversations)"""


@query("fn_collection", f"SELECT conv_id, turn, {_REASON} AS reason FROM {_REASONED}")
def fn_collection(spark, sf):
    return B.table(spark, sf, "conversations").select("conv_id", "turn", Q.collection_reason(F.col("text"), LATIN).alias("reason"))


@query("fn_intent", f"SELECT conv_id, turn, CASE WHEN {_REASON} <> '' THEN 'collection' WHEN regexp_extract(text, 'Q([a-z]+)', 1) <> '' THEN 'target' ELSE 'query' END AS intent FROM {_REASONED}")
def fn_intent(spark, sf):
    text = F.col("text")
    found = Q.intent(Q.collection_reason(text, LATIN), Q.target(text, None, ("Q([a-z]+)",)))
    return B.table(spark, sf, "conversations").select("conv_id", "turn", found.alias("intent"))


@query("fn_intent_terms", """SELECT item_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, 'th.n') THEN 'thing' END, CASE WHEN regexp_matches(text, 'er[a-z]') THEN 'era' END, CASE WHEN regexp_matches(text, 'Q') THEN 'queue' END], lambda x: x IS NOT NULL), ',') AS terms FROM benchmark""")
def fn_intent_terms(spark, sf):
    return B.table(spark, sf, "benchmark").select("item_id", F.array_join(Q.intent_terms(F.col("text"), LATIN), ",").alias("terms"))


@query("fn_aliases", r"""SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(p_type, ' ', '/', 'g') || '、' || p_brand, '[/、,]'), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') AS aliases FROM part""")
def fn_aliases(spark, sf):
    text = F.concat(F.regexp_replace("p_type", " ", "/"), F.lit("、"), "p_brand")
    return B.table(spark, sf, "part").select("p_partkey", F.array_join(Q.aliases(text), "|").alias("aliases"))


@query("fn_possessive", "SELECT n_nationkey, regexp_extract(s, '^(.+)的(.+)$', 1) AS owner, regexp_extract(s, '^(.+)的(.+)$', 2) AS object FROM (SELECT n_nationkey, n_name || '的' || n_regionkey || '的' || n_name AS s FROM nation)")
def fn_possessive(spark, sf):
    owner, thing = Q.possessive(F.concat("n_name", F.lit("的"), "n_regionkey", F.lit("的"), "n_name"))
    return B.table(spark, sf, "nation").select("n_nationkey", owner.alias("owner"), thing.alias("object"))


@query("fn_target", """SELECT item_id, coalesce(CASE WHEN item_id % 4 = 0 THEN 'given ' || item_id END, nullif(regexp_extract(text, '/([^/]{1,24})/', 1), ''), nullif(regexp_extract(text, '(?i)about ([a-z]+)', 1), ''), nullif(regexp_extract(text, '\\b([A-Z][a-z]+)', 1), ''), '') AS target FROM benchmark""")
def fn_target(spark, sf):
    given = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit(" given "), "item_id"))
    found = Q.target(F.col("text"), given, (r"/([^/]{1,24})/", r"(?i)about ([a-z]+)", r"\b([A-Z][a-z]+)"))
    return B.table(spark, sf, "benchmark").select("item_id", found.alias("target"))


@query("fn_target_clean", "SELECT p_partkey, substr(regexp_replace(regexp_replace(regexp_replace(lower(p_name), ' [a-z]+$', ''), ' [a-z]+$', ''), ' [a-z]+$', ''), 1, 24) AS target FROM part")
def fn_target_clean(spark, sf):
    return B.table(spark, sf, "part").select("p_partkey", Q.target_clean(F.lower("p_name"), " [a-z]+$").alias("target"))


@query("fn_target_likely", "SELECT p_partkey, length(p_name) BETWEEN 2 AND 12 AND NOT regexp_matches(lower(p_name), 'd w') AND NOT regexp_matches(lower(p_name), '^(blue|small)') AND NOT lower(p_name) IN ('red bolt', 'red ring') AS likely FROM part")
def fn_target_likely(spark, sf):
    """By length, and neither a word that asks, a counting prefix, nor a reserved name."""
    return B.table(spark, sf, "part").select("p_partkey", Q.target_likely(F.col("p_name"), asks="d w", prefix="blue|small", reserved=("red bolt", "red ring")).alias("likely"))


@query("fn_json_or_text", "SELECT event_id, json_valid(s) AS is_json, CASE WHEN json_valid(s) THEN json_extract_string(s, '$.k') ELSE s END AS value FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'plain ' || event_type ELSE props END AS s FROM events)")
def fn_json_or_text(spark, sf):
    s = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("plain "), "event_type")).otherwise(F.col("props"))
    e = B.table(spark, sf, "events").select("event_id", s.alias("s"), F.try_parse_json(s).alias("v"))
    return e.select("event_id", F.col("v").isNotNull().alias("is_json"), F.coalesce(F.try_variant_get("v", "$.k", "string"), "s").alias("value"))


@query("fn_json_flatten", """SELECT c_custkey, path, value FROM (
    SELECT c_custkey, unnest([{'path': 'name', 'value': c_name}, {'path': 'place / nation', 'value': CAST(c_nationkey AS VARCHAR)}, {'path': 'place / deep / a / b / segment', 'value': c_mktsegment}, {'path': 'tags', 'value': 'x, ' || c_custkey}, {'path': 'rows', 'value': 'k：1；m：y, z' || chr(10) || 'plain'}], recursive := true) FROM customer)""")
def fn_json_flatten(spark, sf):
    """Nested objects as paths, to any of five levels; arrays joined; null, empty texts and empty arrays left out."""
    body = F.concat(F.lit('{"name":'), F.to_json(F.struct("c_name")).substr(F.lit(11), F.length("c_name") + 2), F.lit(',"none":null,"blank":"","no":[],"place":{"nation":'), F.col("c_nationkey").cast("string"), F.lit(',"deep":{"a":{"b":{"segment":"'), "c_mktsegment",
                    F.lit('"}}}},"tags":["x",'), F.col("c_custkey").cast("string"), F.lit('],"rows":[{"k":1,"m":["y","z"],"n":null},"plain"]}'))
    c = B.table(spark, sf, "customer").select("c_custkey", F.parse_json(body).alias("v"))
    return J.flattened(c, ["c_custkey"], "v")


@query("fn_json_tables", """WITH c AS (SELECT *, c_custkey % 3 AS kind FROM customer) SELECT c_custkey, t, CAST(row AS INT) AS row, field, value FROM (
    SELECT c_custkey, unnest([{'t': 'items', 'row': 0, 'field': 'a', 'value': c_name}, {'t': 'items', 'row': 1, 'field': 'value', 'value': 'bare'}, {'t': 'place', 'row': 0, 'field': 'at / nation', 'value': CAST(c_nationkey AS VARCHAR)}], recursive := true) FROM c WHERE kind = 0
    UNION ALL SELECT c_custkey, unnest([{'t': 'summary_fields', 'row': 0, 'field': 'name', 'value': c_name}, {'t': 'summary_fields', 'row': 0, 'field': 'nation', 'value': CAST(c_nationkey AS VARCHAR)}], recursive := true) FROM c WHERE kind = 1
    UNION ALL SELECT c_custkey, unnest([{'t': 'root', 'row': 0, 'field': 'a', 'value': c_name}, {'t': 'root', 'row': 1, 'field': 'a', 'value': 'n'}], recursive := true) FROM c WHERE kind = 2)""")
def fn_json_tables(spark, sf):
    """Arrays are tables of rows, objects tables of fields and values; plain fields only where there is nothing else."""
    name, nation = F.to_json(F.struct("c_name")).substr(F.lit(11), F.length("c_name") + 2), F.col("c_nationkey").cast("string")
    kind = F.col("c_custkey") % 3
    body = F.when(kind == 0, F.concat(F.lit('{"title":"t","items":[{"a":'), name, F.lit('},null,"bare"],"place":{"at":{"nation":'), nation, F.lit("}},\"none\":[]}")))
    body = body.when(kind == 1, F.concat(F.lit('{"name":'), name, F.lit(',"nation":'), nation, F.lit(',"gone":null}'))).otherwise(F.concat(F.lit('[{"a":'), name, F.lit('},{"a":"n"}]')))
    c = B.table(spark, sf, "customer").select("c_custkey", F.parse_json(body).alias("v"))
    return J.tables(c, ["c_custkey"], "v")


@query("fn_label", "SELECT event_id, CASE event_type WHEN 'signup' THEN 'Sign up' WHEN 'error' THEN 'Fault' ELSE replace(event_type, '_', ' ') END AS label FROM events")
def fn_label(spark, sf):
    labels = spark.createDataFrame([("signup", "Sign up"), ("error", "Fault")], "event_type string, label string")
    e = B.table(spark, sf, "events").join(F.broadcast(labels), "event_type", "left")
    return e.select("event_id", F.coalesce("label", F.replace("event_type", F.lit("_"), F.lit(" "))).alias("label"))


@query("fn_short_title", r"SELECT doc_id, regexp_replace('Chapter ' || doc_id || ': ' || split_part(text, chr(10), 1), '^Chapter [0-9]+:? ?', '') AS short_title FROM documents")
def fn_short_title(spark, sf):
    t = F.concat(F.lit("Chapter "), "doc_id", F.lit(": "), F.substring_index("text", "\n", 1))
    return B.table(spark, sf, "documents").select("doc_id", F.regexp_replace(t, "^Chapter [0-9]+:? ?", "").alias("short_title"))


@query("fn_duration", """SELECT o_orderkey, CASE WHEN h > 0 THEN h || 'h ' || m || 'm ' || s || 's' WHEN m > 0 THEN m || 'm ' || s || 's' ELSE s || 's' END AS duration
    FROM (SELECT o_orderkey, t // 3600 AS h, t % 3600 // 60 AS m, t % 60 AS s FROM (SELECT o_orderkey, (o_orderkey * 977) // 1000 AS t FROM orders))""")
def fn_duration(spark, sf):
    return B.table(spark, sf, "orders").select("o_orderkey", C.duration(F.col("o_orderkey") * 977).alias("duration"))


@query("fn_percent", "SELECT p_partkey, CAST(CASE WHEN p_size % 10 > 0 THEN least(100, round(p_size * 100.0::DOUBLE / (p_size % 10 * 5))) ELSE 0 END AS INT) AS pct FROM part")
def fn_percent(spark, sf):
    return B.table(spark, sf, "part").select("p_partkey", C.percent(F.col("p_size"), F.col("p_size") % 10 * 5).alias("pct"))


@query("fn_range", "SELECT o_orderkey, CAST(1 + o_orderkey % 40 AS INT) AS start_chapter, CAST(greatest(1 + o_orderkey % 40, o_custkey % 50) AS INT) AS end_chapter FROM orders")
def fn_range(spark, sf):
    first = 1 + F.col("o_orderkey") % 40
    return B.table(spark, sf, "orders").select("o_orderkey", first.cast("int").alias("start_chapter"), F.greatest(first, F.col("o_custkey") % 50).cast("int").alias("end_chapter"))


@query("fn_free_key", f"""WITH {B.WITH_GROUPS}, used AS (SELECT book_id, group_key FROM groups), base AS (SELECT DISTINCT book_id, group_key FROM groups)
    SELECT book_id, group_key, group_key || '-' || (SELECT min(n) FROM range(2, 1000) t(n) WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.book_id = b.book_id AND u.group_key = b.group_key || '-' || n)) AS free_key FROM base b""")
def fn_free_key(spark, sf):
    base = B.groups(spark, sf).select("book_id", "group_key").distinct()
    tried = base.withColumn("n", F.explode(F.sequence(F.lit(2), F.lit(999)))).withColumn("free_key", F.concat("group_key", F.lit("-"), "n"))
    used = base.select("book_id", F.col("group_key").alias("free_key"))
    left = tried.join(used, ["book_id", "free_key"], "left_anti")
    return left.groupBy("book_id", "group_key").agg(F.min_by("free_key", "n").alias("free_key"))


@query("set_unique", f"WITH {B.WITH_FACTS}, t AS (SELECT entity, id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM facts), f AS (SELECT entity, tag, min(id * 10 + i) AS seen FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY seen) AS n FROM f) SELECT entity, string_agg(tag, ',' ORDER BY seen) AS tags FROM r WHERE n <= 12 GROUP BY entity")
def set_unique(spark, sf):
    """First-seen order without a list of all tags: the place of each tag's first sight is a minimum."""
    from pyspark.sql import Window

    t = B.facts(spark, sf).select("entity", "id", F.posexplode("tags").alias("i", "tag"))
    first = t.groupBy("entity", "tag").agg(F.min(F.col("id") * 10 + F.col("i")).alias("seen"))
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("entity").orderBy("seen"))).where("n <= 12")
    return first.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seen", "tag"))), lambda x: x["tag"]), ",").alias("tags"))


@query("set_alias_union", "WITH a AS (SELECT p_partkey, unnest(list_concat(string_split(p_name, ' '), [p_brand, split_part(p_name, ' ', 1), ' ' || p_type || ' '])) AS x, generate_subscripts(list_concat(string_split(p_name, ' '), ['1', '2', '3']), 1) AS i FROM part), f AS (SELECT p_partkey, trim(x, ' ') AS x, min(i) AS i FROM a GROUP BY 1, 2) SELECT p_partkey, string_agg(x, ',' ORDER BY i) AS aliases FROM f WHERE x <> '' GROUP BY 1")
def set_alias_union(spark, sf):
    """Old names, then new ones, each once, at most 24."""
    old, new = F.split("p_name", " "), F.array("p_brand", F.substring_index("p_name", " ", 1), F.concat(F.lit(" "), "p_type", F.lit(" ")))
    return B.table(spark, sf, "part").select("p_partkey", F.array_join(C.unique_compact(F.concat(old, new), 24), ",").alias("aliases"))


@query("set_terms_except", f"WITH {B.WITH_QUESTIONS}, x AS (SELECT query_id, terms, list_filter(list_transform(string_split(query, ' '), lambda x: lower(trim(x, '.,'))), lambda x: length(x) >= 4) AS w FROM questions) SELECT query_id, array_to_string(list_filter(list_transform(w, lambda x, i: CASE WHEN list_position(w, x) = i AND NOT list_contains(list_transform(terms, lambda t: lower(t)), x) THEN x END), lambda x: x IS NOT NULL), ',') AS terms FROM x")
def set_terms_except(spark, sf):
    """Expanded terms (words of four letters or more) without the question's own."""
    words = F.filter(F.transform(F.split("query", " "), lambda x: F.lower(F.regexp_replace(x, "^[.,]+|[.,]+$", ""))), lambda x: F.length(x) >= 4)
    return B.questions(spark, sf).select("query_id", F.array_join(F.array_except(words, F.transform("terms", F.lower)), ",").alias("terms"))


@query("set_keys", f"SELECT p_brand, array_to_string(list_sort(list_distinct([CASE WHEN k = '' THEN 'base' ELSE k END, 'base'])), ',') AS keys FROM (SELECT DISTINCT p_brand, {_KEY_SQL.format('p_brand')} AS k FROM part)")
def set_keys(spark, sf):
    p = B.table(spark, sf, "part").select("p_brand").distinct()
    return p.select("p_brand", F.array_join(F.array_sort(F.array_distinct(F.array(C.key(F.col("p_brand")), F.lit("base")))), ",").alias("keys"))


@query("set_indexes", "SELECT o_custkey, string_agg(i, ',' ORDER BY i) AS indexes FROM (SELECT DISTINCT o_custkey, o_orderkey % 60 - 5 AS i FROM orders) WHERE i > 0 GROUP BY o_custkey")
def set_indexes(spark, sf):
    """Positive whole numbers among texts, each once, ascending by value."""
    text = F.when(F.col("o_orderkey") % 60 == 7, "2.5").otherwise((F.col("o_orderkey") % 60 - 5).cast("string"))
    o = B.table(spark, sf, "orders").select("o_custkey", F.explode(F.array(text, (F.col("o_orderkey") % 60 - 5).cast("string"), F.lit("x"))).alias("t"))
    o = o.withColumn("i", F.when(F.col("t").rlike("^-?[0-9]+$"), F.col("t").try_cast("int"))).where("i > 0")
    return o.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("i")), ",").alias("indexes"))


@query("set_enabled_keys", f"WITH {B.WITH_GROUPS}, c AS (SELECT book_id, group_key FROM groups WHERE enabled AND contains(name, '12')) SELECT book_id, group_key FROM c UNION ALL SELECT book_id, arg_max(group_key, updated_at) FROM groups WHERE enabled AND book_id NOT IN (SELECT book_id FROM c) GROUP BY 1")
def set_enabled_keys(spark, sf):
    """Chosen groups that are enabled; a book without one gets its newest enabled group."""
    g = B.groups(spark, sf).where("enabled")
    kept = g.where(F.col("name").contains("12")).select("book_id", "group_key")
    default = g.join(kept.select("book_id").distinct(), "book_id", "left_anti").groupBy("book_id").agg(F.max_by("group_key", "updated_at").alias("group_key"))
    return kept.unionByName(default)