"""Queries of subjects: rules, admission, fold, promotion, rescans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom import tables
from corpusloom.operators import subjects as S
from corpusloom.plans import bind as B
from corpusloom.plans.registry import query
from corpusloom.sources import enrich as E

_ALL, _TALE = ("entity", "aliases", "tags", "fact"), ("fact", "evidence")
#: Rules and bases as parameters; the given facts are short Latin sentences, so the vocabulary is, too.
RULES = S.Admission(
    object=S.Rule(_ALL, "k1[0-9]|k5$"),
    animal=S.Rule(("entity", "tags", "fact"), "_1[0-9]* |view", "k3|click"),
    simile=S.Rule(_TALE, "k[0-9]*4", "purchase", entity="^user_[0-9]$"),
    transform=S.Rule(_TALE, "k[0-9]7"),
    artifact=S.Rule(_ALL, "purchase|k2"),
    human=S.Rule(("fact", "evidence", "tags"), "signup", or_entity="^user_2"),
    clue=S.Rule(("fact", "evidence", "tags"), "error|k[0-9]7"),
    bases=("seen", "stated", "turned"), transformed="turned")


def _scoped(spark, sf):
    """Facts with scope fields out of their type and numbers."""
    basis = F.when(F.col("fact_type") == "click", "seen").when(F.col("fact_type") == "purchase", "turned").when(F.col("fact_type") == "view", "stated").otherwise("")
    return B.facts(spark, sf).withColumns({"scope_basis": basis, "scope_eligible": F.col("confidence") >= 0.3, "transformation_eligible": F.col("importance") >= 0.03})


def _text(fields):
    return "lower(concat_ws(' ', " + ", ".join(f"array_to_string({c}, ' ')" if c in ("aliases", "tags", "evidence") else c for c in fields) + "))"


def _hit(rule):
    sql = f"regexp_matches({_text(rule.fields)}, '{rule.yes}')"
    sql += f" AND NOT regexp_matches({_text(rule.fields)}, '{rule.no}')" if rule.no else ""
    sql += f" AND regexp_matches(entity, '{rule.entity}')" if rule.entity else ""
    return f"({sql}" + (f" OR regexp_matches(entity, '{rule.or_entity}'))" if rule.or_entity else ")")


_SCOPED = f"""{B.WITH_FACTS}, scoped AS (SELECT *, CASE fact_type WHEN 'click' THEN 'seen' WHEN 'purchase' THEN 'turned' WHEN 'view' THEN 'stated' ELSE '' END AS scope_basis, confidence >= 0.3 AS scope_eligible, importance >= 0.03 AS transformation_eligible FROM facts)"""
_ELIGIBLE = f"(NOT {_hit(RULES.simile)} AND (NOT {_hit(RULES.artifact)} OR scope_basis = 'turned' AND transformation_eligible AND {_hit(RULES.transform)}) AND scope_eligible AND scope_basis IN ('seen', 'stated', 'turned') AND (scope_basis <> 'turned' OR transformation_eligible))"
_CANDIDATE = f"(entity <> '' AND NOT ({_hit(RULES.artifact)} OR {_hit(RULES.object)} OR {_hit(RULES.human)} OR {_hit(RULES.animal)}) AND (fact_type = 'identity_clue' OR {_hit(RULES.clue)}))"


def _rule(name):
    rule = getattr(RULES, name)

    @query(f"flt_rule_{name}", f"WITH {_SCOPED} SELECT id, {_hit(rule)} AS hit FROM scoped")
    def run(spark, sf):
        return _scoped(spark, sf).select("id", rule.hit().alias("hit"))


for _name in ("object", "animal", "simile", "transform", "artifact", "human"):
    _rule(_name)

_GENERIC = "^(red|blue|small)$|^(red|blue) "


def _usable_name(c):
    return ~c.rlike(_GENERIC)


@query("flt_rescan_name", f"SELECT p_partkey, length(trim(p_name)) >= 2 AND NOT regexp_matches(p_name, '{_GENERIC}') AS usable FROM part")
def flt_rescan_name(spark, sf):
    return B.table(spark, sf, "part").select("p_partkey", ((F.length(F.trim("p_name")) >= 2) & _usable_name(F.col("p_name"))).alias("usable"))


_DENIED = "click k[0-9]*1$|seen (view|error)"


@query("flt_rescan_usable", f"WITH {B.WITH_FACTS} SELECT id, NOT regexp_matches(fact || ' ' || array_to_string(evidence, ' '), '{_DENIED}') AS usable FROM facts")
def flt_rescan_usable(spark, sf):
    return B.facts(spark, sf).select("id", (~F.concat_ws(" ", "fact", "evidence").rlike(_DENIED)).alias("usable"))


@query("flt_eligible", f"WITH {_SCOPED} SELECT id, {_ELIGIBLE} AS eligible FROM scoped")
def flt_eligible(spark, sf):
    return _scoped(spark, sf).select("id", RULES.eligible().alias("eligible"))


@query("flt_candidate", f"WITH {_SCOPED} SELECT id FROM scoped WHERE {_CANDIDATE}")
def flt_candidate(spark, sf):
    return _scoped(spark, sf).where(RULES.candidate()).select("id")


def _verified(f):
    """Names of subjects of eligible facts, by the first chapter that verifies them; only entities that are seen turned."""
    return f.where(RULES.eligible() & (F.col("scope_basis") == "turned")).groupBy("book_id", F.col("entity").alias("name")).agg(F.min("chapter_index").alias("chapter"))


_KNOWN = f"""WITH {_SCOPED}, e AS (SELECT *, {_ELIGIBLE} AS eligible, {_CANDIDATE} AS worth FROM scoped), s AS (SELECT book_id, entity AS name, min(chapter_index) AS chapter FROM e WHERE eligible AND scope_basis = 'turned' GROUP BY 1, 2),
    v AS (SELECT DISTINCT book_id, value FROM (SELECT book_id, unnest(list_concat([entity], aliases, related_entities)) AS value FROM e)),
    w AS (SELECT v.book_id, v.value, min(s.chapter) AS chapter FROM v JOIN s ON s.book_id = v.book_id AND (contains(v.value, s.name) OR contains(s.name, v.value)) GROUP BY 1, 2),
    k AS (SELECT id, min(w.chapter) AS since FROM (SELECT id, book_id, unnest(list_concat([entity], aliases, related_entities)) AS value FROM e) x JOIN w USING (book_id, value) GROUP BY 1),
    m AS (SELECT e.*, coalesce(k.since < e.chapter_index, false) AS known FROM e LEFT JOIN k USING (id))"""


@query("flt_admit", f"{_KNOWN} SELECT id, CASE WHEN eligible THEN scope_basis ELSE 'prior_verified_subject' END AS scope_basis, CASE WHEN eligible THEN 'current_chapter' ELSE 'prior_verified_subject' END AS identity_basis FROM m WHERE eligible OR known")
def flt_admit(spark, sf):
    f = _scoped(spark, sf)
    kept = S.admitted(f, _verified(f), RULES).where("identity_basis is not null")
    return kept.select("id", F.when(F.col("eligible"), F.col("scope_basis")).otherwise("prior_verified_subject").alias("scope_basis"), "identity_basis")


@query("agg_build_diag", f"""{_KNOWN} SELECT book_id, count(*) AS generated, count(*) FILTER (WHERE eligible OR known) AS admitted, count(*) FILTER (WHERE NOT (eligible OR known)) AS rejected,
    count(*) FILTER (WHERE NOT (eligible OR known) AND worth) AS candidate, count(*) FILTER (WHERE NOT (eligible OR known) AND NOT worth) AS candidate_filtered, count(*) FILTER (WHERE scope_basis = '') AS missing_scope,
    count(*) FILTER (WHERE known AND NOT eligible) AS rescan_facts, count(DISTINCT CASE WHEN known AND NOT eligible THEN chapter_index END) AS rescan_chapters FROM m GROUP BY 1""")
def agg_build_diag(spark, sf):
    f = _scoped(spark, sf)
    a = S.admitted(f, _verified(f), RULES)
    inside, late = F.col("identity_basis").isNotNull(), F.col("known") & ~F.col("eligible")
    return a.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("generated"), F.count_if(inside).alias("admitted"), F.count_if(~inside).alias("rejected"), F.count_if("candidate").alias("candidate"),
        F.count_if(~inside & ~F.col("candidate")).alias("candidate_filtered"), F.count_if(F.col("scope_basis") == "").alias("missing_scope"),
        F.count_if(late).alias("rescan_facts"), F.count_distinct(F.when(late, F.col("chapter_index"))).alias("rescan_chapters"))


def _upserts(spark, sf):
    f = _scoped(spark, sf)
    none = F.array().cast("array<string>")
    return f.select(
        "book_id", F.col("entity").alias("subject_key"), F.col("id").alias("pos"), F.when(RULES.eligible(), "verified").otherwise("candidate").alias("status"), F.col("chapter_index").alias("chapter"),
        F.when(F.col("fact_type") == "signup", F.get("aliases", F.lit(0))).otherwise(F.col("entity")).alias("canonical_name"), F.col("category").alias("creature_type"), F.get("tags", F.lit(1)).alias("original_form"), F.col("fact_type").alias("prompt_hash"),
        F.col("scope_basis").alias("basis"), F.when(F.col("importance") >= 0.01, F.col("evidence")).otherwise(none).alias("evidence"), "confidence", F.array(F.get("tags", F.lit(1)), F.concat(F.lit(" "), F.get("tags", F.lit(0)), F.lit(" "))).alias("aliases"))


_FOLD = f"""WITH {_SCOPED}, u AS (SELECT book_id, entity AS subject_key, id AS pos, CASE WHEN {_ELIGIBLE} THEN 'verified' ELSE 'candidate' END AS status, chapter_index AS chapter,
        CASE WHEN fact_type = 'signup' THEN aliases[1] ELSE entity END AS canonical_name, category AS creature_type, tags[2] AS original_form, fact_type AS prompt_hash, scope_basis AS basis, CASE WHEN importance >= 0.01 THEN evidence[1] END AS evidence, confidence,
        list_concat([tags[2], tags[1]], CASE WHEN fact_type = 'signup' THEN [entity] ELSE [] END) AS given FROM scoped),
    l AS (SELECT book_id, subject_key, max(pos) FILTER (WHERE status = 'verified') AS since FROM u GROUP BY 1, 2),
    x AS (SELECT book_id, subject_key, alias, min(pos * 10 + place) AS seen FROM (SELECT book_id, subject_key, pos, unnest(given) AS alias, generate_subscripts(given, 1) AS place FROM u) GROUP BY 1, 2, 3),
    a AS (SELECT book_id, subject_key, string_agg(alias, ',' ORDER BY seen) AS aliases FROM (SELECT *, row_number() OVER (PARTITION BY book_id, subject_key ORDER BY seen) AS n FROM x) WHERE n <= 24 GROUP BY 1, 2),
    folded AS (SELECT book_id, subject_key, arg_max(status, pos) AS status, arg_max(canonical_name, pos) AS canonical_name, arg_max(creature_type, pos) AS creature_type, arg_max(original_form, pos) AS original_form, arg_max(prompt_hash, pos) AS prompt_hash,
           min(chapter) FILTER (WHERE since IS NULL OR pos >= since) AS qualification_chapter, coalesce(arg_min(basis, pos) FILTER (WHERE basis <> ''), '') AS basis, coalesce(arg_min(evidence, pos) FILTER (WHERE evidence IS NOT NULL), '') AS evidence, max(confidence) AS confidence, any_value(aliases) AS aliases
    FROM u JOIN l USING (book_id, subject_key) JOIN a USING (book_id, subject_key) GROUP BY 1, 2)"""


@query("agg_subject_fold", f"{_FOLD} SELECT * FROM folded")
def agg_subject_fold(spark, sf):
    return S.fold(_upserts(spark, sf)).withColumns({"aliases": F.array_join("aliases", ","), "evidence": F.array_join("evidence", "|")})


@query("sink_subject_merge", f"{_FOLD} SELECT book_id, subject_key, status, canonical_name, qualification_chapter, aliases FROM folded")
def sink_subject_merge(spark, sf):
    """Upserts of the first half of the facts make the stored states, the later half is folded by itself and merged into them."""
    u = _upserts(spark, sf)
    middle = u.agg(F.coalesce(F.expr("(min(pos) + max(pos)) div 2"), F.lit(0))).first()[0]
    stored = tables.staged(S.fold_state(u.where(F.col("pos") <= middle)), "subject-states")
    after = S.of_state(S.merged_state(stored, S.fold_state(u.where(F.col("pos") > middle))))
    return after.select("book_id", "subject_key", "status", "canonical_name", "qualification_chapter", F.array_join("aliases", ",").alias("aliases"))


@query("flt_subjects", f"{_FOLD} SELECT book_id, subject_key, qualification_chapter FROM folded WHERE status = 'verified' AND qualification_chapter <= 29 AND prompt_hash = 'click' AND (contains(lower(canonical_name), '_1') OR contains(lower(subject_key), '_1') OR contains(aliases, 'k7') OR contains(aliases, 'purch'))")
def flt_subjects(spark, sf):
    return S.subject_filter(S.fold(_upserts(spark, sf)), 29, "click", ("_1", " K7 ", "purch")).select("book_id", "subject_key", "qualification_chapter")


_CHARACTERS = "s AS (SELECT DISTINCT book_id, entity AS name FROM facts WHERE category = 'character' UNION SELECT DISTINCT book_id, tags[2] FROM facts WHERE category = 'item')"


def _named(f):
    return f.where("category = 'character'").select("book_id", F.col("entity").alias("name")).union(f.where("category = 'item'").select("book_id", F.get("tags", F.lit(1)).alias("name"))).distinct()


@query("jn_promote", f"WITH {B.WITH_FACTS}, {_CHARACTERS} SELECT id, CASE WHEN status = 'candidate' AND EXISTS (SELECT 1 FROM s WHERE s.book_id = f.book_id AND (s.name = f.entity OR list_contains(list_concat(aliases, related_entities, tags), s.name))) THEN 'completed' ELSE status END AS status FROM facts f")
def jn_promote(spark, sf):
    f = B.facts(spark, sf)
    return S.promoted(f, _named(f)).select("id", "status")


@query("jn_subject_match", f"WITH {B.WITH_FACTS}, {_CHARACTERS}, v AS (SELECT DISTINCT book_id, value FROM (SELECT book_id, unnest(list_concat([entity], aliases, related_entities)) AS value FROM facts)), w AS (SELECT DISTINCT v.book_id, v.value FROM v JOIN s ON s.book_id = v.book_id AND (contains(v.value, s.name) OR contains(s.name, v.value))) SELECT DISTINCT id FROM (SELECT id, book_id, unnest(list_concat([entity], aliases, related_entities)) AS value FROM facts) JOIN w USING (book_id, value)")
def jn_subject_match(spark, sf):
    f = B.facts(spark, sf)
    return S.known_from(f, _named(f).withColumn("chapter", F.lit(0))).select("id")


_SUBJECTS = "subjects AS (SELECT item_id AS subject_id, unnest([text, array_to_string(list_slice(string_split(text, ' '), 3, 4), ' ')]) AS name, CAST(1 + item_id % 30 AS INT) AS qualification_chapter FROM benchmark)"


def _subjects(spark, sf):
    """Benchmark passages as subjects; their third and fourth words are another, short name."""
    words = F.array_join(F.slice(F.split("text", " "), 3, 2), " ")
    return B.table(spark, sf, "benchmark").select(F.col("item_id").alias("subject_id"), F.explode(F.array("text", words)).alias("name"), (1 + F.col("item_id") % 30).cast("int").alias("qualification_chapter"))


def _chapter_texts(spark, sf):
    return B.chapters(spark, sf).select("doc_id", "book_id", "chapter_index", F.concat_ws("\n", "title", "content").alias("text"))


@query("jn_known_subjects", f"WITH {B.WITH_CHAPTERS}, {_SUBJECTS} SELECT DISTINCT doc_id, subject_id FROM chapters JOIN subjects ON qualification_chapter <= chapter_index AND contains(title || chr(10) || content, name)")
def jn_known_subjects(spark, sf):
    """Subjects qualified by a chapter that its title or text mentions."""
    c, s = _chapter_texts(spark, sf), _subjects(spark, sf)
    met = S.mentions(c.select("doc_id", "text"), s.select("subject_id", "name"))
    known = met.join(c.select("doc_id", "chapter_index"), "doc_id").join(s.select("subject_id", "qualification_chapter").distinct(), "subject_id")
    return known.where("qualification_chapter <= chapter_index").select("doc_id", "subject_id")


@query("jn_rescan", f"WITH {B.WITH_CHAPTERS}, {_SUBJECTS} SELECT DISTINCT book_id, chapter_index, subject_id FROM chapters JOIN subjects ON chapter_index < qualification_chapter AND chapter_index <= 80 AND contains(title || chr(10) || content, name) WHERE length(name) >= 2 AND NOT regexp_matches(name, '{_GENERIC}')")
def jn_rescan(spark, sf):
    """Chapters before a subject's qualification that mention it by a usable name; a subject belongs to every book that mentions it."""
    return _rescans(spark, sf).select("book_id", "chapter_index", "subject_id")


def _rescans(spark, sf):
    c, s = _chapter_texts(spark, sf), _subjects(spark, sf)
    met = S.mentions(c.select("doc_id", "text"), s.select("subject_id", "name")).join(c.select("doc_id", "book_id"), "doc_id").select("subject_id", "book_id").distinct()
    return S.rescans(c, s.join(met, "subject_id"), _usable_name(F.col("name")))


@query("jn_rescan_facts", rf"""WITH {B.WITH_CHAPTERS}, {_SUBJECTS}, r AS (SELECT DISTINCT doc_id, subject_id FROM chapters JOIN subjects ON chapter_index < qualification_chapter AND chapter_index <= 80 AND contains(title || chr(10) || content, name) WHERE length(name) >= 2 AND NOT regexp_matches(name, '{_GENERIC}')),
    w AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(coalesce(content, ''), '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]{{3,}}'))) AS entity FROM chapters)
    SELECT DISTINCT doc_id, subject_id, entity, 'historical_rescan' AS review_source, 'historical_subject_rescan' AS identity_basis FROM w JOIN r USING (doc_id) JOIN subjects USING (subject_id) WHERE (contains(name, entity) OR contains(entity, name)) AND NOT regexp_matches(entity, '{_DENIED}')""")
def jn_rescan_facts(spark, sf):
    """Names that the extractor finds in rescanned chapters, of those that match the chapter's subject: part of a name, or around one."""
    plan, s = _rescans(spark, sf), _subjects(spark, sf)
    held = B.table(spark, sf, "documents").join(plan.select("doc_id").distinct(), "doc_id", "left_semi")
    found = E.enrich(held, "names", "doc_id", "text").where("ok").select("doc_id", F.explode("items").alias("entity"))
    own = found.join(plan, "doc_id").join(s.select("subject_id", "name"), "subject_id")
    kept = own.where(F.contains("name", "entity") | F.contains("entity", "name")).where(~F.col("entity").rlike(_DENIED))
    return kept.select("doc_id", "subject_id", "entity", F.lit("historical_rescan").alias("review_source"), F.lit("historical_subject_rescan").alias("identity_basis")).distinct()


_MADE = """CASE WHEN entity <> '' THEN ' with ' || entity ELSE '' END"""


@query("pk_embedded", f"WITH {B.WITH_SENTENCES}, s AS (SELECT *, split_part(fact, ' ', 1) AS entity FROM sentences), n AS (SELECT DISTINCT array_to_string(list_slice(string_split(text, ' '), 3, 4), ' ') AS name FROM benchmark) SELECT doc_id, pos, 'index' AS origin, entity, fact FROM s UNION ALL SELECT doc_id, pos, 'embedded', name, 'The chapter mentions ' || name || {_MADE} || '; that isn''t enough to tell what it is.' FROM s JOIN n ON contains(fact, name) AND NOT contains(entity, name)")
def pk_embedded(spark, sf):
    """Sentences as facts, and a candidate for every dictionary name that one mentions."""
    s = B.sentences(spark, sf)
    none = F.array().cast("array<string>")
    facts = s.select(F.struct("doc_id", "pos").alias("key"), F.concat_ws("-", "doc_id", "pos").alias("id"), F.substring_index("fact", " ", 1).alias("entity"), "fact", none.alias("evidence"), none.alias("tags"), none.alias("related_entities"), F.lit("").alias("fact_type"), "importance", "confidence")
    words = F.array_join(F.slice(F.split("text", " "), 3, 2), " ")
    made = S.embedded(facts, B.table(spark, sf, "benchmark").select(words.alias("name")).distinct())
    at = F.split("id", "-")
    return made.select(F.get(at, F.lit(0)).cast("long").alias("doc_id"), F.get(at, F.lit(1)).cast("int").alias("pos"), "origin", "entity", "fact")


@query("jn_live_merge", "WITH u AS (SELECT user_id AS task_id, 'server' AS origin, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1 UNION ALL SELECT user_id, 'channel', count(*) FROM events WHERE event_type IN ('click', 'error') GROUP BY 1) SELECT task_id, origin, n FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY CASE origin WHEN 'channel' THEN 0 ELSE 1 END) AS k FROM u) WHERE k = 1")
def jn_live_merge(spark, sf):
    e = B.table(spark, sf, "events").withColumnRenamed("user_id", "task_id")
    server = e.where("event_type <> 'click'").groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).withColumn("origin", F.lit("server"))
    channel = e.where("event_type in ('click', 'error')").groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).withColumn("origin", F.lit("channel"))
    order = Window.partitionBy("task_id").orderBy(F.when(F.col("origin") == "channel", 0).otherwise(1))
    return server.unionByName(channel).withColumn("k", F.row_number().over(order)).where("k = 1").select("task_id", "origin", "n")
