"""Queries of question answering: scoring, expansion, selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import questions as Q
from corpusloom.operators import recall as R
from corpusloom.plans import bind as B
from corpusloom.plans.registry import query

_GAIN = "2.0::DOUBLE + CASE WHEN contains(content, term) THEN 2.5::DOUBLE ELSE 0 END + CASE WHEN entity = term THEN 4.0::DOUBLE ELSE 0 END + CASE WHEN length(term) >= 3 THEN 0.8::DOUBLE ELSE 0 END"
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, matched DESC, importance DESC, chapter_index, fact_id) AS place"


def _score_sql(terms: str) -> str:
    return f"""SELECT query_id, fact_id, round(2 * any_value(importance) + any_value(confidence) + sum({_GAIN}), 6) AS score, count(*) AS matched, any_value(importance) AS importance, any_value(chapter_index) AS chapter_index
               FROM f JOIN {terms} ON contains(f.low, {terms}.term) GROUP BY 1, 2"""


_SCORED = f"""WITH {B.WITH_SENTENCES}, {B.WITH_QUESTIONS}, {B.WITH_RECALL}, t AS (SELECT DISTINCT query_id, lower(unnest(terms)) AS term FROM questions),
    scored AS ({_score_sql("t")}), ranked AS (SELECT *, {_RANK} FROM scored)"""


def _facts(spark, sf):
    return B.recall_facts(spark, sf)


def _terms(spark, sf):
    return R.terms_of(B.questions(spark, sf)).select("query_id", "term")


@query("win_score", f"{_SCORED} SELECT query_id, fact_id, score, matched FROM scored")
def win_score(spark, sf):
    return R.score(_facts(spark, sf), _terms(spark, sf)).select("query_id", "fact_id", "score", "matched")


def _best(spark, sf, most, chapters=False):
    """The best entries of every question by one pass over the texts; facts count as they come, equal ones, too."""
    return R.scan(_facts(spark, sf).drop("same"), _terms(spark, sf), most, chapters).entries


@query("win_rank", f"{_SCORED} SELECT query_id, fact_id, place FROM ranked WHERE place <= 160")
def win_rank(spark, sf):
    return R.ranked(_best(spark, sf, 160), 160).select("query_id", "fact_id", F.col("place").cast("long").alias("place"))


def _pick_sql(source: str, limit: str, name: str = "p") -> str:
    """Coverage-preserving pick in SQL: tables {name}b, {name}s and {name} (with column pick)."""
    return f"""{name}l AS (SELECT *, CAST({limit} AS INT) AS lim, greatest(1, CAST(floor(({limit}) * 0.6::DOUBLE) AS INT)) AS top FROM {source}),
    {name}b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chapter_index) - 1 AS spot, count(*) OVER (PARTITION BY query_id) AS chapters
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chapter_index ORDER BY place) AS first FROM {name}l) WHERE first = 1),
    {name}i AS (SELECT *, unnest(range(0, greatest(lim - top, 0))) AS i FROM {name}b),
    {name}s AS (SELECT DISTINCT query_id, fact_id FROM {name}i WHERE chapters <= lim - top OR (lim - top = 1 AND spot = chapters - 1) OR (lim - top > 1 AND spot = round(i * (chapters - 1) / greatest(lim - top - 1, 1)::DOUBLE))),
    {name} AS (SELECT r.*, row_number() OVER (PARTITION BY r.query_id ORDER BY CASE WHEN place <= top THEN 0 WHEN s.fact_id IS NOT NULL THEN 1 ELSE 2 END, place) AS pick
          FROM {name}l r LEFT JOIN {name}s s ON r.query_id = s.query_id AND r.fact_id = s.fact_id)"""


@query("win_coverage_pick", f"{_SCORED}, {_pick_sql('ranked', '40')} SELECT query_id, fact_id FROM p WHERE pick <= 40")
def win_coverage_pick(spark, sf):
    return R.coverage_pick(_best(spark, sf, 40, chapters=True), 40).select("query_id", "fact_id")


@query("win_best_chapter", f"{_SCORED} SELECT query_id, chapter_index, arg_min(fact_id, place) AS fact_id FROM ranked GROUP BY 1, 2")
def win_best_chapter(spark, sf):
    return R.best_of_chapter(_best(spark, sf, 1, chapters=True)).select("query_id", "chapter_index", "fact_id")


@query("win_even_sample", f"WITH {B.WITH_CHAPTERS}, n AS (SELECT book_id, chapter_index, row_number() OVER (PARTITION BY book_id ORDER BY chapter_index) - 1 AS spot, count(*) OVER (PARTITION BY book_id) AS n FROM chapters) SELECT DISTINCT book_id, chapter_index FROM n, range(0, 7) i(i) WHERE n <= 7 OR spot = round(i * (n - 1) / 6.0::DOUBLE)")
def win_even_sample(spark, sf):
    by = Window.partitionBy("book_id")
    c = B.chapters(spark, sf).select("book_id", "chapter_index")
    c = c.withColumns({"at": F.row_number().over(by.orderBy("chapter_index")) - 1, "n": F.count(F.lit(1)).over(by)})
    c = c.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return c.where((F.col("n") <= 7) | (F.col("at") == F.round(F.col("i") * (F.col("n") - 1) / 6.0))).select("book_id", "chapter_index").distinct()


@query("win_candidates", f"WITH {B.WITH_FACTS}, r AS (SELECT id, book_id, (chapter_index - 1) // 120 AS tile, row_number() OVER (PARTITION BY book_id, (chapter_index - 1) // 120 ORDER BY importance DESC, confidence DESC, chapter_index, id) AS n FROM facts) SELECT id, book_id, CAST(tile AS INT) AS tile FROM r WHERE n <= 2000")
def win_candidates(spark, sf):
    """The best 2000 facts of every 120 chapters."""
    f = B.facts(spark, sf).withColumn("tile", F.floor((F.col("chapter_index") - 1) / 120).cast("int"))
    order = Window.partitionBy("book_id", "tile").orderBy(F.desc("importance"), F.desc("confidence"), "chapter_index", "id")
    return f.withColumn("n", F.row_number().over(order)).where("n <= 2000").select("id", "book_id", "tile")


_NO_ID = "CASE WHEN fact_type <> 'click' THEN id END"


@query("win_dedupe_facts", f"WITH {B.WITH_FACTS}, r AS (SELECT *, row_number() OVER (ORDER BY importance DESC, event_id) AS place, {_NO_ID} AS known FROM facts), n AS (SELECT *, row_number() OVER (PARTITION BY coalesce('#' || known, concat_ws('|', book_id, index_group_key, chapter_index, category, entity, fact_type, fact)) ORDER BY place) AS k FROM r) SELECT book_id, chapter_index, fact, event_id FROM n WHERE k = 1")
def win_dedupe_facts(spark, sf):
    """One kind of fact has no id: those with equal fields are one."""
    f = B.facts(spark, sf).withColumns({"id": F.expr(_NO_ID), "query_id": F.lit(0), "place": F.struct(-F.col("importance"), F.col("event_id"))})
    return R.first_of_equal(f).select("book_id", "chapter_index", "fact", "event_id")


_EXPAND = f"""{_SCORED}, seeds AS (SELECT r.query_id, r.place, list_concat(f.fields, regexp_extract_all(f.fact || ' ', '[“「『‘]([^”」』’]{{1,12}})[”」』’]', 1)) AS fields FROM ranked r JOIN f USING (fact_id) WHERE place <= 80),
    x AS (SELECT query_id, place, generate_subscripts(fields, 1) - 1 AS pos, lower({B.SQL_CLEAN.format('unnest(fields)')}) AS term FROM seeds),
    y AS (SELECT query_id, term, min(place * 10000 + pos) AS seen FROM x WHERE {B.SQL_FINE.format('term')} AND NOT EXISTS (SELECT 1 FROM t WHERE t.query_id = x.query_id AND t.term = x.term) GROUP BY 1, 2),
    z AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY seen) AS n FROM y)"""


def _seeds(spark, sf):
    best = R.scan(_facts(spark, sf).drop("same"), _terms(spark, sf), R.MOST_SEEDS, seeds=True).entries
    return R.ranked(best, R.MOST_SEEDS).select("query_id", "place", F.col("seeds").alias("fields"))


def _expanded(spark, sf):
    return R.expand(_seeds(spark, sf), _terms(spark, sf), lambda c: Q.term_clean(c, B.VOCABULARY))


@query("win_expand", f"{_EXPAND} SELECT query_id, term, n FROM z WHERE n <= 32")
def win_expand(spark, sf):
    return _expanded(spark, sf).withColumn("n", F.col("n").cast("long"))


@query("win_matched_terms", f"""{_SCORED}, o AS (SELECT query_id, lower(unnest(terms)) AS term, generate_subscripts(terms, 1) AS pos FROM questions), h AS (SELECT o.query_id, o.term, min(o.pos) AS pos FROM ranked r JOIN f USING (fact_id) JOIN o ON o.query_id = r.query_id AND contains(f.low, o.term) WHERE r.place <= 160 GROUP BY 1, 2)
    SELECT query_id, term, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM h) WHERE n <= 40""")
def win_matched_terms(spark, sf):
    """The terms that hit what is selected, in the question's order, at most 40."""
    facts, terms = _facts(spark, sf), R.terms_of(B.questions(spark, sf))
    hits = R.matches(facts, terms)
    top = R.ranked(R.scored(R.gains(facts, hits)), 160).select("query_id", "fact_id")
    met = hits.join(top, ["query_id", "fact_id"], "left_semi").select("query_id", "term").distinct().join(terms, ["query_id", "term"])
    return met.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")).cast("long")).where("n <= 40").select("query_id", "term", "n")


_DIRECT = """tg AS (SELECT query_id, list_concat([lower(target)], list_filter(list_transform(terms, lambda x: lower(x)), lambda x: length(x) BETWEEN 2 AND 12)) AS w FROM questions WHERE target IS NOT NULL),
    tu AS (SELECT query_id, unnest(list_slice(list_filter(list_transform(w, lambda x, i: CASE WHEN list_position(w, x) = i THEN x END), lambda x: x IS NOT NULL), 1, 12)) AS term FROM tg),
    direct AS (SELECT DISTINCT query_id, fact_id FROM (SELECT fact_id, lower(unnest(fields)) AS field FROM f) v JOIN tu ON v.field <> '' AND (v.field = tu.term OR (length(tu.term) >= 3 AND contains(v.field, tu.term))))"""
_STRONG = f"""{_DIRECT.replace('tg AS', 'tgs AS').replace('tu AS', 'tus AS').replace('FROM tg)', 'FROM tgs)').replace('JOIN tu ', 'JOIN tus ').replace('tu.', 'tus.').replace('direct AS', 'plain AS').replace('WHERE target IS NOT NULL', 'WHERE target IS NOT NULL AND owner IS NULL')},
    strong AS (SELECT query_id, fact_id FROM plain UNION SELECT query_id, fact_id FROM questions JOIN f ON contains(f.low, lower(owner)) AND contains(f.low, lower(object)))"""
_RECALL = f"""{_SCORED}, {_STRONG}, sd AS (SELECT query_id, fact_id, place FROM ranked WHERE place <= 80 AND query_id NOT IN (SELECT query_id FROM strong)
         UNION ALL SELECT query_id, fact_id, place FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY chapter_index, fact_id) AS place FROM strong s JOIN f USING (fact_id)) WHERE place <= 80),
    {_EXPAND[len(_SCORED) + 2 :].replace('FROM ranked r JOIN f USING (fact_id) WHERE place <= 80', 'FROM sd r JOIN f USING (fact_id)')},
    bn AS (SELECT query_id, count(*) AS base FROM t GROUP BY 1), t2 AS (SELECT query_id, term FROM t UNION SELECT query_id, term FROM z JOIN bn USING (query_id) WHERE n <= 32 AND n + base <= 80),
    scored2 AS ({_score_sql("t2")}), r1 AS (SELECT s.*, row_number() OVER (PARTITION BY s.query_id, f.same ORDER BY s.score DESC, s.matched DESC, s.importance DESC, s.chapter_index, s.fact_id) AS k FROM scored2 s JOIN f USING (fact_id)),
    own2 AS (SELECT * FROM r1 WHERE k = 1), r2 AS (SELECT *, {_RANK} FROM own2 WHERE query_id NOT IN (SELECT query_id FROM strong)),
    recalled AS (SELECT query_id, fact_id, chapter_index, importance, round(importance + 1000, 6) AS score, true AS target FROM strong JOIN f USING (fact_id)
                 UNION ALL SELECT query_id, fact_id, chapter_index, importance, score, false FROM r2 WHERE place <= 160)"""


def _recall(spark, sf):
    return R.recall(_facts(spark, sf), B.questions(spark, sf), B.VOCABULARY)


@query("win_recall", f"{_RECALL} SELECT query_id, fact_id, chapter_index, score, target FROM recalled")
def win_recall(spark, sf):
    """Score, expand by the best facts, score again, keep the recall limit; all facts of a target, possessive ones too, where there are some."""
    return _recall(spark, sf).entries.select("query_id", "fact_id", "chapter_index", "score", "target")


@query("win_recall_counters", f"""{_RECALL}, ca AS (SELECT query_id, count(*) AS scored FROM own2 GROUP BY 1), cb AS (SELECT query_id, count(*) AS selected, count(*) FILTER (WHERE target) AS targets, count(DISTINCT CASE WHEN target THEN chapter_index END) AS selected_chapters FROM recalled GROUP BY 1),
    tp AS (SELECT query_id, lower(unnest(terms)) AS term, generate_subscripts(terms, 1) AS pos FROM questions UNION ALL SELECT query_id, term, n + 1000 FROM z JOIN bn USING (query_id) WHERE n <= 32 AND n + base <= 80),
    ma AS (SELECT query_id, string_agg(term, ',' ORDER BY pos) AS matched FROM (SELECT query_id, term, min(tp.pos) AS pos, row_number() OVER (PARTITION BY query_id ORDER BY min(tp.pos)) AS n FROM recalled JOIN f USING (fact_id) JOIN tp USING (query_id) WHERE contains(f.low, tp.term) GROUP BY 1, 2) WHERE n <= 40 GROUP BY 1),
    ex AS (SELECT query_id, string_agg(term, ',' ORDER BY n) AS expanded FROM z WHERE n <= 32 GROUP BY 1)
    SELECT q.query_id, coalesce(ca.scored, 0) AS scored, coalesce(cb.targets, 0) AS targets, coalesce(cb.selected, 0) AS selected, coalesce(cb.selected_chapters, 0) AS selected_chapters, greatest(0, coalesce(ca.scored, 0) - coalesce(cb.selected, 0)) AS dropped, coalesce(ma.matched, '') AS matched, coalesce(ex.expanded, '') AS expanded
    FROM questions q LEFT JOIN ca USING (query_id) LEFT JOIN cb USING (query_id) LEFT JOIN ma USING (query_id) LEFT JOIN ex USING (query_id)""")
def win_recall_counters(spark, sf):
    """What the recall of every question counts: facts that any term hits, targets, selected, their chapters, dropped, and the terms."""
    c = _recall(spark, sf).counters
    return c.select("query_id", "scored", "targets", "selected", "selected_chapters", "dropped", F.array_join("matched", ",").alias("matched"), F.array_join("expanded", ",").alias("expanded"))


@query("win_chapter_sample", f"WITH {B.WITH_FACTS}, c AS (SELECT user_id, list_sort(list_distinct(list(chapter_index))) AS v FROM facts GROUP BY 1) SELECT user_id, array_to_string(CASE WHEN len(v) <= 16 THEN v ELSE list_concat(v[1:8], v[-8:]) END, ',') AS chapters FROM c")
def win_chapter_sample(spark, sf):
    from corpusloom.functions import columns as C

    return B.facts(spark, sf).groupBy("user_id").agg(F.array_join(C.chapter_sample(F.collect_set("chapter_index")), ",").alias("chapters"))


@query("win_runs_recent", f"WITH {B.WITH_RUNS}, r AS (SELECT run_id, max(part) AS parts FROM runs GROUP BY 1) SELECT * FROM r ORDER BY run_id DESC LIMIT 100")
def win_runs_recent(spark, sf):
    return B.runs(spark, sf).groupBy("run_id").agg(F.max("part").alias("parts")).orderBy(F.desc("run_id")).limit(100)


@query("win_fact_sample", f"WITH {B.WITH_STATUS}, {B.WITH_FACTS}, r AS (SELECT id, book_id, row_number() OVER (PARTITION BY book_id ORDER BY importance DESC, id) AS n FROM facts WHERE chapter_index <= 20) SELECT 'fact' AS kind, book_id, id AS n FROM r WHERE n <= 5 UNION ALL SELECT 'chapters', c.book_id, count(*) FILTER (WHERE s.status = 'completed') FROM chapters c LEFT JOIN status s USING (book_id, chapter_index) WHERE chapter_index <= 20 GROUP BY 2")
def win_fact_sample(spark, sf):
    """A trial on the first 20 chapters of every book: five sample facts, and how many chapters are built."""
    order = Window.partitionBy("book_id").orderBy(F.desc("importance"), "id")
    best = B.facts(spark, sf).where("chapter_index <= 20").withColumn("k", F.row_number().over(order)).where("k <= 5").select(F.lit("fact").alias("kind"), "book_id", F.col("id").alias("n"))
    built = B.chapters(spark, sf).where("chapter_index <= 20").select("book_id", "chapter_index").join(B.status(spark, sf).select("book_id", "chapter_index", "status"), ["book_id", "chapter_index"], "left")
    return best.unionByName(built.groupBy("book_id").agg(F.count_if(F.col("status") == "completed").alias("n")).withColumn("kind", F.lit("chapters")))


_USERS = f"WITH {B.WITH_FACTS}, u AS (SELECT DISTINCT user_id, fact_type FROM facts), q AS (SELECT DISTINCT 'user_' || user_id AS query_id, 'user_' || user_id AS owner, NULL AS object FROM u UNION ALL SELECT 'user_' || user_id || '的' || fact_type, 'user_' || user_id, fact_type FROM u)"
_HAS = "(object IS NULL AND len(list_filter(list_concat([entity], aliases, tags, related_entities), lambda x: contains(x, owner))) > 0 OR object IS NOT NULL AND contains(lower(concat_ws(' ', entity, fact_type, fact, array_to_string(aliases, ' '), array_to_string(tags, ' '), array_to_string(related_entities, ' '), array_to_string(evidence, ' '))), owner) AND contains(lower(fact || ' ' || evidence[1]), object))"


def _user_facts(spark, sf):
    f = B.facts(spark, sf)
    fields = F.concat(F.array("entity"), "aliases", "tags", "related_entities")
    return f.select(F.col("id").alias("fact_id"), F.lower(F.concat_ws(" ", "entity", "fact_type", "fact", "aliases", "tags", "related_entities", "evidence")).alias("text"), fields.alias("fields"), "importance", "chapter_index", "entity")


def _user_targets(spark, sf):
    """Every user as a target, and every user's event kind as a possessive one (owner and object)."""
    u = B.facts(spark, sf).select("entity", "fact_type").distinct()
    both = u.select(F.concat("entity", F.lit("的"), "fact_type").alias("query_id")).unionByName(u.select(F.col("entity").alias("query_id")).distinct())
    owner, thing = Q.possessive(F.col("query_id"))
    return both.withColumns({"owner": owner, "object": thing})


@query("win_target_match", f"{_USERS} SELECT query_id, id FROM facts JOIN q ON {_HAS}")
def win_target_match(spark, sf):
    """Facts with a target in a structured field; of possessive targets those whose text has the owner and the object."""
    facts, targets = _user_facts(spark, sf), _user_targets(spark, sf)
    plain = R.target_facts(facts, targets.where("owner = ''").select("query_id", R.token(F.col("query_id")).alias("term")))
    owned = R.possessive_facts(facts, targets.where("owner <> ''").select("query_id", F.array("owner").alias("owners"), F.array("object").alias("descriptors")))
    return plain.unionByName(owned).select("query_id", F.col("fact_id").alias("id"))


_FLAGGED = f"""{_EXPAND}, {_DIRECT}, e AS (SELECT r.*, d.fact_id IS NOT NULL AS target FROM ranked r LEFT JOIN direct d ON d.query_id = r.query_id AND d.fact_id = r.fact_id)"""


def _flagged(spark, sf, most, **more):
    """Scores of every question by one pass over the texts, told apart by whether a structured field has the target."""
    targets = R.target_terms(B.questions(spark, sf)).withColumn("use", F.lit(3))
    return R.scan(_facts(spark, sf).drop("same"), _terms(spark, sf), most, targets=targets, **more)


@query("win_select", f"""{_FLAGGED}, o AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY place) AS place) FROM e WHERE target), {_pick_sql('o', '30')}, k AS (SELECT e.query_id, e.fact_id, e.target, row_number() OVER (PARTITION BY e.query_id ORDER BY CASE WHEN p.pick <= 30 THEN 0 ELSE 1 END, e.place) AS turn FROM e LEFT JOIN p ON p.query_id = e.query_id AND p.fact_id = e.fact_id)
    SELECT query_id, fact_id, target, turn FROM k WHERE turn <= 30""")
def win_select(spark, sf):
    return R.select(_flagged(spark, sf, 30, own=True).entries, 30).select("query_id", "fact_id", "target", F.col("turn").cast("long").alias("turn"))


@query("win_select_target", f"""{_FLAGGED}, c AS (SELECT query_id, count(*) AS n FROM e WHERE target GROUP BY 1), w AS (SELECT DISTINCT z.query_id, f.fact_id FROM z JOIN f ON z.n <= 32 AND contains(f.low, z.term)),
    o AS (SELECT e.* REPLACE (row_number() OVER (PARTITION BY e.query_id ORDER BY e.place) AS place), c.n FROM e JOIN c USING (query_id) JOIN w ON w.query_id = e.query_id AND w.fact_id = e.fact_id WHERE NOT target),
    {_pick_sql('o', 'least(greatest(0, greatest(160, n) - n), greatest(8, least(48, 2 * n)))')}
    SELECT query_id, fact_id, true AS target FROM e WHERE target UNION ALL SELECT query_id, fact_id, false FROM p WHERE pick <= lim""")
def win_select_target(spark, sf):
    found = _flagged(spark, sf, R.MOST_SUPPORT, chapters=True, support=_expanded(spark, sf))
    return R.with_support(found.about, found.entries).select("query_id", "fact_id", "target")


@query("win_target_terms", f"WITH {B.WITH_FACTS} SELECT DISTINCT entity || '的' || fact_type AS target, entity AS owner, fact_type AS descriptor, entity || '/' || aliases[1] AS names FROM facts")
def win_target_terms(spark, sf):
    """Owner, descriptor and alias names of possessive targets."""
    f = B.facts(spark, sf).select(F.concat("entity", F.lit("的"), "fact_type").alias("target"), F.concat("entity", F.lit("（又名"), F.get("aliases", F.lit(0)), F.lit("）")).alias("named")).distinct()
    owner, thing = Q.possessive(F.col("target"))
    return f.select("target", owner.alias("owner"), thing.alias("descriptor"), F.array_join(Q.aliases(F.col("named")), "/").alias("names"))
