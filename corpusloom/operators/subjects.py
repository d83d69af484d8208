"""Subjects: rules over facts, admission, the fold of upserts, mentions, rescans.

A fact here has id, book_id, chapter_index, entity, aliases, tags,
related_entities, fact_type, fact, evidence, scope_eligible, scope_basis,
transformation_eligible.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import columns as C
from corpusloom.operators import containment

#: Chapters before a subject's qualification that a rescan looks at.
RESCAN = 80


@dataclass(frozen=True)
class Rule:
    """A fact is of the kind if the lower-cased text of ``fields`` matches ``yes``
    and not ``no``, and (if given) the entity matches ``entity``; or if it matches ``or_entity``."""

    fields: tuple[str, ...]
    yes: str
    no: str | None = None
    entity: str | None = None
    or_entity: str | None = None

    def hit(self) -> Column:
        text = F.lower(F.concat_ws(" ", *self.fields))
        found = text.rlike(self.yes)
        if self.no:
            found = found & ~text.rlike(self.no)
        if self.entity:
            found = found & F.trim("entity").rlike(self.entity)
        if self.or_entity:
            found = found | F.trim("entity").rlike(self.or_entity)
        return F.coalesce(found, F.lit(False))


@dataclass(frozen=True)
class Admission:
    """What admits facts of a restricted group: pattern rules and the bases that count."""

    object: Rule
    animal: Rule
    simile: Rule
    transform: Rule
    artifact: Rule
    human: Rule
    clue: Rule
    bases: tuple[str, ...]
    transformed: str

    def eligible(self) -> Column:
        """By its own scope fields; a transformation needs its flag, an artifact explicit evidence of one, a simile never counts."""
        turned = (F.col("scope_basis") == self.transformed) & F.col("transformation_eligible")
        by_scope = F.col("scope_eligible") & F.col("scope_basis").isin(*self.bases) & ((F.col("scope_basis") != self.transformed) | F.col("transformation_eligible"))
        return F.coalesce(~self.simile.hit() & (~self.artifact.hit() | turned & self.transform.hit()) & by_scope, F.lit(False))

    def candidate(self) -> Column:
        """Worth keeping though not admitted: of no ordinary kind, and an identity clue by type or text."""
        ordinary = self.artifact.hit() | self.object.hit() | self.human.hit() | self.animal.hit()
        return (F.trim("entity") != "") & ~ordinary & ((F.trim("fact_type") == "identity_clue") | self.clue.hit())


def names_of(subjects: DataFrame) -> DataFrame:
    """book_id, name, chapter: every name (canonical, key, alias) of the subjects with its smallest qualification chapter."""
    named = subjects.select("book_id", F.explode(F.concat(F.array("canonical_name", "subject_key"), "aliases")).alias("name"), F.col("qualification_chapter").alias("chapter"))
    return named.where("name <> ''").groupBy("book_id", "name").agg(F.min("chapter").alias("chapter"))


def known_from(facts: DataFrame, names: DataFrame) -> DataFrame:
    """id and chapter of the facts one of whose values (entity, aliases, related
    entities) equals a name of the same book, contains it or is contained in it;
    chapter is the smallest of the names met.

    Values and names meet as distinct strings, each way by ``containment``; no
    fact meets every subject.
    """
    values = facts.select("id", "book_id", F.explode(F.array_distinct(F.concat(F.array("entity"), "aliases", "related_entities"))).alias("value")).withColumn("value", C.trimmed(F.col("value"))).where("value <> ''")
    v, n = values.select("value").distinct(), names.select("name").distinct()
    inside = containment.contained(v.select(F.col("value").alias("text_id"), F.col("value").alias("text")), n.select(F.col("name").alias("pattern"))).toDF("value", "name")
    around = containment.contained(n.select(F.col("name").alias("text_id"), F.col("name").alias("text")), v.select(F.col("value").alias("pattern"))).toDF("name", "value")
    pairs = inside.unionByName(around).distinct()
    by_value = names.join(pairs, "name").groupBy("book_id", "value").agg(F.min("chapter").alias("chapter"))
    return values.join(by_value, ["book_id", "value"]).groupBy("id").agg(F.min("chapter").alias("chapter"))


def admitted(facts: DataFrame, names: DataFrame, rules: Admission) -> DataFrame:
    """facts with eligible, known (a subject verified in an earlier chapter is matched),
    candidate (neither, but a candidate) and identity_basis (null: not admitted)."""
    met = known_from(facts, names).withColumnRenamed("chapter", "__since")
    out = facts.join(met, "id", "left").withColumn("eligible", rules.eligible())
    out = out.withColumn("known", F.coalesce(F.col("__since") < F.col("chapter_index"), F.lit(False))).drop("__since")
    out = out.withColumn("candidate", ~F.col("eligible") & ~F.col("known") & rules.candidate())
    return out.withColumn("identity_basis", F.when(F.col("eligible"), "current_chapter").when(F.col("known"), "prior_verified_subject"))


#: Aliases that a subject keeps, and those that one upsert gives.
MOST_ALIASES, GIVEN_ALIASES = 24, 12
_KEY = ["book_id", "subject_key"]
_LATEST = ("status", "canonical_name", "creature_type", "original_form", "prompt_hash")


def fold_state(events: DataFrame) -> DataFrame:
    """A state a subject out of upserts (book_id, subject_key, pos, status, chapter,
    canonical_name, creature_type, original_form, prompt_hash, basis, evidence (array), confidence, aliases (array)).

    States of consecutive stretches of upserts can be merged (``merged_state``).
    A state has the positions of its first and last upsert, the last one's
    fields, whether any is verified, the smallest chapter from the last verified
    upsert on (of all, if none is), the first basis and evidence that aren't
    empty, the largest confidence, and the first aliases in order of sight.
    """
    last = events.groupBy(*_KEY).agg(F.max(F.when(F.col("status") == "verified", F.col("pos"))).alias("since"))
    marked = events.join(last, _KEY)
    counts = F.col("since").isNull() | (F.col("pos") >= F.col("since"))
    none = F.array().cast("array<string>")
    folded = marked.groupBy(*_KEY).agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.max_by(F.struct(*_LATEST), "pos").alias("latest"), F.max(F.col("since").isNotNull()).alias("verified"),
        F.min(F.when(counts, F.col("chapter"))).alias("chapter"), F.coalesce(F.min_by("basis", F.when(F.col("basis") != "", F.col("pos"))), F.lit("")).alias("basis"),
        F.coalesce(F.min_by("evidence", F.when(F.size("evidence") > 0, F.col("pos"))), none).alias("evidence"), F.max("confidence").alias("confidence"))
    given = F.concat(C.string_array(F.col("aliases"), GIVEN_ALIASES, 80), F.when(F.col("subject_key") != F.col("canonical_name"), F.array("subject_key")).otherwise(none))
    seen = events.select(*_KEY, "pos", F.posexplode(given).alias("place", "alias")).groupBy(*_KEY, "alias").agg(F.min(F.struct("pos", "place")).alias("at"))
    seen = seen.withColumn("n", F.row_number().over(Window.partitionBy(*_KEY).orderBy("at", "alias"))).where(F.col("n") <= MOST_ALIASES)
    names = seen.groupBy(*_KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "alias"))), lambda x: x["alias"]).alias("aliases"))
    return folded.join(names, _KEY, "left").withColumn("aliases", F.coalesce("aliases", none))


def merged_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """States of ``old`` upserts and the ``new`` ones after them as one: what folding all of them gives.

    Associative.  Of a subject in both, every new upsert must come after the old ones, else this is an error.
    Only states meet, one a subject and side; upserts that are folded already aren't read again.
    """
    fields = [c for c in old.columns if c not in _KEY]
    a = old.select(*_KEY, *[F.col(c).alias(f"a_{c}") for c in fields])
    b = new.select(*_KEY, *[F.col(c).alias(f"b_{c}") for c in fields])
    both = F.col("a_last_pos").isNotNull() & F.col("b_last_pos").isNotNull()
    late = F.when(both & (F.col("b_first_pos") <= F.col("a_last_pos")), F.raise_error(F.concat(F.lit("upserts of a subject aren't in order: "), "subject_key")))

    def first(c: str, given):
        return F.when(given(F.col(f"a_{c}")), F.col(f"a_{c}")).otherwise(F.coalesce(f"b_{c}", f"a_{c}"))

    size = lambda c: F.size(c) > 0
    none = F.array().cast("array<string>")
    values = {
        "first_pos": F.coalesce("a_first_pos", "b_first_pos"), "last_pos": F.coalesce(late.cast("long"), F.greatest("a_last_pos", "b_last_pos")), "latest": F.coalesce("b_latest", "a_latest"),
        "verified": F.coalesce("a_verified", F.lit(False)) | F.coalesce("b_verified", F.lit(False)), "chapter": F.when(F.col("b_verified"), F.col("b_chapter")).otherwise(F.least("a_chapter", "b_chapter")),
        "basis": first("basis", lambda c: c != ""), "evidence": first("evidence", size), "confidence": F.greatest("a_confidence", "b_confidence"),
        "aliases": F.slice(F.array_distinct(F.concat(F.coalesce("a_aliases", none), F.coalesce("b_aliases", none))), 1, MOST_ALIASES),
    }
    return a.join(b, _KEY, "full_outer").select(*_KEY, *[values[c].alias(c) for c in fields])


def of_state(states: DataFrame) -> DataFrame:
    """Subjects out of their states."""
    return states.select(*_KEY, "latest.*", F.col("chapter").alias("qualification_chapter"), "basis", "evidence", "confidence", "aliases")


def fold(events: DataFrame) -> DataFrame:
    """Subjects out of ordered upserts, as ``fold_state`` has them.

    Latest status, name, type, form and prompt; the chapter is the smallest from
    the last verified upsert on (of all, if none is verified); first non-empty
    basis and evidence; largest confidence; aliases in first-seen order, with
    the key where it isn't the name, at most 24.
    """
    return of_state(fold_state(events))


def subject_filter(subjects: DataFrame, chapter: int | Column | None = None, prompt_hash: str = "", terms: tuple[str, ...] = ()) -> DataFrame:
    """Verified subjects qualified by ``chapter``, of a prompt, with any of up to 24 terms in name, key or an alias."""
    kept = subjects.where(F.col("status") == "verified")
    if chapter is not None:
        kept = kept.where(F.col("qualification_chapter") <= chapter)
    if prompt_hash:
        kept = kept.where(F.col("prompt_hash") == prompt_hash)
    wanted = [t.strip().lower()[:160] for t in terms if t.strip()][:24]
    if wanted:
        fields = F.transform(F.concat(F.array("canonical_name", "subject_key"), "aliases"), F.lower)
        kept = kept.where(F.exists(fields, lambda f: _any([F.contains(f, F.lit(t)) for t in wanted])))
    return kept


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def promoted(facts: DataFrame, subjects: DataFrame, prompt_hash: str = "") -> DataFrame:
    """facts with candidates of a subject completed: the entity equals one of its
    names, or a name is an alias, related entity or tag; of a prompt, if one is given.
    ``subjects``: book_id, name."""
    asked = facts.where(F.col("status") == "candidate")
    if prompt_hash:
        asked = asked.where(F.col("prompt_hash") == prompt_hash)
    own = asked.select("id", "book_id", F.explode(F.array_distinct(F.concat(F.array("entity"), "aliases", "related_entities", "tags"))).alias("name"))
    up = own.join(subjects, ["book_id", "name"], "left_semi").select("id", F.lit(True).alias("__up")).distinct()
    return facts.join(up, "id", "left").withColumn("status", F.when(F.col("__up"), "completed").otherwise(F.col("status"))).drop("__up")


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id and subject_id where a text contains a name, whatever its length and what stands around it.

    ``texts``: doc_id (unique), text; ``names``: subject_id, name (a subject may have several).
    """
    found = containment.contained(texts.select(F.col("doc_id").alias("text_id"), "text"), names.select(F.col("name").alias("pattern")))
    return found.select(F.col("text_id").alias("doc_id"), F.col("pattern").alias("name")).join(names, "name").select("doc_id", "subject_id").distinct()


def rescans(chapters: DataFrame, subjects: DataFrame, usable: Column, most: int = RESCAN) -> DataFrame:
    """book_id, chapter_index, subject_id of the chapters to look at again: of a
    subject's book the first ``most`` before its qualification, then those with a usable name.

    ``chapters``: doc_id, book_id, chapter_index (from 1 without gaps), text; ``subjects``: subject_id, book_id,
    name, qualification_chapter; ``usable`` is a condition on ``name``.
    """
    names = subjects.where((F.length("name") >= 2) & usable)
    early = chapters.where(F.col("chapter_index") <= most)
    met = mentions(early.select("doc_id", "text"), names.select("subject_id", "name")).join(early.select("doc_id", "book_id", "chapter_index"), "doc_id")
    when = names.select("subject_id", "book_id", "qualification_chapter").distinct()
    return met.join(when, ["subject_id", "book_id"]).where("chapter_index < qualification_chapter").select("book_id", "chapter_index", "subject_id", "doc_id")


def embedded(facts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """facts and a candidate fact for every dictionary subject (name) that a
    fact's text or evidence mentions and its entity doesn't contain.

    Columns: id, origin (index or embedded), entity, related_entities, tags, fact_type, fact, evidence, importance, confidence.
    """
    text = F.concat_ws(" ", "fact", "evidence")
    found = containment.contained(facts.select(F.col("id").alias("text_id"), text.alias("text")), dictionary.select(F.col("name").alias("pattern"))).toDF("id", "name")
    made = facts.join(found, "id").where(~F.contains("entity", "name"))
    proof = F.slice(F.filter("evidence", lambda e: F.contains(e, F.col("name"))), 1, 2)
    note = F.concat(F.lit("The chapter mentions "), "name", F.when(F.col("entity") != "", F.concat(F.lit(" with "), "entity")).otherwise(""), F.lit("; that isn't enough to tell what it is."))
    columns = ("id", "origin", "entity", "related_entities", "tags", "fact_type", "fact", "evidence", "importance", "confidence")
    added = made.select(
        "id", F.lit("embedded").alias("origin"), F.when(F.col("entity") != "", F.array("entity")).otherwise(F.array().cast("array<string>")).alias("related_entities"), F.array(F.lit("candidate subject")).alias("tags"),
        F.lit("identity_clue").alias("fact_type"), note.alias("fact"), F.when(F.size(proof) > 0, proof).otherwise(F.array(F.substring(text, 1, 120))).alias("evidence"), F.lit(0.45).alias("importance"), F.lit(0.55).alias("confidence"), F.col("name").alias("entity"))
    return facts.withColumn("origin", F.lit("index")).select(*columns).unionByName(added.select(*columns))
