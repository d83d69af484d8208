"""Normal forms of route-index values: entities and signals with their caps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import columns as C


def entities(values: Column) -> Column:
    """Entities out of an array of variants: a string is a name, an object has
    name, type, aliases, role and note. Nameless ones go; at most 24."""

    def one(v: Column) -> Column:
        text = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))

        def field(name: str, chars: int) -> Column:
            return F.substring(C.trimmed(F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(""))), 1, chars)

        return F.struct(
            F.substring(C.trimmed(F.coalesce(text, F.try_variant_get(v, "$.name", "string"), F.lit(""))), 1, 120).alias("name"), field("type", 60).alias("type"),
            C.string_array(F.coalesce(F.try_variant_get(v, "$.aliases", "array<string>"), F.array().cast("array<string>")), 12, 80).alias("aliases"), field("role", 80).alias("role"), field("note", 160).alias("note"))

    return F.slice(F.filter(F.transform(values, one), lambda e: e["name"] != ""), 1, 24)


def signals(values: Column, known: tuple[str, ...]) -> Column:
    """Signals with a known category and a strength of 0 to 1; without reason,
    entities and keywords they go; at most 16. ``values``: array of structs
    (category, strength, entities, keywords, reason)."""

    def one(s: Column) -> Column:
        return F.struct(
            C.category(s["category"], known).alias("category"), C.clamp01(s["strength"]).alias("strength"), C.string_array(s["entities"], 12, 120).alias("entities"),
            C.string_array(s["keywords"], 12, 80).alias("keywords"), F.substring(C.trimmed(F.coalesce(s["reason"], F.lit(""))), 1, 160).alias("reason"))

    kept = F.filter(F.transform(values, one), lambda s: (s["reason"] != "") | (F.size(s["entities"]) > 0) | (F.size(s["keywords"]) > 0))
    return F.slice(kept, 1, 16)


def scores(raw: Column, signals: Column, known: tuple[str, ...]) -> Column:
    """Score of every known category: its raw score or its strongest signal, whichever is larger, 0 to 1."""
    def one(category: str) -> Column:
        strongest = F.coalesce(F.array_max(F.transform(F.filter(signals, lambda s: s["category"] == category), lambda s: s["strength"])), F.lit(0.0))
        return C.clamp01(F.greatest(C.clamp01(raw[category]), strongest))

    return F.map_from_arrays(F.array(*map(F.lit, known)), F.array(*map(one, known)))


def major(signals: Column, by_category: Column, strength: float = 0.72, score: float = 0.8) -> Column:
    """A signal of that strength or more, or a category with that score or more."""
    return F.exists(signals, lambda s: s["strength"] >= strength) | F.exists(F.map_values(by_category), lambda x: x >= score)


def _none() -> Column:
    return F.array().cast("array<string>")


def compact() -> Column:
    """A chapter's route for the extractor: its route fields, or, without any, what the older fields give.

    Older entities become route entities (at most 16), older keywords, events,
    places and questions become keywords (24), and entities, events and
    questions each one signal of strength 0.6.
    """
    structured = (F.coalesce(F.col("route_schema_version"), F.lit("")) != "") | (F.size("route_entities") > 0) | (F.size("route_keywords") > 0) | (F.size("signals") > 0)
    named = F.slice(F.filter(F.transform("entities", lambda e: F.struct(C.trimmed(e["name"]).alias("name"), C.trimmed(e["type"]).alias("type"), e["aliases"].alias("aliases"), F.lit("").alias("role"), C.trimmed(e["note"]).alias("note"))), lambda e: e["name"] != ""), 1, 16)
    words = F.slice(F.filter(F.concat("keywords", "key_events", "items_places_orgs", "open_questions"), lambda x: x != ""), 1, 24)

    def signal(category: str, there: Column, entities: Column, keywords: Column, reason: str) -> Column:
        return F.when(F.size(there) > 0, F.struct(F.lit(category).alias("category"), F.lit(0.6).alias("strength"), entities.alias("entities"), keywords.alias("keywords"), F.lit(reason).alias("reason")))

    derived = F.array_compact(F.array(
        signal("character", F.col("entities"), F.transform(named, lambda e: e["name"]), _none(), "entities of an older index"),
        signal("event", F.col("key_events"), _none(), F.slice("key_events", 1, 8), "events of an older index"),
        signal("foreshadowing", F.col("open_questions"), _none(), F.slice("open_questions", 1, 8), "questions of an older index")))
    schema = F.when(structured, F.coalesce(F.nullif("route_schema_version", F.lit("")), F.lit("l1-route-v1"))).otherwise("legacy-l1-compatible")
    return F.struct(schema.alias("schema"), F.when(structured, F.col("route_entities")).otherwise(named).alias("entities"), F.when(structured, F.col("route_keywords")).otherwise(words).alias("keywords"), F.when(structured, F.col("signals")).otherwise(derived).alias("signals"))


def clues() -> Column:
    """What to show of a chapter: events, hooks, changes, entities and keywords, each from the first source that isn't empty."""
    def reasons(wanted) -> Column:
        return F.transform(F.filter("signals", wanted), lambda s: s["reason"])

    def first(*sources: Column) -> Column:
        return F.coalesce(*[F.when(F.size(s) > 0, s) for s in sources], _none())

    told = F.when(F.col("summary") != "", F.array("summary")).otherwise(_none())
    entities = F.when(F.size("entities") > 0, F.col("entities")).otherwise(F.col("route_entities"))
    return F.struct(
        first(F.col("key_events"), reasons(lambda s: s["category"] == "event"), told).alias("events"), first(F.col("open_questions"), reasons(lambda s: s["category"] == "foreshadowing")).alias("hooks"),
        first(F.col("items_places_orgs"), reasons(lambda s: ~s["category"].isin("event", "foreshadowing"))).alias("deltas"), entities.alias("entities"), first(F.col("keywords"), F.col("route_keywords")).alias("keywords"))
