"""Facts: filters with lists and terms, normal forms, evidence packets, traces and whether a result is useful."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import columns as C
from corpusloom.sources import envelopes as N

#: Fields that a term is looked for in: of the full listing and of the one without texts.
SEARCHED = ("entity", "aliases", "related_entities", "tags", "fact_type")
SEARCHED_META = SEARCHED[:4]
MOST_TERMS, MOST_ROWS = 8, 2_000
#: Texts that say nothing.
PLACEHOLDERS = ("", "n/a", "na", "null", "none", "无", "暂无", "空")


def matching(facts: DataFrame, start: int, end: int, groups: Sequence[str] = ("base",), chapters: Sequence[int] = (), categories: Sequence[str] = (), terms: Sequence[str] = (), limit: int = 500, fields: Sequence[str] = SEARCHED) -> DataFrame:
    """Completed facts of a chapter range, groups, listed chapters and categories with any of up to
    eight terms in a field; of each book the ``limit`` (1 to 2000) most important.

    A term counts in any case; empty lists don't filter, but groups: none is base.
    """
    f = facts.where((F.col("status") == "completed") & F.col("chapter_index").between(start, max(start, end)) & F.col("index_group_key").isin(*(groups or ("base",))))
    listed = sorted({c for c in chapters if start <= c <= max(start, end)})
    if listed:
        f = f.where(F.col("chapter_index").isin(*listed))
    if categories:
        f = f.where(F.col("category").isin(*categories))
    wanted = list(dict.fromkeys(t.strip().lower() for t in terms if t and t.strip()))[:MOST_TERMS]
    if wanted:
        values = F.concat(*[F.col(c) if c not in ("entity", "fact_type") else F.array(c) for c in fields])
        f = f.where(F.exists(F.transform(values, F.lower), lambda v: _any([F.contains(v, F.lit(t)) for t in wanted])))
    order = Window.partitionBy("book_id").orderBy(F.desc("importance"), F.desc("confidence"), "chapter_index", "id")
    return f.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= max(1, min(MOST_ROWS, limit))).drop("__n")


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def normal(facts: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """Facts with clipped fields, capped lists, clamped scores and a known category; those without fact and entity go."""
    def text(c: str, n: int) -> Column:
        return F.substring(C.trimmed(F.coalesce(F.col(c), F.lit(""))), 1, n)

    kind = C.category(F.col("category"), categories)
    out = facts.withColumns({
        "entity": text("entity", 120), "fact": C.trimmed(F.coalesce(F.col("fact"), F.lit(""))), "fact_type": F.coalesce(F.nullif(text("fact_type", 80), F.lit("")), kind), "category": kind,
        "aliases": C.string_array(F.col("aliases"), 12, 80), "tags": C.string_array(F.col("tags"), 12, 80), "related_entities": C.string_array(F.col("related_entities"), 12, 120), "evidence": C.string_array(F.col("evidence"), 8, 300),
        "importance": C.clamp01(F.col("importance")), "confidence": C.clamp01(F.col("confidence")), "review_note": text("review_note", 1000),
        "review_source": F.when(F.col("review_source").isin("index", "source_review"), F.col("review_source")).otherwise("index")})
    return out.where((F.col("fact") != "") | (F.col("entity") != ""))


def packet() -> Column:
    """A fact as evidence: clipped content, at most five related subjects, two pieces of evidence, six tags."""
    return F.struct(
        F.when(F.col("review_source") == "source_review", "source_review").otherwise("l2_fact").alias("source_type"), F.nullif("chapter_index", F.lit(0)).alias("chapter_index"), "category", F.col("entity").alias("subject"), C.string_array(F.col("related_entities"), 5, 40).alias("related_subjects"),
        "fact_type", C.clip(F.col("fact"), 260).alias("content"), C.string_array(F.col("evidence"), 2, 120).alias("evidence"), "importance", "confidence", C.string_array(F.col("tags"), 6, 32).alias("tags"))


def compact(fact_chars: int, items: int, chars: int) -> Column:
    """A fact for a budget: lists of four by 24 characters, the fact and its evidence as long as asked."""
    lists = [C.string_array(F.col(c), 4, 24).alias(c) for c in ("aliases", "tags", "related_entities")]
    evidence = C.string_array(F.col("evidence"), items, chars) if items else F.array().cast("array<string>")
    return F.struct("chapter_index", "category", "entity", *lists, "fact_type", C.clip(F.coalesce("fact", F.lit("")), fact_chars).alias("fact"), evidence.alias("evidence"), "importance", "confidence", "index_group_key")


def category_list(c: Column, known: tuple[str, ...]) -> Column:
    """Categories out of a comma-separated text: unknown ones are other, which only stays where it is asked for."""
    raw = F.transform(F.split(c, ","), lambda x: F.lower(C.trimmed(x)))
    return F.filter(F.array_distinct(F.transform(raw, lambda x: F.when(x.isin(*known), x).otherwise("other"))), lambda x: (x != "other") | F.array_contains(raw, "other"))


def trace(packets: DataFrame, part: list[str]) -> DataFrame:
    """Lineage of each part: packets, count maps by source type, category and fact
    type, chapters (count, first, last, sample), up to twelve subjects and eight
    related ones in first-seen order, and packets that match the target.

    ``packets``: the part's columns, pos (order) and the fields of ``packet``, and target (or null).
    """
    maps = {"source_types": F.coalesce("source_type", F.lit("unknown")), "categories": F.col("category"), "fact_types": F.col("fact_type")}
    values = [F.array(_value(k, c)) for k, c in (*maps.items(), ("subjects", F.col("subject")))]
    told = _told(packets, part, F.concat(*values, F.transform("related_subjects", lambda x, i: _value("related", x, i))), tuple(maps), {"subjects": 12, "related": 8})
    text = F.lower(F.concat_ws(" ", "source_type", "category", "subject", "fact_type", "content", "related_subjects", "tags", "evidence"))
    hit = F.coalesce((F.col("target") != "") & F.contains(text, F.lower("target")), F.lit(False))
    flat = packets.groupBy(*part).agg(F.count(F.lit(1)).alias("packets"), F.array_sort(F.collect_set("chapter_index")).alias("chapters"), F.count_if(hit).alias("target_packets"))
    out = flat.withColumns({"chapter_count": F.size("chapters"), "first_chapter": F.array_min("chapters"), "last_chapter": F.array_max("chapters"), "sample": C.chapter_sample(F.col("chapters"))}).drop("chapters")
    return out.join(told, part, "left")


def _value(kind: str, value: Column, place: Column | None = None, n: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), C.trimmed(F.coalesce(value.cast("string"), F.lit(""))).alias("value"), (place if place is not None else F.lit(0)).cast("int").alias("i"), (n if n is not None else F.lit(1)).cast("long").alias("n"))


def _told(rows: DataFrame, by: list[str], values: Column, maps: tuple[str, ...], lists: dict[str, int]) -> DataFrame:
    """Of each group of ``rows`` (with pos) the values by kind: summed maps, and lists of the first distinct values.

    ``values`` are structs of kind, value, i (place in its row) and n.  One aggregation by value, whose
    partial sums and minima are all that is shuffled, serves all kinds; no list of all values is made.
    """
    each = rows.select(*by, "pos", F.explode(values).alias("v")).where("v.value <> ''")
    counted = each.groupBy(*by, "v.kind", "v.value").agg(F.sum("v.n").alias("n"), F.min(F.struct("pos", "v.i")).alias("at"))
    placed = counted.withColumn("place", F.row_number().over(Window.partitionBy(*by, "kind").orderBy("at", "value")))
    kind = F.col("kind")
    made = [F.map_from_entries(F.collect_list(F.when(kind == k, F.struct("value", "n")))).alias(k) for k in maps]
    made += [F.transform(F.array_sort(F.collect_list(F.when((kind == k) & (F.col("place") <= most), F.struct("place", "value")))), lambda x: x["value"]).alias(k) for k, most in lists.items()]
    return placed.groupBy(*by).agg(*made)


def public(traces: DataFrame) -> DataFrame:
    """Traces that say something, with defaults for what they lack."""
    none, empty = F.array().cast("array<string>"), F.create_map().cast("map<string,bigint>")
    kept = traces.where("packets > 0 or target_packets > 0")
    return kept.withColumns({**{c: F.coalesce(c, none) for c in ("subjects", "related")}, **{c: F.coalesce(c, empty) for c in ("source_types", "categories", "fact_types")}})


def merged(traces: DataFrame, by: list[str]) -> DataFrame:
    """One trace of many: summed packets and maps, chapters out of samples, first and last ones, up to twelve subjects. ``traces`` come with pos."""
    maps = ("source_types", "categories")

    def entries_of(name: str) -> Column:
        return F.transform(F.map_entries(name), lambda e: _value(name, e["key"], n=e["value"]))

    entries = [entries_of(name) for name in maps]
    told = _told(traces, by, F.concat(*entries, F.transform("subjects", lambda x, i: _value("subjects", x, i))), maps, {"subjects": 12})
    # Samples have at most 16 chapters each.
    seen = F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list(F.concat("sample", F.array("first_chapter", "last_chapter")))), lambda c: c > 0)))
    out = traces.groupBy(*by).agg(F.count(F.lit(1)).alias("parts"), F.sum("packets").alias("packets"), F.sum("target_packets").alias("target_packets"), seen.alias("c"))
    out = out.withColumns({"chapter_count": F.size("c"), "first_chapter": F.array_min("c"), "last_chapter": F.array_max("c"), "sample": C.chapter_sample(F.col("c"))}).drop("c")
    return out.join(told, by, "left")


def leaves(v: Column, depth: int = 4) -> Column:
    """The values inside a variant, objects and arrays opened to ``depth``."""
    def inside(x: Column) -> Column:
        return F.when(N.is_a(x, "OBJECT"), F.map_values(F.try_variant_get(x, "$", "map<string,variant>"))).when(N.is_a(x, "ARRAY"), F.try_variant_get(x, "$", "array<variant>")).otherwise(F.array(x))

    out = F.array(v)
    for _ in range(depth):
        out = F.flatten(F.transform(out, inside))
    return out


def says_something(v: Column) -> Column:
    """A number, a boolean, or a text that is no placeholder."""
    text = F.lower(C.trimmed(F.try_variant_get(v, "$", "string")))
    scalar = ~N.is_a(v, "OBJECT") & ~N.is_a(v, "ARRAY") & ~F.is_variant_null(v)
    return F.coalesce(scalar & F.when(N.is_a(v, "STRING"), ~text.isin(*PLACEHOLDERS)).otherwise(True), F.lit(False))


def useful(result: Column, sources: Column) -> Column:
    """Whether a result (variant) is worth keeping: it always is for fewer than
    three sources; a text that is no placeholder; an object with items, a title,
    a summary, or anything that says something under another key than failed_chapters."""
    items = N.objects(result, "items")
    named = F.array(*[F.try_variant_get(result, f"$.{k}", "variant") for k in ("summary", "title")])
    others = F.map_filter(F.try_variant_get(result, "$", "map<string,variant>"), lambda k, _: ~k.isin("title", "summary", "items", "failed_chapters"))
    custom = F.exists(F.flatten(F.transform(F.map_values(others), lambda x: leaves(x))), says_something)
    good = F.when(N.is_a(result, "OBJECT"), (F.size(items) > 0) | F.exists(named, says_something) | custom).otherwise(N.is_a(result, "STRING") & says_something(result))
    return (sources < 3) | F.coalesce(good, F.lit(False))
