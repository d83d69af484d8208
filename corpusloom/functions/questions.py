"""Rules that turn questions into terms, intents and targets.

Vocabulary is passed in: the rules only say how it is used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import columns as C

#: Characters that end a segment of a question, in Latin and CJK punctuation.
SEGMENTS = "[，。；;、：:/｜|《》“”「」『』‘’（）()\\s]+"
#: Brackets and quotes that set off a name.
BRACKETED = "[《“「『‘（(\"]([^》”」』’）)\"]{1,24})[》”」』’）)\"]"


@dataclass(frozen=True)
class Vocabulary:
    """Words by their part in a question; each is a regular expression alternative."""

    leading: str
    trailing: str
    stop: str
    dictionary: tuple[str, ...] = ()
    asks: tuple[tuple[str, str], ...] = ()
    many: str = ""
    subjects: str = ""
    extra: tuple[tuple[str, str], ...] = ()
    domain: str = ""


def term_clean(c: Column, v: Vocabulary) -> Column:
    """A term without leading verbs and trailing nouns; null if it isn't 2 to 18 characters or is a stop word."""
    s = F.trim(F.regexp_replace(F.regexp_replace(C.trimmed(c), f"^({v.leading})+", ""), f"({v.trailing})$", ""))
    return F.when(F.length(s).between(2, 18) & ~F.lower(s).rlike(f"^({v.stop}|[0-9]+)$"), s)


def sub_terms(c: Column, v: Vocabulary) -> Column:
    """Words of 2 to 8 characters that the domain pattern hits, then the dictionary's words that the text contains, each once."""
    known = F.filter(F.array(*map(F.lit, v.dictionary)) if v.dictionary else F.array().cast("array<string>"), lambda w: F.contains(F.lower(c), F.lower(w)))
    if not v.domain:
        return known
    words = F.filter(F.regexp_extract_all(c, F.lit("[\\u4e00-\\u9fa5A-Za-z0-9]{2,8}"), F.lit(0)), lambda w: w.rlike(v.domain))
    return F.array_distinct(F.concat(words, known))


def entities(text: Column, patterns: tuple[str, ...], gazetteer: str, stop: str, most: int = 6) -> Column:
    """First groups of the patterns in turn, then known names; without stop words, each once, at most ``most``."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns], F.regexp_extract_all(text, F.lit(gazetteer), F.lit(0)))
    cleaned = F.transform(found, lambda x: F.substring(C.trimmed(x), 1, 24))
    return F.slice(F.array_distinct(F.filter(cleaned, lambda x: (x != "") & ~F.lower(x).rlike(stop))), 1, most)


def target_likely(c: Column, asks: str, prefix: str, reserved: tuple[str, ...]) -> Column:
    """Whether a term may be a question's subject: 2 to 12 characters, no word that asks for something, no counting prefix, not reserved."""
    t = F.lower(C.trimmed(F.coalesce(c, F.lit(""))))
    return F.length(t).between(2, 12) & ~t.rlike(asks) & ~t.rlike(f"^({prefix})") & ~t.isin(*reserved)


def terms(query: Column, v: Vocabulary, target: Column | None = None, most: int = 48) -> Column:
    """Target, bracketed names, cleaned segments and dictionary words, first seen first, at most ``most``."""
    first = F.array(target) if target is not None else F.array().cast("array<string>")
    named = F.regexp_extract_all(query, F.lit(BRACKETED), F.lit(1))
    found = F.concat(first, named, F.split(query, SEGMENTS), sub_terms(query, v))
    cleaned = F.filter(F.transform(found, lambda x: F.coalesce(term_clean(x, v), F.lit(""))), lambda x: x != "")
    return F.slice(F.array_distinct(cleaned), 1, most)


def collection_reason(query: Column, v: Vocabulary, context: Column | None = None) -> Column:
    """Labels of the asking rules that hit, if the question asks for many things of a known kind, else ''."""
    q = F.lower(query)
    labels = F.array_compact(F.array(*(F.when(q.rlike(pattern), label) for pattern, label in v.asks)))
    wanted = (F.size(labels) > 0) & q.rlike(v.many) & F.lower(context if context is not None else query).rlike(v.subjects)
    return F.when(wanted, F.array_join(F.array_distinct(labels), " / ")).otherwise("")


def intent(reason: Column, target: Column) -> Column:
    """collection, target or query."""
    return F.when(reason != "", "collection").when(F.coalesce(target, F.lit("")) != "", "target").otherwise("query")


def intent_terms(context: Column, v: Vocabulary) -> Column:
    """More recall terms that the question's groups suggest: those whose pattern hits, in order."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(context.rlike(p), t) for p, t in v.extra))))


def target(query: Column, given: Column | None, patterns: tuple[str, ...]) -> Column:
    """The question's subject: as given, else the first pattern's first group that is found, else ''."""
    tries = [F.nullif(F.regexp_extract(query, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*([F.nullif(F.trim(given), F.lit(""))] if given is not None else []), *tries, F.lit(""))


def target_clean(c: Column, suffix: str, most: int = 24) -> Column:
    """A subject without up to three suffixes, clipped."""
    for _ in range(3):
        c = F.regexp_replace(c, suffix, "")
    return F.substring(C.trimmed(c), 1, most)


def aliases(c: Column, separators: str = "[/、,，|]") -> Column:
    """Names split at separators; "(also called X)" gives X as another name."""
    opened = F.regexp_replace(F.regexp_replace(c, "[（(](又名|也叫|also called|aka) ?", "/"), "[）)]", "")
    return C.unique_compact(F.split(opened, separators), 12)


def possessive(c: Column, mark: str = "的") -> tuple[Column, Column]:
    """Owner and object at the last mark; '' and '' without one."""
    pattern = f"^(.+){mark}(.+)$"
    return F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
