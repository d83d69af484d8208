"""Scalar rules as Column helpers; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clamp01(c: Column) -> Column:
    """Scores are 0 to 1; null and non-finite ones are 0."""
    d = c.cast("double")
    return F.when(F.abs(d) < float("inf"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), d))).otherwise(0.0)  # NaN is more


def string_array(c: Column, items: int, chars: int) -> Column:
    """Trim, clip, drop empty entries, cap."""
    clipped = F.transform(c, lambda x: F.substring(trimmed(F.coalesce(x, F.lit(""))), 1, chars))
    return F.slice(F.filter(clipped, lambda x: x != ""), 1, items)


def unique_compact(c: Column, items: int) -> Column:
    """First-seen distinct of trimmed non-blank entries, capped."""
    cleaned = F.transform(c, lambda x: trimmed(F.coalesce(x, F.lit(""))))
    return F.slice(F.array_distinct(F.filter(cleaned, lambda x: x != "")), 1, items)


def clip(c: Column, chars: int) -> Column:
    """White space collapsed; longer texts end in three dots within ``chars``."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) > chars, F.concat(F.substring(flat, 1, chars - 3), F.lit("..."))).otherwise(flat)


def key(c: Column) -> Column:
    """Slug: lower case, other characters to one hyphen, no hyphen or underscore at the ends, at most 64; empty: base."""
    s = F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9_-]+", "-")
    s = F.substring(F.regexp_replace(F.regexp_replace(s, "-+", "-"), "^[-_]+|[-_]+$", ""), 1, 64)
    return F.when(F.coalesce(s, F.lit("")) == "", "base").otherwise(s)


def rule_hash(rule: Column, default: str, prefix: str, group: Column | None = None) -> Column:
    """A constant for the default rule, else the hash of prefix (with the group's key, if one is given) and rule."""
    text = F.coalesce(F.nullif(F.trim(rule), F.lit("")), F.lit(default))
    return F.when(text == default, f"{prefix}-default").otherwise(F.sha2(F.concat(F.lit(prefix), *([F.lit(":"), group] if group is not None else []), F.lit("\n"), text), 256))


def stable_hash(body: Column) -> Column:
    """Hash of a JSON text that doesn't depend on the order of keys (a variant keeps them sorted)."""
    return F.sha2(F.to_json(F.parse_json(body)), 256)


def redact(c: Column) -> Column:
    """Mask service tokens and bearer values; at most 1200 characters."""
    s = F.regexp_replace(c, r"\b(app-|sk-|cg_)[A-Za-z0-9_-]{6,}", "$1***")
    return F.substring(F.regexp_replace(s, r"(?i)(bearer)\s+[A-Za-z0-9._~+/=-]+", "$1 ***"), 1, 1200)


def search_text(*cols: Column) -> Column:
    """Lower-cased, space-joined text of scalar and array fields."""
    return F.lower(F.concat_ws(" ", *cols))


def category(c: Column, known: tuple[str, ...]) -> Column:
    """A known category, else other."""
    s = F.lower(F.trim(F.coalesce(c, F.lit("other"))))
    return F.when(s.isin(*known), s).otherwise("other")


def duration(ms: Column) -> Column:
    """Milliseconds as hours, minutes and seconds."""
    s = F.floor(ms / 1000)
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))


def percent(done: Column, total: Column) -> Column:
    """Whole percent, at most 100; 0 without a total."""
    return F.when(total > 0, F.least(F.lit(100), F.round(done * 100.0 / total))).otherwise(0).cast("int")


def chapter_sample(chapters: Column, limit: int = 16) -> Column:
    """Ascending distinct chapters; of many the first and the last ones."""
    v = F.array_sort(F.array_distinct(chapters))
    head, tail = -(-limit // 2), limit // 2
    return F.when(F.size(v) <= limit, v).otherwise(F.concat(F.slice(v, 1, head), F.slice(v, -tail, tail)))
