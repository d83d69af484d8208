"""Results as tables: JSON flattened to paths, and the tables that a JSON value holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources import envelopes as N

DEPTH = 5


def _scalar(v: Column) -> Column:
    return ~N.is_a(v, "OBJECT") & ~N.is_a(v, "ARRAY")


def _text(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))


def _entries(v: Column) -> Column:
    return F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))


def _elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _said(v: Column) -> Column:
    """Neither null nor an empty text."""
    return ~F.is_variant_null(v) & ~(N.is_a(v, "STRING") & (_text(v) == ""))


def _compact(v: Column) -> Column:
    """An object on one line: key：value；…"""
    def value(x: Column) -> Column:
        return F.when(N.is_a(x, "ARRAY"), F.array_join(F.transform(_elements(x), _text), ", ")).when(_scalar(x), _text(x)).otherwise(F.to_json(x))

    return F.array_join(F.transform(F.filter(_entries(v), lambda e: _said(e["value"])), lambda e: F.concat(e["key"], F.lit("："), value(e["value"]))), "；")


def shown(v: Column) -> Column:
    """A value in a cell: a scalar's text, scalars of an array joined by commas, other arrays one element a line."""
    plain = F.forall(_elements(v), _scalar)
    listed = F.when(plain, F.array_join(F.transform(_elements(v), _text), ", ")).otherwise(F.array_join(F.transform(_elements(v), lambda x: F.when(_scalar(x), _text(x)).otherwise(_compact(x))), "\n"))
    return F.when(_scalar(v), _text(v)).when(N.is_a(v, "ARRAY"), listed).otherwise(_compact(v))


def flattened(rows: DataFrame, keys: list[str], column: str, path: str = "path", depth: int = DEPTH) -> DataFrame:
    """keys, path and value of everything in the objects of ``column``: nested
    keys joined by " / ", arrays as one value; null, empty texts and empty arrays are left out.

    Each level is one explode over all rows; what is no object stays as it is.
    """
    at = rows.select(*keys, F.lit("").alias("__path"), F.col(column).alias("__v"))
    for _ in range(depth):
        inside = F.when(N.is_a(F.col("__v"), "OBJECT"), _entries(F.col("__v"))).otherwise(F.array(F.struct(F.lit("").alias("key"), F.col("__v").alias("value"))))
        each = at.select(*keys, "__path", F.explode(inside).alias("__e"))
        at = each.select(*keys, F.concat_ws(" / ", F.nullif("__path", F.lit("")), F.nullif("__e.key", F.lit(""))).alias("__path"), F.col("__e.value").alias("__v"))
    v = F.col("__v")
    kept = at.where(_said(v) & ~N.is_a(v, "OBJECT") & (~N.is_a(v, "ARRAY") | (F.size(_elements(v)) > 0)))
    return kept.select(*keys, F.col("__path").alias(path), shown(v).alias("value"))


def tables(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, t (table), row, field and value of the tables in ``column``.

    An array is a table of its elements (an element that is no object has the
    field value), an object under a key one of flattened fields; a value whose
    fields are all plain gives the table summary_fields; a bare array is root.
    """
    v = F.col(column)
    top = F.when(N.is_a(v, "ARRAY"), F.array(F.struct(F.lit("root").alias("key"), v.alias("value")))).when(N.is_a(v, "OBJECT"), _entries(v))
    each = rows.select(*keys, F.explode(top).alias("__e")).select(*keys, F.col("__e.key").alias("t"), F.col("__e.value").alias("__v"))
    placed = each.where(N.is_a(F.col("__v"), "ARRAY")).select(*keys, "t", F.posexplode(F.filter(_elements(F.col("__v")), lambda x: ~F.is_variant_null(x))).alias("row", "__row"))
    row = F.col("__row")
    fields = F.when(N.is_a(row, "OBJECT"), _entries(row)).otherwise(F.array(F.struct(F.lit("value").alias("key"), row.alias("value"))))
    listed = placed.select(*keys, "t", "row", F.explode(fields).alias("__f")).select(*keys, "t", "row", F.col("__f.key").alias("field"), shown(F.col("__f.value")).alias("value"))
    nested = flattened(each.where(N.is_a(F.col("__v"), "OBJECT")), [*keys, "t"], "__v", "field").select(*keys, "t", F.lit(0).alias("row"), "field", "value")
    full = listed.unionByName(nested)
    plain = each.where(_scalar(F.col("__v")) & ~F.is_variant_null("__v")).join(full.select(*keys).distinct(), keys, "left_anti")
    return full.unionByName(plain.select(*keys, F.lit("summary_fields").alias("t"), F.lit(0).alias("row"), F.col("t").alias("field"), _text(F.col("__v")).alias("value")))
