"""Upserts as new tables: the latest row of every key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with equal keys, the last of ``new`` wins.

    ``new`` has a column ``pos`` (order of arrival).  Columns in ``keep`` keep
    the old row's value where it has one.
    """
    last = new.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("pos")))).where("__n = 1").drop("__n", "pos")
    if keep:
        before = old.select(*keys, *[F.col(c).alias(f"__{c}") for c in keep])
        last = last.join(before, keys, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in keep}).drop(*[f"__{c}" for c in keep])
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last)


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't in ``gone``."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def merged(old: DataFrame, new: DataFrame, keys: list[str], fields: tuple[str, ...], defaults: dict[str, str] | None = None) -> DataFrame:
    """Partial updates: of the last row of ``new`` (with ``pos``) only fields that aren't null replace the
    old ones; a blank text is the field's default.  Keys that are only in ``new`` are added."""
    defaults = defaults or {}
    last = new.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("pos")))).where("__n = 1")
    last = last.select(*keys, *[F.col(c).alias(f"__{c}") for c in fields])

    def value(c: str):
        given = F.col(f"__{c}")
        if c in defaults:
            given = F.when(F.trim(given) == "", defaults[c]).otherwise(given)
        return F.coalesce(given, c)

    return old.join(last, keys, "full_outer").withColumns({c: value(c) for c in fields}).drop(*[f"__{c}" for c in fields])


def replaced(facts: DataFrame, status: DataFrame, built: DataFrame, new_facts: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """Facts and status after chapters were built again.

    ``built``: scope columns, status, source_hash; ``new_facts``: facts with
    ``candidate``.  All old facts of the scope go; admitted ones get the chapter's
    status, candidates the status candidate, and only the former are counted.
    """
    counts = new_facts.where("not candidate").groupBy(*scope).agg(F.count(F.lit(1)).cast("int").alias("facts_count"))
    rows = built.join(counts, scope, "left").withColumn("facts_count", F.coalesce("facts_count", F.lit(0))).select(*status.columns)
    added = new_facts.join(built.select(*scope, F.col("status").alias("__built")), scope).withColumn("status", F.when(F.col("candidate"), "candidate").otherwise(F.col("__built")))
    return without(facts, built, scope).unionByName(added.select(*facts.columns)), without(status, built, scope).unionByName(rows)


def marked(facts: DataFrame, status: DataFrame, changes: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """Facts and status after chapters got a status without facts: counts are 0, and facts go unless the status is failed."""
    rows = changes.withColumn("facts_count", F.lit(0)).select(*status.columns)
    return without(facts, changes.where("status <> 'failed'"), scope), without(status, changes, scope).unionByName(rows)


def cascade(tables: dict[str, DataFrame], gone: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Every table without the rows whose key is in ``gone``."""
    return {name: without(t, gone, keys) for name, t in tables.items()}
