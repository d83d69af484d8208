"""Index groups and books: free keys, base groups, names that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_TRIES = 999


def free_keys(used: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (book_id, group_key, …) with free_key: the key itself if the book doesn't use it, else the first free of key-2 to key-999.

    Rows that want one key of one book at once get its free keys in turn.  Only used keys of the wanted forms are looked at.
    """
    place = Window.partitionBy("book_id", "group_key").orderBy(*[c for c in wanted.columns if c not in ("book_id", "group_key")] or ["group_key"])
    asked = wanted.withColumn("__k", F.row_number().over(place))
    each = asked.select("book_id", "group_key").distinct().withColumn("__n", F.explode(F.sequence(F.lit(1), F.lit(MOST_TRIES))))
    each = each.withColumn("free_key", F.when(F.col("__n") == 1, F.col("group_key")).otherwise(F.concat("group_key", F.lit("-"), "__n")))
    open_ = each.join(used.select("book_id", F.col("group_key").alias("free_key")).distinct(), ["book_id", "free_key"], "left_anti")
    open_ = open_.withColumn("__k", F.row_number().over(Window.partitionBy("book_id", "group_key").orderBy("__n")))
    return asked.join(open_.drop("__n"), ["book_id", "group_key", "__k"]).drop("__k")


def base_groups(books: DataFrame, stored: DataFrame) -> DataFrame:
    """The base group of every book (book_id, rule) with the book's rule, and what was done: kept, updated or inserted."""
    old = stored.where("group_key = 'base'").select("book_id", F.col("rule").alias("__rule"))
    joined = books.join(old, "book_id", "left")
    action = F.when(F.col("__rule").isNull(), "inserted").when(F.col("__rule") != F.col("rule"), "updated").otherwise("kept")
    return joined.select("book_id", F.lit("base").alias("group_key"), "rule", action.alias("action"))


def bound(asked: DataFrame, key: str, name: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Books with the first name given to them that isn't blank, and the rows that ask for another name."""
    given = asked.where(F.trim(name) != "")
    books = given.groupBy(key).agg(F.min_by(name, order).alias("book_name"))
    return books, given.join(books, key).where(F.col(name) != F.col("book_name"))
