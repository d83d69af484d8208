"""Stored tables in partitions of book and chapter range: a change rewrites only the partitions that it touches.

A table lies in folders of a book's bucket and a range of chapters, so a book
with most of the rows is spread over its ranges.  A change reads the partitions
of its keys, computes their new rows (``upsert``) and overwrites just these; files of all others
stay as they are.  Spark writes into a staging folder and moves it in place when
all tasks are done, so a write that is killed before leaves the old state.  In
every touched partition a marker row is written, too, so that one that loses
its last row is overwritten like any other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import tables
from corpusloom.operators import upsert as U

_PLACE = ["__bucket", "__range"]


@dataclass(frozen=True)
class Stored:
    """A stored table: its folder and the schema of its rows, which have ``book_id`` and ``chapter_index``."""

    spark: SparkSession
    folder: str
    schema: T.StructType
    buckets: int = 64
    span: int = 500

    def _placed(self, rows: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64("book_id"), F.lit(self.buckets)).cast("int")
        return rows.withColumns({"__bucket": bucket, "__range": F.floor(F.coalesce("chapter_index", F.lit(0)) / self.span).cast("int")})

    def _written(self, rows: DataFrame, places: DataFrame) -> None:
        """Overwrite the partitions of ``places`` by ``rows``."""
        marks = places.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema], F.lit(False).alias("__live"), *_PLACE)
        live = self._placed(rows.select(*self.schema.names)).withColumn("__live", F.lit(True)).select(*self.schema.names, "__live", *_PLACE)
        # A partition is one file, or as many as its size asks for.
        dealt = live.unionByName(marks).hint("rebalance", *_PLACE)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_PLACE).parquet(self.folder)

    def _all(self) -> DataFrame:
        schema = T.StructType([*self.schema, T.StructField("__live", T.BooleanType()), *(T.StructField(c, T.IntegerType()) for c in _PLACE)])
        return self.spark.read.schema(schema).parquet(self.folder)

    def read(self) -> DataFrame:
        return self._all().where("__live").select(*self.schema.names)

    def touched(self, *changes: DataFrame) -> DataFrame:
        """Partitions of the rows of ``changes`` (with book_id and chapter_index), written once: at most buckets times ranges."""
        places = None
        for c in changes:
            own = self._placed(c.select("book_id", "chapter_index")).select(*_PLACE)
            places = own if places is None else places.unionByName(own)
        return tables.staged(places.distinct(), "touched")

    def within(self, places: DataFrame) -> DataFrame:
        """Rows of these partitions; others aren't read."""
        return self._all().where("__live").join(places, _PLACE, "left_semi").select(*self.schema.names)

    def change(self, places: DataFrame, rule: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the rows of ``places`` by what ``rule`` makes of them; it must not move rows to other partitions."""
        self._written(rule(self.within(places)), places)

    def upsert(self, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> None:
        """As ``upsert.latest``; keys must have the book and the chapter."""
        new = tables.staged(new, "upserts")
        self.change(self.touched(new), lambda old: U.latest(old, new, keys, keep))


def store(rows: DataFrame, folder: str, buckets: int = 64, span: int = 500) -> Stored:
    """Write a table for the first time."""
    out = Stored(rows.sparkSession, folder, rows.schema, buckets, span)
    rows = tables.staged(rows, "rows")
    out._written(rows, out.touched(rows))
    return out


def replace(facts: Stored, status: Stored, built: DataFrame, new_facts: DataFrame, scope: list[str]) -> None:
    """As ``upsert.replaced``, in the touched partitions of both tables.

    Status is written last: a chapter whose facts are new and whose status is old is one to build again.
    """
    built, new_facts = tables.staged(built, "built"), tables.staged(new_facts, "new-facts")
    places, seen = facts.touched(built), status.touched(built)
    after = U.replaced(facts.within(places), status.within(seen), built, new_facts, scope)
    _both(facts, status, places, seen, after)


def mark(facts: Stored, status: Stored, changes: DataFrame, scope: list[str]) -> None:
    """As ``upsert.marked``, in the touched partitions of both tables."""
    changes = tables.staged(changes, "changes")
    places, seen = facts.touched(changes), status.touched(changes)
    _both(facts, status, places, seen, U.marked(facts.within(places), status.within(seen), changes, scope))


def _both(facts: Stored, status: Stored, places: DataFrame, seen: DataFrame, after: tuple[DataFrame, DataFrame]) -> None:
    new_status = tables.staged(after[1], "new-status")
    facts._written(after[0], places)
    status._written(new_status, seen)
