"""Mixing sources to target weights by systematic sampling.  DataFrame functions only.

Every document of a source is expected in target / source-size copies.  The
expected copies are summed along the source, one random offset is added, and a
document is taken once for each whole number that its stretch crosses.
Documents stand in order of size, so the words taken differ from the target by
little more than one document's.

The running sum isn't one window over a source: documents are numbered within
cells of equal (source, size, block), blocks holding about ``BLOCK`` rows, and
cells are summed per source.  So a source with a third of all rows, or one text
copied into a third of them, is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import store

#: Rows of one source and size that are numbered together.
BLOCK = 100_000


def word_count(text: str = "text") -> Column:
    """Runs of anything but ASCII white space; null text has none."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources with given sizes.

    ``sizes``: __source, __source_size (long).  Sources by code point, null last, weigh
    ``weights`` in turn and share ``share`` times all sizes; no target is above
    ``most`` times its source's size, and what is above is shared again by
    weight.  That ends where every target is the smaller of its bound and a
    common level times its weight; the level is found with one running sum over
    the sources.  Adds __target (double).
    """
    ranked = sizes.withColumn("__rank", F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())))
    at = (F.col("__rank") - 1) % len(weights)
    weighed = ranked.withColumn("__weight", F.element_at(F.array(*map(F.lit, weights)), (at + 1).cast("int")).cast("double")).withColumn("__bound", F.col("__source_size") * most)
    up = Window.orderBy(F.col("__bound") / F.col("__weight"), "__rank")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("__source_size").over(everything) - F.coalesce(F.sum("__bound").over(before), F.lit(0.0))) / F.sum("__weight").over(rest)
    # The level rises while the sources before are bound and falls after: the common one is the largest.
    common = F.max("__level").over(everything)
    leveled = weighed.withColumn("__level", level).withColumn("__common", common)
    return leveled.select("__source", "__source_size", F.least("__bound", F.col("__common") * F.col("__weight")).alias("__target"))


def offset(source: Column, seed: int) -> Column:
    """The source's one random offset in [0, 1), the same in every run."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _on(frame: DataFrame, other: DataFrame, *names: str) -> DataFrame:
    """Inner join on names, null equal to null."""
    other = other.withColumnsRenamed({n: f"{n}__r" for n in names})
    same = [frame[n].eqNullSafe(other[f"{n}__r"]) for n in names]
    return frame.join(other, same).drop(*(f"{n}__r" for n in names))


def copies(rows: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: int) -> DataFrame:
    """__row, __size, __source_size, __target and __copies of narrow rows (__row, __id, __hash, __source, __size)."""
    cells = store.staged(rows.groupBy("__source", "__size").agg(F.count(F.lit(1)).alias("__n")), "mix-cells")
    wanted = targets(cells.groupBy("__source").agg(F.sum(F.col("__n") * F.col("__size")).cast("long").alias("__source_size")), weights, share, most)
    wanted = wanted.withColumn("__rate", F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(0.0))
    wanted = wanted.withColumn("__offset", offset(F.col("__source"), seed))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("__n") / BLOCK)).cast("int")
    placed = _on(rows, cells.withColumn("__blocks", blocks).drop("__n"), "__source", "__size")
    block = F.pmod(F.coalesce(F.col("__id"), F.lit(0)), F.col("__blocks").cast("long")).cast("int")
    placed = placed.withColumn("__block", F.when(F.col("__blocks") > 1, block).otherwise(0))
    # Cells of one block are known; those of many blocks are counted.
    split = placed.where("__blocks > 1").groupBy("__source", "__size", "__block").agg(F.count(F.lit(1)).alias("__n"))
    every = cells.where(F.col("__n") <= BLOCK).select("__source", "__size", F.lit(0).alias("__block"), "__n").unionByName(split)
    run = Window.partitionBy("__source").orderBy("__size", "__block").rowsBetween(Window.unboundedPreceding, -1)
    begun = every.withColumn("__begin", F.coalesce(F.sum("__n").over(run), F.lit(0))).drop("__n")
    begun = _on(begun, wanted, "__source")
    number = F.row_number().over(Window.partitionBy("__source", "__size", "__block").orderBy("__id", "__hash", "__row"))
    numbered = _on(placed.withColumn("__number", number), begun, "__source", "__size", "__block")
    place = F.col("__begin") + F.col("__number")

    def crossed(n: Column) -> Column:
        return F.floor(n * F.col("__rate") + F.col("__offset"))

    taken = F.least(crossed(place) - crossed(place - 1), F.lit(int(-(-most // 1))))
    return numbered.select("__row", "__size", "__source_size", "__target", taken.cast("long").alias("__copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """All rows and columns of ``docs`` with __size (words), __source_size, __target and __copies.

    Copies are at most ``most`` rounded up.  Null source is a source of its
    own; null doc_id and repeated rows are numbered like others (ties by text).
    Documents without words are taken like others and add nothing.  An empty
    table gives none.  Columns of ``docs`` may not begin with two underscores.  Rows are told apart by their place in the files that ``docs``
    is read from; it is written first if it isn't a plain scan.  Sizes are counted once, into a narrow table; texts go
    through one shuffle, and through none if the caller doesn't ask for them.
    """
    numbered = store.steady(docs).withColumn("__row", F.monotonically_increasing_id())
    narrow = numbered.select("__row", F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__hash"), F.col("source").cast("string").alias("__source"), word_count().alias("__size"))
    return numbered.join(copies(store.staged(narrow, "mix-sizes"), weights, share, most, seed), "__row").drop("__row")


def sample(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, its columns unchanged."""
    mixed = mix(docs, **how).where("__copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
