"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import store


def _lows(edges: DataFrame) -> DataFrame:
    """Every node, its low (the smallest of itself and its neighbours), and whether it isn't part of a star around its smallest node yet."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    below, above = F.when(F.col("b") < F.col("a"), F.col("b")), F.when(F.col("b") > F.col("a"), F.lit(1))
    lows = both.groupBy("a").agg(F.min(below).alias("least"), F.max(below).alias("most"), F.max(above).alias("above"))
    unsettled = F.col("least").isNotNull() & ((F.col("least") < F.col("most")) | F.col("above").isNotNull())
    return lows.select(F.col("a").alias("node"), F.coalesce("least", "a").alias("low"), unsettled.alias("unsettled"))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from every linked node.

    ``links`` has long columns a and b; direction, order and repeats don't
    matter.  Returns node, root; nodes without a link aren't listed.  Large and
    small stars alternate until the links are stars around their smallest node,
    which the minimum by node tells before a round, so none is spent on finding
    that nothing changes.  What a round needs is written to the shared folder, so
    lineage stays short, and is deleted with the round; a node with very many links
    is only ever grouped by partial minimum, and joins read written tables on both
    sides, which Spark broadcasts if small and whose skewed partitions it splits.
    """
    edges = store.staged(links.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").select("a", "b").distinct(), "links")
    for _ in range(most_rounds):
        lows = store.staged(_lows(edges), "lows")
        if not lows.agg(F.max("unsettled")).first()[0]:
            break
        large = edges.join(lows, edges["b"] == lows["node"]).select(edges["a"], lows["low"].alias("b"))
        large = store.staged(large, "large-star")  # no more rows than edges
        least = store.staged(large.groupBy("a").agg(F.min("b").alias("low")), "least")
        both = F.explode(F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b"))))
        last, edges = edges, store.staged(large.join(least, "a").select(both.alias("link")).select("link.*").where("a <> b").distinct(), "small-star")
        for done in (last, lows, large, least):
            store.drop_staged(done)
        store.forget(edges.sparkSession)
    else:
        raise RuntimeError("components didn't settle")
    store.drop_staged(edges)
    return lows.select("node", F.col("low").alias("root"))
