"""Packing ranked texts into chunks under a character budget.

Packing is sequential within a question and bounded by the recall limit, so it
is one ``aggregate`` over a bounded array for each question, in parallel over
questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digits(n: Column) -> Column:
    """Characters of a number."""
    return F.length(n.cast("string"))


def prompt_chars(overhead: Column, listed: Column, n: Column) -> Column:
    """Length of a whole prompt: its fixed part, the count of its facts as a number, and ``n`` facts of
    ``listed`` characters in a JSON array with commas between them."""
    return overhead + digits(n) + 2 + listed + F.greatest(n - 1, F.lit(0))


def chunk_numbers(entries: DataFrame, budget: int) -> DataFrame:
    """chunk (from 1) and rung of every entry: query_id, place, sizes (array, longest form first) and overhead
    (of the question, the same in all its rows) in; entries in order of place.

    An entry goes in its longest form beside those before it, if the whole prompt stays within ``budget``.  One
    that doesn't fit starts a new chunk in the first form that fits alone (rung, from 0);
    one that fits in none is left out (chunk null), and what follows starts a chunk.
    """
    packed = entries.groupBy("query_id").agg(F.max("overhead").cast("long").alias("overhead"), F.array_sort(F.collect_list(F.struct("place", "sizes"))).alias("items"))
    zero = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("held"), F.array().cast("array<struct<place:int,chunk:int,rung:int>>").alias("out"))

    def step(acc, x):
        first = x["sizes"][0].cast("long")
        beside = (acc["n"] > 0) & (prompt_chars(F.col("overhead"), acc["held"] + first, acc["n"] + 1) <= budget)
        form = F.array_position(F.transform(x["sizes"], lambda s: prompt_chars(F.col("overhead"), s.cast("long"), F.lit(1)) <= budget), True).cast("int") - 1
        omitted = ~beside & (form < 0)
        rung = F.when(beside, F.lit(0)).when(~omitted, form)
        chunk = F.when(beside | omitted, acc["chunk"]).otherwise(acc["chunk"] + 1)
        n = F.when(beside, acc["n"] + 1).when(omitted, F.lit(0)).otherwise(F.lit(1))
        held = F.when(beside, acc["held"] + first).when(omitted, F.lit(0).cast("long")).otherwise(F.get(x["sizes"], form).cast("long"))
        mine = F.struct(x["place"].alias("place"), F.when(~omitted, chunk).alias("chunk"), rung.alias("rung"))
        return F.struct(chunk.alias("chunk"), n.alias("n"), held.alias("held"), F.concat(acc["out"], F.array(mine)).alias("out"))

    out = packed.select("query_id", F.explode(F.aggregate("items", zero, step, lambda a: a["out"])).alias("x"))
    return out.select("query_id", "x.place", "x.chunk", "x.rung")


def trimmed(packed: DataFrame, budget: int) -> DataFrame:
    """Packed entries with kept: whether they still fit when the prompt also says which chunk of how many it is.

    ``packed``: query_id, place, chunk (not null), size (of the form it has) and overhead.  How many chunks there are is
    known only after packing, and their numbers are part of each prompt, so some are too long by then.  Facts go from a chunk's tail
    until it fits.  A chunk keeps its number even if all its facts go, so numbers stay true and one round settles it: a longer
    prefix is always a longer prompt.
    """
    total = packed.groupBy("query_id").agg(F.max("chunk").alias("__total"))
    upto = Window.partitionBy("query_id", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = packed.join(total, "query_id").withColumns({"__n": F.count(F.lit(1)).over(upto), "__listed": F.sum("size").over(upto)})
    chars = prompt_chars(F.col("overhead") + digits(F.col("chunk")) + digits(F.col("__total")), F.col("__listed"), F.col("__n"))
    return rows.withColumn("kept", chars <= budget).drop("__total", "__n", "__listed")


def fallback_reason(message: Column) -> Column:
    """Why a failed summary may be replaced by its excerpt: an empty answer, no model, no transport; '' if it may not."""
    return F.when(message.rlike("(?i)empty text|空文本"), "empty_text").when(message.rlike("(?i)no available upstream|model.*unavailable|upstream"), "model_unavailable").when(
        message.rlike("(?i)timeout|timed out|aborted|fetch failed|network|unexpected end of json input"), "transport_unavailable").otherwise("")


def reused(parts: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """parts with the cached result (column result, null: a miss) of a completed part with equal keys and a result."""
    done = cache.where((F.col("status") == "completed") & (F.coalesce("result", F.lit("")) != "")).groupBy(*keys).agg(F.max("result").alias("result"))
    return parts.join(done, keys, "left")
