"""One answer from partial ones: a merge call whose input fits its budget, and what is said if the call fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import columns as C
from corpusloom.operators import packing as P
from corpusloom.sources import enrich as E
from corpusloom.sources.calls import Limits

# Characters that each partial answer keeps in a merge call, tried in this order; and chapters named beside it.
LADDER = (3200, 1800, 1000, 560, 280, 140, 70, 40)
CHAPTERS = 10


def compact(markdown: Column, chars: int) -> Column:
    """A partial answer as JSON: batch, total, a sample of its chapters, fact_count and at most ``chars`` of its text."""
    return F.to_json(F.struct("batch", "total", F.col("__chapters").alias("chapters"), "fact_count", C.clip(F.coalesce(markdown, F.lit("")), chars).alias("markdown")))


def _sampled(results: DataFrame) -> DataFrame:
    return results.withColumn("__chapters", C.chapter_sample(F.coalesce("chapters", F.array().cast("array<int>")), CHAPTERS))


def steps(results: DataFrame, keys: list[str], budget: int, overhead: Column, ladder: tuple[int, ...] = LADDER) -> DataFrame:
    """keys, step and chars of the merge call of each group.

    ``results``: keys, batch, total, chapters, fact_count, markdown.  step is the first of ``ladder`` with which the whole input,
    ``overhead`` (the same in all rows of a group) and a JSON array of the partial answers, stays within ``budget``; where none does,
    the last.  One aggregation, a sum for each step: texts aren't shuffled.
    """
    r = _sampled(results).withColumn("__overhead", overhead)
    for n in ladder:
        r = r.withColumn(f"__s{n}", F.length(compact(F.col("markdown"), n)))
    whole = {n: (F.max("__overhead") + 2 + F.sum(f"__s{n}") + F.count(F.lit(1)) - 1).alias(f"s{n}") for n in ladder}
    sums = r.select(*keys, "__overhead", *[f"__s{n}" for n in ladder]).groupBy(*keys).agg(*whole.values())
    step = F.coalesce(*[F.when(F.col(f"s{n}") <= budget, n) for n in ladder], F.lit(ladder[-1]))
    chars = F.coalesce(*[F.when(F.col(f"s{n}") <= budget, F.col(f"s{n}")) for n in ladder], F.col(f"s{ladder[-1]}"))
    return sums.select(*keys, step.cast("int").alias("step"), chars.cast("long").alias("chars"))


def merge_inputs(results: DataFrame, keys: list[str], budget: int, head: Column, ladder: tuple[int, ...] = LADDER) -> DataFrame:
    """keys, step and input (text) of each group's merge call: ``head``, then the partial answers in order of batch as a JSON array."""
    r = results.withColumn("__head", F.coalesce(head, F.lit("")))
    chosen = steps(r, keys, budget, F.length("__head"), ladder)
    r = _sampled(r).join(chosen, keys)
    text = F.coalesce(*[F.when(F.col("step") == n, compact(F.col("markdown"), n)) for n in ladder])
    listed = F.array_sort(F.collect_list(F.struct("batch", text.alias("text"))))
    whole = r.groupBy(*keys, "step").agg(F.max("__head").alias("head"), F.transform(listed, lambda x: x["text"]).alias("texts"))
    return whole.select(*keys, "step", F.concat("head", F.lit("["), F.array_join("texts", ","), F.lit("]")).alias("input"))


def joined(results: DataFrame, keys: list[str]) -> DataFrame:
    """keys and markdown: the partial answers under their numbers, whole and in order of batch."""
    part = F.concat(F.lit("### Part "), "batch", F.lit("/"), "total", F.lit("\n"), F.coalesce("markdown", F.lit("")))
    listed = F.array_sort(F.collect_list(F.struct("batch", part.alias("text"))))
    return results.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n\n").alias("markdown"))


def merged(results: DataFrame, keys: list[str], summariser: str, budget: int, head: Column, folder: str | None = None, limits: Limits = Limits(waits=E.SUMMARY_BACKOFF)) -> DataFrame:
    """keys, step, answer, how and error of each group.

    how: ``merged`` by the summariser; why its failure may be covered (``packing.fallback_reason``), and then the
    answer is the partial ones joined; or ``failed``, without an answer.
    Equal inputs are called for once, and with a ``folder`` never again.
    """
    made = E.summarise(merge_inputs(results, keys, budget, head), summariser, [*keys, "step"], "input", folder, limits)
    empty = F.col("ok") & (F.trim(F.coalesce("result", F.lit(""))) == "")
    why = F.when(empty, F.lit("empty_text")).when(~F.col("ok"), P.fallback_reason(F.coalesce("error", F.lit("")))).otherwise("")
    how = F.when(F.col("ok") & ~empty, "merged").when(why != "", why).otherwise("failed")
    made = made.withColumn("how", how).select(*keys, "step", "result", "how", "error")
    plain = joined(results.join(made.where("how not in ('merged', 'failed')").select(*keys), keys, "left_semi"), keys)
    answer = F.when(F.col("how") == "merged", F.col("result")).otherwise(F.col("markdown"))
    return made.join(plain, keys, "left").select(*keys, "step", answer.alias("answer"), "how", "error")
