"""Extractors and summarisers: registries of rules over single texts, called for whole tables.

A row that fails becomes an error row, never a failed job; a fatal answer stops
further calls (``calls``).  Defaults are deterministic, so everything runs
without a service.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import tables
from corpusloom.sources import calls
from corpusloom.sources.calls import Limits, TransportError  # noqa: F401

#: Waits before the second and the third attempt, in seconds.
BACKOFF = (0.3, 0.9)
SUMMARY_BACKOFF = (1.2, 2.4)


def names(text: str) -> list[str]:
    """Default rule: capitalised words of four letters or more, first-seen."""
    return list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]{3,}\b", text)))


EXTRACTORS: dict[str, Callable[[str], list[str]]] = {"names": names}


def _called(rows: DataFrame, rule: Callable, text_column: str, folder: str | None, salt: str, limits: Limits) -> tuple[DataFrame, DataFrame]:
    asked = rows.withColumn("__hash", calls.hash_of(text_column, salt))
    folder = folder or tables.new_folder(rows.sparkSession, "calls")
    return asked, calls.answers(rows.select(F.col(text_column).alias("text")), rule, folder, salt, limits).withColumnRenamed("hash", "__hash")


def enrich(rows: DataFrame, extractor: str, id_column: str, text_column: str, folder: str | None = None, limits: Limits = Limits(waits=BACKOFF)) -> DataFrame:
    """Apply a named extractor to every row: id, ok, items, error, outcome.

    Equal texts are called for once.  With a ``folder`` answers are kept between runs.
    """
    asked, found = _called(rows, EXTRACTORS[extractor], text_column, folder, extractor, limits)
    items = F.from_json(F.concat(F.lit('{"v":'), "answer", F.lit("}")), "v array<string>")["v"]
    none = F.array().cast("array<string>")
    return asked.select(id_column, "__hash").join(found, "__hash").select(id_column, (F.col("outcome") == "ok").alias("ok"), F.coalesce(items, none).alias("items"), F.coalesce("error", F.lit("")).alias("error"), "outcome")


def excerpt(text: str) -> str:
    """Default summariser: the text itself under a heading."""
    return f"## Facts\n{text}"


SUMMARISERS: dict[str, Callable[[str], str]] = {"excerpt": excerpt}


def summarise(parts: DataFrame, summariser: str, keys: list[str], text_column: str, folder: str | None = None, limits: Limits = Limits(waits=SUMMARY_BACKOFF)) -> DataFrame:
    """Apply a named summariser to every part: keys, ok, result, error, outcome; as ``enrich``."""
    asked, found = _called(parts, SUMMARISERS[summariser], text_column, folder, summariser, limits)
    result = F.from_json(F.concat(F.lit('{"v":'), "answer", F.lit("}")), "v string")["v"]
    return asked.select(*keys, "__hash").join(found, "__hash").select(*keys, (F.col("outcome") == "ok").alias("ok"), result.alias("result"), F.coalesce("error", F.lit("")).alias("error"), "outcome")
