"""Calls to an outside service: bounded, kept as they come, stopped by a fatal answer.

Every distinct input is called once.  A task makes at most ``concurrent`` calls
at a time and starts them no faster than its share of the rate.  Answers go
into files below a shared folder as they come, with the hash of their input,
so neither a repeated task nor a later run calls for them again.  A fatal
answer leaves a marker in the folder: no task starts another round of calls once
it sees it, and what wasn't called says so.
"""

from __future__ import annotations

import json
import posixpath
import re
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Messages after which no further call can do better (limits and unpaid bills); fixed values.
FATAL = re.compile("成本保护|rate limit|quota|insufficient_quota|billing|429", re.IGNORECASE)
_KEPT = "hash string, outcome string, answer string, error string"


class TransportError(Exception):
    """Worth another attempt."""


@dataclass(frozen=True)
class Limits:
    """``concurrent`` calls at once in a task; ``per_second`` calls of the whole job (none: no limit); waits before
    further attempts, and how long answers may be held before they are written (0: after every round), in seconds."""

    concurrent: int = 4
    per_second: float | None = None
    waits: tuple[float, ...] = (0.3, 0.9)
    held: float = 1.0


def _open(folder: str):
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _put(filesystem, path: str, data: bytes) -> None:
    """A file that appears whole."""
    draft = posixpath.join(posixpath.dirname(path), f"_draft-{uuid.uuid4().hex}")
    with filesystem.open_output_stream(draft) as out:
        out.write(data)
    filesystem.move(draft, path)


def _attempt(rule: Callable, text: str, waits: tuple[float, ...]) -> tuple[str, str | None, str]:
    """outcome (ok, error or fatal), answer as JSON, message."""
    for wait in (*waits, None):
        try:
            return "ok", json.dumps(rule(text), ensure_ascii=False), ""
        except Exception as e:  # noqa: BLE001  a bad input is a result
            message = str(e) if isinstance(e, TransportError) else f"{type(e).__name__}: {e}"
            if FATAL.search(message):
                return "fatal", None, message
            if wait is None or not isinstance(e, TransportError):
                return "error", None, message
            time.sleep(wait)
    raise AssertionError


def kept(spark, folder: str) -> DataFrame:
    """Answers below ``folder``: hash, outcome, answer, error. What failed isn't kept."""
    filesystem, path = _open(folder)
    filesystem.create_dir(path, recursive=True)
    return spark.read.schema(_KEPT).option("pathGlobFilter", "answers-*.jsonl").option("recursiveFileLookup", "true").json(folder).dropDuplicates(["hash"])


def stopped(folder: str) -> str | None:
    """The message of the fatal answer that stopped calls into ``folder``."""
    filesystem, path = _open(folder)
    marker = posixpath.join(path, "_stopped")
    if not filesystem.get_file_info(marker).is_file:
        return None
    with filesystem.open_input_stream(marker) as f:
        return f.read().decode()


def resume(folder: str) -> None:
    """Allow calls again after a fatal answer."""
    filesystem, path = _open(folder)
    if stopped(folder) is not None:
        filesystem.delete_file(posixpath.join(path, "_stopped"))


def answers(rows: DataFrame, rule: Callable[[str], object], folder: str, salt: str = "", limits: Limits = Limits(), parallelism: int | None = None) -> DataFrame:
    """hash, outcome (ok, error, fatal or stopped), answer (JSON), error of every distinct ``text`` of ``rows``.

    ``salt`` stands for whatever else decides an answer (prompt, model, version): it is part of the hash
    ``sha256(salt, text)``.  Null text counts as empty.  The table has been written when this returns, so
    nothing that uses it calls again.
    """
    spark = rows.sparkSession
    found = kept(spark, folder)
    asked = rows.select(hash_of("text", salt).alias("hash"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["hash"])
    todo = asked.join(found.select("hash"), "hash", "left_anti")
    tasks = parallelism or spark.sparkContext.defaultParallelism
    pace, job = tasks / limits.per_second if limits.per_second else 0.0, uuid.uuid4().hex

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, path = _open(folder)
        marker, own = posixpath.join(path, "_stopped"), posixpath.join(path, job, f"{TaskContext.get().partitionId():06d}")
        filesystem.create_dir(own, recursive=True)
        done, files = {}, 0  # what an earlier attempt of this task has kept
        for info in filesystem.get_file_info(fs.FileSelector(own)):
            if posixpath.basename(info.path).startswith("answers-"):
                files += 1
                with filesystem.open_input_stream(info.path) as f:
                    done |= {r["hash"]: r for r in map(json.loads, f.read().decode().splitlines())}
        fresh, since, next_start = [], time.monotonic(), 0.0

        def keep() -> None:
            nonlocal files, since
            if fresh:
                _put(filesystem, posixpath.join(own, f"answers-{files:06d}-{uuid.uuid4().hex}.jsonl"), "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in fresh).encode())
                fresh.clear()
                files += 1
            since = time.monotonic()

        def call(text: str, at: float) -> tuple[str, str | None, str]:
            if (wait := at - time.monotonic()) > 0:
                time.sleep(wait)
            return _attempt(rule, text, limits.waits)

        with ThreadPoolExecutor(limits.concurrent) as pool:
            for frame in frames:
                todo = [(h, t) for h, t in zip(frame["hash"], frame["text"], strict=True) if h not in done]
                for at in range(0, len(todo), limits.concurrent):
                    some = todo[at : at + limits.concurrent]
                    if (why := stopped(folder)) is not None:
                        done |= {h: {"hash": h, "outcome": "stopped", "answer": None, "error": why} for h, _ in some}
                        continue
                    starts = []
                    for _ in some:
                        next_start = max(next_start + pace, time.monotonic())
                        starts.append(next_start)
                    for (h, _), (outcome, answer, error) in zip(some, pool.map(call, [t for _, t in some], starts), strict=True):
                        done[h] = {"hash": h, "outcome": outcome, "answer": answer, "error": error}
                        if outcome == "ok":
                            fresh.append(done[h])
                        elif outcome == "fatal":
                            _put(filesystem, marker, error.encode())
                    if time.monotonic() - since >= limits.held:
                        keep()
                keep()
                yield pd.DataFrame([done[h] for h in frame["hash"]], columns=["hash", "outcome", "answer", "error"])

    called = todo.repartition(tasks, "hash").mapInPandas(run, _KEPT)
    called.write.mode("append").parquet(out := posixpath.join(folder, f"runs/{job}"))
    return found.join(asked.select("hash"), "hash", "left_semi").unionByName(spark.read.schema(_KEPT).parquet(out)).dropDuplicates(["hash"])


def hash_of(text: str, salt: str = ""):
    return F.sha2(F.concat(F.lit(salt + "\n"), F.coalesce(F.col(text), F.lit(""))), 256)
