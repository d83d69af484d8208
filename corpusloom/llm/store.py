"""The shared folder: intermediate tables and operator-made files.

Everything that outlives a task goes below ``spark.checkpoint.dir``, the one
folder that the driver and all executors share.  Intermediate tables are
written once and reread, which cuts lineage and lets a lost executor's work
restart from files instead of from the source.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import posixpath
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir`` as a qualified URI.

    Only a local session without the setting (a test on one machine) gets a
    folder of its own; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="corpusloom-")
        sc.setCheckpointDir(found)
    path = sc._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    """URI of a folder that no other run uses."""
    return f"{shared_dir(spark)}/corpusloom/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and reread it."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Spark's setting by which a query deletes its shuffle files when it ends.
_FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete their shuffle files when they end.

    Otherwise these lie on disk until the driver happens to collect its garbage, though what is staged is
    never read from them again.
    """
    before = spark.conf.get(_FREES, "false")
    spark.conf.set(_FREES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREES, before)


#: Plan nodes that give the same rows in the same partitions whenever they run.
_STEADY = {"Project", "Filter", "SubqueryAlias", "LogicalRelation", "LocalRelation", "LogicalRDD", "Range"}


def steady(df: DataFrame) -> DataFrame:
    """``df``, staged unless it is a plain scan: only then a row has the same place whenever it is read.

    After a shuffle rows may come in another order when a lost executor's tasks run again, so what tells
    rows apart by their place (``monotonically_increasing_id``) is only right on the result of this.
    """
    plans, seen = [df._jdf.queryExecution().optimizedPlan()], set()
    while plans:
        plan = plans.pop()
        seen.add(plan.nodeName().split(" ")[0])
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
    return df if seen <= _STEADY else staged(df, "steady")


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    for folder in {posixpath.dirname(f) for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession) -> None:
    """Let the driver collect its garbage: until then it holds the plans and shuffle files of finished jobs, and its heap grows beside them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return freed memory to the system: Python workers are used again by later tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


#: What operators leave in a Python worker for their own next task, by owner.
_LEFT: dict[str, dict] = {}


def left(owner: str) -> dict:
    """A dict that stays in the worker until a ``tidy`` task of another owner begins there."""
    return _LEFT.setdefault(owner, {})


def drop_left(but: str | None = None) -> None:
    """Forget what tasks of other owners left: a later operator's tasks need that memory."""
    for owner, what in _LEFT.items():
        if owner != but:
            what.clear()


def tidy(work, owner: str | None = None):
    """A function over batches that gives memory back when its partition is done, and of what earlier tasks left in the worker keeps its ``owner``'s."""

    @functools.wraps(work)
    def run(batches):
        drop_left(owner)
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and path of a URI, usable inside tasks."""
    return pafs.FileSystem.from_uri(uri)


def put_whole(uri: str, write) -> None:
    """Let ``write(stream)`` fill a file that appears under its name only when complete.

    A repeated or speculative attempt of the same task replaces the file by an
    equal one.
    """
    filesystem, path = open_fs(uri)
    filesystem.create_dir(posixpath.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with filesystem.open_output_stream(draft) as stream:
        write(stream)
    filesystem.move(draft, path)


def null_safe_text(name: str = "text"):
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(frame: pd.DataFrame, column: str, most: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Cut a batch so that each cut holds about ``most`` characters, or one row."""
    lengths = frame[column].str.len().to_numpy()
    begin, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield frame.iloc[begin:i]
            begin, held = i, 0
        held += n
    if begin < len(frame):
        yield frame.iloc[begin:]
