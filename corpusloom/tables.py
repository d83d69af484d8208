"""Tables that a query needs more than once, written to the session's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder that no other run uses, below ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a missing setting is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="corpusloom-")
    return f"{shared.rstrip('/')}/corpusloom/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet and reread: later uses don't compute it again."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Plan nodes that keep the partitions of what they read.
_NARROW = {"Project", "Filter", "SubqueryAlias", "LogicalRelation", "LocalRelation", "Generate"}


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    A small table may be one row group of one file, so one task; it is dealt
    anew then.  What has enough partitions, as any large table, stays as it is,
    and so does whatever has been shuffled already.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plans = [df._jdf.queryExecution().optimizedPlan()]
    while plans:
        plan = plans.pop()
        if plan.nodeName().split(" ")[0] not in _NARROW:
            return df
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
