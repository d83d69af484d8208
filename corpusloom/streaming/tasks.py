"""Task logs: the fold of events to task state, in batch and as a stream.

Events: task_id, seq, at (timestamp that doesn't fall as seq rises within a task), event, completed, failed,
skipped (a progress event's counters, totals so far), total.  Both give the
same state.  A created task is queued, until it runs or progresses; it may pause
and run again.  The first of completed, failed and cancelled ends it, and what
comes later is ignored, but cancelled wins over failed.  Events that repeat a
seq of their task count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FINAL = ("completed", "failed", "cancelled")
COUNTERS = ("completed", "failed", "skipped")
#: Events of a task that are kept, and those of them that are published; unit durations that are kept, and those that make an estimate.
KEPT, PUBLISHED, UNITS, RECENT_UNITS = 200, 80, 12, 6


def fold(events: DataFrame) -> DataFrame:
    """State of every task: task_id, state, completed, failed, skipped, processed, last_seq.

    The counters are those of the last progress before the end.  Only partial minima and maxima are
    grouped, no list of events; the narrow table of ends is joined back for what counts before them.
    """
    seq = F.col("seq")

    def first(*kinds: str):
        return F.min(F.when(F.col("event").isin(*kinds), seq))

    ends = events.groupBy("task_id").agg(first("cancelled").alias("cancelled"), F.min(F.when(F.col("event").isin("completed", "failed"), F.struct("seq", "event"))).alias("ended"), F.max("seq").alias("last_seq"))
    before = events.join(ends.select("task_id", F.least("cancelled", "ended.seq").alias("end")), "task_id").where(F.col("end").isNull() | (seq < F.col("end")))
    counters = F.struct(*[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTERS])
    live = before.groupBy("task_id").agg(
        F.max(F.when(F.col("event") == "progress", F.struct("seq", counters.alias("c")))).alias("progress"), F.max(F.when(F.col("event").isin("created", "running", "paused"), F.struct("seq", "event"))).alias("last"))
    progressed = F.coalesce(F.col("progress.seq") > F.col("last.seq"), F.col("last").isNull() & F.col("progress").isNotNull())
    running = F.when(F.col("last.event") == "paused", "paused").when((F.col("last.event") == "created") & ~progressed, "queued").otherwise("running")
    state = F.when(F.col("cancelled").isNotNull() & (F.col("ended").isNull() | (F.col("ended.event") != "completed")), "cancelled").otherwise(F.coalesce("ended.event", running))
    out = ends.join(live, "task_id", "left").select("task_id", state.alias("state"), *[F.coalesce(f"progress.c.{c}", F.lit(0)).alias(c) for c in COUNTERS], "last_seq")
    return out.select("task_id", "state", *COUNTERS, sum(F.col(c) for c in COUNTERS).alias("processed"), "last_seq")


def recent(events: DataFrame) -> DataFrame:
    """The last events of each task: task_id, seq, event, published."""
    order = Window.partitionBy("task_id").orderBy(F.desc("seq"))
    return events.withColumn("n", F.row_number().over(order)).where(F.col("n") <= KEPT).select("task_id", "seq", "event", (F.col("n") <= PUBLISHED).alias("published"))


def durations(events: DataFrame) -> DataFrame:
    """task_id, seq, elapsed and remaining (seconds) at every event of the log.

    ``events``: task_id, seq, at (seconds as double), event, total.  Elapsed is the time since the
    task's first event without its pauses (paused to the next event); remaining is what is left of
    the total times the mean of the last six unit durations, of twelve kept, else elapsed by units done.
    """
    w = Window.partitionBy("task_id").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.coalesce(F.col("at") - F.lag("at").over(w), F.lit(0.0))
    was_paused = F.coalesce(F.lag("event").over(w) == "paused", F.lit(False))
    e = events.withColumns({"gap": gap, "pause": F.when(was_paused, gap).otherwise(0.0), "unit": F.col("event") == "progress"})
    e = e.withColumns({"paused": F.sum("pause").over(upto), "done": F.sum(F.when(F.col("unit"), 1).otherwise(0)).over(upto), "elapsed": F.col("at") - F.first("at").over(upto)})
    e = e.withColumn("elapsed", F.round(F.col("elapsed") - F.col("paused"), 2))
    since = F.when(F.col("unit"), F.col("at") - F.last(F.when(F.col("unit"), F.col("at")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    units = e.withColumn("took", since)
    recent = Window.partitionBy("task_id", "unit").orderBy("seq").rowsBetween(1 - RECENT_UNITS, 0)
    mean = F.when(F.col("unit"), F.avg(F.when(F.col("took") > 0, F.col("took"))).over(recent))
    units = units.withColumn("__mean", mean).withColumn("mean", F.last("__mean", ignorenulls=True).over(upto)).drop("__mean")
    left = F.greatest(F.lit(0), F.col("total") - F.col("done"))
    rate = F.coalesce("mean", F.when(F.col("done") > 0, F.col("elapsed") / F.col("done")))
    return units.select("task_id", "seq", "elapsed", F.when(left == 0, 0.0).otherwise(F.round(rate * left, 2)).alias("remaining"))


class _Task:
    """What the stream holds of a task once its events can't be preceded any more: the same as ``fold``, ``durations`` and ``recent`` have of them."""

    FIELDS = (
        "seq long, first_at double, last_at double, last_event string, paused double, done long, total long, unit_at double, took array<double>, "
        "cancelled boolean, ended string, state string, completed long, failed long, skipped long"
    )

    def __init__(self, row: tuple | None = None):
        names = [f.split()[0] for f in self.FIELDS.split(", ")]
        self.__dict__.update(zip(names, row or (-1, None, None, None, 0.0, 0, 0, None, [], False, None, None, 0, 0, 0), strict=True))
        self.took = [None if t is None or t != t else t for t in self.took]

    def row(self) -> tuple:
        return tuple(self.__dict__[f.split()[0]] for f in self.FIELDS.split(", "))

    def add(self, seq: int, at: float, event: str, counters: tuple[int, int, int], total: int) -> None:
        if self.first_at is None:
            self.first_at = at
        elif self.last_event == "paused":
            self.paused += at - self.last_at
        self.seq, self.last_at, self.last_event, self.total = seq, at, event, total
        if event == "progress":
            self.took = [*self.took, None if self.unit_at is None else at - self.unit_at][-UNITS:]
            self.unit_at, self.done = at, self.done + 1
        over = self.cancelled or self.ended is not None
        if event == "cancelled":
            self.cancelled = True
        elif event in FINAL and self.ended is None:
            self.ended = event
        elif over:
            pass
        elif event == "progress":
            self.completed, self.failed, self.skipped = counters
            self.state = self.state if self.state == "paused" else "running"
        elif event in ("created", "running", "paused"):
            self.state = "queued" if event == "created" else event

    @property
    def finished(self) -> bool:
        return self.cancelled or self.ended is not None

    def told(self) -> dict:
        state = "cancelled" if self.cancelled and self.ended != "completed" else self.ended or self.state or "running"
        elapsed = round(self.last_at - self.first_at - self.paused, 2)
        took = [t for t in self.took[-RECENT_UNITS:] if t is not None and t > 0]
        left = max(0, self.total - self.done)
        rate = sum(took) / len(took) if took else elapsed / self.done if self.done else None
        counters = {c: getattr(self, c) for c in COUNTERS}
        return {"state": state, **counters, "processed": sum(counters.values()), "last_seq": self.seq, "elapsed": elapsed, "remaining": 0.0 if left == 0 else None if rate is None else round(rate * left, 2)}


class _Fold(StatefulProcessor):
    """Events wait in a list until the watermark has passed them, then they are folded in order and forgotten.

    So state holds the events of the stated lateness, the last ``KEPT`` of the task
    and one row; a finished task's state goes once the watermark has passed its end by ``keep`` seconds.
    """

    def __init__(self, keep: float):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", _Task.FIELDS)
        self.waiting = handle.getListState("waiting", "seq long, at double, event string, completed long, failed long, skipped long, total long")
        self.recent = handle.getListState("recent", "seq long, event string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        task, waiting, recent, watermark = self._held(timerValues)
        known = {w[0] for w in waiting}
        for frame in rows:
            at = frame["at"].astype("int64") / 1e9 if frame["at"].dtype == "datetime64[ns]" else frame["at"].astype("datetime64[ns]").astype("int64") / 1e9
            for seq, when, event, *numbers in zip(frame["seq"].tolist(), at.tolist(), frame["event"], *(frame[c].fillna(0).astype("int64").tolist() for c in (*COUNTERS, "total")), strict=True):
                if when > watermark and seq > task.seq and seq not in known:
                    known.add(seq)
                    waiting.append((seq, when, event, *numbers))
        waiting.sort()
        view = _Task(task.row())
        view.took = list(task.took)
        for seq, when, event, *numbers in waiting:
            view.add(seq, when, event, tuple(numbers[:3]), numbers[3])
        shown = [*recent, *((w[0], w[2]) for w in waiting)][-PUBLISHED:]
        self._settle(task, waiting, recent, watermark)
        if view.seq >= 0:
            yield pd.DataFrame([{"task_id": key[0], **view.told(), "recent": [{"seq": s, "event": e} for s, e in shown]}])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._settle(*self._held(timerValues))
        return iter([])

    def _held(self, timers):
        task = _Task(self.folded.get() if self.folded.exists() else None)
        waiting = [tuple(w) for w in self.waiting.get()] if self.waiting.exists() else []
        recent = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
        return task, waiting, recent, timers.getCurrentWatermarkInMs() / 1e3

    def _settle(self, task: _Task, waiting: list[tuple], recent: list[tuple], watermark: float) -> None:
        passed = [w for w in waiting if w[1] <= watermark]
        for seq, when, event, *numbers in passed:
            task.add(seq, when, event, tuple(numbers[:3]), numbers[3])
        left = waiting[len(passed) :]
        if not left and task.finished and watermark >= task.last_at + self.keep:
            for state in (self.folded, self.waiting, self.recent):
                state.clear()
            return
        if passed:
            self.folded.update(task.row())
            self.recent.put([*recent, *((w[0], w[2]) for w in passed)][-KEPT:])
        if left:
            self.waiting.put(left)
        elif waiting:
            self.waiting.clear()
        due = left[-1][1] if left else task.last_at + self.keep if task.finished else None
        if due is not None:
            self.handle.registerTimer(int(due * 1e3) + 1)

    def close(self) -> None:
        pass


STATE = "task_id long, state string, completed long, failed long, skipped long, processed long, last_seq long, elapsed double, remaining double, recent array<struct<seq:bigint,event:string>>"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def fold_stream(events: DataFrame, lateness: str = "10 minutes", keep: float = 600.0) -> DataFrame:
    """The same from a stream whose events may come in any order, and more than once, within ``lateness`` of the latest ``at``.

    A task's row comes again whenever it changes (update mode): its state and counters as ``fold`` has them, elapsed and remaining
    time as the last row of ``durations``, and its published events as ``recent``.  Events that come later than the lateness are dropped.
    Needs the RocksDB state store, which is set for the session.
    """
    spark = events.sparkSession
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    columns = ("task_id", "seq", "at", "event", *COUNTERS, "total")
    keyed = events.select(*columns).withWatermark("at", lateness).groupBy("task_id")
    return keyed.transformWithStateInPandas(_Fold(keep), outputStructType=STATE, outputMode="Update", timeMode="EventTime")


def deliver(rows: DataFrame, epoch: int, folder: str) -> None:
    """Write an epoch's rows into its own folder; an epoch that runs again replaces what it wrote.

    For ``foreachBatch``: a batch that is retried after a crash gives its rows once.
    """
    rows.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")


def delivered(spark, folder: str, schema: str) -> DataFrame:
    """Rows of all epochs with the column epoch. ``schema``: without it."""
    return spark.read.schema(f"{schema}, epoch long").parquet(folder)
