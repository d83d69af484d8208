"""The fold of task logs: by hand, in batch, and as a stream of shuffled and repeated micro-batches."""

import datetime
import random

from pyspark.sql import functions as F

from corpusloom.streaming import tasks as T

SCHEMA = "task_id long, seq long, at timestamp, event string, completed long, failed long, skipped long, total long"
KINDS = ["created", "running", "paused", "progress", "progress", "progress", "progress", "completed", "failed", "cancelled"]
BEGIN = datetime.datetime(2024, 1, 1)


def row(task, seq, event, counters=(0, 0, 0), total=5, at=None):
    return (task, seq, BEGIN + datetime.timedelta(seconds=10 * seq if at is None else at), event, *counters, total)


def states(df):
    return {r.task_id: (r.state, r.completed, r.failed, r.skipped, r.processed) for r in df.collect()}


def test_fold_by_hand(spark):
    log = [
        row(1, 1, "created"), row(1, 2, "progress", (1, 0, 0)), row(1, 3, "failed"), row(1, 4, "cancelled"),
        row(2, 1, "progress", (1, 0, 0)), row(2, 2, "completed"), row(2, 3, "progress", (2, 0, 0)), row(2, 4, "cancelled"),
        row(3, 1, "created"),
        row(4, 1, "created"), row(4, 2, "progress", (1, 0, 0)), row(4, 3, "cancelled"), row(4, 4, "progress", (2, 1, 1)),
        row(5, 1, "created"), row(5, 2, "running"), row(5, 3, "progress", (1, 0, 2)), row(5, 4, "paused"), row(5, 5, "progress", (1, 1, 2)),
        row(6, 1, "created"), row(6, 2, "paused"), row(6, 3, "running"), row(6, 4, "progress", (3, 0, 0)),
    ]
    got = states(T.fold(spark.createDataFrame(log, SCHEMA)))
    assert got == {1: ("cancelled", 1, 0, 0, 1), 2: ("completed", 1, 0, 0, 1), 3: ("queued", 0, 0, 0, 0), 4: ("cancelled", 1, 0, 0, 1), 5: ("paused", 1, 1, 2, 4), 6: ("running", 3, 0, 0, 3)}


def random_log(seed, tasks=10, length=30):
    r = random.Random(seed)
    out = []
    for t in range(tasks):
        done, at = [0, 0, 0], 0
        for s in range(length):
            at += r.randrange(0, 40)
            done[r.randrange(3)] += 1
            out.append(row(t, s, r.choice(KINDS) if r.random() < 0.25 else "progress", tuple(done), length, at))
    return out


def streamed(spark, path, batches, **options):
    """Last row of every task, and how often a row came."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/log/{i:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/log")
    last = {}
    sink = T.fold_stream(stream, **options).writeStream.outputMode("update").option("checkpointLocation", f"{path}/state")
    sink.foreachBatch(lambda df, epoch: last.update({x.task_id: x for x in df.collect()})).trigger(availableNow=True).start().awaitTermination()
    return last


def test_stream_equals_batch_in_any_order(spark, tmp_path):
    log = random_log(3)
    frame = spark.createDataFrame(log, SCHEMA)
    mixed = log * 2  # every event twice
    random.Random(4).shuffle(mixed)
    last = streamed(spark, str(tmp_path), [mixed[i::4] for i in range(4)], lateness="100 days", keep=1e9)
    columns = ["task_id", "state", *T.COUNTERS, "processed", "last_seq"]
    assert {tuple(x[c] for c in columns) for x in last.values()} == {tuple(x) for x in T.fold(frame).select(*columns).collect()}
    timed = T.durations(frame.withColumn("at", F.unix_micros("at") / 1e6)).groupBy("task_id").agg(F.max_by(F.struct("elapsed", "remaining"), "seq").alias("x")).collect()
    assert {(x.task_id, x.elapsed, x.remaining) for x in last.values()} == {(r.task_id, r.x.elapsed, r.x.remaining) for r in timed}
    shown = T.recent(frame).where("published").groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("seq", "event"))).alias("x")).collect()
    assert {x.task_id: [tuple(e) for e in x.recent] for x in last.values()} == {r.task_id: [tuple(e) for e in r.x] for r in shown}


def test_stream_in_order_forgets_what_the_watermark_passed(spark, tmp_path):
    """A log that comes by time, each batch shuffled: most events are folded and forgotten while it runs; repeats of them are dropped."""
    log = sorted(random_log(5, tasks=4, length=60), key=lambda x: x[2])
    size = len(log) // 4
    batches = [log[i * size : (i + 1) * size] + (log[(i - 1) * size : i * size : 3] if i else []) for i in range(4)]
    for b in batches:
        random.Random(6).shuffle(b)
    last = streamed(spark, str(tmp_path), batches, lateness="1 second", keep=1e9)
    columns = ["task_id", "state", *T.COUNTERS, "processed", "last_seq"]
    frame = spark.createDataFrame([x for b in batches for x in b], SCHEMA).dropDuplicates(["task_id", "seq"])
    assert {tuple(x[c] for c in columns) for x in last.values()} == {tuple(x) for x in T.fold(frame).select(*columns).collect()}


def test_held_events_are_those_of_the_lateness():
    """The fold of passed events is one row, whatever their number."""
    task = T._Task()
    for i in range(5000):
        task.add(i, float(i), "progress", (i, 0, 0), 10_000)
    assert len(str(task.row())) < 400 and len(task.took) == T.UNITS
    assert task.told()["processed"] == 4999 and T._Task(task.row()).told() == task.told()


def test_an_epoch_that_runs_again_gives_its_rows_once(spark, tmp_path):
    folder = str(tmp_path / "out")
    for epoch, times in ((0, 1), (1, 3)):
        for _ in range(times):
            T.deliver(spark.createDataFrame([(epoch * 10 + i,) for i in range(3)], "n long"), epoch, folder)
    assert sorted((r.epoch, r.n) for r in T.delivered(spark, folder, "n long").collect()) == [(0, 0), (0, 1), (0, 2), (1, 10), (1, 11), (1, 12)]
