"""Queue simulations and telemetry over logs of tasks.

What depends on order alone (backlogs, bounded admission) is computed per queue and time bucket first and joined by prefix, so a
queue that holds a large share of the log is spread over tasks; aging with resets is sequential by nature and streams through one
task per queue, which holds what waits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def effective_priority(priority: Column, waited_ms: Column, interval_ms: int, cap: int, boost: Column | None = None) -> Column:
    """priority plus one for each whole interval waited, cap at most; no gain without an interval or before the first."""
    boost = boost if boost is not None else F.lit(0)
    if interval_ms <= 0:
        return priority.cast("bigint")
    gained = F.when(waited_ms < interval_ms, boost).otherwise(boost + F.floor(waited_ms / interval_ms))
    return (priority + F.least(gained, F.lit(cap))).cast("bigint")


def pop_order(entries: DataFrame, priority: Column) -> DataFrame:
    """entries (queue_id, seq, ...) with place, from 1 in each queue: the highest priority first, of equal ones the oldest."""
    order = Window.partitionBy("queue_id").orderBy(priority.desc(), "seq")
    return entries.withColumn("place", F.row_number().over(order).cast("bigint"))


def running_total(rows: DataFrame, part: str, ts: str, tie: str, delta: str, bucket: str = "hour") -> DataFrame:
    """rows with total: the sum of delta up to each row, in the order of ts and tie; buckets of time are summed apart and joined by prefix."""
    marked = rows.withColumn("bucket", F.date_trunc(bucket, ts))
    sums = marked.groupBy(part, "bucket").agg(F.sum(delta).alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.partitionBy(part).orderBy("bucket")) - F.col("s")).drop("s")
    inside = F.sum(delta).over(Window.partitionBy(part, "bucket").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("inside", inside).join(before, [part, "bucket"]).withColumn("total", F.col("inside") + F.col("before")).drop("inside", "before", "bucket")


def backlog_peak(log: DataFrame, part: str = "queue_id") -> DataFrame:
    """(queue_id, peak_pending): the greatest backlog of each queue, 0 at least; log (queue_id, ts, seq, delta) has 1 in and -1 out."""
    return running_total(log, part, "ts", "seq", "delta").groupBy(part).agg(F.greatest(F.max("total"), F.lit(0)).cast("bigint").alias("peak_pending"))


def admission(log: DataFrame, capacity: int, bucket: str = "day") -> DataFrame:
    """log (queue_id, ts, seq, delta) with accepted: whether a push found the queue below its capacity (0: no limit); null for pops.

    A pop of an empty queue does nothing. A step maps a size x to min(hi, max(lo, x + add)), and so does every sequence of steps:
    each bucket of time becomes one such map, the maps are applied in order to give every bucket its starting size, and
    the buckets are then played apart from each other.
    """
    top = capacity if capacity > 0 else 1 << 60
    if capacity < 0:
        raise ValueError("capacity must not be negative")
    rows = log.withColumn("bucket", F.date_trunc(bucket, "ts"))

    def play(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by queue, bucket, ts and seq; the size is carried from batch to batch."""
        key, size = None, 0
        for frame in frames:
            accepted = []
            for queue, at, start, delta in frame[["queue_id", "bucket", "start", "delta"]].itertuples(index=False, name=None):
                if (queue, at) != key:
                    key, size = (queue, at), start
                if delta > 0:
                    accepted.append(size < top)
                    size += size < top
                else:
                    accepted.append(None)
                    size = max(0, size - 1)
            frame["accepted"] = pd.array(accepted, dtype="boolean")
            yield frame.drop(columns=["bucket", "start"])

    def maps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, add, low, high = None, 0, 0, top
        for frame in frames:
            out = []
            for queue, at, delta in frame[["queue_id", "bucket", "delta"]].itertuples(index=False, name=None):
                if (queue, at) != key:
                    if key:
                        out.append((*key, add, low, high))
                    key, add, low, high = (queue, at), 0, 0, top
                step = 1 if delta > 0 else -1
                add, low, high = add + step, min(top, max(0, low + step)), min(top, max(0, high + step))
            yield pd.DataFrame(out, columns=["queue_id", "bucket", "add", "low", "high"])
        if key:
            yield pd.DataFrame([(*key, add, low, high)], columns=["queue_id", "bucket", "add", "low", "high"])

    kind = log.schema["queue_id"].dataType.simpleString()
    ordered = lambda df: df.repartition("queue_id", "bucket").sortWithinPartitions("queue_id", "bucket", "ts", "seq")
    steps = ordered(rows).select("queue_id", "bucket", "delta").mapInPandas(maps, f"queue_id {kind}, bucket timestamp, add bigint, low bigint, high bigint")
    listed = steps.groupBy("queue_id").agg(F.sort_array(F.collect_list(F.struct("bucket", "add", "low", "high"))).alias("maps"))
    first = F.array(F.lit(0).cast("bigint"))
    follow = lambda acc, m: F.concat(acc, F.array(F.least(m["high"], F.greatest(m["low"], F.element_at(acc, -1) + m["add"]))))
    starts = listed.withColumn("sizes", F.aggregate("maps", first, follow)).select("queue_id", F.explode(F.arrays_zip(F.col("maps.bucket").alias("bucket"), F.slice("sizes", 1, F.size("maps")).alias("start"))).alias("x"))
    started = rows.join(starts.select("queue_id", "x.bucket", "x.start"), ["queue_id", "bucket"])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in started.schema if f.name not in ("bucket", "start"))
    return ordered(started).mapInPandas(play, f"{schema}, accepted boolean")


class _Aging:
    """Waiting tasks of one queue: a heap by rank and a heap by the time of the next gain; a task gains at most cap times."""

    def __init__(self, interval: int, cap: int):
        self.interval, self.cap = interval, cap
        self.ranks: list[tuple[int, int]] = []  # (-(priority + gain), seq); out of date where the gain has grown since
        self.timers: list[tuple[int, int]] = []  # (time of the next gain, seq)
        self.tasks: dict[int, tuple[int, int, int, str]] = {}  # seq: (priority, gain, timer started, task)

    def push(self, at: int, seq: int, task: str, priority: int) -> None:
        self.tasks[seq] = (priority, 0, at, task)
        heapq.heappush(self.ranks, (-priority, seq))
        if self.interval > 0 and self.cap > 0:
            heapq.heappush(self.timers, (at + self.interval, seq))

    def pop(self, at: int) -> str | None:
        while self.timers and self.timers[0][0] <= at:
            _, seq = heapq.heappop(self.timers)
            if seq not in self.tasks:
                continue
            priority, gain, since, task = self.tasks[seq]
            gain = min(self.cap, gain + (at - since) // self.interval)
            self.tasks[seq] = (priority, gain, at, task)
            heapq.heappush(self.ranks, (-(priority + gain), seq))
            if gain < self.cap:
                heapq.heappush(self.timers, (at + self.interval, seq))
        while self.ranks:
            rank, seq = heapq.heappop(self.ranks)
            if seq in self.tasks and -rank == self.tasks[seq][0] + self.tasks[seq][1]:
                return self.tasks.pop(seq)[3]
        return None


def drain_with_aging(log: DataFrame, interval_ms: int, cap: int) -> DataFrame:
    """(queue_id, pop_no, task_id): what each pop takes; log (queue_id, at_ms, seq, task_id, priority) has a null task_id for pops.

    At a pop every waiting task gains a level for each whole interval since its timer started, which then starts again; the highest
    of priority and gain, cap at most, goes first, of equal ones the oldest. A pop of an empty queue gives no row. What a pop takes
    depends on all before it, so a queue is one task's; the task holds what waits and needs the logarithm of that for each step.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queue, waiting, popped = None, _Aging(interval_ms, cap), 0
        for frame in frames:
            out = []
            for name, at, seq, task, priority in frame[["queue_id", "at_ms", "seq", "task_id", "priority"]].itertuples(index=False, name=None):
                if name != queue:
                    queue, waiting, popped = name, _Aging(interval_ms, cap), 0
                if task is not None:
                    waiting.push(at, seq, task, int(priority))
                    continue
                best = waiting.pop(at)
                if best is not None:
                    popped += 1
                    out.append((name, popped, best))
            yield pd.DataFrame(out, columns=["queue_id", "pop_no", "task_id"])

    kinds = {f.name: f.dataType.simpleString() for f in log.schema}
    rows = log.select("queue_id", "at_ms", "seq", "task_id", "priority").repartition("queue_id").sortWithinPartitions("queue_id", "at_ms", "seq")
    return rows.mapInPandas(run, f"queue_id {kinds['queue_id']}, pop_no bigint, task_id {kinds['task_id']}")


def steals(log: DataFrame) -> DataFrame:
    """(worker, executed, stolen, lost) of log (worker, home): tasks a worker ran, those of another home among them, and its own that others ran.

    A row without a home was given to the worker that ran it. The totals of a run are the sums over the workers.
    """
    home = F.coalesce("home", "worker")
    ran = log.select("worker", F.lit(1).alias("e"), (home != F.col("worker")).cast("int").alias("s"), F.lit(0).alias("l"))
    given = log.filter(home != F.col("worker")).select(home.alias("worker"), F.lit(0).alias("e"), F.lit(0).alias("s"), F.lit(1).alias("l"))
    return ran.unionByName(given).groupBy("worker").agg(F.sum("e").alias("executed"), F.sum("s").alias("stolen"), F.sum("l").alias("lost"))


def telemetry(log: DataFrame) -> DataFrame:
    """(worker, done, failed, skipped, rejected, total_us, avg_task_ms) of log (worker, outcome, elapsed_us); only Done tasks have a time."""
    count = lambda o: F.count_if(F.col("outcome") == o)
    spent = F.coalesce(F.sum(F.when(F.col("outcome") == "Done", F.col("elapsed_us"))), F.lit(0)).cast("bigint")
    sums = log.groupBy("worker").agg(count("Done").alias("done"), count("Failed").alias("failed"), count("Skipped").alias("skipped"), count("Rejected").alias("rejected"), spent.alias("total_us"))
    mean = F.when(F.col("done") > 0, F.col("total_us") / F.when(F.col("done") > 0, F.col("done")) / 1000.0).otherwise(F.lit(0.0))
    return sums.withColumn("avg_task_ms", mean)


def round_robin(seq: Column, workers: int) -> Column:
    if workers < 1:
        raise ValueError("workers must be at least 1")
    return F.pmod(seq, F.lit(workers)).cast("bigint")
