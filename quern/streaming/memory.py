"""Streams into the memory: replicated records and activation."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.replica import KEYS, merge
from quern.session import move_pointer, read_pointer

TARGET = "source string, ident_no bigint, page_no int, text string, us bigint"


def read_target(spark: SparkSession, root: str) -> DataFrame:
    """The merged store that the pointer file names; empty before the first batch."""
    version = read_pointer(spark, f"{root}/CURRENT")
    return spark.read.schema(TARGET).parquet(f"{root}/{version}") if version else spark.createDataFrame([], TARGET)


def upsert_stream(records: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Apply a stream of records (source, ident_no, page_no, text, us) to the store in `root`, the last writer winning.

    Each micro-batch writes a new version and then moves the pointer, so readers never see half a batch, and a batch that is delivered
    again changes nothing. Old versions are left to the caller.
    """

    def apply(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy(*KEYS).agg(F.max(F.struct("us", "text", "page_no")).alias("top")).select(*KEYS, "top.page_no", "top.text", "top.us")
        version = uuid.uuid4().hex
        merge(newest, read_target(spark, root)).write.parquet(f"{root}/{version}")
        move_pointer(spark, f"{root}/CURRENT", version)

    return records.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def activation_stream(accesses: DataFrame, rate: float, reward: float = 0.1) -> DataFrame:
    """(memory_id, at_us, activation) after each access (memory_id, at_us): decay since the last one, then the reward, 1 at most."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        value, last = state.get if state.exists else (0.0, None)
        out = []
        for at in sorted(t for frame in frames for t in frame["at_us"]):
            passed = max(0, at - last) / 1e6 if last is not None else 0.0
            value = min(1.0, value * math.exp(-rate * passed) + reward)
            last = at if last is None else max(at, last)
            out.append((key[0], at, value))
        state.update((value, last))
        yield pd.DataFrame(out, columns=["memory_id", "at_us", "activation"])

    return accesses.groupBy("memory_id").applyInPandasWithState(step, "memory_id string, at_us bigint, activation double", "value double, last bigint", "append", "NoTimeout")


def distinct_stream(records: DataFrame, time_col: str, keys: list[str], delay: str = "1 day") -> DataFrame:
    """A stream in which a record delivered again within the delay is left out."""
    return records.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)
