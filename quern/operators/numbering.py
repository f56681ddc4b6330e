"""Numbering all rows of a table in order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import cut_lineage

_ROW_BITS = (1 << 33) - 1


def numbered_rows(rows: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """rows with a column `name`: whole numbers from `start` on, without gaps, in the order of `order`.

    Rows are split into ranges of the order, which are sorted and written once; ranges' counts, one small row for each task, then
    give every range its offset. So a key that many rows share is spread over tasks as long as `order` as a whole tells rows
    apart; rows that it doesn't tell apart get numbers in no defined order. An empty table gives no rows.
    """
    row = F.monotonically_increasing_id()  # the task in the high bits, the place in it in the low ones
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = cut_lineage(sorted_rows.withColumn("__task", F.shiftright(row, 33).cast("int")).withColumn("__row", row.bitwiseAND(F.lit(_ROW_BITS))))
    total, offsets = start, []
    for r in marked.groupBy("__task").agg(F.count(F.lit(1)).alias("n")).orderBy("__task").collect():  # a row for each task
        offsets.append((r["__task"], total))
        total += r["n"]
    offset = rows.sparkSession.createDataFrame(offsets, "__task int, __offset bigint")
    joined = marked.join(F.broadcast(offset), "__task")
    return joined.withColumn(name, (F.col("__offset") + F.col("__row")).cast("bigint")).drop("__task", "__row", "__offset")
