"""One row for each key of a table in which rows are repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from quern.session import cut_lineage

#: Repeated keys that are broadcast at most (16 bytes each); beyond that all rows are grouped by a shuffle.
REPEATED = 1_000_000


def row_hash(rows: DataFrame, columns: list[str]) -> Column:
    """A hash of whole rows that tells nulls from values."""
    value = lambda c: F.map_entries(c) if isinstance(rows.schema[c].dataType, MapType) else F.col(c)
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), value(c))])


def grouped_each(rows: DataFrame, key: str) -> DataFrame:
    """The row with the greatest hash for each key, by a shuffle; the result is partitioned by the key."""
    others = [c for c in rows.columns if c != key]
    top = F.max_by(F.struct(*others), row_hash(rows, others))
    return rows.groupBy(key).agg(top.alias("top")).select(key, *[f"top.{c}" for c in others])


def one_each(rows: DataFrame, key: str, repeated: int = REPEATED) -> DataFrame:
    """One row for each key; null keys are left out. Of rows that differ, the one with the greatest hash stands as a whole.

    Only keys are shuffled to tell which are repeated; if those are few, which is counted first, rows of all other keys stay where
    they are, whatever their size. So rows that are mostly distinct cost no shuffle of their contents.
    """
    rows = rows.filter(F.col(key).isNotNull())
    again = cut_lineage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key))
    if again.count() > repeated:
        return grouped_each(rows, key)
    known = F.broadcast(again)
    return rows.join(known, key, "left_anti").select(*rows.columns).unionByName(grouped_each(rows.join(known, key, "left_semi").select(*rows.columns), key))
