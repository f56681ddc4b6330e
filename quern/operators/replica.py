"""Replication of two record stores: what to send, what became of it, and the merged store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["source", "ident_no"]


def latest(records: DataFrame, number: Column, created: Column) -> DataFrame:
    """(source, ident_no, page_no, text, us): the newest row of each identity; rows without one are left out.

    Null times count as oldest; of equal times the greatest text, then page, stands.
    """
    rows = records.select("source", number.alias("ident_no"), "page_no", "text", created.alias("us")).filter(F.col("source").isNotNull() & F.col("ident_no").isNotNull())
    return rows.groupBy(*KEYS).agg(F.max(F.struct("us", "text", "page_no")).alias("top")).select(*KEYS, "top.page_no", "top.text", "top.us")


def _beside(source: DataFrame, target: DataFrame) -> DataFrame:
    other = target.select(*KEYS, F.col("text").alias("t_text"), F.col("us").alias("t_us"), F.lit(True).alias("there"))
    return source.join(other, KEYS, "left")


def outcome() -> Column:
    """Of a source's row beside the target's: added, updated (other text, newer) or skipped; equal times keep the target."""
    newer = (~F.col("text").eqNullSafe(F.col("t_text"))) & F.coalesce(F.col("us") > F.col("t_us"), F.col("us").isNotNull() & F.col("t_us").isNull())
    return F.when(F.col("there").isNull(), "added").when(newer, "updated").otherwise("skipped")


def missing_in(source: DataFrame, target: DataFrame, mode: str = "versioned") -> DataFrame:
    """Rows that the source sends: unknown ones and newer versions, or with 'ids_only' just the unknown ones."""
    if mode not in ("versioned", "ids_only"):
        raise ValueError("mode is 'versioned' or 'ids_only'")
    if mode == "ids_only":
        return source.join(target.select(*KEYS), KEYS, "left_anti")
    return _beside(source, target).withColumn("outcome", outcome()).filter("outcome <> 'skipped'").select(*source.columns, "outcome")


def stats(source: DataFrame, target: DataFrame, direction: str) -> DataFrame:
    """One row (direction, sent, added, updated, skipped)."""
    made = _beside(source, target).select(outcome().alias("o"))
    count = lambda *names: F.count_if(F.col("o").isin(*names))
    return made.agg(count("added", "updated").alias("sent"), count("added").alias("added"), count("updated").alias("updated"), count("skipped").alias("skipped")).select(F.lit(direction).alias("direction"), "*")


def merge(source: DataFrame, target: DataFrame) -> DataFrame:
    """The target after the source was applied: an update takes text and time but keeps the target's page."""
    other = source.select(*KEYS, *[F.col(c).alias(f"s_{c}") for c in ("page_no", "text", "us")], F.lit(True).alias("sent"))
    both = target.withColumn("there", F.lit(True)).join(other, KEYS, "full")
    newer = (~F.col("s_text").eqNullSafe(F.col("text"))) & F.coalesce(F.col("s_us") > F.col("us"), F.col("s_us").isNotNull() & F.col("us").isNull()) & F.col("sent")
    take = F.col("there").isNull() | F.coalesce(newer, F.lit(False))
    pick = lambda c, when: F.when(when, F.col(f"s_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*KEYS, pick("page_no", F.col("there").isNull()), pick("text", take), pick("us", take))


def sync_all(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new a, new b, statistics of both directions): first a to b, then the changed b to a."""
    new_b = merge(a, b)
    new_a = merge(new_b, a)
    return new_a, new_b, stats(a, b, "a_to_b").unionByName(stats(new_b, a, "b_to_a"))
