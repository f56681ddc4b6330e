"""Pages and their overlapping chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import windows


def page_stats(pages: DataFrame) -> DataFrame:
    """(source, page_count, non_empty, total_chars); null texts count as empty."""
    text = F.coalesce("text", F.lit(""))
    return pages.groupBy("source").agg(F.count(F.lit(1)).alias("page_count"), F.count_if(text != "").alias("non_empty"), F.sum(F.length(text)).cast("bigint").alias("total_chars"))


def chunk_pages(pages: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """(source, page_no, chunk_seq, pos, text): windows of every page, numbered from 1 within a source by page and position.

    Windows don't cross pages; empty and null pages give none; equal rows count once, different texts of one page follow each other
    in the order of the texts. Numbers are made per page by a prefix sum over pages' counts, so a source of any size needs
    one small row for each page in one task, never its texts.
    """
    rows = pages.filter(F.length("text") > 0).select("source", "page_no", "text").distinct()
    cut = rows.withColumn("cut", windows(F.col("text"), size, overlap)).withColumn("key", F.md5("text"))
    counts = cut.select("source", "page_no", "key", F.size("cut").alias("n"))
    order = Window.partitionBy("source").orderBy(F.col("page_no").asc_nulls_first(), "key")
    before = counts.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("source").alias("s"), F.col("page_no").alias("p"), F.col("key").alias("k"), F.coalesce("before", F.lit(0)).alias("before"))
    same = F.col("source").eqNullSafe(F.col("s")) & F.col("page_no").eqNullSafe(F.col("p")) & (F.col("key") == F.col("k"))
    return cut.join(before, same).select("source", "page_no", "before", F.posexplode("cut").alias("pos", "text")).select(
        "source", "page_no", (F.col("before") + F.col("pos") + 1).cast("bigint").alias("chunk_seq"), "pos", "text"
    )


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """(source, chunk_count, total_chars), overlaps counted."""
    return chunks.groupBy("source").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum(F.length("text")).cast("bigint").alias("total_chars"))
