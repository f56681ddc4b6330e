"""Instants written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(text: Column) -> Column:
    """An ISO 8601 text as microseconds since 1970; a time without an offset means UTC, unreadable texts give null."""
    bare = text.rlike(r"[T ]\d\d:\d\d(:\d\d(\.\d+)?)?$")
    return F.unix_micros(F.when(bare, F.concat(text, F.lit("Z"))).otherwise(text).try_cast("timestamp"))
