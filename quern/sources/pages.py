"""Files as pages: PDF where a parser is installed, plain text with form feeds between pages anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import normalize_text

PAGES = "source string, page_no int, text string, parse_error string"


def _parse(name: str, data: bytes) -> list[tuple[int, str]]:
    if data[:5] == b"%PDF-" or name.lower().endswith(".pdf"):
        try:
            import fitz
        except ImportError as e:
            raise ValueError("no PDF parser is installed") from e
        with fitz.open(stream=data, filetype="pdf") as doc:
            return [(n, page.get_text()) for n, page in enumerate(doc, 1)]
    return list(enumerate(data.decode("utf-8").split("\f"), 1))


def read_pages(spark: SparkSession, path: str, pattern: str = "*", strict: bool = True) -> DataFrame:
    """(source, page_no, text, parse_error) of all files under a path; texts are normalised, empty pages kept.

    A missing path raises FileNotFoundError. A file that can't be read fails the job if strict, else it gives one row
    without a page and with the error.
    """
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    except Exception as e:
        raise FileNotFoundError(path) from e

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, data in frame.itertuples(index=False, name=None):
                source = name.rsplit("/", 1)[-1]
                try:
                    rows += [(source, n, text, None) for n, text in _parse(source, bytes(data))]
                except Exception as e:
                    if strict:
                        raise ValueError(f"{name} can't be read: {e}") from e
                    rows.append((source, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["source", "page_no", "text", "parse_error"]).astype({"page_no": "Int32"})

    pages = files.select("path", "content").mapInPandas(run, PAGES)
    return pages.withColumn("text", normalize_text(F.col("text")))


def is_valid(spark: SparkSession, path: str) -> bool:
    """Whether every page of a file could be read."""
    try:
        return read_pages(spark, path, strict=False).filter(F.col("parse_error").isNotNull()).isEmpty()
    except FileNotFoundError:
        return False
