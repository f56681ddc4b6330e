"""Helpers for operators that work on Arrow batches in Python workers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq

#: Schemes that Spark's file systems and Arrow's name differently (fixed values).
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def by_length(batches: Iterator[pa.RecordBatch], column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice have at most `most` bytes together (a longer single text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            limit = (ends[at - 1] if at else 0) + most
            to = max(at + 1, int(np.searchsorted(ends, limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def shared_tables(path: str) -> Iterator[pa.Table]:
    """The Parquet files of a folder that the engine wrote, one after the other in the order of their names; none if there is no such folder.

    Works in tasks: local and mounted paths, hdfs, s3 (also as s3a), gs and abfs are opened by Arrow itself.
    """
    scheme = urlparse(path).scheme
    if not scheme:
        path = f"file://{path}"
    elif scheme in SCHEMES:
        path = SCHEMES[scheme] + path[len(scheme) :]
    files, base = pyarrow.fs.FileSystem.from_uri(path)
    found = files.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True))
    for name in sorted(f.path for f in found if f.path.endswith(".parquet")):
        with files.open_input_file(name) as file:
            yield pq.read_table(file, partitioning=None)


def give_back() -> None:
    """Return freed memory to the system: Python workers live on after a task, and what they keep is missing to the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
