"""A data source of messages in files of captured frames, for batches and for streams, a partition for each file."""

from __future__ import annotations

import os
import time
from urllib.parse import urlparse

import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quern.functions.arrow import SCHEMES
from quern.functions.frames import Decoder

#: Seconds that a file must have been left alone before a stream reads it.
SETTLED = 2.0


def _files(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    scheme = urlparse(path).scheme
    if not scheme:
        path = f"file://{os.path.abspath(path)}"
    elif scheme in SCHEMES:
        path = SCHEMES[scheme] + path[len(scheme) :]
    return pyarrow.fs.FileSystem.from_uri(path)


class _File(InputPartition):
    def __init__(self, root: str, path: str):
        self.root, self.path = root, path


def _messages(part: _File):
    decoder, number, name = Decoder(), 0, os.path.basename(part.path)
    files, _ = _files(part.root)
    with files.open_input_stream(part.path) as f:
        while data := f.read(1 << 20):
            for payload in decoder.feed(data):
                number += 1
                yield name, number, payload
    if decoder.rest:
        raise ValueError(f"{name} ends within a frame")


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        files, base = _files(self.path)
        info = files.get_file_info(base)
        found = files.get_file_info(pyarrow.fs.FileSelector(base)) if info.type == pyarrow.fs.FileType.Directory else [info]
        return [_File(self.path, f.path) for f in sorted(found, key=lambda f: f.path) if f.type == pyarrow.fs.FileType.File]

    def read(self, partition):
        yield from _messages(partition)


class _StreamReader(DataSourceStreamReader):
    """The offset is the time and name of the last file; files are read by executors, in the order of time, then name.

    A file counts from `settled` seconds after its last change on, so that a file that comes later can't get a place before one that
    was read; its name doesn't matter.
    """

    def __init__(self, path: str, settled: float):
        self.path, self.settled = path, settled

    def _listed(self) -> list[tuple[int, str]]:
        files, base = _files(self.path)
        until = time.time_ns() - int(self.settled * 1e9)
        found = files.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True))
        return sorted((f.mtime_ns, f.path) for f in found if f.type == pyarrow.fs.FileType.File and f.mtime_ns <= until)

    def initialOffset(self):
        return {"at": 0, "path": ""}

    def latestOffset(self):
        listed = self._listed()
        return dict(zip(("at", "path"), listed[-1])) if listed else self.initialOffset()

    def partitions(self, start, end):
        low, high = (start["at"], start["path"]), (end["at"], end["path"])
        return [_File(self.path, path) for at, path in self._listed() if low < (at, path) <= high]

    def read(self, partition):
        yield from _messages(partition)

    def commit(self, end):
        pass


class FrameSource(DataSource):
    """spark.dataSource.register(FrameSource), then format("frames") with a path; for streams also `settled`, in seconds."""

    @classmethod
    def name(cls):
        return "frames"

    def schema(self):
        return "conn_id string, msg_no bigint, payload string"

    def reader(self, schema):
        return _Reader(self.options["path"])

    def streamReader(self, schema):
        return _StreamReader(self.options["path"], float(self.options.get("settled", SETTLED)))
