"""Session settings, table access and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "quern", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the engine's settings; `conf` wins over them, an existing session is reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder.

    Timestamps without zone mean UTC; they are read as instants whatever the session was started with.
    """
    spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of the scratch scopes that are open, the innermost last.
_SCOPES: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a temporary one for a local session, else an error.

    A machine's own temporary folder would lose what the executors of other machines write.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.environ.get("QUERN_LOCAL_SHARED") or tempfile.mkdtemp(prefix="quern-")
        os.environ["QUERN_LOCAL_SHARED"] = named
    return named


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has yet, within the innermost open scratch scope."""
    return f"{_SCOPES[-1] if _SCOPES else f'{shared_dir(spark)}/quern'}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back, so that later plans neither recompute it nor lose it with an executor.

    A written table rather than checkpoint(): it is columnar, compressed and prunable.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A scope whose written tables are deleted at its end: use it around a query and the action that consumes its result."""
    path = f"{shared_dir(spark)}/quern/{uuid.uuid4().hex}"
    _SCOPES.append(path)
    try:
        yield path
    finally:
        _SCOPES.remove(path)
        _delete(spark, path)


def _delete(spark: SparkSession, name: str) -> None:
    path, files = _path(spark, name)
    files.delete(path, True)


def clean_shared(spark: SparkSession) -> None:
    """Delete all tables that cut_lineage and the index wrote; DataFrames that read them can't be used afterwards."""
    _delete(spark, f"{shared_dir(spark)}/quern")


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def read_pointer(spark: SparkSession, name: str) -> str | None:
    """The word in a small file, None if there is no such file."""
    path, files = _path(spark, name)
    return spark.read.text(name).first()["value"] if files.exists(path) else None


def move_pointer(spark: SparkSession, name: str, value: str) -> None:
    """Write a word to a small file by writing another and renaming it."""
    path, files = _path(spark, name)
    new, _ = _path(spark, f"{name}.{uuid.uuid4().hex}")
    out = files.create(new, True)
    out.write(bytearray(value.encode()))
    out.close()
    files.delete(path, False)
    if not files.rename(new, path):
        raise OSError(f"{name} can't be written")
