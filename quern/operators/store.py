"""The record store: appending, deleting, updating, ingesting and versioned files.

A store is a DataFrame of records; an operation returns the new DataFrame. Files are written to a new path and never over the one
that is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.chunking import chunk_pages
from quern.operators.numbering import numbered_rows

SCHEMA_VERSION = 1
RECORD_SCHEMA = "chunk_id bigint, page_no int, text string, vector map<string,double>, created_at timestamp, source string, source_chunk_id bigint"


def identity() -> Column:
    """The number of a record within its source, the same on all devices."""
    return F.coalesce(F.col("source_chunk_id"), F.col("chunk_id"))


def next_id(store: DataFrame) -> int:
    return (store.agg(F.max("chunk_id").alias("m")).first()["m"] or 0) + 1


def numbered(rows: DataFrame, order: list[str], start: int, by: str = "source") -> DataFrame:
    """chunk_id from `start` on, by source and order. A source of any size is spread over tasks."""
    return numbered_rows(rows, [F.col(by).asc_nulls_first(), *map(F.col, order)], "chunk_id", start)


def append(store: DataFrame, rows: DataFrame, created_at: Column, order: list[str]) -> DataFrame:
    """Local rows (source, page_no, text, vector) with new ids; rows with a null or empty vector are left out."""
    kept = rows.filter(F.size("vector") > 0)
    fresh = numbered(kept, order, next_id(store)).withColumn("created_at", created_at).withColumn("source_chunk_id", F.lit(None).cast("bigint"))
    return store.unionByName(fresh.select(*store.columns))


def append_remote(store: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of another device: new local ids, but their own identity number and time."""
    fresh = numbered(rows.withColumn("source_chunk_id", identity()).drop("chunk_id"), ["source_chunk_id"], next_id(store))
    return store.unionByName(fresh.select(*store.columns))


def has_source(store: DataFrame, source: str) -> bool:
    return not store.filter(F.col("source") == source).isEmpty()


def delete_source(store: DataFrame, source: str) -> tuple[DataFrame, int]:
    """The store without a source, and how many rows that were."""
    return store.filter(~F.col("source").eqNullSafe(F.lit(source))), store.filter(F.col("source") == source).count()


def update_record(store: DataFrame, source: str, number: int, text: str, vector: dict[str, float], created_at: Column) -> tuple[DataFrame, bool]:
    """Text, vector and time of the first record (least chunk_id) with an identity; page_no and ids stay."""
    mine = (F.col("source") == source) & (identity() == number)
    least = store.filter(mine).agg(F.min("chunk_id").alias("m")).first()["m"]
    if least is None:
        return store, False
    hit = mine & (F.col("chunk_id") == least)
    new = F.create_map(*[F.lit(x) for kv in vector.items() for x in kv]) if vector else F.create_map().cast("map<string,double>")
    return store.withColumns({"text": F.when(hit, F.lit(text)).otherwise(F.col("text")), "vector": F.when(hit, new).otherwise(F.col("vector")), "created_at": F.when(hit, created_at).otherwise(F.col("created_at"))}), True


def new_chunks(store: DataFrame, pages: DataFrame, size: int = 512, overlap: int = 64, force: bool = False) -> DataFrame:
    """Chunks of pages whose source the store doesn't hold yet; with force, of all pages."""
    if not force:
        known = store.select("source").distinct().withColumnRenamed("source", "known")
        pages = pages.join(known, F.col("source").eqNullSafe(F.col("known")), "left_anti")
    return chunk_pages(pages, size, overlap)


def ingest(store: DataFrame, pages: DataFrame, encode, created_at: Column, size: int = 512, overlap: int = 64, force: bool = False) -> DataFrame:
    """The store with the pages' chunks; `encode` turns rows with a text into rows with a vector as well.

    Sources already there are skipped, or replaced with force. Deleting and adding are one step, also where no chunk comes out.
    """
    chunks = new_chunks(store, pages, size, overlap, force)
    if force:
        gone = pages.select("source").distinct().withColumnRenamed("source", "gone")
        kept = store.join(gone, F.col("source").eqNullSafe(F.col("gone")), "left_anti")
        start = next_id(store)
    else:
        kept, start = store, next_id(store)
    rows = encode(chunks).filter(F.size("vector") > 0)
    fresh = numbered(rows, ["chunk_seq"], start).withColumn("created_at", created_at).withColumn("source_chunk_id", F.col("chunk_seq"))
    return kept.unionByName(fresh.select(*store.columns))


def save(store: DataFrame, path: str) -> None:
    """Parquet with a version beside it."""
    spark = store.sparkSession
    store.write.mode("errorifexists").parquet(f"{path}/records")
    spark.createDataFrame([(SCHEMA_VERSION,)], "schema_version int").write.mode("errorifexists").json(f"{path}/meta")


def load(spark: SparkSession, path: str) -> DataFrame:
    try:
        version = spark.read.schema("schema_version int").json(f"{path}/meta").first()
    except Exception as e:
        raise FileNotFoundError(f"no store in {path}") from e
    if version is None or version["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"schema version {version and version['schema_version']} isn't {SCHEMA_VERSION}")
    return spark.read.schema(RECORD_SCHEMA).parquet(f"{path}/records")


def load_or_empty(spark: SparkSession, path: str) -> DataFrame:
    """The store in a folder, an empty one if there is none yet; another version is still an error."""
    try:
        return load(spark, path)
    except FileNotFoundError:
        return empty(spark)


def export_json(store: DataFrame, path: str) -> None:
    """One JSON object a line, in UTF-8 without escapes."""
    store.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RECORD_SCHEMA)
