"""The memory as one object: ingest pages, keep records and model in a folder, search."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.score import DAY_S, Weights
from quern.functions.text import check_window, tokens
from quern.operators import model as tfidf
from quern.operators import search, store
from quern.session import cut_lineage, move_pointer, read_pointer


class Backend(Protocol):
    """What turns texts into vectors. A fitted model is anything that the same backend saved, loaded and can encode with."""

    def fit(self, texts: DataFrame) -> object:
        """A model of texts (key, text)."""

    def save(self, model: object, path: str) -> None: ...

    def load(self, spark: SparkSession, path: str) -> object: ...

    def encode(self, rows: DataFrame, model: object) -> DataFrame:
        """rows (key, text, ...) without key and with the vector of each, empty or null where there is none."""

    def asked(self, queries: DataFrame, model: object) -> DataFrame:
        """(qid, term, weight) of queries (qid, query)."""


class TfidfBackend:
    """Share of a text's tokens times idf; `tokenizer` may be a segmenter."""

    def __init__(self, tokenizer: Callable[[Column], Column] = tokens):
        self.tokenizer = tokenizer

    @staticmethod
    def vectors(rows: DataFrame, model: tfidf.Model, tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
        long = tfidf.weights(tfidf.token_counts(rows.select("key", "text"), "key", tokenizer=tokenizer), model)
        vectors = long.groupBy(F.col("doc_id").alias("key")).agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("vector"))
        return rows.join(vectors, "key", "left").drop("key")

    def fit(self, texts: DataFrame) -> tfidf.Model:
        return tfidf.fit(texts, "key", model_id=uuid.uuid4().hex, tokenizer=self.tokenizer)

    def save(self, model: tfidf.Model, path: str) -> None:
        model.save(path)

    def load(self, spark: SparkSession, path: str) -> tfidf.Model:
        return tfidf.Model.load(spark, path)

    def encode(self, rows: DataFrame, model: tfidf.Model) -> DataFrame:
        return self.vectors(rows, model, self.tokenizer)

    def asked(self, queries: DataFrame, model: tfidf.Model) -> DataFrame:
        return tfidf.weights(tfidf.token_counts(queries, "qid", "query", self.tokenizer), model).withColumnRenamed("doc_id", "qid")


class DenseBackend:
    """Vectors of a function from texts to lists of numbers, called with batches of texts; nothing is fitted. Dimensions become terms."""

    def __init__(self, function: Callable[[list[str]], list[list[float]]]):
        @F.pandas_udf("map<string,double>")
        def run(texts: pd.Series) -> pd.Series:
            given = texts.fillna("")
            vectors = iter(function([t for t in given if t]))
            return pd.Series([{str(i): float(x) for i, x in enumerate(next(vectors))} if t else {} for t in given], dtype=object)

        self.run = run

    def fit(self, texts: DataFrame) -> None:
        return None

    def save(self, model: None, path: str) -> None:
        return None

    def load(self, spark: SparkSession, path: str) -> None:
        return None

    def encode(self, rows: DataFrame, model: None) -> DataFrame:
        return rows.withColumn("vector", self.run("text")).drop("key")

    def asked(self, queries: DataFrame, model: None) -> DataFrame:
        return queries.select("qid", F.explode(self.run("query")).alias("term", "weight"))


class Memory:
    """Records and model under `root`. Each ingest writes a new version of the records and then moves the pointer to it.

    The backend's model is fitted on the first chunks and then frozen, so that all stored vectors stay comparable; `refit` makes a new
    one and encodes all records again.
    """

    def __init__(self, spark: SparkSession, root: str, size: int = 512, overlap: int = 64, half_life_days: float = 30, backend: Backend | None = None):
        check_window(size, overlap)
        self.spark, self.root, self.size, self.overlap, self.half_life_s = spark, root, size, overlap, half_life_days * DAY_S
        self.backend = backend or TfidfBackend()

    def records(self) -> DataFrame:
        version = read_pointer(self.spark, f"{self.root}/CURRENT")
        if version is None:
            raise FileNotFoundError(f"no records in {self.root}")
        return store.load(self.spark, f"{self.root}/{version}")

    def model(self) -> object:
        version = read_pointer(self.spark, f"{self.root}/MODEL")
        if version is None:
            raise FileNotFoundError(f"no model in {self.root}")
        return self.backend.load(self.spark, f"{self.root}/{version}")

    def _write(self, records: DataFrame) -> None:
        version = uuid.uuid4().hex
        store.save(records, f"{self.root}/{version}")
        move_pointer(self.spark, f"{self.root}/CURRENT", version)

    def _fitted(self, texts: DataFrame) -> object:
        version = uuid.uuid4().hex
        self.backend.save(self.backend.fit(texts), f"{self.root}/{version}")
        move_pointer(self.spark, f"{self.root}/MODEL", version)
        return self.model()

    def ingest(self, pages: DataFrame, force: bool = False, created_at: datetime | None = None) -> DataFrame:
        """(source, pages, chunks_added, skipped) for each source of pages (source, page_no, text).

        Sources already there are skipped, or replaced with force. Rows without a source are left out.
        """
        pages = pages.filter(F.col("source").isNotNull())
        try:
            old = self.records()
        except FileNotFoundError:
            old = store.empty(self.spark)
        known = old.select("source").distinct().withColumn("known", F.lit(True))
        chunks = cut_lineage(store.new_chunks(old, pages, self.size, self.overlap, force))
        at = F.lit((created_at or datetime.now(UTC)).astimezone(UTC).isoformat()).cast("timestamp")

        def encode(rows: DataFrame) -> DataFrame:
            keyed = cut_lineage(rows.withColumn("key", F.concat_ws("\u001f", "source", "chunk_seq")))
            try:
                model = self.model()
            except FileNotFoundError:
                model = self._fitted(keyed)
            return self.backend.encode(keyed, model)

        seen = pages.groupBy("source").agg(F.count(F.lit(1)).alias("pages")).join(known, "source", "left")
        added = chunks.groupBy("source").agg(F.count(F.lit(1)).alias("added"))
        skipped = F.coalesce("known", F.lit(False)) if not force else F.lit(False)
        result = cut_lineage(seen.join(added, "source", "left").select("source", "pages", F.coalesce("added", F.lit(0)).alias("chunks_added"), skipped.alias("skipped")))
        if not result.filter("not skipped").isEmpty() and (force or not chunks.isEmpty()):
            self._write(store.ingest(old, pages, encode, at, self.size, self.overlap, force))
        return result

    def refit(self) -> None:
        """A new model, fitted on all records, and their vectors by it."""
        old = self.records()
        keyed = cut_lineage(old.drop("vector").withColumn("key", F.col("chunk_id")))
        self._write(self.backend.encode(keyed, self._fitted(keyed)).select(*old.columns))

    def search(self, queries: DataFrame, k: int = 5, min_score: float = 0.05, scored: bool = True, weights: Weights | None = None, since: datetime | None = None, since_mode: str = "post", as_of: datetime | None = None) -> DataFrame:
        """Hits (qid, chunk_id, page_no, score, raw_score, recency, parts, rank, text) of queries (qid, query)."""
        records, model = self.records(), self.model()
        asked = self.backend.asked(queries, model)
        if k < 1 and (asked.isEmpty() or records.isEmpty()):  # nothing asked, or nothing there, comes before a wrong k
            k = 1
        elif k < 1:
            raise ValueError("k must be at least 1")
        moment: Column = F.lit((as_of or datetime.now(UTC)).astimezone(UTC).isoformat()).cast("timestamp")
        limit = F.lit(since.astimezone(UTC).isoformat()).cast("timestamp") if since else None
        docs = tfidf.long_form(records)
        if min_score > 0:
            hits = search.similarities(asked, docs).filter(F.col("score") >= min_score)
        else:
            hits = search.vector_search(asked, docs, 3 * k, min_score).drop("rank")
        found = search.memory_search(hits, records.select("chunk_id", "page_no", "created_at"), moment, k, weights, limit, since_mode, scored, self.half_life_s)
        return found.join(records.select("chunk_id", "text"), "chunk_id")
