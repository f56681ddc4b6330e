"""The TF-IDF model as tables: fitting, weights and norms.

Vectors are kept long, (chunk_id, term, weight): dot products are then joins and sums that the optimizer sees.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import tokens
from quern.operators.numbering import numbered_rows


def token_counts(docs: DataFrame, id_col: str, text_col: str = "text", tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    """(doc_id, term, n, n_tokens): occurrences of each term, and of all terms, in each document; texts without terms give no rows.

    A document is one row: ids must be unique. n_tokens is taken before the terms are spread, so no second pass is needed.
    """
    listed = docs.select(F.col(id_col).alias("doc_id"), tokenizer(F.col(text_col)).alias("terms"))
    spread = listed.select("doc_id", F.size("terms").alias("n_tokens"), F.explode("terms").alias("term"))
    return spread.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"), F.first("n_tokens").cast("bigint").alias("n_tokens"))


@dataclass(frozen=True)
class Model:
    """terms(term, df, idf) and the number of documents it was fitted on."""

    model_id: str
    terms: DataFrame
    n_docs: int

    def with_index(self) -> DataFrame:
        """(term, term_idx, df, idf): terms numbered from 0 in order, without gathering them in one task."""
        return numbered_rows(self.terms, [F.col("term")], "term_idx", 0).select("term", "term_idx", "df", "idf")

    def save(self, path: str) -> None:
        self.terms.select(F.lit(self.model_id).alias("model_id"), "*").write.mode("overwrite").parquet(f"{path}/model_terms")
        row = [(self.model_id, "tfidf", self.n_docs)]
        self.terms.sparkSession.createDataFrame(row, "model_id string, type string, n_docs bigint").write.mode("overwrite").parquet(f"{path}/model_meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        try:
            meta = spark.read.parquet(f"{path}/model_meta").first()
        except Exception as e:
            raise FileNotFoundError(f"no model in {path}") from e
        if meta is None or meta["type"] != "tfidf":
            raise ValueError("not a TF-IDF model")
        return cls(meta["model_id"], spark.read.parquet(f"{path}/model_terms").drop("model_id"), meta["n_docs"])

    def is_fitted(self) -> bool:
        return not self.terms.isEmpty()


def fit(docs: DataFrame, id_col: str, text_col: str = "text", model_id: str = "tfidf", tokenizer: Callable[[Column], Column] = tokens, counts: DataFrame | None = None) -> Model:
    """idf = ln(N / df) + 1 over all documents, empty ones included."""
    n_docs = docs.count()
    if counts is not None:
        df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    else:  # the distinct terms of each document, summed before they are shuffled
        df = docs.select(F.explode(F.array_distinct(tokenizer(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return Model(model_id, df.withColumn("idf", F.log(F.lit(float(n_docs)) / F.col("df")) + 1), n_docs)


def weights(counts: DataFrame, model: Model) -> DataFrame:
    """(doc_id, term, weight): share of the document's tokens times idf; terms the model doesn't know are dropped afterwards."""
    return counts.join(model.terms, "term").select("doc_id", "term", (F.col("n") / F.col("n_tokens") * F.col("idf")).alias("weight"))


def units(vectors: DataFrame) -> DataFrame:
    """(doc_id, term, weight) of vectors of length 1; vectors without length are left out. One shuffle, by document."""
    size = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("doc_id")))
    return vectors.select("doc_id", "term", "weight", size.alias("size")).filter("size > 0").select("doc_id", "term", (F.col("weight") / F.col("size")).alias("weight"))


def norms(vectors: DataFrame) -> DataFrame:
    """(doc_id, norm): the length of each vector."""
    return vectors.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def long_form(records: DataFrame, id_col: str = "chunk_id", vector_col: str = "vector") -> DataFrame:
    """(doc_id, term, weight) of stored maps."""
    return records.select(F.col(id_col).alias("doc_id"), F.explode(vector_col).alias("term", "weight"))
