"""How characteristic a term is of a record: graph-of-words weights times rarity in the collection.

Each record becomes an undirected graph whose nodes are its terms, with an edge between terms that stand within `window`
positions; the number of distinct neighbours replaces the term frequency. The graphs are built from Arrow batches with whole-array
operations, one numpy sort for all edges of a batch, so no pair is ever shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.arrow import by_length
from quern.functions.text import TOKEN_PATTERN
from quern.llm.terms import distinct_records, text_terms

GRAPH_SCHEMA = "rec_id bigint, term string, tf bigint, degree bigint"


def word_graph(ids: list[int], texts: list[str], window: int) -> tuple[list, list, np.ndarray, np.ndarray]:
    """Rows (record, term, tf, degree) of the graphs of some records."""
    found = [re.findall(TOKEN_PATTERN, t.translate(_LOWER)) for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = [w for words in found for w in words]
    if not flat:
        return [], [], np.empty(0, np.int64), np.empty(0, np.int64)
    codes, vocabulary = pd.factorize(np.array(flat, dtype=object))
    codes = codes.astype(np.int64)
    width, rec = np.int64(len(vocabulary)), np.repeat(np.arange(len(found), dtype=np.int64), sizes)
    node = rec * width + codes
    nodes, tf = np.unique(node, return_counts=True)
    place = np.searchsorted(nodes, node)
    edges = []
    for step in range(1, window):
        a, b = place[:-step], place[step:]
        near = (rec[:-step] == rec[step:]) & (a != b)
        a, b = a[near], b[near]
        edges.append(np.minimum(a, b) * len(nodes) + np.maximum(a, b))
    edge = np.unique(np.concatenate(edges)) if edges else np.empty(0, np.int64)
    degree = np.bincount(edge // len(nodes), minlength=len(nodes)) + np.bincount(edge % len(nodes), minlength=len(nodes))
    who = np.asarray(ids, dtype=np.int64)[nodes // width]
    return who, vocabulary[nodes % width], tf, degree


_LOWER = {a: a + 32 for a in range(65, 91)}


def _graphs(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_length(batches, "text"):
            ids, texts = batch.column("rec_id").to_pylist(), batch.column("text").to_pylist()
            who, terms, tf, degree = word_graph(ids, texts, window)
            yield pa.RecordBatch.from_arrays(
                [pa.array(who, pa.int64()), pa.array(terms, pa.string()), pa.array(tf, pa.int64()), pa.array(degree, pa.int64())], names=["rec_id", "term", "tf", "degree"]
            )

    return run


def text_distinctiveness(records: DataFrame, id_col: str = "chunk_id", text_col: str = "text", window: int = 4, min_tf: int = 1, max_df: int | None = None, hot_share: int = 256) -> DataFrame:
    """(rec_id, term, tf, degree, df, score) for every term of every record's text; score = degree * ln((n + 1) / df).

    n is the number of records with a text, df the number of records that hold the term. `min_tf` and `max_df` keep only terms
    with at least that many occurrences in the record, in at most that many records. Terms in more than 1/`hot_share` of all records
    are few (at most hot_share times the mean number of terms of a record), so they are broadcast and never gather in one
    task; the others are joined by a shuffle. Null, empty and punctuation-only texts give no rows, a text of one distinct term
    gives degree 0 and score 0; repeated rows count once, an empty table gives no rows, other columns are ignored.
    """
    base = distinct_records(records, id_col, text_col, None).filter(F.col("text").isNotNull())
    graph = base.mapInArrow(_graphs(window), GRAPH_SCHEMA).filter(F.col("tf") >= min_tf)
    df = base.select(F.explode(F.array_distinct(F.transform(text_terms(F.col("text")), F.lower))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = base.count()
    score = F.col("degree") * F.log((F.lit(float(n)) + 1) / F.col("df"))
    hot_from = max(n // hot_share, 16, max_df or 0) + 1
    hot = F.broadcast(df.filter(F.col("df") >= hot_from))
    if max_df is not None:
        joined = graph.join(hot.select("term"), "term", "left_anti").join(df.filter(F.col("df") <= max_df), "term")
    else:
        # rows of hot terms get keys that match nothing and spread evenly over the tasks of the second join
        marked = graph.join(hot.withColumnRenamed("df", "hot_df"), "term", "left")
        spread = F.concat(F.lit("\u0001"), F.pmod(F.xxhash64("rec_id"), F.lit(4096)).cast("string"))
        keyed = marked.withColumn("key", F.when(F.col("hot_df").isNull(), F.col("term")).otherwise(spread))
        rest = df.filter(F.col("df") < hot_from).select(F.col("term").alias("key"), "df")
        joined = keyed.join(rest, "key", "left").select("rec_id", "term", "tf", "degree", F.coalesce("hot_df", "df").alias("df"))
    return joined.select("rec_id", "term", "tf", "degree", "df", score.alias("score"))


def vector_distinctiveness(records: DataFrame, id_col: str = "chunk_id", vector_col: str = "vector") -> DataFrame:
    """(rec_id, term, weight, df, score) for every key of every record's vector; score = weight * ln((n + 1) / df).

    A vector has no order, hence no windows: the stored weight stands in place of the degree. Null weights and null or empty
    vectors give no rows; should copies of a record differ, the greatest list of entries stands for it.
    """
    entries = (
        records.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
        .groupBy(F.col(id_col).alias("rec_id"))
        .agg(F.max(F.map_entries(vector_col)).alias("entries"))
    )
    n = records.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).agg(F.count_distinct(id_col).alias("n")).first()["n"]
    rows = entries.select("rec_id", F.inline("entries").alias("term", "weight"))
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    hot = F.broadcast(df.filter(F.col("df") > max(n // 256, 16)).withColumnRenamed("df", "hot_df"))
    rest = df.filter(F.col("df") <= max(n // 256, 16)).withColumnRenamed("term", "key")
    spread = F.concat(F.lit("\u0001"), F.pmod(F.xxhash64("rec_id"), F.lit(4096)).cast("string"))
    keyed = rows.join(hot, "term", "left").withColumn("key", F.when(F.col("hot_df").isNull(), F.col("term")).otherwise(spread))
    joined = keyed.join(rest, "key", "left").filter(F.col("weight").isNotNull())
    every = F.coalesce("hot_df", "df")
    return joined.select("rec_id", "term", "weight", every.alias("df"), (F.col("weight") * F.log((F.lit(float(n)) + 1) / every)).alias("score"))
