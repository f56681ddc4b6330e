"""How often every distinct term occurs, and in how many records.

Texts are never shuffled: ids alone tell which records were delivered more than once, and only those few rows are brought together.
Every record gives its terms in order, the first of equal ones marked, so one hash aggregation, combined on the map side, sums
occurrences and records before the only shuffle, which is as large as the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import TOKEN_PATTERN
from quern.operators.records import REPEATED, one_each


def text_terms(text: Column) -> Column:
    """All terms of a text in order, not yet lower-cased (lower-casing first would turn some other letters into ASCII)."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def distinct_records(records: DataFrame, id_col: str = "chunk_id", text_col: str = "text", vector_col: str | None = "vector", repeated: int = REPEATED) -> DataFrame:
    """One row (rec_id, text, keys) per record id; without a vector column just (rec_id, text).

    Repeated deliveries are equal; should copies differ, one of them stands for the record as a whole. Rows without an id name no
    record and are left out.
    """
    keys = [F.map_keys(F.col(vector_col)).alias("keys")] if vector_col else []
    return one_each(records.select(F.col(id_col).alias("rec_id"), F.col(text_col).alias("text"), *keys), "rec_id", repeated)


def term_statistics(
    records: DataFrame,
    id_col: str = "chunk_id",
    text_col: str = "text",
    vector_col: str = "vector",
    rare_at_most: int = 2,
    common_above: float = 0.25,
) -> DataFrame:
    """(field, term, occurrences, n_docs, mark) for every term of the texts and every key of the vectors.

    A vector key occurs once in each record that holds it and is taken exactly as stored. mark is 'rare' for a term in at most
    `rare_at_most` records, else 'common' for one in more than `common_above` of the records whose field is not null, else null.
    Null and empty fields add no term, an empty table gives no rows, repeated rows count once, other columns are ignored.
    """
    base = distinct_records(records, id_col, text_col, vector_col)
    # in order, so that equal terms of a record stand together and the first of them counts the record
    ordered = base.select(F.sort_array(F.transform(text_terms(F.col("text")), F.lower)).alias("words"), "keys")
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))))
    marked = F.zip_with("words", before, lambda w, b: F.struct(w.alias("term"), (~w.eqNullSafe(b)).alias("first")))
    once = F.transform("keys", lambda k: F.struct(k.alias("term"), F.lit(True).alias("first")))
    listed = ordered.select(marked.alias("words"), once.alias("keys")).select(F.expr("stack(2, 'text', words, 'vector', keys) as (field, terms)"))
    totals = listed.select("field", F.inline("terms")).filter(F.col("term").isNotNull()).groupBy("field", "term").agg(F.count(F.lit(1)).alias("occurrences"), F.count_if("first").alias("n_docs"))
    sizes = base.agg(F.count("text").alias("t"), F.count("keys").alias("v")).select(F.expr("stack(2, 'text', t, 'vector', v) as (field, n_records)"))
    return totals.join(F.broadcast(sizes), "field").select(
        "field",
        "term",
        "occurrences",
        "n_docs",
        F.when(F.col("n_docs") <= rare_at_most, "rare").when(F.col("n_docs") > common_above * F.col("n_records"), "common").alias("mark"),
    )
