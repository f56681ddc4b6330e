"""Ground truth by keyword, retrieval metrics and the comparison of rankings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _finder(words: list[str]):
    """A function that gives the words standing in a text, in time that hardly depends on their number."""
    try:
        import ahocorasick
    except ImportError:
        by_length: dict[int, set[str]] = {}
        for w in words:
            by_length.setdefault(len(w), set()).add(w)
        return lambda t: {t[i : i + n] for n, some in by_length.items() for i in range(len(t) - n + 1) if t[i : i + n] in some}
    find = ahocorasick.Automaton()
    for w in words:
        find.add_word(w, w)
    find.make_automaton()
    return lambda t: {w for _, w in find.iter(t)} if words else set()


def truth_sets(questions: DataFrame, records: DataFrame, block: int = 4 << 20) -> DataFrame:
    """(qid, chunk_id) of every record whose text contains the question's keyword.

    Keywords go to the executors as automata of about `block` bytes of distinct keywords each (an automaton takes some 60 times as
    much), and the records are scanned once for each automaton in time that doesn't depend on how many keywords it has. Null and
    empty keywords have no truth; repeated rows count once.
    """
    spark = records.sparkSession
    words = questions.filter(F.length("keyword") > 0).select("keyword").distinct()
    texts = records.filter(F.col("text").isNotNull()).select("chunk_id", "text")
    # parts are cut from the sums of 1024 shares by hash, so a part exceeds the block by one share at most
    share = F.pmod(F.xxhash64("keyword"), F.lit(1024)).cast("int")
    sizes = {r["s"]: r["n"] for r in words.groupBy(share.alias("s")).agg(F.sum(F.octet_length("keyword")).alias("n")).collect()}
    parts, held = [[]], 0
    for s in range(1024):
        if held and held + sizes.get(s, 0) > block:
            parts.append([])
            held = 0
        parts[-1].append(s)
        held += sizes.get(s, 0)

    def scan(mine: list[int]) -> DataFrame:
        some = words if len(parts) == 1 else words.filter(share.between(mine[0], mine[-1]))
        shared = spark.sparkContext.broadcast([r["keyword"] for r in some.collect()])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            look = _finder(shared.value)
            for frame in frames:
                rows = [(c, w) for c, t in frame.itertuples(index=False, name=None) for w in look(t)]
                yield pd.DataFrame(rows, columns=["chunk_id", "keyword"])

        return texts.mapInPandas(run, "chunk_id bigint, keyword string")

    found = scan(parts[0])
    for mine in parts[1:]:
        found = found.unionByName(scan(mine))
    return questions.select("qid", "keyword").join(found, "keyword").select("qid", "chunk_id").distinct()


def metrics(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, recall, precision, mrr, top1) of ranked hits (qid, rank, chunk_id) for each question with a truth; 0 where nothing was hit."""
    marked = hits.select("qid", "rank", "chunk_id").join(truth.withColumn("good", F.lit(True)), ["qid", "chunk_id"], "left")
    good = F.coalesce(F.col("good"), F.lit(False))
    by_hits = marked.groupBy("qid").agg(
        F.count(F.lit(1)).alias("returned"), F.count_if(good).alias("found"), F.min(F.when(good, F.col("rank"))).alias("first"), F.max(F.when(F.col("rank") == 1, good)).alias("top")
    )
    sizes = truth.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0.0)
    joined = sizes.join(by_hits, "qid", "left")
    return joined.select(
        "qid",
        F.coalesce(F.col("found") / F.col("n"), zero).alias("recall"),
        F.coalesce(F.col("found") / F.col("returned"), zero).alias("precision"),
        F.coalesce(1.0 / F.col("first"), zero).alias("mrr"),
        F.coalesce(F.col("top").cast("double"), zero).alias("top1"),
    )


def macro(per_query: DataFrame) -> DataFrame:
    """One row: the mean of each metric over the questions."""
    return per_query.agg(F.count(F.lit(1)).alias("questions"), *[F.avg(c).alias(c) for c in ("recall", "precision", "mrr", "top1")])


def aged(records: DataFrame, old: Column, days: int) -> DataFrame:
    """Records with created_at moved back by some days where `old` holds."""
    moved = F.col("created_at") - F.make_dt_interval(F.lit(days))
    return records.withColumn("created_at", F.when(old, moved).otherwise(F.col("created_at")))


def top_one_new(hits: DataFrame, old_ids: DataFrame) -> DataFrame:
    """One row (questions, new_top1): first hits, and how many of them aren't among the old records."""
    first = hits.filter("rank = 1").join(old_ids.select("chunk_id").distinct().withColumn("old", F.lit(True)), "chunk_id", "left")
    return first.agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("old").isNull()).alias("new_top1"))


def answerable(truth: DataFrame, old_ids: DataFrame) -> DataFrame:
    """(qid) of questions whose truth has old records and new ones."""
    marked = truth.join(old_ids.select("chunk_id").distinct().withColumn("old", F.lit(True)), "chunk_id", "left")
    return marked.groupBy("qid").agg(F.count_if("old").alias("o"), F.count_if(F.col("old").isNull()).alias("n")).filter("o > 0 and n > 0").select("qid")
