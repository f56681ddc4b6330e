"""Exact vector search and the two-stage memory search, for whole tables of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.arrow import shared_tables
from quern.functions.score import DAY_S, Weights, memory_score, recency
from quern.operators import model as tfidf
from quern.session import cut_lineage, new_folder

#: Rows of query vectors (some 50 bytes each) that are broadcast at most, and parts that documents are split into beyond.
FEW, PARTS = 200_000, 8
#: For `nearest`: queries in a file, entries of documents multiplied at once, entries of queries and hits that a task holds at most, and
#: hits from which one of SHARE documents is searched first to tell what score k documents reach.
BLOCK, AT_ONCE, HELD, SAMPLED, SHARE = 2048, 2_000_000, 4_000_000, 200_000, 16


def similarities(query_vectors: DataFrame, doc_vectors: DataFrame, few: int = FEW, parts: int = PARTS) -> DataFrame:
    """(qid, doc_id, score): the cosine of every query and document that share a term.

    An inverted index as a plan: vectors are made unit vectors before they meet, so the sums by pair, combined before they are shuffled,
    are the scores and no pair is joined again. Queries are vectors (qid, term, weight). Up to `few` of their rows, which are counted,
    are sent to the documents, so that no term gathers anywhere; more of them are joined by a shuffle, each repeated for `parts` parts of
    the documents, so that a term that stands in most documents is joined in as many tasks.
    """
    asked = cut_lineage(tfidf.units(query_vectors.withColumnRenamed("qid", "doc_id")).select(F.col("doc_id").alias("qid"), "term", F.col("weight").alias("wq")))
    docs = tfidf.units(doc_vectors)
    if asked.count() <= few:
        met = docs.join(F.broadcast(asked), "term")
    else:
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        met = asked.join(docs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")), ["term", "part"])
    scores = met.groupBy("qid", "doc_id").agg(F.sum(F.col("wq") * F.col("weight")).alias("score"))
    # rounding may push the cosine of equal vectors just over 1
    return scores.select("qid", "doc_id", F.least(F.lit(1.0), "score").alias("score"))


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of entries of each row, terms, weights) of the lists v."""
    v = batch.column("v")
    flat = v.flatten()
    return pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64), flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)


def _scorer(path: str, k: int | None, held: bool, kept: bool, at_once: int):
    """The function of a task of `nearest`: its documents, `at_once` entries at a time, against all blocks of queries."""

    def blocks() -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for table in shared_tables(path):
            for batch in table.combine_chunks().to_batches():
                sizes, terms, weights = _rows(batch)
                yield batch.column("qid"), batch.column("least").to_numpy(zero_copy_only=False).copy(), np.concatenate(([0], np.cumsum(sizes))), terms, weights

    def best(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if k is None or len(ids) <= k:
            return ids, scores
        value = np.round(scores, 9)
        enough = value >= np.partition(value, len(value) - k)[len(value) - k]
        ids, scores, value = ids[enough], scores[enough], value[enough]
        first = np.lexsort((ids, -value))[:k]
        return ids[first], scores[first]

    def batch_of(qids: pa.Array, found: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        numbers = np.repeat(np.fromiter(found, np.int64, len(found)), [len(i) for i, _ in found.values()])
        ids, scores = (np.concatenate(x) for x in zip(*found.values()))
        return pa.RecordBatch.from_arrays([qids.take(pa.array(numbers)), pa.array(ids), pa.array(scores)], names=["qid", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None
        hits: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}

        def search(some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal asked
            batch = pa.Table.from_batches(some).combine_chunks().to_batches()[0]
            ids, sizes_terms = batch.column("doc_id").to_numpy(zero_copy_only=False), _rows(batch)
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            ids = ids[order]
            row = np.repeat(np.arange(len(ids)), sizes_terms[0])
            weight = sizes_terms[2] / batch.column("length").to_numpy(zero_copy_only=False)[row]
            by_term = np.argsort(sizes_terms[1], kind="stable")
            terms, starts = np.unique(sizes_terms[1][by_term], return_index=True)
            rows, weight, ends = place[row][by_term], weight[by_term], np.append(starts[1:], len(by_term))
            if held and asked is None:
                asked = list(blocks())
            for n, (qids, least, bounds, q_terms, q_weights) in enumerate(asked if held else blocks()):
                at = np.minimum(np.searchsorted(terms, q_terms), len(terms) - 1)
                met = terms[at] == q_terms
                first, last = np.where(met, starts[at], 0), np.where(met, ends[at], 0)
                found = hits.setdefault(n, {}) if kept else {}
                size = 0
                for j in range(len(qids)):
                    parts = [(x, y, w) for x, y, w in zip(first[bounds[j] : bounds[j + 1]].tolist(), last[bounds[j] : bounds[j + 1]].tolist(), q_weights[bounds[j] : bounds[j + 1]].tolist()) if y > x]
                    if not parts:
                        continue
                    touched = np.concatenate([rows[x:y] for x, y, _ in parts])
                    score = np.bincount(touched, np.concatenate([weight[x:y] * w for x, y, w in parts]), len(ids))
                    good = np.flatnonzero(score >= least[j])
                    if least[j] <= 0:  # documents without a common term aren't meant
                        good = good[np.bincount(touched, minlength=len(ids))[good] > 0]
                    if not len(good):
                        continue
                    new = best(ids[good], score[good])
                    if kept:
                        if j in found:
                            new = best(np.concatenate((found[j][0], new[0])), np.concatenate((found[j][1], new[1])))
                        if len(new[0]) == k:  # equal scores of smaller ids still count
                            least[j] = max(least[j], np.round(new[1], 9).min() - 1e-9)
                    found[j] = new
                    size += len(new[0])
                    if not kept and size > 500_000:
                        yield batch_of(qids, found)
                        found, size = {}, 0
                if found and not kept:
                    yield batch_of(qids, found)

        some, entries = [], 0
        for batch in batches:
            if batch.num_rows:
                some.append(batch)
                entries += len(batch.column("v").flatten())
            if entries >= at_once:
                yield from search(some)
                some, entries = [], 0
        if some:
            yield from search(some)
        for n, (qids, *_) in enumerate(asked or ()):
            if hits.get(n):
                yield batch_of(qids, hits[n])

    return run


def nearest(query_vectors: DataFrame, doc_vectors: DataFrame, k: int | None, min_score: float, few: int = FEW, sampled: int = SAMPLED, share: int = SHARE, held: int = HELD, at_once: int = AT_ONCE) -> DataFrame:
    """(qid, doc_id, score): the cosines of at least min_score of queries and documents that share a term; with a k the k best of each
    query, ties by the smaller id, are among the rows, which are all of them without one.

    The pairs are never shuffled: the queries' unit vectors are written once to the shared folder, and each task multiplies its
    documents with all of them and keeps the k best for each query. Where these are many, one of `share` documents is searched
    first: the k-th best score there is one that k documents reach, so tasks keep nothing below it. Documents (doc_id bigint) are gathered by
    doc_id, without a shuffle where they are partitioned by it. Terms of the queries are broadcast if they are at most `few`.
    """
    spark = doc_vectors.sparkSession
    asked = cut_lineage(tfidf.units(query_vectors.withColumnRenamed("qid", "doc_id")).select(F.col("doc_id").alias("qid"), "term", "weight"))
    terms = cut_lineage(asked.select("term").distinct().withColumn("number", F.monotonically_increasing_id()))
    known = F.broadcast(terms) if terms.count() <= few else terms.hint("merge")
    grouped = asked.join(known, "term").groupBy("qid").agg(F.collect_list(F.struct("number", "weight")).alias("v"))
    total = F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length")
    entry = F.when(F.col("number").isNotNull(), F.struct("number", "weight"))
    docs = doc_vectors.filter(F.col("doc_id").isNotNull()).join(known, "term", "left").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(total, F.collect_list(entry).alias("v")).filter((F.col("length") > 0) & (F.size("v") > 0))
    n_entries = asked.count()

    cores = spark.sparkContext.defaultParallelism

    def scan(queries: DataFrame, rows: DataFrame, tasks: int) -> DataFrame:
        # every task goes through all queries, so there are few large ones; parts of the documents follow each other in a task
        path = new_folder(spark)
        queries.select("qid", F.col("least").cast("double").alias("least"), "v").write.option("maxRecordsPerFile", BLOCK).parquet(path)
        hold = n_entries <= held
        return rows.coalesce(tasks).mapInArrow(_scorer(path, k, hold, hold and k is not None and n_queries * k <= held, at_once), f"qid {asked.schema['qid'].dataType.simpleString()}, doc_id bigint, score double")

    n_queries = asked.select("qid").distinct().count()
    queries = grouped.withColumn("least", F.lit(float(min_score)))
    if k is not None and n_queries * k > sampled:
        some = top_k(scan(queries, docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0), cores), k)
        reached = some.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), (F.min(F.round("score", 9)) - 1e-9).alias("reached")).filter(F.col("n") == k)
        queries = grouped.join(reached, "qid", "left").select("qid", "v", F.greatest(F.lit(float(min_score)), "reached").alias("least"))
    # rounding may push the cosine of equal vectors just over 1
    return scan(queries, docs, 4 * cores).select("qid", "doc_id", F.least(F.lit(1.0), "score").alias("score"))


def top_k(scored: DataFrame, k: int, by: Column | None = None, part: str = "qid", tie: str = "doc_id") -> DataFrame:
    """The k best rows of each part with their rank; ties go to the smaller id. Limits are applied before the shuffle."""
    if k < 1:
        raise ValueError("k must be at least 1")
    order = Window.partitionBy(part).orderBy((by if by is not None else F.round("score", 9)).desc(), tie)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def vector_search(query_vectors: DataFrame, doc_vectors: DataFrame, k: int = 5, min_score: float = 0.05) -> DataFrame:
    """(qid, doc_id, score, rank) of the k most similar documents of at least min_score.

    With min_score 0 or less, documents that share no term count too, with score 0: only the smallest ids among them can be
    hits, so each query is joined with a few documents at most and never with all. Without queries or documents there are no rows,
    whatever k; otherwise k must be at least 1.
    """
    if k < 1 and (query_vectors.isEmpty() or doc_vectors.isEmpty()):
        return query_vectors.sparkSession.createDataFrame([], f"qid {query_vectors.schema['qid'].dataType.simpleString()}, doc_id bigint, score double, rank int")
    if k < 1:
        raise ValueError("k must be at least 1")
    best = top_k(nearest(query_vectors, doc_vectors, k, min_score), k)
    if min_score > 0:
        return best
    few = [r["doc_id"] for r in doc_vectors.select("doc_id").distinct().orderBy("doc_id").limit(2 * k).collect()]  # at most 2 * k ids
    zero = query_vectors.select("qid").distinct().select("qid", F.explode(F.array(*map(F.lit, few)).cast("array<bigint>")).alias("doc_id"))
    shared = nearest(query_vectors, doc_vectors.filter(F.col("doc_id").isin(few)), None, float("-inf"))
    zero = zero.join(shared.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(best.drop("rank").unionByName(zero), k)


def memory_search(
    hits: DataFrame,
    records: DataFrame,
    as_of: Column,
    k: int = 5,
    weights: Weights | None = None,
    since: Column | None = None,
    since_mode: str = "post",
    scored: bool = True,
    half_life_s: float = 30 * DAY_S,
    parts: dict[str, Column] | None = None,
) -> DataFrame:
    """(qid, chunk_id, page_no, score, raw_score, recency, parts, rank): hits ranked again by the memory score, or as they are.

    hits (qid, doc_id, score) are all candidates of at least the least score; the first stage keeps 3 * k of each query by
    similarity. since keeps records created then or later: 'post' filters those candidates, so fewer than k may stay; 'pre'
    filters the records first. Records without a creation time have recency 0 and no place under since. Activation is the recency,
    importance 0.5 and graph 0 unless `parts` gives columns of records.
    """
    if since_mode not in ("post", "pre"):
        raise ValueError("since_mode is 'post' or 'pre'")
    meta = records.withColumnRenamed("chunk_id", "doc_id")
    if since is not None and since_mode == "pre":
        hits = hits.join(meta.filter(F.col("created_at") >= since).select("doc_id"), "doc_id", "left_semi")
    stage1 = top_k(hits, 3 * k).drop("rank").join(meta, "doc_id", "left")
    if since is not None and since_mode == "post":
        stage1 = stage1.filter(F.col("created_at") >= since)
    if scored:
        fresh = recency(F.col("created_at"), as_of, half_life_s)
        values = {"semantic": F.col("raw_score"), "recency": F.col("recency"), "activation": F.col("recency"), "importance": F.lit(0.5), **(parts or {})}
        total, struct = memory_score(values, weights)
        rows = stage1.withColumnRenamed("score", "raw_score").withColumn("recency", fresh).withColumn("score", total).withColumn("parts", struct)
    else:
        rows = stage1.withColumn("raw_score", F.col("score")).withColumn("recency", F.lit(0.0)).withColumn("parts", F.lit(None))
    ranked = top_k(rows, k)
    return ranked.select("qid", F.col("doc_id").alias("chunk_id"), "page_no", "score", "raw_score", "recency", "parts", "rank")


def _matrix(batch: pa.RecordBatch | pa.Table, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of the rows with `width` numbers (the first row's number if None) that have a direction."""
    pairs = [(i, v) for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist()) if v and None not in v and (width is None or len(v) == width)]
    if not pairs:
        return np.empty(0, np.int64), np.empty((0, width or 0))
    width = width or len(pairs[0][1])
    pairs = [(i, v) for i, v in pairs if len(v) == width]
    ids, m = np.array([i for i, _ in pairs], np.int64), np.array([v for _, v in pairs])
    size = np.sqrt((m * m).sum(1))
    good = np.isfinite(size) & (size > 0)
    return ids[good], m[good] / size[good][:, None]


def dense_top_k(queries: DataFrame, rows: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 2048, held: int = 16, at_once: int = 20_000) -> DataFrame:
    """(qid, doc_id, score, rank): exact cosine over dense arrays of one length.

    The queries are written once to the shared folder in blocks. A task multiplies `at_once` of its rows with one block after the other
    and keeps the k best for each query, so only those are shuffled; it keeps up to `held` blocks, so that queries that fit are read
    and made into a matrix once for each task, and more of them once for each `at_once` rows. Rows of another length, with
    nulls or without direction don't match; a row isn't its own neighbour.
    """
    spark = rows.sparkSession
    path = new_folder(spark)
    unit = lambda df: df.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    unit(queries).write.option("maxRecordsPerFile", block).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}

        def asked(width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if kept and len(kept) <= held and all(w == width for w, _, _ in kept.values()):
                yield from ((ids, m) for _, ids, m in kept.values())
                return
            kept.clear()
            for n, table in enumerate(shared_tables(path)):
                ids, m = _matrix(table, width)
                if n <= held:  # one too many shows that they don't fit
                    kept[n] = (width, ids, m)
                yield ids, m

        def best(some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m = _matrix(pa.Table.from_batches(some))
            for q_ids, q in asked(m.shape[1]) if len(ids) else ():
                if not len(q_ids):
                    continue
                score = np.minimum(q @ m.T, 1.0)
                score[q_ids[:, None] == ids[None, :]] = -np.inf
                keep = min(k, len(ids))
                # by score, then by id: ids in order and a stable sort
                order = np.argsort(ids, kind="stable")
                first = order[np.argsort(-np.round(score[:, order], 9), axis=1, kind="stable")[:, :keep]]
                value = np.take_along_axis(score, first, 1)
                ok = np.isfinite(value)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, keep)[ok.ravel()]), pa.array(ids[first][ok]), pa.array(value[ok])], names=["qid", "doc_id", "score"])

        some, size = [], 0
        for batch in batches:
            some.append(batch)
            size += batch.num_rows
            if size >= at_once:
                yield from best(some)
                some, size = [], 0
        if size:
            yield from best(some)

    return top_k(unit(rows).mapInArrow(run, "qid bigint, doc_id bigint, score double"), k)
