"""Pages, chunks, the TF-IDF model, search and evaluation over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.score import DAY_S, Weights, decay, half_life, memory_score, rate_of, recency, reinforce
from quern.functions.segment import bigrams, segmenter
from quern.functions.text import is_token, normalize_text
from quern.functions.timestamps import instant
from quern.operators import chunking, evaluate, model, search, store
from quern.operators.records import grouped_each, one_each
from quern.plans.pipeline import TfidfBackend
from quern.session import cut_lineage, new_folder, table

AS_OF = "2026-11-01 00:00:00"
SINCE = "2026-09-01 00:00:00"
HALF_LIFE_D = 30


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def records(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The distinct records of memory_records, one of the equal deliveries for each; `more` columns besides the small ones and the text."""
    rows = table(spark, sf_dir, "memory_records").select("chunk_id", "page_no", "text", "created_at", "source", "source_chunk_id", *more)
    return one_each(rows, "chunk_id")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, text) of the distinct records, partitioned by chunk_id, so that what is counted in a record needs no further shuffle."""
    rows = table(spark, sf_dir, "memory_records").filter(F.col("chunk_id").isNotNull()).select("chunk_id", "text")
    return grouped_each(rows, "chunk_id")


def normalize_lines(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("source", "page_no", normalize_text(F.col("text")).alias("t"))
    return pages.select("source", "page_no", F.length("t").cast("bigint").alias("chars"), F.md5("t").alias("hash"))


def page_stats(spark, sf_dir):
    return chunking.page_stats(table(spark, sf_dir, "pages"))


def chunk_windows(spark, sf_dir):
    chunks = chunking.chunk_pages(table(spark, sf_dir, "pages"), 200, 30)
    return chunks.select("source", "page_no", "chunk_seq", F.col("pos").cast("bigint").alias("pos"), F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("hash"))


def chunk_totals(spark, sf_dir):
    return chunking.chunk_stats(chunking.chunk_pages(table(spark, sf_dir, "pages")))


def token_counts(spark, sf_dir):
    return model.token_counts(_texts(spark, sf_dir), "chunk_id").select("doc_id", "term", "n", "n_tokens")


def _fitted(spark, sf_dir) -> tuple[DataFrame, model.Model]:
    """(token counts, model) of the records' texts; the model's terms are written, as they are joined several times."""
    rows = _texts(spark, sf_dir)
    fitted = model.fit(records(spark, sf_dir).select("chunk_id", "text"), "chunk_id")
    return model.token_counts(rows, "chunk_id"), model.Model(fitted.model_id, cut_lineage(fitted.terms), fitted.n_docs)


def doc_freq(spark, sf_dir):
    return _fitted(spark, sf_dir)[1].terms.select("term", "df")


def idf_table(spark, sf_dir):
    return _fitted(spark, sf_dir)[1].terms.select("term", "df", F.round("idf", 6).alias("idf"))


def vocab_index(spark, sf_dir):
    return _fitted(spark, sf_dir)[1].with_index().select("term", "term_idx")


def tfidf_weights(spark, sf_dir):
    counts, fitted = _fitted(spark, sf_dir)
    return model.weights(counts, fitted).select("doc_id", "term", F.round("weight", 6).alias("weight"))


def vector_norms(spark, sf_dir):
    counts, fitted = _fitted(spark, sf_dir)
    return model.norms(model.weights(counts, fitted)).select("doc_id", F.round("norm", 6).alias("norm"))


def _near(fitted: model.Model) -> model.Model:
    """The model with its terms broadcast where they are few, so that documents' counts stay where they are."""
    return model.Model(fitted.model_id, F.broadcast(fitted.terms), fitted.n_docs) if fitted.terms.count() <= search.FEW else fitted


def _vectors(spark, sf_dir, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(query vectors, document vectors): the model is fitted on the records and used for both; `only` has the chunk_ids of the documents wanted."""
    counts, fitted = _fitted(spark, sf_dir)
    fitted = _near(fitted)
    if only is not None:
        counts = model.token_counts(_texts(spark, sf_dir).join(only, "chunk_id", "left_semi"), "chunk_id")
    asked = model.token_counts(table(spark, sf_dir, "queries"), "qid", "query")
    return model.weights(asked, fitted).withColumnRenamed("doc_id", "qid"), model.weights(counts, fitted)


def _hits(spark, sf_dir, k, min_score=0.05):
    hits = search.vector_search(*_vectors(spark, sf_dir), k=k, min_score=min_score)
    return hits.select("qid", F.col("rank").cast("bigint").alias("rank"), F.col("doc_id").alias("chunk_id"), F.round("score", 6).alias("score"))


def tfidf_topk(spark, sf_dir):
    return _hits(spark, sf_dir, 10)


def tfidf_topk_zero_scores(spark, sf_dir):
    return _hits(spark, sf_dir, 10, 0.0)


def pairwise_similarity(spark, sf_dir):
    """Every hundredth record against all records."""
    counts, fitted = _fitted(spark, sf_dir)
    docs = model.weights(counts, _near(fitted))
    asked = docs.filter(F.pmod("doc_id", F.lit(100)) == 0).withColumnRenamed("doc_id", "qid")
    return search.nearest(asked, docs, None, 0.2).filter("qid <> doc_id").select("qid", F.col("doc_id").alias("chunk_id"), F.round("score", 6).alias("score"))


def dense_topk(spark, sf_dir):
    """Every hundredth vector against all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    hits = search.dense_top_k(rows.filter(F.pmod("vec_id", F.lit(100)) == 0), rows, 10)
    return hits.select("qid", F.col("doc_id").alias("vec_id"), F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


def _searched(spark, sf_dir, **options):
    meta = records(spark, sf_dir).select("chunk_id", "page_no", "created_at")
    only = meta.filter(F.col("created_at") >= options["since"]).select("chunk_id") if options.get("since_mode") == "pre" else None
    hits = search.nearest(*_vectors(spark, sf_dir, only), k=15, min_score=0.05)  # the first stage has 3 * 5 candidates
    found = search.memory_search(hits, meta, _as_of(), k=5, half_life_s=HALF_LIFE_D * DAY_S, **options)
    return found.select("qid", F.col("rank").cast("bigint").alias("rank"), "chunk_id", "page_no", *[F.round(c, 6).alias(c) for c in ("score", "raw_score", "recency")])


def memory_search_default(spark, sf_dir):
    return _searched(spark, sf_dir)


def memory_search_plain(spark, sf_dir):
    return _searched(spark, sf_dir, scored=False)


def memory_search_since_post(spark, sf_dir):
    return _searched(spark, sf_dir, since=F.lit(SINCE).cast("timestamp"))


def memory_search_since_pre(spark, sf_dir):
    return _searched(spark, sf_dir, since=F.lit(SINCE).cast("timestamp"), since_mode="pre")


def memory_search_custom_weights(spark, sf_dir):
    return _searched(spark, sf_dir, weights=Weights(0.2, 0.7, 0.0, 0.1, 0.0))


def recency_of_records(spark, sf_dir):
    rows = records(spark, sf_dir)
    return rows.select("chunk_id", F.round(recency(F.col("created_at"), _as_of(), HALF_LIFE_D * DAY_S), 6).alias("recency"))


def memory_score_components(spark, sf_dir):
    """Logged hits, scored; a stored score is used where it is a number, cut to [0, 1]."""
    hits = table(spark, sf_dir, "retrieval_hits").filter("score is not null and not isnan(score)").select("qid", "rank", "chunk_id", F.greatest(F.least("score", F.lit(1.0)), F.lit(0.0)).alias("semantic")).distinct()
    joined = hits.join(records(spark, sf_dir).select("chunk_id", "created_at"), "chunk_id")
    fresh = recency(F.col("created_at"), _as_of(), HALF_LIFE_D * DAY_S)
    total, parts = memory_score({"semantic": F.col("semantic"), "recency": fresh, "activation": fresh, "importance": F.lit(0.5)})
    rows = joined.select("qid", "rank", "chunk_id", total.alias("score"), parts.alias("p"))
    return rows.select("qid", "rank", "chunk_id", *[F.round(c, 6).alias(n) for c, n in (("score", "score"), ("p.semantic", "semantic"), ("p.recency", "recency"), ("p.graph", "graph"))])


def decay_curve(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    hours = F.unix_micros(F.lit("2024-02-01 00:00:00").cast("timestamp")) / 1e6 - F.unix_micros("ts") / 1e6
    return events.select("event_id", F.round(decay(F.least(F.col("value") / 500, F.lit(1.0)), rate_of(7 * DAY_S), hours), 6).alias("activation"))


def half_lives(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 1000 + 0.001).alias("rate"))
    return rows.select("event_id", F.round(half_life(F.col("rate")), 6).alias("half_life"), F.lit(round(half_life(0.1), 6)).alias("of_tenth"))


def reinforce_counts(spark, sf_dir):
    """Activation of each user after their events, 0.1 for each, and one more access."""
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    after = F.least(F.lit(1.0), F.lit(0.1) * F.col("n"))
    return counts.select("user_id", "n", F.round(after, 6).alias("activation"), F.round(reinforce(after), 6).alias("reinforced"))


def _pages_with_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter(F.col("source").isNotNull())


def _part_of_store(spark, sf_dir):
    """A store without the sources whose names have an even length."""
    return table(spark, sf_dir, "memory_records").filter(F.length("source") % 2 == 1)


def ingest_new_only(spark, sf_dir):
    """Chunks of the pages whose source isn't in the store."""
    return chunking.chunk_stats(store.new_chunks(_part_of_store(spark, sf_dir), _pages_with_text(spark, sf_dir)))


def force_reload(spark, sf_dir):
    """Records by source after all pages were ingested again with force, encoded by the model of the records; chunks without a known term drop out."""
    fitted = _fitted(spark, sf_dir)[1]

    def encode(rows: DataFrame) -> DataFrame:
        keyed = rows.withColumn("key", F.concat_ws("\u001f", "source", F.col("chunk_seq").cast("string")))
        return TfidfBackend.vectors(keyed, fitted)

    new = store.ingest(table(spark, sf_dir, "memory_records"), _pages_with_text(spark, sf_dir), encode, _as_of(), force=True)
    fresh = F.col("created_at") == _as_of()
    return new.groupBy("source").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(fresh).alias("fresh"), F.min("chunk_id").alias("least_id"), F.max("chunk_id").alias("greatest_id"), F.coalesce(F.sum(F.when(fresh, F.size("vector"))), F.lit(0)).cast("bigint").alias("fresh_terms")
    )


def _small_vectors(spark, sf_dir):
    """(source, page_no, text, vector) of pages: lengths as weights, empty vectors for empty texts, none for null ones."""
    length = F.length("text").cast("double")
    vector = F.when(length > 0, F.create_map(F.lit("length"), length)).when(F.col("text").isNotNull(), F.create_map().cast("map<string,double>"))
    return _pages_with_text(spark, sf_dir).distinct().withColumn("vector", vector)


def append_local(spark, sf_dir):
    """The new rows of the store after pages were appended: those with an empty or null vector are left out."""
    memory = table(spark, sf_dir, "memory_records")
    new = store.append(memory, _small_vectors(spark, sf_dir).withColumn("k", F.md5("text")), _as_of(), ["page_no", "k"])
    return new.filter(F.col("chunk_id") >= store.next_id(memory)).select("chunk_id", "source", "page_no", "source_chunk_id", F.md5("text").alias("hash"))


def append_remote(spark, sf_dir):
    """Another device's records get new local ids and keep their own number and time."""
    memory = table(spark, sf_dir, "memory_records")
    remote = table(spark, sf_dir, "replica_b").filter("source is not null and chunk_id is not null").select("source", "chunk_id").distinct()
    rows = remote.select("chunk_id", F.lit(1).alias("page_no"), F.lit("t").alias("text"), F.create_map(F.lit("t"), F.lit(1.0)).alias("vector"), F.lit(AS_OF).cast("timestamp").alias("created_at"), "source", F.lit(None).cast("bigint").alias("source_chunk_id"))
    new = store.append_remote(memory, rows)
    return new.filter(F.col("chunk_id") >= store.next_id(memory)).select("chunk_id", "source", "source_chunk_id")


def source_present(spark, sf_dir):
    """Which of the pages' sources, and of one that no page has, a store without some of them holds."""
    kept = _part_of_store(spark, sf_dir)
    asked = sorted(r["source"] for r in _pages_with_text(spark, sf_dir).select("source").distinct().orderBy("source").limit(5).collect())  # five names
    return spark.createDataFrame([(s, store.has_source(kept, s)) for s in [*asked, "no such source"]], "source string, present boolean")


def store_roundtrip(spark, sf_dir):
    """The store saved to files with a version and loaded again, by source; a folder without a store is an empty one."""
    memory, path = table(spark, sf_dir, "memory_records"), new_folder(spark)
    assert store.load_or_empty(spark, path).isEmpty()
    store.save(memory, path)
    again = store.load_or_empty(spark, path)
    return again.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("text")).cast("bigint").alias("chars"), F.sum(F.when(F.col("vector").isNotNull(), F.size("vector"))).cast("bigint").alias("terms"), F.max(F.unix_micros("created_at")).alias("newest"))


def model_roundtrip(spark, sf_dir):
    """The model saved to files and loaded again."""
    path = new_folder(spark)
    _fitted(spark, sf_dir)[1].save(path)
    again = model.Model.load(spark, path)
    assert again.is_fitted()
    return again.terms.select("term", "df", F.round("idf", 6).alias("idf"), F.lit(again.n_docs).alias("n_docs"))


def token_validity(spark, sf_dir):
    """Words of the questions between blanks, and whether they hold anything that can be a token."""
    words = table(spark, sf_dir, "queries").select(F.explode(F.split("query", " ")).alias("word")).distinct()
    return words.select("word", is_token(F.col("word")).alias("valid"))


def token_bigrams(spark, sf_dir):
    """How often every pair of neighbouring ideographs, and every ASCII word, stands in the records."""
    rows = records(spark, sf_dir).select(F.explode(bigrams(F.col("text"))).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def token_segments(spark, sf_dir):
    """The same with words of a list: the pairs of ideographs that stand in at least a hundredth of the records."""
    rows = records(spark, sf_dir).select("chunk_id", "text")
    pairs = rows.select(F.explode(F.array_distinct(bigrams(F.col("text")))).alias("term")).filter(F.col("term").rlike("^[一-鿿]{2}$")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    listed = [r["term"] for r in pairs.filter(F.col("n") * 100 >= rows.count()).orderBy("term").collect()]  # at most 100 times the pairs of a record
    return rows.select(F.explode(segmenter(listed)(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def delete_by_source(spark, sf_dir):
    left, gone = store.delete_source(table(spark, sf_dir, "memory_records"), "field-handbook.pdf")
    return left.agg(F.count(F.lit(1)).alias("kept"), F.count_distinct("source").alias("sources")).withColumn("deleted", F.lit(gone).cast("bigint"))


def alloc_ids(spark, sf_dir):
    memory = table(spark, sf_dir, "memory_records")
    chunks = chunking.chunk_pages(_pages_with_text(spark, sf_dir))
    return store.numbered(chunks, ["chunk_seq"], store.next_id(memory)).select("source", "chunk_seq", "chunk_id")


def record_identities(spark, sf_dir):
    return records(spark, sf_dir).select("chunk_id", "source", store.identity().alias("ident_no"))


def update_one(spark, sf_dir):
    """Records, changed ones among them and all vectors' entries after one record was given another text and vector."""
    memory = records(spark, sf_dir, "vector")
    new, _ = store.update_record(memory, "field-handbook.pdf", 1, "changed", {"changed": 1.0}, _as_of())
    entries = F.sum(F.when(F.col("vector").isNotNull(), F.size("vector"))).cast("bigint")
    return new.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("text") == "changed").alias("changed"), F.count_if(F.map_contains_key("vector", F.lit("changed"))).alias("with_new_key"), entries.alias("entries"))


def iso_instants(spark, sf_dir):
    return table(spark, sf_dir, "replica_a").select("created_at", instant(F.col("created_at")).alias("us")).distinct()


def truth_sets(spark, sf_dir):
    return evaluate.truth_sets(table(spark, sf_dir, "queries"), records(spark, sf_dir))


def _logged(spark, sf_dir):
    """The hit log with one record for each rank."""
    return table(spark, sf_dir, "retrieval_hits").groupBy("qid", "rank").agg(F.min("chunk_id").alias("chunk_id"))


def ir_metrics(spark, sf_dir):
    found = evaluate.metrics(_logged(spark, sf_dir), truth_sets(spark, sf_dir))
    return found.select("qid", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr", "top1")])


def ir_macro(spark, sf_dir):
    found = evaluate.macro(evaluate.metrics(_logged(spark, sf_dir), truth_sets(spark, sf_dir)))
    return found.select("questions", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr", "top1")])


def _old(spark, sf_dir):
    return records(spark, sf_dir).select("chunk_id").filter(F.pmod("chunk_id", F.lit(2)) == 0)


def ab_topone_new(spark, sf_dir):
    """Scenario B: half of the records made 30 days older; questions whose first hit is a newer one, ranked plainly and by score."""
    hits = cut_lineage(search.nearest(*_vectors(spark, sf_dir), k=3, min_score=0.05))  # the first stage has 3 * 1 candidates
    rows = records(spark, sf_dir).select("chunk_id", "page_no", F.lit(AS_OF).cast("timestamp").alias("created_at"))
    rows = evaluate.aged(rows, F.pmod("chunk_id", F.lit(2)) == 0, 30)
    truth = truth_sets(spark, sf_dir)
    good = evaluate.answerable(truth, _old(spark, sf_dir))
    out = None
    for name, scored in (("plain", False), ("scored", True)):
        found = search.memory_search(hits, rows, _as_of(), k=1, scored=scored).join(good, "qid", "left_semi")
        row = evaluate.top_one_new(found, _old(spark, sf_dir)).select(F.lit(name).alias("ranking"), "questions", "new_top1")
        out = row if out is None else out.unionByName(row)
    return out


def ab_quality(spark, sf_dir):
    """Recall, precision, MRR and first hits of the plain and the scored ranking, k = 5.

    In scenario A all records are new and all questions with a truth count; in B every second record is 30 days old and questions
    count whose truth has old and new records.
    """
    hits = cut_lineage(search.nearest(*_vectors(spark, sf_dir), k=15, min_score=0.05))  # the first stage has 3 * 5 candidates
    new = records(spark, sf_dir).select("chunk_id", "page_no", F.lit(AS_OF).cast("timestamp").alias("created_at"))
    truth = cut_lineage(truth_sets(spark, sf_dir))
    mixed = truth.join(evaluate.answerable(truth, _old(spark, sf_dir)), "qid", "left_semi")
    out = None
    for scenario, rows, right in (("A", new, truth), ("B", evaluate.aged(new, F.pmod("chunk_id", F.lit(2)) == 0, 30), mixed)):
        for ranking, scored in (("plain", False), ("scored", True)):
            found = search.memory_search(hits, rows, _as_of(), k=5, scored=scored)
            one = evaluate.macro(evaluate.metrics(found, right)).select(F.lit(scenario).alias("scenario"), F.lit(ranking).alias("ranking"), "questions", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr", "top1")])
            out = one if out is None else out.unionByName(one)
    return out


def aged_records(spark, sf_dir):
    rows = evaluate.aged(records(spark, sf_dir), F.pmod("chunk_id", F.lit(2)) == 0, 30)
    return rows.select("chunk_id", F.unix_micros("created_at").alias("us"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_lines, page_stats, chunk_windows, chunk_totals, token_counts, doc_freq, idf_table, vocab_index, tfidf_weights, vector_norms, tfidf_topk, tfidf_topk_zero_scores,
        pairwise_similarity, dense_topk, memory_search_default, memory_search_plain, memory_search_since_post, memory_search_since_pre, memory_search_custom_weights, recency_of_records,
        memory_score_components, decay_curve, half_lives, reinforce_counts, ingest_new_only, force_reload, delete_by_source, alloc_ids, record_identities, update_one, iso_instants, truth_sets,
        ir_metrics, ir_macro, ab_topone_new, ab_quality, aged_records, append_local, append_remote, source_present, store_roundtrip, model_roundtrip, token_validity, token_bigrams, token_segments,
    )
}

_R = "r AS (SELECT DISTINCT ON (chunk_id) chunk_id, page_no, text, created_at, source, source_chunk_id, vector FROM memory_records WHERE chunk_id IS NOT NULL)"
_LIST = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9]+|[一-鿿]'), lambda w: lower(w))"
_C = f"""{_R}, l AS (SELECT chunk_id AS doc_id, {_LIST.format("text")} AS ws FROM r),
 c AS (SELECT doc_id, term, count(*) AS n, any_value(k) AS n_tokens FROM (SELECT doc_id, len(ws) AS k, unnest(ws) AS term FROM l) GROUP BY doc_id, term),
 m AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM r) / count(*)) + 1 AS idf FROM c GROUP BY term)"""
_W = _C + f""", w AS (SELECT doc_id, term, n / n_tokens * idf AS weight FROM c JOIN m USING (term)), nd AS (SELECT doc_id, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY doc_id),
 q AS (SELECT qid, term, n / k * idf AS wq FROM (SELECT qid, term, count(*) AS n, any_value(k) AS k FROM (SELECT qid, len(ws) AS k, unnest(ws) AS term FROM (SELECT qid, {_LIST.format("query")} AS ws FROM queries)) GROUP BY ALL) JOIN m USING (term)),
 nq AS (SELECT qid, sqrt(sum(wq * wq)) AS nq FROM q GROUP BY qid),
 s AS (SELECT qid, doc_id, least(1.0, dot / (nq * norm)) AS score FROM (SELECT qid, doc_id, sum(wq * weight) AS dot FROM q JOIN w USING (term) GROUP BY ALL) JOIN nq USING (qid) JOIN nd USING (doc_id)),
 h AS (SELECT * FROM s WHERE score >= 0.05)"""
_TOP = "row_number() OVER (PARTITION BY qid ORDER BY round({0}, 9) DESC, doc_id)"
_AGE = f"greatest(0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 1e6)"
_REC = f"CASE WHEN created_at IS NULL THEN 0.0 ELSE exp(-(ln(2) / ({HALF_LIFE_D} * 86400.0)) * {_AGE}) END"
_CUT = "SELECT source, page_no, text, md5(text) AS k, greatest(CAST(ceil((length(text) - {0}) / {1}.0) AS BIGINT), 0) + 1 AS n FROM (SELECT DISTINCT source, page_no, text FROM pages WHERE length(text) > 0 {2})"
_NUM = "SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY page_no NULLS FIRST, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({0})"


def _chunked(size: int, overlap: int, where: str = "") -> str:
    step = size - overlap
    return f"SELECT source, page_no, CAST(before + i + 1 AS BIGINT) AS chunk_seq, i AS pos, substring(text, i * {step} + 1, {size}) AS t FROM (SELECT *, unnest(range(n)) AS i FROM ({_NUM.format(_CUT.format(size, step, where))}))"


def _memory(score: str, first: str = "", then: str = "", rec: str = _REC) -> str:
    return (
        f"WITH {_W}, a AS (SELECT qid, doc_id, score AS raw_score FROM (SELECT *, {_TOP.format('score')} AS rk FROM h {first}) WHERE rk <= 15),"
        f" b AS (SELECT a.*, r.page_no, {rec} AS recency FROM a JOIN r ON r.chunk_id = a.doc_id {then}), d AS (SELECT *, {score} AS score FROM b)"
        f" SELECT qid, rk AS rank, doc_id AS chunk_id, page_no, round(score, 6) AS score, round(raw_score, 6) AS raw_score, round(recency, 6) AS recency FROM (SELECT *, {_TOP.format('score')} AS rk FROM d) WHERE rk <= 5"
    )


_DEFAULT = "0.5 * raw_score + 0.2 * recency + 0.15 * recency + 0.1 * 0.5"
_TRUTH = f"{_R}, t AS (SELECT DISTINCT qid, chunk_id FROM queries JOIN r ON contains(r.text, keyword) WHERE length(keyword) > 0)"
_IR = f"""{_TRUTH}, hh AS (SELECT qid, rank, min(chunk_id) AS chunk_id FROM retrieval_hits GROUP BY ALL), g AS (SELECT hh.*, t.chunk_id IS NOT NULL AS good FROM hh LEFT JOIN t USING (qid, chunk_id)),
 b AS (SELECT qid, count(*) AS returned, count(*) FILTER (good) AS found, min(rank) FILTER (good) AS first, max(CASE WHEN rank = 1 AND good THEN 1.0 ELSE 0.0 END) AS top FROM g GROUP BY qid),
 z AS (SELECT qid, count(*) AS n FROM t GROUP BY qid),
 ir AS (SELECT qid, coalesce(found / n, 0) AS recall, coalesce(found / returned, 0) AS precision, coalesce(1.0 / first, 0) AS mrr, coalesce(top, 0.0) AS top1 FROM z LEFT JOIN b USING (qid))"""
_STRIP = "[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_LINES = "regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x{b}\\x{c}\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]')"
_US_A = "epoch_us(CAST(CASE WHEN regexp_matches(created_at, '[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?$') THEN created_at || 'Z' ELSE created_at END AS TIMESTAMPTZ))"

SQL = {
    "normalize_lines": f"WITH n AS (SELECT source, page_no, array_to_string(list_filter(list_transform({_LINES}, lambda x: regexp_replace(regexp_replace(x, '^{_STRIP}', ''), '{_STRIP}$', '')), lambda x: x <> ''), ' ') AS t FROM pages) SELECT source, page_no, CAST(length(t) AS BIGINT) AS chars, md5(t) AS hash FROM n",
    "page_stats": "SELECT source, count(*) AS page_count, count(*) FILTER (coalesce(text, '') <> '') AS non_empty, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS total_chars FROM pages GROUP BY source",
    "chunk_windows": f"SELECT source, page_no, chunk_seq, pos, CAST(length(t) AS BIGINT) AS chars, md5(t) AS hash FROM ({_chunked(200, 30)})",
    "chunk_totals": f"SELECT source, count(*) AS chunk_count, CAST(sum(length(t)) AS BIGINT) AS total_chars FROM ({_chunked(512, 64)}) GROUP BY source",
    "token_counts": f"WITH {_C} SELECT doc_id, term, n, CAST(n_tokens AS BIGINT) AS n_tokens FROM c",
    "doc_freq": f"WITH {_C} SELECT term, df FROM m",
    "idf_table": f"WITH {_C} SELECT term, df, round(idf, 6) AS idf FROM m",
    "vocab_index": f"WITH {_C} SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_idx FROM m",
    "tfidf_weights": f"WITH {_W} SELECT doc_id, term, round(weight, 6) AS weight FROM w",
    "vector_norms": f"WITH {_W} SELECT doc_id, round(norm, 6) AS norm FROM nd",
    "tfidf_topk": f"WITH {_W} SELECT qid, rk AS rank, doc_id AS chunk_id, round(score, 6) AS score FROM (SELECT *, {_TOP.format('score')} AS rk FROM h) WHERE rk <= 10",
    "tfidf_topk_zero_scores": f"WITH {_W}, z AS (SELECT qid, doc_id, coalesce(score, 0.0) AS score FROM (SELECT qid, doc_id FROM nq CROSS JOIN nd) LEFT JOIN s USING (qid, doc_id)) SELECT qid, rk AS rank, doc_id AS chunk_id, round(score, 6) AS score FROM (SELECT *, {_TOP.format('score')} AS rk FROM z) WHERE rk <= 10",
    "pairwise_similarity": f"WITH {_W}, p AS (SELECT a.doc_id AS qid, b.doc_id, sum(a.weight * b.weight) AS dot FROM w a JOIN w b USING (term) WHERE a.doc_id % 100 = 0 GROUP BY ALL), o AS (SELECT qid, p.doc_id AS chunk_id, least(1.0, dot / (x.norm * y.norm)) AS score FROM p JOIN nd x ON x.doc_id = qid JOIN nd y ON y.doc_id = p.doc_id) SELECT qid, chunk_id, round(score, 6) AS score FROM o WHERE score >= 0.2 AND qid <> chunk_id",
    "dense_topk": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS qid, e.vec_id, least(1.0, list_cosine_similarity(q.v, e.v)) AS score FROM e q JOIN e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id) SELECT qid, vec_id, rk AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rk FROM s) WHERE rk <= 10",
    "memory_search_default": _memory(_DEFAULT),
    "memory_search_plain": _memory("raw_score", rec="0.0::DOUBLE"),
    "memory_search_since_post": _memory(_DEFAULT, then=f"WHERE r.created_at >= TIMESTAMP '{SINCE}'"),
    "memory_search_since_pre": _memory(_DEFAULT, first=f"WHERE doc_id IN (SELECT chunk_id FROM r WHERE created_at >= TIMESTAMP '{SINCE}')"),
    "memory_search_custom_weights": _memory("0.2 * raw_score + 0.7 * recency + 0.1 * 0.5"),
    "recency_of_records": f"WITH {_R} SELECT chunk_id, round({_REC}, 6) AS recency FROM r",
    "memory_score_components": f"WITH {_R}, x AS (SELECT DISTINCT qid, rank, chunk_id, greatest(least(score, 1.0), 0.0) AS semantic FROM retrieval_hits WHERE score IS NOT NULL AND NOT isnan(score)), y AS (SELECT x.*, {_REC} AS recency FROM x JOIN r USING (chunk_id)) SELECT qid, rank, chunk_id, round(0.5 * semantic + 0.35 * recency + 0.05, 6) AS score, round(semantic, 6) AS semantic, round(recency, 6) AS recency, 0.0::DOUBLE AS graph FROM y",
    "decay_curve": "SELECT event_id, round(least(value / 500, 1.0) * exp(-(ln(2) / (7 * 86400.0)) * ((epoch_us(TIMESTAMP '2024-02-01') / 1e6) - epoch_us(ts) / 1e6)), 6) AS activation FROM events",
    "half_lives": "SELECT event_id, round(ln(2) / (value / 1000 + 0.001), 6) AS half_life, 6.931472::DOUBLE AS of_tenth FROM events",
    "reinforce_counts": "SELECT user_id, count(*) AS n, round(least(1.0, 0.1::DOUBLE * count(*)), 6) AS activation, round(least(1.0, least(1.0, 0.1::DOUBLE * count(*)) + 0.1), 6) AS reinforced FROM events GROUP BY user_id",
    "ingest_new_only": f"SELECT source, count(*) AS chunk_count, CAST(sum(length(t)) AS BIGINT) AS total_chars FROM ({_chunked(512, 64, 'AND source IS NOT NULL AND source NOT IN (SELECT source FROM memory_records WHERE length(source) % 2 = 1)')}) GROUP BY source",
    "force_reload": f"""WITH {_C}, x AS ({_chunked(512, 64, 'AND source IS NOT NULL')}), y AS (SELECT DISTINCT source, chunk_seq, unnest({_LIST.format("t")}) AS term FROM x),
 n AS (SELECT source, row_number() OVER (ORDER BY source, chunk_seq) + (SELECT max(chunk_id) FROM memory_records) AS chunk_id, true AS fresh, count(*) AS terms FROM y JOIN m USING (term) GROUP BY source, chunk_seq),
 k AS (SELECT source, chunk_id, coalesce(created_at = TIMESTAMP '{AS_OF}', false) AS fresh, cardinality(vector) AS terms FROM memory_records WHERE source IS NULL OR source NOT IN (SELECT source FROM pages WHERE source IS NOT NULL))
SELECT source, count(*) AS records, count(*) FILTER (fresh) AS fresh, min(chunk_id) AS least_id, max(chunk_id) AS greatest_id, CAST(coalesce(sum(terms) FILTER (fresh), 0) AS BIGINT) AS fresh_terms FROM (SELECT * FROM n UNION ALL SELECT * FROM k) GROUP BY source""",
    "append_local": "SELECT row_number() OVER (ORDER BY source, page_no NULLS FIRST, md5(text)) + (SELECT max(chunk_id) FROM memory_records) AS chunk_id, source, page_no, CAST(NULL AS BIGINT) AS source_chunk_id, md5(text) AS hash FROM (SELECT DISTINCT source, page_no, text FROM pages WHERE length(text) > 0 AND source IS NOT NULL)",
    "append_remote": "SELECT row_number() OVER (ORDER BY source, chunk_id) + (SELECT max(chunk_id) FROM memory_records) AS chunk_id, source, chunk_id AS source_chunk_id FROM (SELECT DISTINCT source, chunk_id FROM replica_b WHERE source IS NOT NULL AND chunk_id IS NOT NULL)",
    "source_present": "WITH a AS (SELECT source FROM (SELECT DISTINCT source FROM pages WHERE source IS NOT NULL ORDER BY source LIMIT 5) UNION ALL SELECT 'no such source') SELECT source, source IN (SELECT source FROM memory_records WHERE length(source) % 2 = 1) AS present FROM a",
    "store_roundtrip": "SELECT source, count(*) AS records, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(cardinality(vector)) AS BIGINT) AS terms, max(epoch_us(created_at)) AS newest FROM memory_records GROUP BY source",
    "model_roundtrip": f"WITH {_C} SELECT term, df, round(idf, 6) AS idf, (SELECT count(*) FROM r) AS n_docs FROM m",
    "token_validity": "SELECT DISTINCT word, regexp_matches(word, '[一-鿿A-Za-z0-9]') AS valid FROM (SELECT unnest(string_split(query, ' ')) AS word FROM queries)",
    "token_bigrams": f"WITH {_R}, w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]+|[一-鿿]+')) AS x FROM r), t AS (SELECT unnest(CASE WHEN regexp_matches(x, '^[一-鿿]') THEN list_transform(range(1, greatest(length(x), 2)), lambda i: substring(x, i, 2)) ELSE [lower(x)] END) AS term FROM w) SELECT term, count(*) AS n FROM t GROUP BY term",
    "delete_by_source": "SELECT count(*) FILTER (source IS DISTINCT FROM 'field-handbook.pdf') AS kept, count(DISTINCT source) FILTER (source IS DISTINCT FROM 'field-handbook.pdf') AS sources, count(*) FILTER (source = 'field-handbook.pdf') AS deleted FROM memory_records",
    "alloc_ids": f"SELECT source, chunk_seq, row_number() OVER (ORDER BY source, chunk_seq) + (SELECT max(chunk_id) FROM memory_records) AS chunk_id FROM ({_chunked(512, 64, 'AND source IS NOT NULL')})",
    "record_identities": f"WITH {_R} SELECT chunk_id, source, coalesce(source_chunk_id, chunk_id) AS ident_no FROM r",
    "update_one": f"""WITH {_R}, hit AS (SELECT min(chunk_id) AS c FROM r WHERE source = 'field-handbook.pdf' AND coalesce(source_chunk_id, chunk_id) = 1),
 u AS (SELECT chunk_id = c AS mine, text, vector FROM r CROSS JOIN hit)
SELECT count(*) AS records, count(*) FILTER (mine OR text = 'changed') AS changed, count(*) FILTER (mine OR map_contains(vector, 'changed')) AS with_new_key, CAST(sum(CASE WHEN mine THEN 1 ELSE cardinality(vector) END) AS BIGINT) AS entries FROM u""",
    "iso_instants": f"SELECT DISTINCT created_at, {_US_A} AS us FROM replica_a",
    "truth_sets": f"WITH {_TRUTH} SELECT qid, chunk_id FROM t",
    "ir_metrics": f"WITH {_IR} SELECT qid, round(recall, 6) AS recall, round(precision, 6) AS precision, round(mrr, 6)::DOUBLE AS mrr, top1::DOUBLE AS top1 FROM ir",
    "ir_macro": f"WITH {_IR} SELECT count(*) AS questions, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(mrr), 6) AS mrr, round(avg(top1), 6) AS top1 FROM ir",
    "ab_topone_new": f"""WITH {_W}, t AS (SELECT DISTINCT qid, chunk_id FROM queries JOIN r ON contains(r.text, keyword) WHERE length(keyword) > 0), good AS (SELECT qid FROM t GROUP BY qid HAVING count(*) FILTER (chunk_id % 2 = 0) > 0 AND count(*) FILTER (chunk_id % 2 <> 0) > 0),
 a AS (SELECT * FROM (SELECT *, {_TOP.format('score')} AS rk FROM h) WHERE rk <= 3), b AS (SELECT qid, doc_id, score AS plain, 0.5 * score + 0.35 * (CASE WHEN doc_id % 2 = 0 THEN exp(-(ln(2) / (30 * 86400.0)) * 30 * 86400.0) ELSE 1.0 END) + 0.05 AS scored FROM a WHERE qid IN (SELECT qid FROM good)),
 o AS (SELECT 'plain' AS ranking, * FROM (SELECT doc_id, {_TOP.format('plain')} AS rk FROM b) UNION ALL SELECT 'scored', * FROM (SELECT doc_id, {_TOP.format('scored')} AS rk FROM b))
SELECT ranking, count(*) AS questions, count(*) FILTER (doc_id % 2 <> 0) AS new_top1 FROM o WHERE rk = 1 GROUP BY ranking""",
    "ab_quality": f"""WITH {_W}, t AS (SELECT DISTINCT qid, chunk_id FROM queries JOIN r ON contains(r.text, keyword) WHERE length(keyword) > 0),
 good AS (SELECT qid FROM t GROUP BY qid HAVING count(*) FILTER (chunk_id % 2 = 0) > 0 AND count(*) FILTER (chunk_id % 2 <> 0) > 0),
 a AS (SELECT * FROM (SELECT *, {_TOP.format('score')} AS rk FROM h) WHERE rk <= 15), v AS (SELECT qid, doc_id, score AS s0, 0.5 * score + 0.35 + 0.05 AS s1, 0.5 * score + 0.35 * (CASE WHEN doc_id % 2 = 0 THEN exp(-(ln(2) / (30 * 86400.0)) * 30 * 86400.0) ELSE 1.0 END) + 0.05 AS s2 FROM a),
 x AS (SELECT 'A' AS scenario, 'plain' AS ranking, qid, doc_id, s0 AS s FROM v UNION ALL SELECT 'A', 'scored', qid, doc_id, s1 FROM v UNION ALL SELECT 'B', 'plain', qid, doc_id, s0 FROM v UNION ALL SELECT 'B', 'scored', qid, doc_id, s2 FROM v),
 y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario, ranking, qid ORDER BY round(s, 9) DESC, doc_id) AS rk FROM x) WHERE rk <= 5),
 z AS (SELECT y.*, t.chunk_id IS NOT NULL AS hit FROM y LEFT JOIN t ON t.qid = y.qid AND t.chunk_id = y.doc_id),
 b AS (SELECT scenario, ranking, qid, count(*) AS returned, count(*) FILTER (hit) AS found, min(rk) FILTER (hit) AS first FROM z GROUP BY ALL),
 asked AS (SELECT scenario, ranking, qid, n FROM (SELECT qid, count(*) AS n FROM t GROUP BY qid) CROSS JOIN (SELECT unnest(['A', 'B']) AS scenario) CROSS JOIN (SELECT unnest(['plain', 'scored']) AS ranking) WHERE scenario = 'A' OR qid IN (SELECT qid FROM good)),
 m2 AS (SELECT scenario, ranking, coalesce(found / n, 0) AS recall, coalesce(found / returned, 0) AS precision, coalesce(1.0 / first, 0) AS mrr, CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END AS top1 FROM asked LEFT JOIN b USING (scenario, ranking, qid))
SELECT scenario, ranking, count(*) AS questions, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(mrr), 6) AS mrr, round(avg(top1), 6) AS top1 FROM m2 GROUP BY scenario, ranking""",
    "aged_records": f"WITH {_R} SELECT chunk_id, epoch_us(created_at) - CASE WHEN chunk_id % 2 = 0 THEN 30 * 86400000000 ELSE 0 END AS us FROM r",
}
