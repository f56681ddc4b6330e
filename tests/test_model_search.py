import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions.score import DAY_S, Weights
from quern.operators import evaluate, model, search


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "apple apple apple banana"), (2, "apple banana grape"), (3, ""), (4, None)], "doc_id bigint, text string")


def vectors(spark, rows, name="doc_id"):
    return spark.createDataFrame(rows, f"{name} bigint, term string, weight double")


def test_idf_and_weights(spark, docs):
    two = docs.filter("doc_id < 3")
    fitted = model.fit(two, "doc_id")
    idf = {r["term"]: r["idf"] for r in fitted.terms.collect()}
    assert idf == pytest.approx({"apple": 1.0, "banana": 1.0, "grape": math.log(2) + 1})
    counts = model.token_counts(spark.createDataFrame([(9, "apple stone stone stone"), (8, "stone")], "doc_id bigint, text string"), "doc_id")
    assert [tuple(r) for r in model.weights(counts, fitted).collect()] == [(9, "apple", 0.25)]
    assert [tuple(r)[:2] for r in fitted.with_index().orderBy("term_idx").collect()] == [("apple", 0), ("banana", 1), ("grape", 2)]
    assert model.fit(docs, "doc_id").n_docs == 4 and not model.fit(docs.limit(0), "doc_id").is_fitted()


def test_length_does_not_matter(spark):
    rows = spark.createDataFrame([(1, "a a a"), (2, "a a a a a a")], "doc_id bigint, text string")
    weights = model.weights(model.token_counts(rows, "doc_id"), model.fit(rows, "doc_id"))
    assert len({r["weight"] for r in weights.collect()}) == 1


def test_model_files(spark, docs, tmp_path):
    fitted = model.fit(docs, "doc_id")
    fitted.save(str(tmp_path / "m"))
    again = model.Model.load(spark, str(tmp_path / "m"))
    assert again.n_docs == 4 and sorted(map(tuple, again.terms.collect())) == sorted(map(tuple, fitted.terms.collect()))
    with pytest.raises(FileNotFoundError):
        model.Model.load(spark, str(tmp_path / "none"))


def test_cosine(spark):
    q = vectors(spark, [(1, "a", 2.0), (1, "b", 1.0)], "qid")
    d = vectors(spark, [(1, "a", 4.0), (1, "b", 2.0), (2, "c", 1.0), (3, "a", 1.0), (4, "a", 0.0)])
    got = {r["doc_id"]: r["score"] for r in search.similarities(q, d).collect()}
    assert got == pytest.approx({r["doc_id"]: r["score"] for r in search.similarities(q, d, few=0).collect()})
    assert got == pytest.approx({1: 1.0, 3: 2 / math.sqrt(5)}) and max(got.values()) <= 1.0


def test_search_ties_and_limits(spark):
    q = vectors(spark, [(1, "a", 1.0)], "qid")
    d = vectors(spark, [(i, "a", 1.0) for i in (3, 1, 2)] + [(9, "z", 1.0), (8, "z", 1.0)])
    hits = lambda **k: [r["doc_id"] for r in search.vector_search(q, d, **k).orderBy("rank").collect()]
    assert hits(k=2) == [1, 2] and hits(k=10) == [1, 2, 3]
    assert hits(k=4, min_score=0.0) == [1, 2, 3, 8] and hits(k=10, min_score=0.0) == [1, 2, 3, 8, 9]
    assert search.vector_search(q.limit(0), d).count() == 0 and search.vector_search(q, d.limit(0), min_score=0.0).count() == 0
    assert search.vector_search(q.limit(0), d, k=0).count() == 0 and search.vector_search(q, d.limit(0), k=0).count() == 0
    with pytest.raises(ValueError):
        search.vector_search(q, d, k=0)


@pytest.mark.parametrize("least,options", [(-1.0, {"at_once": 5}), (0.05, {"few": 0, "held": 0}), (0.05, {"sampled": 0, "share": 2})])
def test_nearest_is_the_ranking_of_all_pairs(spark, least, options):
    """Every way: terms broadcast or not, with a sample, blocks read again, many batches; also with equal scores and weights below 0."""
    rng = np.random.default_rng(1)
    rows = lambda n, most: [(i, f"t{t}", float(rng.integers(-1, 4))) for i in range(n) for t in rng.choice(12, rng.integers(1, most), replace=False)]
    q, d = vectors(spark, rows(6, 4), "qid"), vectors(spark, rows(60, 6) + [(100 + i, "t1", 1.0) for i in range(9)])
    both = search.similarities(q, d).collect()
    want = {}
    for r in both:
        if r["score"] >= least:
            want.setdefault(r["qid"], []).append((-round(r["score"], 9), r["doc_id"]))
    got = search.top_k(search.nearest(q, d, 4, least, **options), 4).collect()
    assert {(r["qid"], r["rank"], r["doc_id"]) for r in got} == {(i, n, x[1]) for i, some in want.items() for n, x in enumerate(sorted(some)[:4], 1)}
    if "sampled" not in options:
        assert {(r["qid"], r["doc_id"]) for r in search.nearest(q, d, None, least, **options).collect()} == {(i, x[1]) for i, some in want.items() for x in some}


def test_pairs_of_queries_and_documents_are_not_shuffled(spark):
    """A search of 40 queries in 500 documents that all share a term gives the ranking 4 rows of each query and task at most."""
    q, d = vectors(spark, [(i, "a", 1.0) for i in range(40)], "qid"), vectors(spark, [(i, "a", 1.0) for i in range(500)])
    near = search.nearest(q, d, 4, 0.05)
    assert near.count() <= 40 * 4 * near.rdd.getNumPartitions() and near.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert [r["doc_id"] for r in search.vector_search(q, d, 4).filter("qid = 7").orderBy("rank").collect()] == [0, 1, 2, 3]


def test_memory_search(spark):
    meta = spark.createDataFrame([(1, 1, "2026-01-31"), (2, 1, "2025-11-02"), (3, 2, None)], "chunk_id bigint, page_no int, d string").withColumn("created_at", F.to_timestamp("d")).drop("d")
    hits = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (1, 3, 0.9)], "qid bigint, doc_id bigint, score double")
    now, since = F.lit("2026-01-31").cast("timestamp"), F.lit("2026-01-01").cast("timestamp")
    run = lambda **k: search.memory_search(hits, meta, now, k=k.pop("k", 5), half_life_s=60 * DAY_S, **k).orderBy("rank").collect()
    full = run()
    assert [r["chunk_id"] for r in full] == [1, 3, 2] and full[0]["score"] == pytest.approx(0.25 + 0.35 + 0.05) and full[1]["recency"] == 0.0
    assert [r["chunk_id"] for r in run(scored=False)] == [3, 1, 2] and run(scored=False)[0]["raw_score"] == 0.9
    assert [r["chunk_id"] for r in run(since=since)] == [r["chunk_id"] for r in run(since=since, scored=False)] == [1]
    assert [r["chunk_id"] for r in run(weights=Weights(1, 0, 0, 0, 0))] == [3, 1, 2]
    with pytest.raises(ValueError):
        run(since_mode="later")


def test_since_after_and_before_the_first_stage(spark):
    rows = [(i, 1, "2025-01-01" if i <= 3 else "2026-01-01") for i in range(1, 6)]
    meta = spark.createDataFrame(rows, "chunk_id bigint, page_no int, d string").withColumn("created_at", F.to_timestamp("d")).drop("d")
    hits = spark.createDataFrame([(1, i, 1.0 - i / 10) for i in range(1, 6)], "qid bigint, doc_id bigint, score double")
    now, since = F.lit("2026-02-01").cast("timestamp"), F.lit("2026-01-01").cast("timestamp")
    run = lambda mode: [r["chunk_id"] for r in search.memory_search(hits, meta, now, k=1, since=since, since_mode=mode).collect()]
    assert run("post") == [] and run("pre") == [4]


def test_dense_top_k(spark):
    rng = np.random.default_rng(0)
    m = rng.standard_normal((60, 5))
    m[7] = m[3]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(100, None), (101, [0.0] * 5), (102, [1.0])], "vec_id bigint, embedding array<double>")
    got = search.dense_top_k(rows.filter("vec_id < 10"), rows, 3, block=4).collect()
    u = m / np.linalg.norm(m, axis=1)[:, None]
    for q in range(10):
        s = u @ u[q]
        s[q] = -9
        want = sorted(range(60), key=lambda i: (-round(s[i], 9), i))[:3]
        assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["qid"] == q] == want


def test_metrics(spark):
    hits = spark.createDataFrame([(1, i, c) for i, c in enumerate([5, 3, 7, 9], 1)] + [(2, 1, 1), (2, 2, 2), (3, 1, 1)], "qid int, rank int, chunk_id bigint")
    truth = spark.createDataFrame([(1, 3), (1, 7), (2, 9), (4, 1)], "qid int, chunk_id bigint")
    got = {r["qid"]: tuple(r)[1:] for r in evaluate.metrics(hits, truth).collect()}
    assert got == {1: (1.0, 0.5, 0.5, 0.0), 2: (0, 0, 0, 0), 4: (0, 0, 0, 0)}
    assert evaluate.macro(evaluate.metrics(hits, truth)).first()["recall"] == pytest.approx(1 / 3)


@pytest.mark.parametrize("block,automaton", [(1 << 20, True), (2, True), (2, False)])
def test_truth(spark, monkeypatch, block, automaton):
    """One part and several, with the automaton and without."""
    if not automaton:
        plain = lambda words: lambda t: {t[i : i + n] for n in {len(w) for w in words} for i in range(len(t) - n + 1) if t[i : i + n] in words}
        monkeypatch.setattr(evaluate, "_finder", plain)
    questions = spark.createDataFrame([(1, "ab"), (2, "b c"), (3, None), (4, ""), (5, "zz"), (6, "ab")], "qid int, keyword string")
    records = spark.createDataFrame([(1, "xabx"), (2, "ab c"), (3, None), (2, "ab c")], "chunk_id bigint, text string")
    got = {tuple(r) for r in evaluate.truth_sets(questions, records, block).collect()}
    assert got == {(1, 1), (1, 2), (2, 2), (6, 1), (6, 2)}


def test_aging_and_new_first_hits(spark):
    rows = spark.createDataFrame([(1,), (2,)], "chunk_id bigint").withColumn("created_at", F.lit("2026-01-31").cast("timestamp"))
    got = {r["chunk_id"]: str(r["created_at"])[:10] for r in evaluate.aged(rows, F.col("chunk_id") == 2, 30).collect()}
    assert got == {1: "2026-01-31", 2: "2026-01-01"}
    hits = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 6)], "qid int, rank int, chunk_id bigint")
    old = spark.createDataFrame([(6,), (6,)], "chunk_id bigint")
    assert tuple(evaluate.top_one_new(hits, old).first()) == (2, 1)
    assert [r["qid"] for r in evaluate.answerable(spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "qid int, chunk_id bigint"), old).collect()] == [1]
