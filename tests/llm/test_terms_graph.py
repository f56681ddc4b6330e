import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import graph_words, terms

DDL = "chunk_id bigint, text string, vector map<string,double>, rec_id string, term string"
ROWS = [
    (1, "Apple apple, APPLE 苹果 x1!", {"apple": 1.0, "Ä": 0.5}),
    (1, "Apple apple, APPLE 苹果 x1!", {"apple": 1.0, "Ä": 0.5}),
    (2, "apple Kelvin: K", {}),
    (3, None, {"apple": 2.0}),
    (4, "", None),
    (5, "?!", {"z": None}),
    (6, "b " * 3000 + "c", {"apple": 1.0}),
    (None, "lost", {"lost": 1.0}),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], DDL)


def split(text):
    return [w.lower() for w in re.findall("[A-Za-z0-9]+|[一-鿿]", text)]


def distinct():
    return {r[0]: r for r in ROWS if r[0] is not None}.values()


def test_term_statistics(spark):
    want = {}
    for field in ("text", "vector"):
        occurrences, held = Counter(), Counter()
        for _, text, vector in distinct():
            found = (split(text) if text is not None else []) if field == "text" else list(vector or {})
            occurrences.update(found)
            held.update(set(found))
        n = sum((r[1] if field == "text" else r[2]) is not None for r in distinct())
        for t in held:
            want[field, t] = (occurrences[t], held[t], "rare" if held[t] <= 2 else "common" if held[t] > 0.25 * n else None)
    got = {(r["field"], r["term"]): (r["occurrences"], r["n_docs"], r["mark"]) for r in terms.term_statistics(table(spark)).collect()}
    assert got == want and got["vector", "apple"] == (3, 3, "common") and got["text", "b"][0] == 3000
    assert terms.term_statistics(table(spark).limit(0)).count() == 0


def brute_graph(text, window=4):
    words = split(text)
    near = defaultdict(set)
    for i, a in enumerate(words):
        for b in words[max(0, i - window + 1) : i + window]:
            if a != b:
                near[a].add(b)
    return {w: (n, len(near[w])) for w, n in Counter(words).items()}


@pytest.mark.parametrize("hot_share", [256, 1])
def test_text_scores(spark, hot_share):
    texts = {r[0]: r[1] for r in distinct() if r[1] is not None}
    graphs = {i: brute_graph(t) for i, t in texts.items()}
    df = Counter(w for g in graphs.values() for w in g)
    want = {(i, w): (tf, d, df[w], pytest.approx(d * math.log((len(texts) + 1) / df[w]))) for i, g in graphs.items() for w, (tf, d) in g.items()}
    got = {(r["rec_id"], r["term"]): (r["tf"], r["degree"], r["df"], r["score"]) for r in graph_words.text_distinctiveness(table(spark), hot_share=hot_share).collect()}
    assert got == want
    some = graph_words.text_distinctiveness(table(spark), min_tf=3, max_df=1, hot_share=hot_share).collect()
    assert {(r["rec_id"], r["term"]) for r in some} == {k for k, v in want.items() if v[0] >= 3 and v[2] <= 1}
    assert graph_words.text_distinctiveness(table(spark).limit(0)).count() == 0


def test_hot_terms(spark):
    """Terms over the threshold are broadcast, the others joined: both get the same statistics."""
    rows = [(i, f"the w{i % 90} w{i % 7}", None) for i in range(300)]
    df = Counter(w for _, t, _ in rows for w in set(split(t)))
    got = graph_words.text_distinctiveness(table(spark, rows)).collect()
    assert len(got) == sum(len(set(split(t))) for _, t, _ in rows) and all(r["df"] == df[r["term"]] for r in got)
    rare = graph_words.text_distinctiveness(table(spark, rows), max_df=3).collect()
    assert {r["term"] for r in rare} == {w for w, n in df.items() if n <= 3}


def test_vector_scores(spark):
    got = {(r["rec_id"], r["term"]): (r["df"], r["score"]) for r in graph_words.vector_distinctiveness(table(spark)).collect()}
    n = 5
    assert got == {
        (1, "apple"): (3, pytest.approx(math.log((n + 1) / 3))), (1, "Ä"): (1, pytest.approx(0.5 * math.log(n + 1))),
        (3, "apple"): (3, pytest.approx(2 * math.log((n + 1) / 3))), (6, "apple"): (3, pytest.approx(math.log((n + 1) / 3))),
    }
    assert graph_words.vector_distinctiveness(table(spark).limit(0)).count() == 0
