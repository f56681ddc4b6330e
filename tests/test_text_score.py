import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import score
from quern.functions.text import is_token, normalize_text, tokens, windows
from quern.functions.timestamps import instant
from quern.operators.chunking import chunk_pages, chunk_stats, page_stats


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t")).alias("r")).first()["r"]


def test_normalize(spark):
    f = lambda v: one(spark, normalize_text, v)
    assert f("  a  b \n\n\t c \r\nd e\x0bf ") == "a  b c d e f"
    assert f("") == "" and f(" \n ") == "" and f(None) is None


def test_windows_golden(spark):
    cut = lambda t, s, o: one(spark, lambda c: windows(c, s, o), t)
    letters = "abcdefghijklmnopqrstuvwxyz"
    assert cut("", 10, 0) == [] and cut(None, 10, 0) is None
    assert cut("hello", 10, 0) == ["hello"]
    assert cut(letters, 10, 0) == ["abcdefghij", "klmnopqrst", "uvwxyz"]
    assert cut(letters, 10, 4) == ["abcdefghij", "ghijklmnop", "mnopqrstuv", "stuvwxyz"]
    assert cut("一二三四五六七八九十", 4, 1) == ["一二三四", "四五六七", "七八九十"]
    for size, overlap in ((0, 0), (5, -1), (5, 5), (5, 6)):
        with pytest.raises(ValueError):
            windows(F.col("t"), size, overlap)


@settings(max_examples=12, deadline=None)
@given(text=st.text(alphabet="ab 中😀\n", min_size=1, max_size=60), size=st.integers(1, 9), data=st.data())
def test_windows_cover(spark, text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    got = one(spark, lambda c: windows(c, size, overlap), text)
    assert got[0] + "".join(g[overlap:] for g in got[1:]) == text
    assert all(len(g) == size for g in got[:-1]) and all(a[len(a) - overlap :] == b[:overlap] for a, b in zip(got, got[1:]) if len(b) >= overlap)


def test_pages_and_chunks(spark):
    pages = spark.createDataFrame([("d", 1, "x" * 20), ("d", 2, ""), ("d", 3, "y" * 20), ("d", 3, "y" * 20), ("e", None, None)], "source string, page_no int, text string").withColumn("extra", F.lit(1))
    rows = chunk_pages(pages, 10, 0).orderBy("chunk_seq").collect()
    assert [(r["page_no"], r["chunk_seq"], r["text"]) for r in rows] == [(1, 1, "x" * 10), (1, 2, "x" * 10), (3, 3, "y" * 10), (3, 4, "y" * 10)]
    assert chunk_stats(chunk_pages(pages.filter("page_no = 1"), 10, 5)).first()[1:] == (3, 30)
    assert {tuple(r) for r in page_stats(pages).collect()} == {("d", 4, 3, 60), ("e", 1, 0, 0)}
    assert chunk_pages(pages.limit(0)).count() == 0


def test_tokens(spark):
    f = lambda v: one(spark, tokens, v)
    assert f("PDF format") == ["pdf", "format"] and f("，。!") == [] and f("") == [] and f(None) is None
    assert f("Élan 苹果x2") == ["lan", "苹", "果", "x2"]
    assert one(spark, is_token, "，") is False and one(spark, is_token, "苹果") is True


def test_instants(spark):
    f = lambda v: one(spark, instant, v)
    assert f("1970-01-01T00:00:01") == f("1970-01-01T00:00:01Z") == f("1970-01-01T01:00:01+01:00") == f("1969-12-31T20:30:01.000-03:30") == 1_000_000
    assert f("1970-01-01T00:00:00.000001") == 1 and f("nonsense") is None and f(None) is None


def test_decay(spark):
    f = lambda a, rate, dt: spark.range(1).select(score.decay(F.lit(a), rate, F.lit(dt)).alias("r")).first()["r"]
    assert f(0.8, 0.1, 0.0) == 0.8 and f(0.9, 0.0, 1e9) == 0.9
    assert abs(f(1.0, 0.1, score.half_life(0.1)) - 0.5) < 1e-9
    for a, dt in ((1.5, 0.0), (-0.1, 0.0), (0.5, -1.0)):
        with pytest.raises(Exception, match="out of range"):
            f(a, 0.1, dt)
    for bad in (lambda: score.decay(F.lit(1.0), -0.1, F.lit(1.0)), lambda: score.half_life(0), lambda: score.half_life(-1), lambda: score.rate_of(0)):
        with pytest.raises(ValueError):
            bad()


def test_reinforce_and_score(spark):
    run = lambda c: spark.range(1).select(c.alias("r")).first()["r"]
    got = [run(score.reinforce(F.lit(a), r)) for a, r in ((0.5, 0.2), (0.95, 0.1), (1.0, 0.5), (0.5, 0.1))]
    assert got == pytest.approx([0.7, 1, 1, 0.6])
    total = lambda parts, w=None: run(score.memory_score({k: F.lit(v) for k, v in parts.items()}, w)[0])
    assert total({"semantic": 0.8}) == pytest.approx(0.4)
    assert total({p: 1.0 for p in score.PARTS}) == pytest.approx(1) and total({}) == 0
    assert total({"semantic": 0.7, "recency": 0.9}, score.Weights(1, 0, 0, 0, 0)) == pytest.approx(0.7)
    for age, expect in ((7, 0.683), (200, 0.395)):
        r = math.exp(-score.rate_of(60 * score.DAY_S) * age * score.DAY_S)
        assert round(total({"semantic": 0.62, "recency": r, "activation": r, "importance": 0.5}), 3) == expect
    for w in ((-1, 1, 1, 1, 1), (0, 0, 0, 0, 0)):
        with pytest.raises(ValueError):
            total({"semantic": 0.5}, score.Weights(*w))
    with pytest.raises(Exception, match="out of range"):
        total({"semantic": 1.5})


def test_cut_lineage(spark):
    import os

    from quern.session import clean_shared, cut_lineage, shared_dir

    kept = cut_lineage(spark.range(3).withColumn("v", F.map_from_arrays(F.array(F.lit("a")), F.array(F.col("id")))))
    assert kept.count() == 3 and "Parquet" in kept._jdf.queryExecution().toString()
    place = shared_dir(spark).removeprefix("file://") + "/quern"
    assert os.listdir(place)
    clean_shared(spark)
    assert not os.path.exists(place)
