import pytest
from pyspark.sql import functions as F

from quern.functions.score import half_life
from quern.functions.segment import WordList, bigrams, segmenter
from quern.operators import model
from quern.plans.pipeline import DenseBackend, Memory, TfidfBackend
from quern.streaming import sessions

TEXTS = ["Apple 苹果树下 B2", "我们在北京大学", "果", "", None, "!?"]


def test_words_of_a_list(spark):
    words = ["苹果", "苹果树", "北京", "大学", "北京大学", "x", "单"]
    assert WordList(words).tokens("在苹果树下 Ab") == ["在", "苹果树", "下", "ab"]
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = [r["t"] for r in rows.select(segmenter(words)(F.col("text")).alias("t")).collect()]
    assert got == [["apple", "苹果树", "下", "b2"], ["我", "们", "在", "北京大学"], ["果"], [], None, []]
    pairs = [r["t"] for r in rows.select(bigrams(F.col("text")).alias("t")).collect()]
    assert pairs == [["apple", "苹果", "果树", "树下", "b2"], ["我们", "们在", "在北", "北京", "京大", "大学"], ["果"], [], None, []]
    docs = spark.createDataFrame([(1, "苹果树"), (2, "苹果")], "id bigint, text string")
    assert {r["term"] for r in model.fit(docs, "id", tokenizer=segmenter(words)).terms.collect()} == {"苹果树", "苹果"}


def messages(spark, rows):
    return spark.createDataFrame(rows, "conn_id string, msg_no bigint, payload string").select("conn_id", "msg_no", sessions.message_type(F.col("payload")).alias("type"))


def test_an_exchange(spark):
    send = lambda kind, done=False: '{"type": "%s"%s}' % (kind, ', "done": true' if done else "")
    whole = [sessions.IDS, sessions.IDS, sessions.RECORDS, (sessions.RECORDS, True), sessions.ACK_STATS, (sessions.RECORDS, True), sessions.ACK_STATS, sessions.BYE]
    rows = [("a", i, send(*(m if isinstance(m, tuple) else (m,)))) for i, m in enumerate(whole)]
    rows += [("b", 0, send(sessions.RECORDS)), ("b", 1, send(sessions.IDS)), ("c", 0, "no json"), ("d", 5, send(sessions.IDS)), ("d", 7, None)]
    got = {}
    for r in sessions.session_states(messages(spark, rows), sessions.EXCHANGE).orderBy("conn_id", "msg_no").collect():
        got.setdefault(r["conn_id"], []).append((r["before"], r["after"], r["allowed"]))
    assert got["a"][-1] == ("end", "end", True) and all(x[2] for x in got["a"])
    assert got["b"] == [("start", "broken", False), ("broken", "broken", False)] and got["c"][0][1] == "broken"
    assert got["d"] == [("start", "ids", True), ("ids", "broken", False)]
    assert sessions.session_states(messages(spark, rows).limit(0), sessions.EXCHANGE).count() == 0


def test_backends(spark, tmp_path):
    pages = spark.createDataFrame([("a", 1, "苹果树"), ("b", 1, "北京大学")], "source string, page_no int, text string")
    ask = spark.createDataFrame([(1, "苹果树"), (2, "no")], "qid int, query string")
    memory = Memory(spark, str(tmp_path / "words"), backend=TfidfBackend(segmenter(["苹果树", "北京大学"])))
    memory.ingest(pages)
    assert [r["text"] for r in memory.search(ask).collect()] == ["苹果树"]
    assert {tuple(r["vector"]) for r in memory.records().collect()} == {("苹果树",), ("北京大学",)}
    count = lambda texts: [[float(len(t)), float("大" in t)] for t in texts]
    dense = Memory(spark, str(tmp_path / "dense"), backend=DenseBackend(count))
    dense.ingest(pages)
    hits = dense.search(ask.filter("qid = 1")).orderBy("rank").collect()
    assert [r["text"] for r in hits] == ["苹果树", "北京大学"] and hits[0]["raw_score"] == pytest.approx(1.0)


def test_half_life_of_a_column(spark):
    assert spark.range(1).select(half_life(F.lit(0.1)).alias("h")).first()["h"] == pytest.approx(half_life(0.1))
    with pytest.raises(Exception, match="positive"):
        spark.range(1).select(half_life(F.lit(0.0)).alias("h")).collect()
