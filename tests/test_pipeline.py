from datetime import UTC, datetime, timedelta

import pytest

from quern.plans.pipeline import Memory

NOW = datetime(2026, 1, 31, tzinfo=UTC)


def pages(spark, rows):
    return spark.createDataFrame(rows, "source string, page_no int, text string")


def ask(spark, text):
    return spark.createDataFrame([(1, text)], "qid int, query string")


def test_ingest_search_restart(spark, tmp_path):
    root = str(tmp_path / "m")
    memory = Memory(spark, root, 40, 0)
    with pytest.raises(FileNotFoundError):
        memory.search(ask(spark, "x"))
    with pytest.raises(ValueError):
        Memory(spark, root, 5, 5)
    old = NOW - timedelta(days=60)
    got = memory.ingest(pages(spark, [("a", 1, "red apples are sweet"), ("a", 2, ""), ("b", 1, "green pears are sour")]), created_at=old)
    assert {tuple(r) for r in got.collect()} == {("a", 2, 1, False), ("b", 1, 1, False)}
    again = memory.ingest(pages(spark, [("a", 1, "changed"), ("c", 1, "red apples are sweet")]), created_at=NOW)
    assert {tuple(r) for r in again.collect()} == {("a", 1, 0, True), ("c", 1, 1, False)}
    memory = Memory(spark, root, 40, 0)
    hits = memory.search(ask(spark, "sweet apples"), as_of=NOW).orderBy("rank").collect()
    assert [r["text"] for r in hits] == ["red apples are sweet"] * 2 and hits[0]["recency"] > hits[1]["recency"] and hits[0]["raw_score"] == hits[1]["raw_score"]
    assert memory.search(ask(spark, "sweet apples"), as_of=NOW, since=NOW).count() == 1
    assert memory.search(ask(spark, "unknown words"), as_of=NOW).count() == 0
    assert memory.search(ask(spark, "apples"), min_score=0.0, as_of=NOW).count() == 3
    with pytest.raises(ValueError):
        memory.search(ask(spark, "apples"), k=0)
    assert memory.search(ask(spark, "unknown words"), k=0).count() == 0
    forced = memory.ingest(pages(spark, [("a", 1, "plums")]), force=True, created_at=NOW)
    assert {tuple(r) for r in forced.collect()} == {("a", 1, 1, False)}
    # the frozen model doesn't know plums, so the chunk has no vector and no record until the model is fitted again
    assert memory.records().filter("source = 'a'").count() == 0 and memory.records().count() == 2
    memory.refit()
    assert memory.records().count() == 2 and memory.model().n_docs == 2
