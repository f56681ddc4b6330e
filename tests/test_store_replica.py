import pytest
from pyspark.sql import functions as F

from quern.operators import replica, store


def NOW():
    return F.lit("2026-01-01").cast("timestamp")



def records(spark, rows):
    base = spark.createDataFrame(rows, "chunk_id bigint, source string, text string, source_chunk_id bigint")
    return base.select("chunk_id", F.lit(1).alias("page_no"), "text", F.create_map(F.lit("w"), F.lit(1.0)).alias("vector"), NOW().alias("created_at"), "source", "source_chunk_id")


def test_append_and_ids(spark, tmp_path):
    empty = store.empty(spark)
    assert store.next_id(empty) == 1
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "source string, page_no int, text string").withColumn("vector", F.create_map(F.lit("w"), F.lit(1.0)))
    none = rows.limit(1).withColumn("vector", F.create_map().cast("map<string,double>"))
    full = store.append(empty, rows.unionByName(none), NOW(), ["page_no"])
    assert sorted(r["chunk_id"] for r in full.collect()) == [1, 2, 3] and store.next_id(full) == 4
    store.save(full, str(tmp_path / "s"))
    again = store.load(spark, str(tmp_path / "s"))
    assert again.count() == 3 and store.next_id(again) == 4
    store.export_json(full, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    spark.createDataFrame([(99,)], "schema_version int").write.mode("overwrite").json(str(tmp_path / "s/meta"))
    with pytest.raises(ValueError):
        store.load(spark, str(tmp_path / "s"))
    with pytest.raises(FileNotFoundError):
        store.load(spark, str(tmp_path / "none"))


def test_delete_update_remote(spark):
    full = records(spark, [(1, "a", "x", None), (2, "a", "y", None), (3, "b", "z", 7)])
    left, gone = store.delete_source(full, "a")
    assert gone == 2 and left.count() == 1 and store.has_source(full, "a") and not store.has_source(left, "a")
    new, hit = store.update_record(full, "b", 7, "new", {"n": 2.0}, NOW())
    assert hit and {(r["chunk_id"], r["text"]) for r in new.collect()} == {(1, "x"), (2, "y"), (3, "new")}
    assert store.update_record(full, "b", 8, "new", {}, NOW())[1] is False
    more = store.append_remote(full, records(spark, [(5, "c", "r", None)]))
    row = more.filter("source = 'c'").first()
    assert (row["chunk_id"], row["source_chunk_id"]) == (4, 5)


def test_ingest_is_idempotent(spark):
    pages = spark.createDataFrame([("d", 1, "x" * 30), ("e", 1, "y" * 10), ("e", 2, "")], "source string, page_no int, text string")
    encode = lambda rows: rows.withColumn("vector", F.create_map(F.lit("w"), F.lit(1.0)))
    first = store.ingest(store.empty(spark), pages, encode, NOW(), 10, 0)
    assert first.count() == 4 and first.select("chunk_id").distinct().count() == 4
    assert store.ingest(first, pages, encode, NOW(), 10, 0).count() == 4
    forced = store.ingest(first, pages.filter("source = 'd'").withColumn("text", F.lit("z" * 10)), encode, NOW(), 10, 0, force=True)
    assert sorted((r["source"], r["text"]) for r in forced.collect()) == [("d", "z" * 10), ("e", "y" * 10)]
    gone = store.ingest(first, pages.filter("source = 'd'").withColumn("text", F.lit("")), encode, NOW(), 10, 0, force=True)
    assert [r["source"] for r in gone.collect()] == ["e"]


def side(spark, rows):
    base = spark.createDataFrame(rows, "source string, chunk_id bigint, text string, us bigint, page_no int")
    return replica.latest(base, F.col("chunk_id"), F.col("us"))


def stats(a, b):
    return {r["direction"]: tuple(r)[1:] for r in replica.sync_all(a, b)[2].collect()}


def test_sync_union_and_second_run(spark):
    a = side(spark, [("a", i, "t", 1, 1) for i in (1, 2, 3)])
    b = side(spark, [("b", 1, "t", 1, 1), ("c", 1, "t", 1, 1)])
    new_a, new_b, _ = replica.sync_all(a, b)
    assert stats(a, b) == {"a_to_b": (3, 3, 0, 0), "b_to_a": (2, 2, 0, 3)}
    assert new_a.count() == new_b.count() == 5
    assert {v[0] for v in stats(new_a, new_b).values()} == {0}


def test_sync_conflicts(spark):
    a = side(spark, [("s", 1, "old", 1, 1), ("s", 2, "same time", 5, 1), ("s", 3, "mine", 9, 1)])
    b = side(spark, [("s", 1, "new", 2, 8), ("s", 2, "other", 5, 1), ("s", 3, "older", 3, 1)])
    new_a, new_b, _ = replica.sync_all(a, b)
    assert {(r["ident_no"], r["text"], r["page_no"]) for r in new_a.collect()} == {(1, "new", 1), (2, "same time", 1), (3, "mine", 1)}
    assert {(r["ident_no"], r["text"], r["page_no"]) for r in new_b.collect()} == {(1, "new", 8), (2, "other", 1), (3, "mine", 1)}
    assert replica.missing_in(a, b, "ids_only").count() == 0
    assert {(r["ident_no"], r["outcome"]) for r in replica.missing_in(a, b).collect()} == {(3, "updated")}
    with pytest.raises(ValueError):
        replica.missing_in(a, b, "all")


def test_delta_only_and_no_identity(spark):
    a = side(spark, [("s", i, "t", 1, 1) for i in range(10)] + [(None, 1, "t", 1, 1), ("s", None, "t", 1, 1)])
    b = side(spark, [("s", i, "t", 1, 1) for i in range(9)])
    assert stats(a, b)["a_to_b"][:2] == (1, 1) and stats(a, b)["b_to_a"][0] == 0
