import pytest
from pyspark.sql import functions as F

from quern.functions import frames as wire
from quern.sources.frames import FrameSource
from quern.sources.pages import is_valid, read_pages
from quern.streaming import memory
from quern.streaming.frames import decode_batch, decode_stream


def frame(text):
    data = text.encode()
    return len(data).to_bytes(4, "big") + data


def test_decoder_portions():
    d = wire.Decoder()
    assert d.feed(frame("a") + frame("b")) == ["a", "b"] and d.rest == b""
    half = frame("hello")
    assert d.feed(half[:6]) == [] and len(d.rest) == 6 and d.feed(half[6:]) == ["hello"]
    assert d.feed(half[:2]) == [] and d.feed(half[2:]) == ["hello"]
    data = b"".join(frame(f"m{i}中") for i in range(5))
    assert [m for i in range(len(data)) for m in d.feed(data[i : i + 1])] == [f"m{i}中" for i in range(5)]
    with pytest.raises(ValueError):
        d.feed((65_537).to_bytes(4, "big"))


def test_encode(spark):
    row = spark.createDataFrame([("é中",)], "t string").select(wire.encode(F.col("t")).alias("f")).select("f", wire.declared_length(F.col("f")).alias("n")).first()
    assert bytes(row["f"]) == frame("é中") and row["n"] == 5
    with pytest.raises(Exception, match="65536"):
        spark.range(1).select(wire.encode(F.repeat(F.lit("x"), 65_537))).collect()


PIECES = "conn_id string, seq bigint, bytes binary"


def pieces():
    data = b"".join(frame(f"m{i}") for i in range(6))
    return [("c", i, data[i * 5 : i * 5 + 5]) for i in range(9)] + [("d", 0, frame("x") + frame("y")[:3]), ("d", 1, None), ("d", 2, frame("y")[3:])]


WANT = {("c", i + 1, f"m{i}") for i in range(6)} | {("d", 1, "x"), ("d", 2, "y")}


def test_batch_and_stream_agree(spark, tmp_path):
    batch = decode_batch(spark.createDataFrame(pieces(), PIECES))
    assert {tuple(r)[:3] for r in batch.collect()} == WANT
    for n, part in enumerate((pieces()[:4], pieces()[4:10], pieces()[10:])):
        spark.createDataFrame(part, PIECES).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{n}"))
    for n in range(3):
        spark.read.parquet(str(tmp_path / f"in{n}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = decode_stream(spark.readStream.schema(PIECES).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = [tuple(r)[:3] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert set(got) == WANT and len(got) == len(WANT)


def test_upsert_stream(spark, tmp_path):
    rows = [[("s", 1, 1, "a", 1), ("s", 2, 1, "b", 5)], [("s", 1, 9, "c", 2), ("s", 2, 1, "old", 1)], [("s", 1, 9, "c", 2)]]
    for part in rows:
        spark.createDataFrame(part, memory.TARGET).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(memory.TARGET).parquet(str(tmp_path / "in"))
        memory.upsert_stream(stream, str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination() if (tmp_path / "store").mkdir(exist_ok=True) is None else None
    assert {tuple(r) for r in memory.read_target(spark, str(tmp_path / "store")).collect()} == {("s", 1, 1, "c", 2), ("s", 2, 1, "b", 5)}


def test_activation_stream(spark, tmp_path):
    ddl = "memory_id string, at_us bigint"
    spark.createDataFrame([("m", 0), ("m", 1_000_000)], ddl).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = memory.activation_stream(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")), 0.693147180559945).writeStream.format("memory").queryName("act").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["at_us"]: r["activation"] for r in spark.sql("select * from act").collect()}
    assert got == pytest.approx({0: 0.1, 1_000_000: 0.15})


def test_distinct_stream(spark, tmp_path):
    ddl = "source string, n bigint, at timestamp"
    spark.createDataFrame([("s", 1, None), ("s", 1, None), ("s", 2, None)], ddl).withColumn("at", F.lit("2026-01-01").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = memory.distinct_stream(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")), "at", ["source", "n"]).writeStream.format("memory").queryName("dist").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select * from dist").count() == 2


def test_frame_source(spark, tmp_path):
    spark.dataSource.register(FrameSource)
    (tmp_path / "a.bin").write_bytes(frame("one") + frame("two"))
    (tmp_path / "b.bin").write_bytes(frame("three"))
    rows = spark.read.format("frames").option("path", str(tmp_path)).load()
    assert {tuple(r) for r in rows.collect()} == {("a.bin", 1, "one"), ("a.bin", 2, "two"), ("b.bin", 1, "three")}
    (tmp_path / "b.bin").write_bytes(frame("three")[:-1])
    with pytest.raises(Exception, match="within a frame"):
        rows.collect()
    assert spark.read.format("frames").option("path", str(tmp_path / "a.bin")).load().count() == 2


def test_frame_stream_takes_late_files_with_early_names(spark, tmp_path):
    spark.dataSource.register(FrameSource)
    (tmp_path / "in").mkdir()

    def run():
        stream = spark.readStream.format("frames").option("path", str(tmp_path / "in")).option("settled", "0").load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    (tmp_path / "in" / "b.bin").write_bytes(frame("one") + frame("two"))
    run()
    (tmp_path / "in" / "a.bin").write_bytes(frame("three"))
    run()
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a.bin", 1, "three"), ("b.bin", 1, "one"), ("b.bin", 2, "two")]


def test_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_text("first\n page \f\fthird", encoding="utf-8")
    got = {(r["source"], r["page_no"], r["text"]) for r in read_pages(spark, str(tmp_path)).collect()}
    assert got == {("a.txt", 1, "first page"), ("a.txt", 2, ""), ("a.txt", 3, "third")} and is_valid(spark, str(tmp_path))
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\xff")
    assert not is_valid(spark, str(tmp_path)) and read_pages(spark, str(tmp_path), strict=False).filter("parse_error is not null").count() == 1
    with pytest.raises(Exception, match="can't be read"):
        read_pages(spark, str(tmp_path)).collect()
    with pytest.raises(FileNotFoundError):
        read_pages(spark, str(tmp_path / "none"))
