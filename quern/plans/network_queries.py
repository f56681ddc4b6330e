"""Replication, the entity graph, task graphs, queues and frames over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import frames as wire
from quern.functions.score import DAY_S, rate_of
from quern.functions.timestamps import instant
from quern.operators import dag, graph, replica, sched
from quern.session import cut_lineage, new_folder, table
from quern.streaming import sessions
from quern.streaming.frames import decode_batch
from quern.streaming.memory import activation_stream, distinct_stream, read_target, upsert_stream


def _replicas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tuple(replica.latest(table(spark, sf_dir, t), F.col("chunk_id"), instant(F.col("created_at"))) for t in ("replica_a", "replica_b"))


def sync_missing(spark, sf_dir):
    a, b = _replicas(spark, sf_dir)
    return replica.missing_in(a, b).select("source", "ident_no", "outcome")


def sync_ids_only(spark, sf_dir):
    a, b = _replicas(spark, sf_dir)
    return replica.missing_in(a, b, "ids_only").select("source", "ident_no")


def sync_stats(spark, sf_dir):
    return replica.sync_all(*_replicas(spark, sf_dir))[2]


def sync_merged(spark, sf_dir):
    merged = replica.sync_all(*_replicas(spark, sf_dir))[1]
    return merged.select("source", "ident_no", "page_no", F.md5("text").alias("hash"), "us")


def sync_second_pass(spark, sf_dir):
    new_a, new_b, _ = replica.sync_all(*_replicas(spark, sf_dir))
    return replica.sync_all(cut_lineage(new_a), cut_lineage(new_b))[2].select("direction", "sent", "added", "updated")


def _entities(spark, sf_dir) -> graph.Graph:
    nation, supplier, customer = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = nation.select(key("N", "n_nationkey").alias("a"), key("R", "n_regionkey").alias("b"))
    edges = edges.unionByName(supplier.select(key("S", "s_suppkey").alias("a"), key("N", "s_nationkey").alias("b"))).unionByName(customer.select(key("C", "c_custkey").alias("a"), key("N", "c_nationkey").alias("b")))
    return graph.build(edges)


def graph_counts(spark, sf_dir):
    return _entities(spark, sf_dir).counts()


def graph_degree(spark, sf_dir):
    return _entities(spark, sf_dir).degrees()


def graph_neighbors(spark, sf_dir):
    return _entities(spark, sf_dir).neighbors("N3")


def graph_khop2(spark, sf_dir):
    return _entities(spark, sf_dir).k_hop("R1", 2).select("id", F.col("hops").cast("bigint").alias("hops"))


def graph_relevance(spark, sf_dir):
    return _entities(spark, sf_dir).relevance().select("id", F.round("relevance", 6).alias("relevance"))


def _tasks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All events as a graph: a node depends on the one of half its number, every fifth also on the one two before it."""
    events = table(spark, sf_dir, "events")
    length = F.floor(F.col("value") * 1000).cast("bigint")
    bad = (F.col("event_type") == "error") & (F.col("event_id") % 19 == 10)
    nodes = events.select(F.col("event_id").alias("id"), F.when(bad, "Failed").otherwise("Done").alias("outcome"), F.lit(1).cast("bigint").alias("begin_us"), (length + 1).alias("end_us"))
    i = F.col("event_id")
    first = events.filter(i >= 1).select(F.expr("(event_id - 1) div 2").alias("src"), i.alias("dst"))
    second = events.filter((i % 5 == 0) & (i > 6)).select((i - 2).alias("src"), i.alias("dst"))
    return nodes, first.unionByName(second).distinct()


def dag_levels(spark, sf_dir):
    nodes, edges = _tasks(spark, sf_dir)
    return dag.levels(nodes, cut_lineage(edges)).select("id", F.col("level").cast("bigint").alias("level"))


def dag_status(spark, sf_dir):
    nodes, edges = _tasks(spark, sf_dir)
    return dag.propagate(nodes, cut_lineage(edges))


def dag_problems(spark, sf_dir):
    nodes, edges = _tasks(spark, sf_dir)
    wrong = edges.unionByName(edges.filter("dst % 1000 = 7")).unionByName(edges.filter("dst % 1000 = 9").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return dag.problems(nodes, wrong)


def dag_ready(spark, sf_dir):
    nodes, edges = _tasks(spark, sf_dir)
    return dag.ready(nodes, edges)


def _pending(spark, sf_dir) -> DataFrame:
    """The graph's nodes with every third not yet run."""
    nodes, _ = _tasks(spark, sf_dir)
    return nodes.withColumn("outcome", F.when(F.col("id") % 3 == 0, "Pending").otherwise(F.col("outcome")))


def dag_cancel(spark, sf_dir):
    return dag.cancel(_pending(spark, sf_dir))


def dag_summary(spark, sf_dir):
    return dag.summary(_pending(spark, sf_dir)).select("*", F.lit("before").alias("moment")).unionByName(dag.summary(_pending(spark, sf_dir).drop("outcome").join(dag.cancel(_pending(spark, sf_dir)), "id")).select("*", F.lit("after").alias("moment")))


def _settled(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    nodes, edges = _tasks(spark, sf_dir)
    edges = cut_lineage(edges)
    return cut_lineage(nodes.drop("outcome").join(dag.propagate(nodes, edges), "id")), edges


def dag_timings(spark, sf_dir):
    return dag.timings(*_settled(spark, sf_dir))


def dag_critical_path(spark, sf_dir):
    return dag.critical_path_rows(*_settled(spark, sf_dir))


def _queue(spark, sf_dir) -> DataFrame:
    """Events as queue entries: one queue for each user."""
    kind = F.col("event_type")
    priority = F.when(kind.isin("signup", "purchase"), 2).when(kind.isin("click", "view"), 1).otherwise(0)
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("queue_id"), F.col("event_id").alias("task_id"), priority.alias("priority"), seq.cast("bigint").alias("seq"), "ts", "event_type", "value")


def priority_order(spark, sf_dir):
    return sched.pop_order(_queue(spark, sf_dir), F.col("priority")).select("queue_id", "task_id", "place")


def aging_once(spark, sf_dir):
    rows = _queue(spark, sf_dir)
    waited = F.expr("(unix_micros(timestamp'2024-02-01 00:00:00') - unix_micros(ts)) div 1000")
    aged = rows.withColumn("effective", sched.effective_priority(F.col("priority"), waited, 86_400_000, 3))
    return sched.pop_order(aged, F.col("effective")).select("queue_id", "task_id", "effective", "place")


def _moves(spark, sf_dir):
    """Errors and purchases take a task out, everything else puts one in."""
    return _queue(spark, sf_dir).select("queue_id", "ts", "seq", "task_id", F.when(F.col("event_type").isin("error", "purchase"), -1).otherwise(1).alias("delta"))


def queue_backlog_peak(spark, sf_dir):
    return sched.backlog_peak(_moves(spark, sf_dir))


def admission_bounded(spark, sf_dir):
    return sched.admission(_moves(spark, sf_dir), 3).filter("delta > 0").select("queue_id", "seq", "accepted")


def aging_pops(spark, sf_dir):
    rows = _queue(spark, sf_dir)
    pop = F.col("event_type").isin("error", "purchase")
    log = rows.select("queue_id", F.expr("unix_micros(ts) div 1000").alias("at_ms"), "seq", F.when(~pop, F.col("task_id").cast("string")).alias("task_id"), "priority")
    return sched.drain_with_aging(log, 86_400_000, 3)


def worker_telemetry(spark, sf_dir):
    kind = F.col("event_type")
    outcome = F.when(kind == "error", "Failed").when(kind == "signup", "Skipped").otherwise("Done")
    log = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(4)).alias("worker"), outcome.alias("outcome"), F.floor(F.col("value") * 1000).cast("bigint").alias("elapsed_us"))
    return sched.telemetry(log).withColumn("avg_task_ms", F.round("avg_task_ms", 6))


def round_robin(spark, sf_dir):
    return _queue(spark, sf_dir).select("queue_id", "task_id", sched.round_robin(F.col("seq"), 4).alias("worker"))


def fifo_order(spark, sf_dir):
    """Tasks of equal priority leave a queue in the order they came."""
    return sched.pop_order(_queue(spark, sf_dir), F.lit(1)).select("queue_id", "task_id", "place")


def worker_steals(spark, sf_dir):
    """Events as tasks given to a worker by their order and run by the one of their user."""
    log = _queue(spark, sf_dir).select(F.pmod("queue_id", F.lit(4)).alias("worker"), F.pmod("seq", F.lit(4)).alias("home"))
    return sched.steals(log)


#: A visit: views, then clicks, then a purchase, which ends it or begins another; anything else breaks it.
VISIT = {("start", "view"): "looking", ("looking", "view"): "looking", ("start", "click"): "choosing", ("looking", "click"): "choosing", ("choosing", "click"): "choosing", ("choosing", "view"): "looking", ("choosing", "purchase"): "start"}


def session_states(spark, sf_dir):
    """Every event of a user as a message of one session."""
    rows = _queue(spark, sf_dir).select(F.col("queue_id").alias("conn_id"), F.col("seq").alias("msg_no"), F.col("event_type").alias("type"))
    return sessions.session_states(rows, VISIT)


def exchange_states(spark, sf_dir):
    """Logged hits as the messages of one exchange for each query: identities both ways, records, the end of the batch and its confirmation, and on."""
    rows = table(spark, sf_dir, "retrieval_hits").select("qid", "rank", "chunk_id").distinct()
    first = F.struct(F.lit(1).alias("step"), F.to_json(F.struct(F.lit(sessions.IDS).alias("type"))).alias("payload"))
    both = rows.select("qid").distinct().select("qid", F.inline(F.array(first, F.struct(F.lit(2).alias("step"), first["payload"].alias("payload")))))
    sent = rows.select("qid", F.lit(3).alias("step"), F.to_json(F.struct(F.lit(sessions.RECORDS).alias("type"), "rank", "chunk_id")).alias("payload"))
    # queries with an odd number leave out the end of the batch, so their confirmation comes too early
    done = rows.select("qid").distinct().filter("qid % 2 = 0").select("qid", F.lit(4).alias("step"), F.to_json(F.struct(F.lit(sessions.RECORDS).alias("type"), F.lit(True).alias("done"))).alias("payload"))
    ack = rows.select("qid").distinct().select("qid", F.lit(5).alias("step"), F.to_json(F.struct(F.lit(sessions.ACK_STATS).alias("type"))).alias("payload"))
    every = both.unionByName(sent).unionByName(done).unionByName(ack)
    place = F.row_number().over(Window.partitionBy("qid").orderBy("step", "payload")).cast("bigint")
    messages = every.select(F.col("qid").alias("conn_id"), place.alias("msg_no"), sessions.message_type(F.col("payload")).alias("type"))
    return sessions.session_states(messages, sessions.EXCHANGE).groupBy("conn_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if(~F.col("allowed")).alias("refused"), F.max_by("after", "msg_no").alias("state"))


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its file or files."""
    schema = table(spark, sf_dir, "events").schema
    folder = f"{sf_dir}/events.parquet"
    path, files = spark._jvm.org.apache.hadoop.fs.Path(folder), None
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getFileStatus(path).isDirectory():
        return spark.readStream.schema(schema).parquet(folder)
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """All rows that a stream gives for what is there."""
    out = new_folder(spark)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_folder(spark)).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def activation_after_events(spark, sf_dir):
    """A stream of accesses: the activation of each user after every event, with a half-life of a day."""
    accesses = _events_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("memory_id"), F.unix_micros("ts").alias("at_us"))
    found = _drained(spark, activation_stream(accesses, rate_of(DAY_S)))
    return found.groupBy("memory_id").agg(F.count(F.lit(1)).alias("accesses"), F.round(F.max_by("activation", F.struct("at_us", "activation")), 6).alias("activation"))


def redelivered_events(spark, sf_dir):
    """A stream in which every event comes twice: each counts once."""
    events = _events_stream(spark, sf_dir)
    twice = events.select("event_id", "user_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    found = _drained(spark, distinct_stream(twice, "ts", ["event_id"]).select("event_id", "user_id"))
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))


def upserted_events(spark, sf_dir):
    """A stream of events as versions of one record for each user and kind: the newest stands."""
    events = _events_stream(spark, sf_dir)
    rows = events.select(F.col("event_type").alias("source"), F.col("user_id").cast("bigint").alias("ident_no"), F.lit(1).alias("page_no"), F.col("event_id").cast("string").alias("text"), F.unix_micros("ts").alias("us"))
    root = new_folder(spark)
    upsert_stream(rows, root, new_folder(spark)).awaitTermination()
    return read_target(spark, root)


def frame_buffered(spark, sf_dir):
    """How many bytes wait after each message when frames come in pieces of 100 bytes, for one connection a question."""
    rows = table(spark, sf_dir, "queries").filter("query is not null").select("qid", "query").distinct()
    framed = rows.select(F.col("qid").cast("string").alias("conn_id"), wire.encode(F.col("query")).alias("f")).withColumn("frame", F.concat("f", "f", "f"))
    starts = F.transform(F.sequence(F.lit(0), ((F.octet_length("frame") - 1) / 100).cast("int")), lambda i: F.struct(i.cast("bigint").alias("seq"), F.substring("frame", i * 100 + 1, F.lit(100)).alias("bytes")))
    got = decode_batch(framed.select("conn_id", F.inline(starts)))
    return got.select(F.col("conn_id").cast("int").alias("qid"), "msg_no", "buffered", F.md5("payload").alias("hash"))


def frame_lengths(spark, sf_dir):
    """The length that each frame's head declares beside the payload's own."""
    rows = table(spark, sf_dir, "queries").filter("query is not null").select("qid", "query").distinct()
    return rows.select("qid", wire.declared_length(wire.encode(F.col("query"))).alias("declared"), F.octet_length("query").cast("bigint").alias("own"))


def json_props(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return rows.groupBy("event_type").agg(F.count("p.k").alias("n"), F.sum("p.k").cast("bigint").alias("k_sum"), F.max("p.k").alias("k_max"))


def frame_roundtrip(spark, sf_dir):
    """Logged hits as JSON frames, each cut in two pieces and decoded again."""
    rows = table(spark, sf_dir, "retrieval_hits").select("qid", "rank", "chunk_id", "text").distinct()
    payload = F.to_json(F.struct(F.lit("RECORD").alias("type"), "rank", "chunk_id", "text"), {"ignoreNullFields": "false"})
    framed = rows.select(F.col("qid").cast("string").alias("conn_id"), "rank", "chunk_id", wire.encode(payload).alias("frame"))
    numbered = framed.withColumn("n", F.row_number().over(Window.partitionBy("conn_id").orderBy("rank", "chunk_id", "frame")))
    half = F.octet_length("frame") - 3
    halves = F.array(F.struct((F.col("n") * 2).alias("seq"), F.substring("frame", F.lit(1), half).alias("bytes")), F.struct((F.col("n") * 2 + 1).alias("seq"), F.substring("frame", half + 1, F.lit(3)).alias("bytes")))
    pieces = numbered.select("conn_id", F.inline(halves))
    got = decode_batch(pieces).withColumn("m", F.from_json("payload", "type string, rank int, chunk_id bigint, text string"))
    return got.select(F.col("conn_id").cast("int").alias("qid"), "msg_no", "m.rank", "m.chunk_id", F.md5("m.text").alias("hash"))


QUERIES = {
    f.__name__: f
    for f in (
        sync_missing, sync_ids_only, sync_stats, sync_merged, sync_second_pass, graph_counts, graph_degree, graph_neighbors, graph_khop2, graph_relevance, dag_levels, dag_status, dag_problems,
        dag_timings, dag_critical_path, dag_ready, dag_cancel, dag_summary, priority_order, fifo_order, aging_once, queue_backlog_peak, admission_bounded, aging_pops, worker_telemetry, worker_steals, round_robin, session_states,
        exchange_states, activation_after_events, redelivered_events, upserted_events, json_props, frame_roundtrip, frame_buffered, frame_lengths,
    )
}

_US = "epoch_us(CAST(CASE WHEN regexp_matches(created_at, '[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?$') THEN created_at || 'Z' ELSE created_at END AS TIMESTAMPTZ))"
_LAST = "SELECT DISTINCT ON (source, chunk_id) source, chunk_id AS ident_no, page_no, text, us FROM (SELECT *, {u} AS us FROM {t} WHERE source IS NOT NULL AND chunk_id IS NOT NULL) ORDER BY source, chunk_id, us DESC NULLS LAST, text DESC NULLS LAST, page_no DESC NULLS LAST"
_NEWER = "({0}.text IS DISTINCT FROM {1}.text AND coalesce({0}.us > {1}.us, {0}.us IS NOT NULL AND {1}.us IS NULL))"
_AB = f"WITH a AS ({_LAST.format(u=_US, t='replica_a')}), b AS ({_LAST.format(u=_US, t='replica_b')})"
_OUT = "CASE WHEN {1}.source IS NULL THEN 'added' WHEN " + _NEWER + " THEN 'updated' ELSE 'skipped' END"
_NB = f"""nb AS (SELECT coalesce(b.source, a.source) AS source, coalesce(b.ident_no, a.ident_no) AS ident_no, CASE WHEN b.source IS NULL THEN a.page_no ELSE b.page_no END AS page_no,
 CASE WHEN b.source IS NULL OR (a.source IS NOT NULL AND {_NEWER.format("a", "b")}) THEN a.text ELSE b.text END AS text, CASE WHEN b.source IS NULL OR (a.source IS NOT NULL AND {_NEWER.format("a", "b")}) THEN a.us ELSE b.us END AS us
 FROM b FULL JOIN a ON a.source = b.source AND a.ident_no = b.ident_no)"""
_COUNT = "count(*) FILTER (o <> 'skipped') AS sent, count(*) FILTER (o = 'added') AS added, count(*) FILTER (o = 'updated') AS updated, count(*) FILTER (o = 'skipped') AS skipped"
_E = """e0 AS (SELECT 'N' || n_nationkey AS x, 'R' || n_regionkey AS y FROM nation UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier UNION SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer),
 e AS (SELECT x AS a, y AS b FROM e0 UNION SELECT y, x FROM e0), d AS (SELECT a AS id, count(*) AS degree FROM e GROUP BY a)"""
_T = """n AS (SELECT event_id AS id, CAST(floor(value * 1000) AS BIGINT) AS duration, CASE WHEN event_type = 'error' AND event_id % 19 = 10 THEN 'Failed' ELSE 'Done' END AS outcome FROM events),
 g AS (SELECT (event_id - 1) // 2 AS src, event_id AS dst FROM events WHERE event_id >= 1 UNION SELECT event_id - 2, event_id FROM events WHERE event_id % 5 = 0 AND event_id > 6)"""
_ST = _T + """, hit AS (SELECT id FROM n WHERE outcome = 'Failed' UNION SELECT dst FROM hit JOIN g ON src = id),
 st AS (SELECT n.id, duration, CASE WHEN outcome = 'Done' AND n.id IN (SELECT id FROM hit) THEN 'Skipped' ELSE outcome END AS outcome FROM n)"""
_TM = _ST + """, k AS (SELECT id, duration FROM st WHERE outcome = 'Done'), ge AS (SELECT src, dst FROM g WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)),
 f AS (SELECT id, 0::BIGINT AS es FROM k WHERE id NOT IN (SELECT dst FROM ge) UNION SELECT ge.dst, f.es + k.duration FROM f JOIN k ON k.id = f.id JOIN ge ON ge.src = f.id),
 fw AS (SELECT f.id, any_value(k.duration) AS duration, max(es) AS es, max(es) + any_value(k.duration) AS ef FROM f JOIN k ON k.id = f.id GROUP BY f.id), mx AS (SELECT max(ef) AS total FROM fw),
 bk AS (SELECT id, total AS lf FROM k CROSS JOIN mx WHERE id NOT IN (SELECT src FROM ge) UNION SELECT ge.src, bk.lf - k.duration FROM bk JOIN k ON k.id = bk.id JOIN ge ON ge.dst = bk.id),
 tm AS (SELECT fw.id, duration, es, ef, min(lf) - duration AS ls, min(lf) AS lf, greatest(min(lf) - duration - es, 0) AS slack FROM fw JOIN bk ON bk.id = fw.id GROUP BY fw.id, duration, es, ef)"""
_Q = """q AS (SELECT user_id AS queue_id, event_id AS task_id, CASE WHEN event_type IN ('signup', 'purchase') THEN 2 WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS priority,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts, event_type, value, CASE WHEN event_type IN ('error', 'purchase') THEN -1 ELSE 1 END AS delta FROM events)"""

SQL = {
    "sync_missing": f"{_AB}, j AS (SELECT a.source, a.ident_no, {_OUT.format('a', 'b')} AS outcome FROM a LEFT JOIN b ON a.source = b.source AND a.ident_no = b.ident_no) SELECT * FROM j WHERE outcome <> 'skipped'",
    "sync_ids_only": f"{_AB} SELECT source, ident_no FROM a EXCEPT SELECT source, ident_no FROM b",
    "sync_stats": f"{_AB}, {_NB}, x AS (SELECT {_OUT.format('a', 'b')} AS o FROM a LEFT JOIN b ON a.source = b.source AND a.ident_no = b.ident_no), y AS (SELECT {_OUT.format('nb', 'a')} AS o FROM nb LEFT JOIN a ON a.source = nb.source AND a.ident_no = nb.ident_no) SELECT 'a_to_b' AS direction, {_COUNT} FROM x UNION ALL SELECT 'b_to_a', {_COUNT} FROM y",
    "sync_merged": f"{_AB}, {_NB} SELECT source, ident_no, page_no, md5(text) AS hash, us FROM nb",
    "sync_second_pass": "SELECT unnest(['a_to_b', 'b_to_a']) AS direction, 0::BIGINT AS sent, 0::BIGINT AS added, 0::BIGINT AS updated",
    "graph_counts": f"WITH {_E} SELECT (SELECT count(*) FROM d) AS node_count, (SELECT count(*) // 2 FROM e) AS edge_count",
    "graph_degree": f"WITH {_E} SELECT id, degree FROM d",
    "graph_neighbors": f"WITH {_E} SELECT b AS id FROM e WHERE a = 'N3'",
    "graph_khop2": f"WITH {_E}, one AS (SELECT b AS id FROM e WHERE a = 'R1'), two AS (SELECT DISTINCT b AS id FROM one JOIN e ON e.a = one.id WHERE b <> 'R1' AND b NOT IN (SELECT id FROM one)) SELECT id, 1::BIGINT AS hops FROM one UNION ALL SELECT id, 2::BIGINT FROM two",
    "graph_relevance": f"WITH {_E} SELECT id, round(degree / (SELECT max(degree) FROM d), 6) AS relevance FROM d",
    "dag_levels": f"WITH RECURSIVE {_T}, l AS (SELECT id, 0::BIGINT AS level FROM n WHERE id NOT IN (SELECT dst FROM g) UNION SELECT dst, level + 1 FROM l JOIN g ON src = id) SELECT id, max(level) AS level FROM l GROUP BY id",
    "dag_status": f"WITH RECURSIVE {_ST} SELECT id, outcome FROM st",
    "dag_problems": f"WITH {_T}, w AS (SELECT src, dst, 'repeated' AS problem FROM g WHERE dst % 1000 = 7 UNION SELECT dst, src, 'not older' FROM g WHERE dst % 1000 = 9) SELECT * FROM w",
    "dag_timings": f"WITH RECURSIVE {_TM} SELECT id, duration, es, ef, ls, lf, slack, slack = 0 AS critical FROM tm",
    "dag_critical_path": f"""WITH RECURSIVE {_TM}, s AS (SELECT id, es, ef FROM tm WHERE id NOT IN (SELECT src FROM ge) ORDER BY ef DESC, id LIMIT 1),
 p AS (SELECT id, es, 0::BIGINT AS back FROM s UNION ALL SELECT t.id, t.es, back + 1 FROM p JOIN LATERAL (SELECT tm.id, tm.es FROM ge JOIN tm ON tm.id = ge.src WHERE ge.dst = p.id AND tm.slack = 0 AND tm.ef = p.es AND tm.ef > 0 ORDER BY tm.id LIMIT 1) t ON true)
SELECT id, max(back) OVER () - back AS place, (SELECT ef FROM s) AS total_us FROM p""",
    "priority_order": f"WITH {_Q} SELECT queue_id, task_id, row_number() OVER (PARTITION BY queue_id ORDER BY priority DESC, seq) AS place FROM q",
    "aging_once": f"""WITH {_Q}, w AS (SELECT *, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) // 1000 AS waited FROM q), p AS (SELECT *, CAST(priority + least(waited // 86400000, 3) AS BIGINT) AS effective FROM w)
SELECT queue_id, task_id, effective, row_number() OVER (PARTITION BY queue_id ORDER BY effective DESC, seq) AS place FROM p""",
    "queue_backlog_peak": f"WITH {_Q}, t AS (SELECT queue_id, sum(delta) OVER (PARTITION BY queue_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS total FROM q) SELECT queue_id, CAST(greatest(max(total), 0) AS BIGINT) AS peak_pending FROM t GROUP BY queue_id",
    "admission_bounded": f"""WITH RECURSIVE {_Q}, r AS (SELECT queue_id, seq, delta, CASE WHEN delta > 0 THEN 1 ELSE 0 END AS size, delta > 0 AS accepted FROM q WHERE seq = 1
 UNION ALL SELECT q.queue_id, q.seq, q.delta, CASE WHEN q.delta > 0 THEN least(3, r.size + 1) ELSE greatest(0, r.size - 1) END, q.delta > 0 AND r.size < 3 FROM r JOIN q ON q.queue_id = r.queue_id AND q.seq = r.seq + 1)
SELECT queue_id, seq, accepted FROM r WHERE delta > 0""",
    "worker_telemetry": """WITH l AS (SELECT user_id % 4 AS worker, CASE event_type WHEN 'error' THEN 'Failed' WHEN 'signup' THEN 'Skipped' ELSE 'Done' END AS o, CAST(floor(value * 1000) AS BIGINT) AS us FROM events),
 s AS (SELECT worker, count(*) FILTER (o = 'Done') AS done, count(*) FILTER (o = 'Failed') AS failed, count(*) FILTER (o = 'Skipped') AS skipped, 0::BIGINT AS rejected, CAST(coalesce(sum(us) FILTER (o = 'Done'), 0) AS BIGINT) AS total_us FROM l GROUP BY worker)
SELECT *, round(coalesce(total_us / nullif(done, 0) / 1000.0, 0), 6) AS avg_task_ms FROM s""",
    "round_robin": f"WITH {_Q} SELECT queue_id, task_id, seq % 4 AS worker FROM q",
    "dag_ready": f"WITH {_T} SELECT id FROM n WHERE id NOT IN (SELECT dst FROM g)",
    "dag_cancel": f"WITH {_T} SELECT id, CASE WHEN id % 3 = 0 THEN 'Skipped' ELSE outcome END AS outcome FROM n",
    "dag_summary": f"""WITH {_T}, o AS (SELECT 'before' AS moment, CASE WHEN id % 3 = 0 THEN 'Pending' ELSE outcome END AS o FROM n UNION ALL SELECT 'after', CASE WHEN id % 3 = 0 THEN 'Skipped' ELSE outcome END FROM n)
SELECT moment, count(*) AS node_count, count(*) FILTER (o = 'Done') AS done, count(*) FILTER (o = 'Failed') AS failed, count(*) FILTER (o = 'Skipped') AS skipped, count(*) FILTER (o = 'Pending') AS pending, count(*) FILTER (o = 'Pending') = 0 AS finished FROM o GROUP BY moment""",
    "fifo_order": f"WITH {_Q} SELECT queue_id, task_id, seq AS place FROM q",
    "worker_steals": f"""WITH {_Q}, l AS (SELECT queue_id % 4 AS worker, seq % 4 AS home FROM q), e AS (SELECT worker, count(*) AS executed, count(*) FILTER (home <> worker) AS stolen FROM l GROUP BY worker), o AS (SELECT home AS worker, count(*) AS lost FROM l WHERE home <> worker GROUP BY home)
SELECT coalesce(e.worker, o.worker) AS worker, coalesce(executed, 0) AS executed, coalesce(stolen, 0) AS stolen, coalesce(lost, 0) AS lost FROM e FULL JOIN o ON e.worker = o.worker""",
    "session_states": f"""WITH RECURSIVE {_Q}, d AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{t}', '{b}')" for (a, t), b in VISIT.items())}) v(before, kind, after)),
 s AS (SELECT queue_id, seq, event_type, 'start' AS before, coalesce((SELECT after FROM d WHERE d.before = 'start' AND kind = event_type), 'broken') AS after FROM q WHERE seq = 1
  UNION ALL SELECT q.queue_id, q.seq, q.event_type, s.after, coalesce(d.after, 'broken') FROM s JOIN q ON q.queue_id = s.queue_id AND q.seq = s.seq + 1 LEFT JOIN d ON d.before = s.after AND d.kind = q.event_type)
SELECT queue_id AS conn_id, seq AS msg_no, event_type AS type, before, after, after <> 'broken' AS allowed FROM s""",
    "exchange_states": "SELECT qid AS conn_id, count(*) + CASE WHEN qid % 2 = 0 THEN 4 ELSE 3 END AS messages, CASE WHEN qid % 2 = 0 THEN 0 ELSE 1 END::BIGINT AS refused, CASE WHEN qid % 2 = 0 THEN 'receiving' ELSE 'broken' END AS state FROM (SELECT DISTINCT qid, rank, chunk_id FROM retrieval_hits) GROUP BY qid",
    "activation_after_events": f"""WITH RECURSIVE {_Q}, c AS (SELECT queue_id, count(*) AS n FROM q GROUP BY queue_id), o AS (SELECT queue_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY queue_id ORDER BY ts) AS i FROM q),
 a AS (SELECT queue_id, i, us, 0.1::DOUBLE AS v FROM o WHERE i = 1 UNION ALL SELECT o.queue_id, o.i, o.us, least(1.0, a.v * exp(-(ln(2) / 86400.0) * greatest(o.us - a.us, 0) / 1e6) + 0.1) FROM a JOIN o ON o.queue_id = a.queue_id AND o.i = a.i + 1)
SELECT CAST(a.queue_id AS VARCHAR) AS memory_id, n AS accesses, round(v, 6) AS activation FROM a JOIN c ON c.queue_id = a.queue_id AND c.n = a.i""",
    "redelivered_events": "SELECT user_id, count(DISTINCT event_id) AS events FROM events GROUP BY user_id",
    "upserted_events": "SELECT DISTINCT ON (event_type, user_id) event_type AS source, CAST(user_id AS BIGINT) AS ident_no, 1 AS page_no, CAST(event_id AS VARCHAR) AS text, epoch_us(ts) AS us FROM events ORDER BY event_type, user_id, ts DESC, CAST(event_id AS VARCHAR) DESC",
    "frame_buffered": """WITH r AS (SELECT DISTINCT qid, query, strlen(query) + 4 AS n FROM queries WHERE query IS NOT NULL), m AS (SELECT *, unnest([1, 2, 3]) AS k FROM r)
SELECT qid, CAST(k AS BIGINT) AS msg_no, CAST(least(CAST(ceil(k * n / 100.0) AS BIGINT) * 100, 3 * n) - (least(CAST(ceil(k * n / 100.0) AS BIGINT) * 100, 3 * n) // n) * n AS INTEGER) AS buffered, md5(query) AS hash FROM m""",
    "frame_lengths": "SELECT DISTINCT qid, CAST(strlen(query) AS BIGINT) AS declared, CAST(strlen(query) AS BIGINT) AS own FROM queries WHERE query IS NOT NULL",
    "aging_pops": f"""WITH RECURSIVE {_Q}, e AS (SELECT queue_id, seq, epoch_us(ts) // 1000 AS ms, CASE WHEN delta > 0 THEN CAST(task_id AS VARCHAR) END AS task, priority AS p FROM q),
 r AS (SELECT DISTINCT queue_id, 0::BIGINT AS seq, CAST([] AS STRUCT(o BIGINT, s BIGINT, k VARCHAR, p BIGINT, g BIGINT, t BIGINT)[]) AS w, 0::BIGINT AS n, CAST(NULL AS VARCHAR) AS took FROM e
  UNION ALL
  SELECT queue_id, seq, CASE WHEN task IS NOT NULL THEN list_append(w, {{'o': -p, 's': seq, 'k': task, 'p': p, 'g': 0, 't': ms}}) ELSE list_filter(aged, lambda x: x.s <> best.s) END,
   n + CASE WHEN task IS NULL AND best IS NOT NULL THEN 1 ELSE 0 END, CASE WHEN task IS NULL THEN best.k END
  FROM (SELECT *, list_aggregate(aged, 'min') AS best FROM (SELECT e.queue_id, e.seq, e.ms, e.task, e.p, r.w, r.n,
   list_transform(r.w, lambda x: CASE WHEN (e.ms - x.t) // 86400000 >= 1 THEN {{'o': -(x.p + least(3, x.g + (e.ms - x.t) // 86400000)), 's': x.s, 'k': x.k, 'p': x.p, 'g': least(3, x.g + (e.ms - x.t) // 86400000), 't': e.ms}} ELSE x END) AS aged
   FROM r JOIN e ON e.queue_id = r.queue_id AND e.seq = r.seq + 1)))
SELECT queue_id, n AS pop_no, took AS task_id FROM r WHERE took IS NOT NULL""",
    "json_props": "WITH p AS (SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS k_sum, max(k) AS k_max FROM p GROUP BY event_type",
    "frame_roundtrip": "WITH r AS (SELECT DISTINCT qid, rank, chunk_id, text FROM retrieval_hits) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank, chunk_id, text NULLS FIRST) AS msg_no, rank, chunk_id, md5(text) AS hash FROM r",
}
