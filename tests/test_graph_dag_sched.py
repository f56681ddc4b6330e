import random

import pytest
from pyspark.sql import functions as F

from quern.operators import dag, graph, sched

#: A wheel: a hub with six rim nodes in a ring, and a tail of two nodes on one of them.
EDGES = [("hub", f"r{i}") for i in range(6)] + [(f"r{i}", f"r{(i + 1) % 6}") for i in range(6)] + [("r2", "t1"), ("t1", "t2")]


@pytest.fixture(scope="module")
def net(spark):
    twice = EDGES + [("r1", "r0"), ("t2", "t1")]
    return graph.build(spark.createDataFrame(twice, "a string, b string"), spark.createDataFrame([("alone",), ("r4",)], "id string"))


def ids(df):
    return {r["id"] for r in df.collect()}


def test_graph(spark, net):
    assert tuple(net.counts().first()) == (10, 14)
    assert ids(net.neighbors("r2")) == {"hub", "r1", "r3", "t1"} and ids(net.neighbors("x")) == set()
    assert ids(net.k_hop("t1", 1)) == {"r2", "t2"}
    assert {r["id"]: r["hops"] for r in net.k_hop("t2", 3).collect()} == {"t1": 1, "r2": 2, "hub": 3, "r1": 3, "r3": 3}
    assert ids(net.k_hop("x", 2)) == set()
    relevance = {r["id"]: r["relevance"] for r in net.relevance().collect()}
    assert relevance["hub"] == 1 and relevance["r0"] == 0.5 and relevance["t2"] == pytest.approx(1 / 6) and relevance["alone"] == 0
    with pytest.raises(ValueError):
        net.k_hop("hub", 0)
    for bad in (("", "b"), ("a", "a"), (None, "b")):
        with pytest.raises(Exception, match="two different, named"):
            graph.build(spark.createDataFrame([bad], "a string, b string")).counts().collect()
    none = graph.build(spark.createDataFrame([], "a string, b string"), spark.createDataFrame([("n",)], "id string"))
    assert none.relevance().first()["relevance"] == 0


def tasks(spark, durations, edges, outcomes=None):
    nodes = [(i, (outcomes or {}).get(i, "Done"), 1, 1 + d) for i, d in enumerate(durations)]
    return spark.createDataFrame(nodes, "id bigint, outcome string, begin_us bigint, end_us bigint"), spark.createDataFrame(edges, "src bigint, dst bigint")


BOTH = pytest.mark.parametrize("whole", [dag.WHOLE, 0])


@BOTH
def test_chain_and_diamond(spark, whole):
    chain = tasks(spark, [10000, 20000, 5000], [(0, 1), (1, 2)])
    rows = dag.timings(*chain, whole=whole).orderBy("id").collect()
    assert [r["es"] for r in rows] == [0, 10000, 30000] and all(r["slack"] == 0 and r["critical"] for r in rows)
    assert dag.critical_path(*chain, whole=whole) == ([0, 1, 2], 35000)
    diamond = tasks(spark, [10000, 40000, 10000, 5000], [(0, 1), (0, 2), (1, 3), (2, 3)])
    rows = {r["id"]: r for r in dag.timings(*diamond, whole=whole).collect()}
    assert rows[2]["slack"] == 30000 and not rows[2]["critical"] and dag.critical_path(*diamond, whole=whole) == ([0, 1, 3], 55000)
    zero = tasks(spark, [40000, 20000, 60000, 0, 0], [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)])
    assert dag.critical_path(*zero, whole=whole) == ([0, 2, 3, 4], 100000)


@BOTH
def test_failures(spark, whole):
    nodes, edges = tasks(spark, [1, 1, 1, 1], [(0, 1), (1, 2)], {0: "Failed", 2: "Rejected"})
    got = {r["id"]: r["outcome"] for r in dag.propagate(nodes, edges, whole).collect()}
    assert got == {0: "Failed", 1: "Skipped", 2: "Rejected", 3: "Done"}
    none = tasks(spark, [1, 1], [(0, 1)], {0: "Failed", 1: "Skipped"})
    assert dag.timings(*none, whole=whole).count() == 0 and dag.critical_path(*none, whole=whole) is None
    assert {r["outcome"] for r in dag.cancel(nodes.withColumn("outcome", F.lit("Pending"))).collect()} == {"Skipped"}
    assert dag.summary(nodes).first()["failed"] == 1


@BOTH
def test_cycles(spark, whole):
    nodes, edges = tasks(spark, [1, 1, 1], [(0, 1), (1, 2), (2, 1)])
    with pytest.raises(ValueError):
        dag.levels(nodes, edges, whole)
    assert {tuple(r) for r in dag.problems(nodes, edges.unionByName(edges.limit(1)).unionByName(spark.createDataFrame([(0, 42)], "src bigint, dst bigint"))).collect()} == {
        (2, 1, "not older"), (0, 1, "repeated"), (0, 42, "unknown node"),
    }


@BOTH
def test_a_null_outcome_is_not_done(spark, whole):
    nodes, edges = tasks(spark, [1, 1, 1], [(0, 1), (1, 2)], {0: None})
    assert {r["id"]: r["outcome"] for r in dag.propagate(nodes, edges, whole).collect()} == {0: None, 1: "Skipped", 2: "Skipped"}


@BOTH
def test_edges_to_lower_ids(spark, whole):
    """Without a cycle such a graph is numbered anew and has all its results under the old ids."""
    nodes, edges = tasks(spark, [5, 7, 11, 2], [(3, 1), (1, 0), (3, 2), (2, 0)], {3: "Done"})
    assert {r["id"]: r["level"] for r in dag.levels(nodes, edges, whole).collect()} == {3: 0, 1: 1, 2: 1, 0: 2}
    assert dag.critical_path(nodes, edges, whole) == ([3, 2, 0], 18)
    failed, _ = tasks(spark, [1] * 4, [], {3: "Failed"})
    assert {r["outcome"] for r in dag.propagate(failed, edges, whole).filter("id <> 3").collect()} == {"Skipped"}


def long_path(spark, n):
    nodes = spark.range(n).select("id", F.lit("Done").alias("outcome"), F.lit(1).cast("bigint").alias("begin_us"), F.lit(3).cast("bigint").alias("end_us"))
    return nodes, spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def test_depth_costs_no_jobs(spark):
    """Beyond the bound a path of 5,000 nodes is walked in ranges, its critical path found by doubling, and a cycle told at once."""
    nodes, edges = long_path(spark, 5000)
    assert dag.levels(nodes, edges, 0).agg(F.max("level")).first()[0] == 4999
    path, total = dag.critical_path(nodes, edges, 0)
    assert path == list(range(5000)) and total == 10_000
    failed = nodes.withColumn("outcome", F.when(F.col("id") == 10, "Failed").otherwise("Done"))
    assert dag.propagate(failed, edges, 0).filter("outcome = 'Skipped'").count() == 4989
    with pytest.raises(ValueError):
        dag.levels(nodes, edges.unionByName(spark.createDataFrame([(4999, 0)], "src bigint, dst bigint")), 0)


def test_both_ways_agree(spark):
    rng = random.Random(5)
    n = 2000
    edges = sorted({(rng.randrange(max(0, i - 300), i), i) for i in range(1, n) for _ in range(2)})
    nodes, links = tasks(spark, [rng.randrange(100) for _ in range(n)], edges, {i: "Failed" for i in range(0, n, 97)})
    a, b = (sorted(map(tuple, dag.timings(nodes, links, whole=w).collect())) for w in (dag.WHOLE, 0))
    for f in (dag.levels, dag.propagate):
        assert sorted(map(tuple, f(nodes, links).collect())) == sorted(map(tuple, f(nodes, links, 0).collect()))
    assert dag.critical_path(nodes, links) == dag.critical_path(nodes, links, 0)
    assert a == b and all(r[3] == r[2] + r[1] and r[5] == r[4] + r[1] for r in a)


def test_priorities(spark):
    def order(rows, interval, cap, now):
        df = spark.createDataFrame(rows, "queue_id string, task_id string, priority int, seq bigint, at_ms bigint")
        eff = sched.effective_priority(F.col("priority"), F.lit(now) - F.col("at_ms"), interval, cap)
        return [r["task_id"] for r in sched.pop_order(df, eff).orderBy("place").collect()]

    assert order([("q", "low", 0, 1, 0), ("q", "high", 2, 2, 0)], 0, 0, 100) == ["high", "low"]
    assert order([("q", "low", 0, 1, 0), ("q", "high", 2, 2, 20)], 5, 2, 20) == ["low", "high"]
    assert order([("q", "a", 0, 1, 0), ("q", "b", 0, 2, 0), ("q", "c", 2, 3, 50)], 1, 1, 50) == ["c", "a", "b"]


def moves(spark, rows):
    return spark.createDataFrame([(q, 3600 * t, i, d) for i, (q, t, d) in enumerate(rows)], "queue_id string, s bigint, seq bigint, delta int").withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_admission_golden(spark):
    log = moves(spark, [("q", 0, 1), ("q", 1, 1), ("q", 2, 1), ("q", 3, -1), ("q", 4, 1)])
    assert [r["accepted"] for r in sched.admission(log, 2).orderBy("seq").collect()] == [True, True, False, None, True]
    assert all(r["accepted"] for r in sched.admission(log.filter("delta > 0"), 0).collect())
    with pytest.raises(ValueError):
        sched.admission(log, -1)


def test_admission_and_backlog_against_loops(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abb"), t, rng.choice((1, 1, -1))) for t in range(300)]
    log = moves(spark, rows)
    want, size, total, peak = [], {}, {}, {}
    for q, _, d in rows:
        have = size.get(q, 0)
        want.append((have < 3) if d > 0 else None)
        size[q] = have + (have < 3) if d > 0 else max(0, have - 1)
        total[q] = total.get(q, 0) + d
        peak[q] = max(peak.get(q, 0), total[q])
    assert [r["accepted"] for r in sched.admission(log, 3).orderBy("seq").collect()] == want
    assert {r["queue_id"]: r["peak_pending"] for r in sched.backlog_peak(log).collect()} == peak


def test_aging_pops(spark):
    rows = [("q", 0, 1, "low", 0), ("q", 19, 2, "high", 2), ("q", 20, 3, None, 0), ("q", 21, 4, None, 0), ("q", 22, 5, None, 0)]
    log = spark.createDataFrame(rows, "queue_id string, at_ms bigint, seq bigint, task_id string, priority int")
    assert [(r["pop_no"], r["task_id"]) for r in sched.drain_with_aging(log, 5, 2).orderBy("pop_no").collect()] == [(1, "low"), (2, "high")]
    assert [r["task_id"] for r in sched.drain_with_aging(log, 0, 2).orderBy("pop_no").collect()] == ["high", "low"]


def test_aging_pops_against_a_loop(spark):
    """Every waiting task is looked at in each pop, as the rule says it."""
    rng = random.Random(8)
    rows, at = [], 0
    for i in range(400):
        at += rng.randrange(4)
        rows.append(("q", at, i, None if rng.random() < 0.45 else f"t{i}", rng.randrange(4)))
    waiting, want = [], []
    for _, at, seq, task, priority in rows:
        if task is not None:
            waiting.append([priority, seq, at, 0, task])
            continue
        for w in waiting:
            if (at - w[2]) // 7 >= 1:
                w[3], w[2] = min(3, w[3] + (at - w[2]) // 7), at
        if waiting:
            best = min(waiting, key=lambda w: (-(w[0] + w[3]), w[1]))
            waiting.remove(best)
            want.append(best[4])
    log = spark.createDataFrame(rows, "queue_id string, at_ms bigint, seq bigint, task_id string, priority int")
    assert [r["task_id"] for r in sched.drain_with_aging(log, 7, 3).orderBy("pop_no").collect()] == want


def test_steals(spark):
    log = spark.createDataFrame([(0, 0), (1, 0), (1, 0), (1, None), (2, 1)], "worker int, home int")
    assert {tuple(r) for r in sched.steals(log).collect()} == {(0, 1, 0, 2), (1, 3, 2, 1), (2, 1, 1, 0)}


def test_telemetry(spark):
    log = spark.createDataFrame([(0, "Done", 2000), (0, "Done", 2000), (2, "Done", 2000), (1, "Failed", 9), (1, "Skipped", 9)], "worker int, outcome string, elapsed_us bigint")
    got = {r["worker"]: (r["done"], r["failed"], r["avg_task_ms"]) for r in sched.telemetry(log).collect()}
    assert got == {0: (2, 0, 2.0), 2: (1, 0, 2.0), 1: (0, 1, 0.0)}
    with pytest.raises(ValueError):
        sched.round_robin(F.lit(1), 0)
