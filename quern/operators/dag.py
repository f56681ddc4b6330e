"""Analysis of task graphs: levels, failures passed on, slack and the critical path.

A graph of at most `whole` nodes and edges together (counted first, so the bound is checked) is walked by one task with array
operations. A larger one is cut into ranges of ids of about that size, which are walked one after the other in the order of the
ids; what crosses from one range to another is joined and combined before it reaches a task. So the number of jobs depends on the
size of the graph and not on its depth. Where an edge leads to a lower id, nodes are first put in order by peeling off those that
nothing waits for; if none is left to peel, there is a cycle. All ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.numbering import numbered_rows
from quern.session import cut_lineage

#: Nodes and edges that one task walks, and the fewest that a range is made of.
WHOLE, LEAST = 1_000_000, 1_024


class _Walk:
    """A graph as arrays: nodes by position in the order of ids, edges grouped by source; edges of other nodes are left out."""

    def __init__(self, ids: np.ndarray, src: np.ndarray, dst: np.ndarray):
        self.ids = np.sort(ids)
        known = np.isin(src, ids) & np.isin(dst, ids)
        src, dst = src[known], dst[known]
        pairs = np.unique(np.stack([np.searchsorted(self.ids, src), np.searchsorted(self.ids, dst)], axis=1), axis=0) if len(src) else np.empty((0, 2), np.int64)
        self.src, self.dst = pairs[:, 0], pairs[:, 1]
        self.begin = np.searchsorted(self.src, np.arange(len(self.ids) + 1))

    def after(self, nodes: np.ndarray) -> np.ndarray:
        """Targets of all edges of some nodes."""
        sizes = self.begin[nodes + 1] - self.begin[nodes]
        return self.dst[np.repeat(self.begin[nodes] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]

    def levels(self) -> np.ndarray:
        """The most edges on any way to each node, -1 on and behind cycles."""
        waits = np.bincount(self.dst, minlength=len(self.ids))
        level, front, at = np.full(len(self.ids), -1), np.flatnonzero(waits == 0), 0
        while len(front):
            level[front] = at
            targets = self.after(front)
            np.subtract.at(waits, targets, 1)
            front = np.unique(targets[waits[targets] == 0])
            at += 1
        return level

    def spread(self, value: np.ndarray, step: Callable[[np.ndarray], np.ndarray], better: np.ufunc, back: bool = False) -> np.ndarray:
        """Carry values along all edges: what a node's `step` makes of its value reaches its targets (its sources, if back)."""
        level = self.levels()
        if (level < 0).any():
            raise ValueError("the graph has a cycle")
        source, target = (self.dst, self.src) if back else (self.src, self.dst)
        rank = -level[source] if back else level[source]
        order = np.argsort(rank, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(rank[order], prepend=rank[order][:1] - 1)), len(order)) if len(order) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            e = order[a:b]
            better.at(value, target[e], step(source[e]))
        return value


def _in_one_task(nodes: DataFrame, edges: DataFrame, run, schema: str) -> DataFrame:
    one = lambda df: df.withColumn("one", F.lit(0)).groupBy("one")
    return one(nodes).cogroup(one(edges)).applyInPandas(lambda n, e: run(n.sort_values("id"), _Walk(n["id"].to_numpy(), e["src"].to_numpy(), e["dst"].to_numpy())), schema)


def _fits(nodes: DataFrame, edges: DataFrame, whole: int) -> bool:
    return nodes.count() + edges.count() <= whole


def _walked(nodes: DataFrame, edges: DataFrame, whole: int, run, schema: str, carry: str, combine: Callable[[str], Column], back: bool = False) -> DataFrame:
    """Rows `schema` of `run` over all nodes (id, ...); a column `met` holds what reached a node from outside its range, or null.

    run(nodes, walk) gets the nodes in the order of ids. `carry` is the column of its result that edges carry, `combine` brings together
    what several of them carry. Edges must lead to higher ids.
    """
    edges, weight = edges.select("src", "dst"), nodes.count() + edges.count()
    parts = -(-weight // max(whole, LEAST))
    if weight <= whole or parts == 1:
        return _in_one_task(nodes.withColumn("met", F.lit(None).cast("bigint")), edges, run, schema)
    places = nodes.select("id").unionByName(edges.select(F.col("dst" if not back else "src").alias("id")))
    bounds = sorted({int(x) for x in places.approxQuantile("id", [i / parts for i in range(1, parts)], 1 / (8 * parts))})
    cuts = list(zip([None, *bounds], [*bounds, None]))
    near, far = ("src", "dst") if back else ("dst", "src")
    done = None
    for low, high in reversed(cuts) if back else cuts:

        def inside(c: str, low=low, high=high) -> Column:
            test = F.lit(True) if low is None else F.col(c) >= low
            return test if high is None else test & (F.col(c) < high)

        here, mine = nodes.filter(inside("id")), edges.filter(inside(near))
        if done is None:
            here = here.withColumn("met", F.lit(None).cast("bigint"))
        else:
            met = mine.filter(~inside(far)).join(done.select(F.col("id").alias(far), carry), far).groupBy(F.col(near).alias("id")).agg(combine(carry).cast("bigint").alias("met"))
            here = here.join(met, "id", "left")
        out = cut_lineage(_in_one_task(here, mine.filter(inside(far)), run, schema))
        done = out if done is None else done.unionByName(out)
    return done


def _peeled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level) by peeling off, level by level, the nodes that nothing waits for. An empty front with nodes left is a cycle.

    What was met so far is kept only for nodes that still wait, so a level costs as much as its own edges.
    """
    edges = cut_lineage(edges.select("src", "dst").distinct())
    waits = cut_lineage(edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n")))
    left, level = nodes.count(), 0
    front = cut_lineage(ready(nodes, edges))
    waiting, found = None, None
    while True:
        size = front.count()
        if not size:
            break
        left -= size
        found = front.withColumn("level", F.lit(level)) if found is None else found.unionByName(front.withColumn("level", F.lit(level)))
        if level % 64 == 63:
            found = cut_lineage(found)
        met = edges.join(front.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("met"))
        if waiting is not None:
            met = met.unionByName(waiting).groupBy("id").agg(F.sum("met").alias("met"))
        state = cut_lineage(met.join(waits, "id"))
        front, waiting = state.filter("met = n").select("id"), state.filter("met < n").select("id", "met")
        level += 1
    if left:
        raise ValueError("the graph has a cycle")
    return found if found is not None else nodes.select("id", F.lit(0).alias("level"))


def _in_order(nodes: DataFrame, edges: DataFrame, whole: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(nodes, edges, names): a graph whose edges lead to higher ids, and the old ids (id, old) if it had to be numbered anew."""
    if _fits(nodes, edges, whole) or edges.filter("src >= dst").isEmpty():
        return nodes, edges, None
    inner = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    names = cut_lineage(numbered_rows(_peeled(nodes.select("id"), inner), [F.col("level"), F.col("id")], "new", 0).select("new", F.col("id").alias("old")))
    other = lambda df, c: df.join(names.select(F.col("old").alias(c), F.col("new").alias(f"new_{c}")), c).drop(c).withColumnRenamed(f"new_{c}", c)
    return cut_lineage(other(nodes, "id")), cut_lineage(other(other(inner.select("src", "dst"), "src"), "dst")), names


def _named(rows: DataFrame, names: DataFrame | None) -> DataFrame:
    return rows if names is None else rows.join(names.withColumnRenamed("new", "id"), "id").drop("id").select(F.col("old").alias("id"), *[c for c in rows.columns if c != "id"])


def problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, problem) of edges that no graph may have: unknown nodes, a node not after its dependency, repeated edges."""
    ids = nodes.select("id")
    unknown = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").unionByName(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti"))
    twice = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    named = lambda df, p: df.select("src", "dst", F.lit(p).alias("problem")).distinct()
    return named(unknown, "unknown node").unionByName(named(edges.filter("src >= dst"), "not older")).unionByName(named(twice, "repeated"))


def ready(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of nodes without dependencies."""
    return nodes.select("id").join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def levels(nodes: DataFrame, edges: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(id, level): the most edges on any way to a node. A cycle raises ValueError."""
    nodes, edges, names = _in_order(nodes.select("id"), edges, whole)

    def run(n: pd.DataFrame, walk: _Walk) -> pd.DataFrame:
        level = walk.levels()
        if (level >= 0).all():
            first = np.nan_to_num(n["met"].to_numpy(np.float64), nan=-1).astype(np.int64) + 1
            level = walk.spread(first, lambda e: first[e] + 1, np.maximum)
        return pd.DataFrame({"id": walk.ids, "level": level})

    out = cut_lineage(_walked(nodes, edges, whole, run, "id bigint, level int", "level", F.max))
    if not out.filter("level < 0").isEmpty():
        raise ValueError("the graph has a cycle")
    return _named(out, names)


def propagate(nodes: DataFrame, edges: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(id, outcome): what a node without its own failure becomes: Skipped if any node before it isn't Done.

    Settled outcomes other than Done stay as they are; a null outcome isn't Done.
    """
    nodes, edges, names = _in_order(nodes.select("id", "outcome"), edges, whole)

    def run(n: pd.DataFrame, walk: _Walk) -> pd.DataFrame:
        done = (n["outcome"] == "Done").to_numpy()
        bad = np.maximum(np.nan_to_num(n["met"].to_numpy(np.float64), nan=0).astype(np.int64), ~done)
        bad = walk.spread(bad, lambda e: bad[e], np.maximum)
        return pd.DataFrame({"id": walk.ids, "outcome": np.where(done & (bad > 0), "Skipped", n["outcome"]), "bad": bad})

    return _named(_walked(nodes, edges, whole, run, "id bigint, outcome string, bad bigint", "bad", F.max).drop("bad"), names)


def cancel(nodes: DataFrame) -> DataFrame:
    """(id, outcome) after the whole graph was cancelled: Pending becomes Skipped."""
    return nodes.select("id", F.when(F.col("outcome") == "Pending", "Skipped").otherwise(F.col("outcome")).alias("outcome"))


def timings(nodes: DataFrame, edges: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(id, duration, es, ef, ls, lf, slack, critical) in microseconds of the Done nodes; none Done gives no rows.

    Only edges between Done nodes count; a duration is end - begin if end > begin > 0, else 0. A cycle fails.
    """
    spent = F.when((F.col("end_us") > F.col("begin_us")) & (F.col("begin_us") > 0), F.col("end_us") - F.col("begin_us")).otherwise(F.lit(0)).cast("bigint")
    done, own, names = _in_order(nodes.filter("outcome = 'Done'").select("id", spent.alias("duration")), edges.select("src", "dst"), whole)

    def forward(n: pd.DataFrame, walk: _Walk) -> pd.DataFrame:
        took = n["duration"].to_numpy()
        es = np.nan_to_num(n["met"].to_numpy(np.float64), nan=0).astype(np.int64)
        es = walk.spread(es, lambda e: es[e] + took[e], np.maximum)
        return pd.DataFrame({"id": walk.ids, "duration": took, "es": es, "ef": es + took})

    early = cut_lineage(_walked(done, own, whole, forward, "id bigint, duration bigint, es bigint, ef bigint", "ef", F.max))
    total = early.agg(F.max("ef").alias("m")).first()["m"] or 0

    def backward(n: pd.DataFrame, walk: _Walk) -> pd.DataFrame:
        took = n["duration"].to_numpy()
        met = n["met"].to_numpy(np.float64)
        lf = np.where(np.isnan(met), total, np.nan_to_num(met)).astype(np.int64)
        lf = walk.spread(lf, lambda e: lf[e] - took[e], np.minimum, back=True)
        es = n["es"].to_numpy()
        slack = np.maximum(lf - took - es, 0)
        return pd.DataFrame({"id": walk.ids, "duration": took, "es": es, "ef": n["ef"], "ls": lf - took, "lf": lf, "slack": slack, "critical": slack == 0})

    schema = "id bigint, duration bigint, es bigint, ef bigint, ls bigint, lf bigint, slack bigint, critical boolean"
    return _named(_walked(early, own, whole, backward, schema, "ls", F.min, back=True), names)


def critical_path_rows(nodes: DataFrame, edges: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(id, place, total_us) of the critical path from its start, place 0, to its end; no rows if nothing is Done.

    The end is the sink of greatest finish, the lowest id of several; each step back takes the lowest critical dependency that
    finishes, later than 0, when the node starts. Each node thus knows its step back, and steps are doubled until the path is whole:
    as many rounds as the logarithm of its length.
    """
    spark = nodes.sparkSession
    table = cut_lineage(timings(nodes, edges, whole))
    inner = edges.join(table.select(F.col("id").alias("dst")), "dst", "left_semi")
    sinks = table.join(inner.select(F.col("src").alias("id")), "id", "left_anti")
    last = sinks.orderBy(F.desc("ef"), "id").select("id", "ef").first()
    if last is None:
        return spark.createDataFrame([], "id bigint, place bigint, total_us bigint")
    starts = table.select(F.col("id").alias("dst"), F.col("es").alias("ef"))
    before = table.filter("critical and ef > 0").select(F.col("id").alias("src"), "ef")
    steps = cut_lineage(edges.select("src", "dst").join(before, "src").join(starts, ["dst", "ef"]).groupBy(F.col("dst").alias("at")).agg(F.min("src").alias("to")))
    path, far = spark.createDataFrame([(last["id"], 0)], "id bigint, back bigint"), 1
    while True:
        more = cut_lineage(path.join(steps, path["id"] == steps["at"]).select(F.col("to").alias("id"), (F.col("back") + far).alias("back")))
        if more.isEmpty():
            break
        path = path.unionByName(more)
        steps = cut_lineage(steps.join(steps.select(F.col("at").alias("to"), F.col("to").alias("then")), "to").select("at", F.col("then").alias("to")))
        far *= 2
    path = cut_lineage(path)
    length = path.agg(F.max("back").alias("m")).first()["m"]
    return path.select("id", (F.lit(length) - F.col("back")).alias("place"), F.lit(last["ef"]).cast("bigint").alias("total_us"))


def critical_path(nodes: DataFrame, edges: DataFrame, whole: int = WHOLE) -> tuple[list[int], int] | None:
    """(node ids from start to end, total microseconds) of critical_path_rows, or None if nothing is Done."""
    rows = critical_path_rows(nodes, edges, whole).orderBy("place").collect()
    return ([r["id"] for r in rows], rows[0]["total_us"]) if rows else None


def summary(nodes: DataFrame) -> DataFrame:
    """One row (node_count, done, failed, skipped, pending, finished)."""
    count = lambda o: F.count_if(F.col("outcome") == o)
    return nodes.agg(F.count(F.lit(1)).alias("node_count"), count("Done").alias("done"), count("Failed").alias("failed"), count("Skipped").alias("skipped"), count("Pending").alias("pending"), (count("Pending") == 0).alias("finished"))
