"""The undirected entity graph: edges in both directions, and the nodes, also isolated ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut_lineage


@dataclass(frozen=True)
class Graph:
    """edges(a, b) holds every edge both ways, nodes(id) every node."""

    edges: DataFrame
    nodes: DataFrame

    def counts(self) -> DataFrame:
        """One row (node_count, edge_count)."""
        return self.nodes.agg(F.count(F.lit(1)).alias("node_count")).join(self.edges.agg((F.count(F.lit(1)) / 2).cast("bigint").alias("edge_count")), F.lit(True))

    def degrees(self) -> DataFrame:
        """(id, degree); isolated nodes have 0."""
        found = self.edges.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
        return self.nodes.join(found, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))

    def relevance(self) -> DataFrame:
        """(id, relevance): the degree over the greatest degree, 0 if there are no edges."""
        degrees = self.degrees()
        most = degrees.agg(F.max("degree").alias("m")).first()["m"] or 0
        return degrees.select("id", (F.col("degree") / most if most else F.lit(0.0)).cast("double").alias("relevance"))

    def neighbors(self, node: str) -> DataFrame:
        """(id); none for an unknown node."""
        return self.edges.filter(F.col("a") == node).select(F.col("b").alias("id"))

    def k_hop(self, node: str, depth: int = 2) -> DataFrame:
        """(id, hops) of all nodes within `depth` edges of a node, itself left out.

        One join for each hop, with the nodes seen so far cut off; lineage is cut at each hop.
        """
        if depth < 1:
            raise ValueError("depth must be at least 1")
        spark = self.edges.sparkSession
        seen = front = spark.createDataFrame([(node, 0)], "id string, hops int")
        for hop in range(1, depth + 1):
            reached = self.edges.join(front.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
            front = cut_lineage(reached.join(seen, "id", "left_anti").withColumn("hops", F.lit(hop)))
            if front.isEmpty():
                break
            seen = seen.unionByName(front)
        return seen.filter("hops > 0")


def build(edges: DataFrame, nodes: DataFrame | None = None) -> Graph:
    """A graph of edges (a, b) and more nodes (id). Repeated edges count once, either way round.

    Empty or null names and edges from a node to itself fail when the plan runs.
    """
    bad = F.col("a").isNull() | F.col("b").isNull() | (F.col("a") == "") | (F.col("b") == "") | (F.col("a") == F.col("b"))
    checked = edges.select(F.when(bad, F.raise_error(F.lit("an edge needs two different, named nodes")).cast("string")).otherwise(F.col("a")).alias("a"), "b")
    once = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = both.select(F.col("a").alias("id")).distinct()
    if nodes is not None:
        empty = F.col("id").isNull() | (F.col("id") == "")
        extra = nodes.select(F.when(empty, F.raise_error(F.lit("a node needs a name")).cast("string")).otherwise(F.col("id")).alias("id"))
        named = named.unionByName(extra).distinct()
    return Graph(both, named)
