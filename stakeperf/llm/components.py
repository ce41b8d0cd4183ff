"""Connected components of a graph too large for one machine.

Alternating large-star and small-star steps: each step replaces the links of a
node by links to the smallest id around it, with one partial-aggregated minimum
and one join.  The minimum is written first, so that both sides of the join are
plain shuffles and adaptive execution can split a hub's rows; no task gathers a
component.  Each round is written to the
shared folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeperf.llm.common import written


def _settled(edges: DataFrame) -> bool:
    """Whether the links are stars already: no node has two smaller ids, or is both centre and leaf."""
    roles = edges.selectExpr("hi node", "1 up", "0 down").unionAll(edges.selectExpr("lo node", "0 up", "1 down"))
    nodes = roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or (up = 1 and down = 1)").count() == 0


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.selectExpr("hi u", "lo v").unionAll(edges.selectExpr("lo u", "hi v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    least = written(least, "least")
    return both.where("v > u").join(least, "u").selectExpr("v hi", "m lo").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    least = written(least, "least")
    moved = edges.join(least, "hi").where("lo <> m").selectExpr("lo hi", "m lo")
    return moved.unionAll(least.selectExpr("hi", "m lo")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; component: the smallest
    id reachable.  Repeated links, both directions and loops are allowed; nulls
    and empty tables give no rows."""
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    edges = written(edges, "links")
    while not _settled(edges):
        edges = written(_small_star(_large_star(edges)), "stars")
    # a star forest: each node but the roots has one row
    return edges.selectExpr("hi node", "lo component").unionAll(edges.selectExpr("lo node", "lo component").distinct())
