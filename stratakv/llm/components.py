"""Connected components of a graph given as edges, by alternating large and small stars.

Each round is two joins and two grouped minima over the edges; edges are distributed throughout, and every round is a
written table, so neither links nor components ever meet in one place. The number of rounds grows with the logarithm of
the longest path; a star of any size takes two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workdir import Table


def _by_mins(edges: DataFrame, name: str) -> tuple[DataFrame, Table]:
    """Edges (a, b) with m, the least neighbour of a. The minima are a written table, so that a node of many edges can be
    split in the join."""
    mins = Table(edges.groupBy("a").agg(F.min("b").alias("m")), name)
    return edges.join(mins.df, "a"), mins


def components(edges: DataFrame, most_rounds: int = 60) -> Table:
    """(node, label) of every node with an edge to another: label is the least node of its component. edges: (a, b), in
    any direction, with repeats and loops."""
    now = Table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = now.df.unionByName(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joined, mins = _by_mins(both, "large")
        large = Table(joined.filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).filter("a <> b").distinct(), "edges")
        mins.drop()
        now.drop()
        joined, mins = _by_mins(large.df, "small")
        out = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        now = Table(out, "edges")
        mins.drop()
        large.drop()
        mark = tuple(now.df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    out = Table(now.df.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.df.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()), "labels")
    now.drop()
    return out
