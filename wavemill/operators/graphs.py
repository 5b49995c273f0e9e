"""Worst-case paths on weighted acyclic graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.session import written


def longest_paths(edges: DataFrame, source: str, target: str, weight: str, rounds: int = 100) -> DataFrame:
    """``source, target, cost, hops``: for each pair with a path, the greatest sum of weights and the hops of that path (the most, if several tie).

    Paths grow by an edge a round, and only the best of each pair goes on, so a
    round is one join and one aggregation. A graph that still grows after
    ``rounds`` has a cycle, which is an error. Of parallel edges the heaviest
    counts; edges with a null are left out.
    """
    e = written(edges.select(F.col(source).alias("a"), F.col(target).alias("b"), F.col(weight).cast("double").alias("w")).dropna().groupBy("a", "b").agg(F.max("w").alias("w")), "edges")
    front = e.select("a", "b", F.col("w").alias("cost"), F.lit(1).alias("hops"))
    found = front
    for _ in range(rounds):
        step = front.join(e.select(F.col("a").alias("b"), F.col("b").alias("c"), "w"), "b")
        front = written(step.select("a", F.col("c").alias("b"), (F.col("cost") + F.col("w")).alias("cost"), (F.col("hops") + 1).alias("hops")).groupBy("a", "b").agg(F.max(F.struct("cost", "hops")).alias("x")).select("a", "b", "x.*"), "front")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    else:
        raise ValueError("the graph has a cycle, or a path of more edges than rounds")
    best = found.groupBy("a", "b").agg(F.max(F.struct("cost", "hops")).alias("x"))
    return best.select(F.col("a").alias(source), F.col("b").alias(target), "x.cost", "x.hops")
