"""Connected components of an edge table by alternating large and small stars.

Each round is two aggregations (with map-side partial minima) and two equi
joins; a node with very many neighbours is never gathered in one task: its
minimum is pre-aggregated and the join back is a plain sort-merge join, whose
large partitions AQE splits.  Rounds are logarithmic in the component size.
Tables are read in as many partitions as their counted rows need, and a table
whose components are stars already needs no round.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.llm.base import settle, sized


def _large_star(e: DataFrame, fit) -> DataFrame:
    both = e.select(F.col("u"), F.col("v")).unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = fit(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    return fit(fit(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                   .where("u <> v")).distinct())


def _small_star(e: DataFrame, fit) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = fit(down.groupBy("u").agg(F.min("v").alias("m")))
    kept = fit(down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
    return fit(kept.unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())


def _stars(e: DataFrame) -> bool:
    """Whether every node has one edge down at most and no node has edges both up and down: each component is a star."""
    end = lambda c, down, up: e.select(F.col(c).alias("x"), F.lit(down).alias("down"), F.lit(up).alias("up"))
    ends = end("u", 1, 0).unionAll(end("v", 0, 1)).groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not ends.where("down > 1 OR (down = 1 AND up = 1)").limit(1).count()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node that has an edge to another; root = smallest node reachable.

    Self edges and repeated edges are allowed, null ends are not linked.  An
    empty edge table gives an empty result.  Raises if ``max_rounds`` (far
    above log2 of any table) does not settle, instead of returning a partial
    answer.
    """
    e = settle(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(max_rounds):
        rows = e.count()
        e, fit = sized(e, rows), partial(sized, rows=2 * rows)
        if _stars(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        e = settle(_small_star(_large_star(e, fit), fit))
    raise RuntimeError("components did not settle")
