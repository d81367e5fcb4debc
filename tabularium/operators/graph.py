"""Connected components of an edge table, by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut

#: Edges to a stored partition.
ROWS = 100_000


def _star(pairs: DataFrame, keep: str) -> DataFrame:
    """Link every neighbour of ``u`` to the least node near ``u``.

    The least neighbour is a partial aggregate, so a hub's rows are never gathered in one task;
    the join back is one that adaptive execution can split when a hub is hot.
    """
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    near = pairs.join(least, "u")
    if keep == "large":
        out = near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.where(F.col("m") != F.col("u")).select("u", F.col("m").alias("v"))
        )
    return out.where(F.col("u") != F.col("v"))


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of an undirected edge table.

    ``component`` is the smallest node id reachable. Null ends and self loops are ignored; a node
    that appears only in self loops gets itself. Each round stores its edges in the checkpoint
    folder, and the loop ends when a round changes nothing (a few rounds, logarithmic in the
    size of the largest component). More than ``max_rounds`` raise an error.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    alone = ends.where("a = b").select(F.col("a").alias("node")).distinct()
    current = cut(ends.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark, parts = None, 1 + current.count() // ROWS
    for _ in range(max_rounds):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "large")
        # no more files than the edges need: a round doesn't add any
        current = cut(_star(large, "small").distinct().coalesce(parts))
        now = tuple(
            current.agg(
                F.count(F.lit(1)),
                F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
            ).first()
        )
        if now == mark:
            break
        mark, parts = now, 1 + now[0] // ROWS
    else:
        raise RuntimeError(f"components are not final after {max_rounds} rounds")
    labelled = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    known = labelled.union(roots)
    lone = alone.join(known.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return known.union(lone)
