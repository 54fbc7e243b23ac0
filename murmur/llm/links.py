"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.arrow import staged

#: Rounds in which nodes go by their own order, in which hubs are met; later ones deal a new order each.
OWN_ORDER = 4


def _moves(links: DataFrame, turn: int) -> DataFrame:
    """(node, target): the first of a node and its neighbours, in the order of the round."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if turn < OWN_ORDER:
        return both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("target"))
    place = lambda n: F.struct(F.xxhash64(F.lit(turn), n).alias("at"), F.col(n).alias("n"))
    return both.groupBy(F.col("u").alias("node")).agg(F.least(place("node"), F.min(place("v")))["n"].alias("target"))


def _moved(links: DataFrame, moves: DataFrame) -> DataFrame:
    """What is left of the links between nodes that have moved."""
    for end in ("u", "v"):
        links = links.join(moves.select(F.col("node").alias(end), F.col("target").alias(f"to_{end}")), end)
    ends = links.select(F.least("to_u", "to_v").alias("v"), F.greatest("to_u", "to_v").alias("u"))
    return ends.where("u > v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """The smallest node that each linked node reaches, as (node, component).

    Links are long pairs in either direction and may repeat. In a round every
    node moves to the first of itself and its neighbours, and links become links
    between the nodes moved to, until none is left. Nodes go by their own order
    at first, in which the links of a hub are done in one round; a chain in
    that order would lose one node a round, so later rounds each deal a new
    order by hash, by which the nodes left shrink by a share a round however
    they are linked. No step holds the neighbours of a node together: the first
    is found by a partial aggregate.
    """
    links = links.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct()
    links = staged(links, "links")  # u > v
    label = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    turn = 0
    while not links.isEmpty():
        moves = _moves(links, turn)
        if turn == 0:
            label = moves.select("node", F.col("target").alias("component"))
        else:
            on = moves.select(F.col("node").alias("component"), "target")
            label = label.join(on, "component", "left").select("node", F.coalesce("target", "component").alias("component"))
        links = staged(_moved(links, moves), "links")
        turn += 1
    if turn <= OWN_ORDER:  # in their own order the smallest never moves
        return label
    least = label.groupBy("component").agg(F.min("node").alias("least"))
    return label.join(least, "component").select("node", F.col("least").alias("component"))
