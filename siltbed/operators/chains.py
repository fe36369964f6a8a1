"""Chains of single links, followed by pointer doubling: rounds grow with the logarithm of a chain's length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.plans.shared import cut

#: Doublings after which a chain that has not ended is a cycle.
ROUNDS = 64


class Cycle(ValueError):
    pass


def ends(links: DataFrame) -> DataFrame:
    """(node, anchor, distance) for links (node, up), nodes distinct: the node without `up` that a chain ends in, and the
    number of links to it. A chain that leads to a node outside links is left out; a cycle raises Cycle.

    A round joins the chains that have not ended with the state of the node each has come to. Many chains may have come
    to one node: they are on the side that adaptive execution splits, the other side has one row a node.
    """
    state = cut(links.select("node", F.coalesce("up", "node").alias("anchor"), F.col("up").isNotNull().cast("long").alias("distance"), F.col("up").isNull().alias("done")))
    for _ in range(ROUNDS):
        going = state.where("not done")
        if going.isEmpty():
            return state.drop("done")
        there = state.select(F.col("node").alias("anchor"), F.col("anchor").alias("further"), F.col("distance").alias("more"), F.col("done").alias("ended"))
        moved = going.join(there, "anchor").select("node", F.col("further").alias("anchor"), (F.col("distance") + F.col("more")).alias("distance"), F.col("ended").alias("done"))
        state = cut(state.where("done").union(moved))
    raise Cycle("links lead back to where they come from")
