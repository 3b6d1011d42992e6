"""Connected components of an edge list, as a loop that joins nodes until no link is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.sources.scratch import discard, written


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``component``, the least node that it is linked with, for every node of ``edges``.

    In a round each node hangs on its least neighbour, if that is less than itself; trees are flattened by jumping, on the
    nodes alone; and the links go on between the trees' least nodes, once each. A node hangs once only, and half of the nodes
    at least go in two rounds, so the links get fewer and what is written for nodes is one row each. Files of the rounds are
    deleted when the next stands, the last ones hold the result.
    """
    pair = lambda x, y: [F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi")]
    links = written(edges.filter(F.col(a) != F.col(b)).select(*pair(a, b)), "links")
    hung: list[DataFrame] = []
    for _ in range(max_rounds):
        if links.isEmpty():
            break
        tree = _flat(written(links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("top")), "tops"), max_rounds)
        of = lambda end: tree.select(F.col("node").alias(end), F.col("top").alias(f"{end}_top"))  # noqa: E731, B023
        moved = links.join(of("hi"), "hi").select("lo", F.col("hi_top").alias("hi")).filter("lo <> hi")
        moved = moved.join(of("lo"), "lo", "left").select(F.coalesce("lo_top", "lo").alias("lo"), "hi").select(*pair("lo", "hi"))
        new = written(moved.filter("lo < hi").distinct(), "links")
        discard(links)
        links = new
        hung.append(tree)
    else:
        raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    discard(links)
    if not hung:
        return links.select(F.col("lo").alias("node"), F.col("hi").alias("component")).limit(0)
    found = hung[-1]
    for tree in reversed(hung[:-1]):  # tops of a round may hang on others in a later one
        later = found.select(F.col("node").alias("top"), F.col("top").alias("last"))
        found = found.unionByName(tree.join(later, "top", "left").select("node", F.coalesce("last", "top").alias("top")))
    found = found.select("node", F.col("top").alias("component"))
    out = written(found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()), "components")
    discard(*hung)
    return out


def _flat(tree: DataFrame, max_rounds: int) -> DataFrame:
    """``node`` and its last ``top``: each jump takes a top's own top until no top has one."""
    for _ in range(max_rounds):
        above = tree.select(F.col("node").alias("top"), F.col("top").alias("next"))
        if tree.join(above, "top", "left_semi").isEmpty():
            return tree
        new = written(tree.join(above, "top", "left").select("node", F.coalesce("next", "top").alias("top")), "tops")
        discard(tree)
        tree = new
    raise RuntimeError(f"trees deeper than 2 to the {max_rounds}")
