"""Connected components of a table of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut_lineage

ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links of every node to the least of its neighbours and itself.

    The large star moves the neighbours above the node, the small star those below it.
    """
    seen = links
    if large:
        seen = links.union(links.select("b", "a"))
    least = seen.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select("a", F.least("a", "least").alias("least"))
    met = seen.join(least, "a")
    if large:
        moved = met.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = met.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least)
    return moved.filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root``: all nodes that ``links`` (``a``, ``b``) name, with the least they reach.

    Every round writes its links to the shared folder, so a lost executor costs one round. Self
    links, repeated links and both directions may occur; an empty table gives an empty one. Rounds
    grow with the logarithm of the longest chain; more than ``ROUNDS`` of them are an error.
    """
    links = cut_lineage(links.select("a", "b"), "found-links")
    nodes_only = links.filter("a = b").select(F.col("a").alias("node")).distinct()
    turned = links.filter("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    current = cut_lineage(turned.distinct(), "links")
    state = None
    for _ in range(ROUNDS):
        mark = current.agg(
            F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(hash(a, b))")
        ).first()
        if mark == state:
            break
        state = mark
        current = cut_lineage(_star(_star(current, True), False), "links")
    else:
        raise RuntimeError("the components did not settle")
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    heads = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    lone = nodes_only.join(roots, "node", "left_anti").join(heads, "node", "left_anti")
    return roots.union(heads).union(lone.select("node", F.col("node").alias("root")))
