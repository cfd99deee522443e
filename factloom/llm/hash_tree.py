"""Sharding by a hierarchical weighted hash tree.

A tree has regions, regions have racks, racks have shards, and shards have weights; a rack and a
region weigh what their shards weigh together. A key descends from level to level. At each level
every child draws a number from the hash of key and child, an exponential variable whose rate is the
child's weight, and the least draw wins. A child wins in proportion to its weight, and a changed
weight changes that child's draw alone: keys move only into a child that became heavier, or out of
one that became lighter, and only inside subtrees whose weights changed.

All of it is one column expression of built-in functions.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import ROW, numbered
from factloom.session import cut_lineage

#: Rows that are ranked together when slots are given out.
CHUNK = 65_536
#: The highest bits of a row number name the task that gave it.
TASK_BITS = 33
DRAWS = 1 << 53


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int, regions: int = 4, racks: int = 2) -> list[Leaf]:
    """Shards 0 to ``shards - 1``, dealt in turn to the racks of all regions."""
    return [
        Leaf(f"region-{n % regions}", f"rack-{n // regions % racks}", n) for n in range(shards)
    ]


def grown_tree(tree: Iterable[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region of its own.

    All other subtrees keep their weights, so the new shard only takes keys, and only into itself.
    """
    tree = list(tree)
    shard = max(leaf.shard for leaf in tree) + 1
    return [*tree, Leaf(f"region-of-{shard}", f"rack-of-{shard}", shard, weight)]


def _draw(key: Column, node: str, weight: float) -> Column:
    uniform = (F.pmod(F.xxhash64(key, F.lit(node)), F.lit(DRAWS)) + 1) / F.lit(float(DRAWS + 1))
    return -F.ln(uniform) / F.lit(float(weight))


def _winner(key: Column, children: dict[str, float]) -> Column:
    """The name of the child with the least draw; equal draws go to the smaller name."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    draws = [
        F.struct(_draw(key, node, weight).alias("draw"), F.lit(node).alias("node"))
        for node, weight in sorted(children.items())
    ]
    return F.array_min(F.array(*draws))["node"]


def _descend(key: Column, tree: list[Leaf], path: str, depth: int) -> Column:
    if depth == 3:
        return F.lit(tree[0].shard)
    children: dict[str, list[Leaf]] = {}
    for leaf in tree:
        children.setdefault(f"{path}/{leaf[depth]}", []).append(leaf)
    winner = _winner(key, {n: sum(x.weight for x in under) for n, under in children.items()})
    out = F.lit(None).cast("int")
    for node, under in sorted(children.items()):
        out = F.when(winner == node, _descend(key, under, node, depth + 1)).otherwise(out)
    return out


def shard_of(key: Column, tree: Iterable[Leaf]) -> Column:
    """The shard of a key; all null keys share one. Shards of weight 0 or less get no keys."""
    live = [leaf for leaf in tree if leaf.weight > 0]
    if not live:
        raise ValueError("a tree needs a shard with a weight")
    if len({leaf.shard for leaf in live}) < len(live):
        raise ValueError("a shard stands in one rack only")
    return _descend(key, live, "", 0).cast("int")


def with_slots(df: DataFrame, shard: str) -> DataFrame:
    """``df`` with ``slot``: a number for each row, gapless from 0 within its shard.

    Rows are numbered where they lie and written to the shared folder. Short chunks are ranked on
    their own; a running sum over the chunks' counts gives where each begins. No task ever holds a
    shard, however many rows have the same key.
    """
    place = (F.shiftright(ROW, TASK_BITS), F.shiftright(ROW, 16) % F.lit(1 << (TASK_BITS - 16)))
    rows = cut_lineage(
        numbered(df).withColumns({"__task": place[0], "__chunk": place[1].cast("int")}), "slots"
    )
    keys = [shard, "__task", "__chunk"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__count"))
    before = Window.partitionBy(shard).orderBy("__task", "__chunk")
    begun = counts.withColumn("__begin", F.sum("__count").over(before) - F.col("__count"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(ROW)) - 1
    ranked = rows.withColumn("__rank", rank).join(begun.drop("__count"), keys)
    return ranked.withColumn("slot", F.col("__begin") + F.col("__rank")).drop(
        "__task", "__chunk", "__begin", "__rank", ROW
    )


def assign_shards(
    docs: DataFrame, tree: list[Leaf], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` for each row of ``docs``.

    Key and tree decide (law ``key``); ``grown_shard`` is the shard with one more of them. A null
    text has no bytes, a null key is a key like any other. Repeated rows share a shard and get slots
    of their own. Columns of ``docs`` other than key and text are left out.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(key), tree).alias("shard"),
        shard_of(F.col(key), grown_tree(tree)).alias("grown_shard"),
    )
    return with_slots(narrow, "shard").select(
        key, "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
