"""Components of links between nodes, their comparison in blocks, and the classes of documents that come of it.

A node stands for the documents of equal content. Links are found inside components that other steps bound from above.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, small_side, written


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of ``edges(a, b)``; comp is the least node of its component.

    Null ends and loops are ignored; an empty table gives an empty one. Each round is one shuffle a step and is
    written to the shared folder, so a lost executor costs one round at most. Rounds grow with the logarithm of
    the longest path.
    """
    spark = edges.sparkSession
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    mark = None
    for _ in range(rounds):
        # large-star: neighbours above u point to the least node around u
        both = now.union(now.select("v", "u"))
        least = F.least(F.min("v").over(Window.partitionBy("u")), F.col("u"))
        large = both.select("u", "v", least.alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small-star: u and its lower neighbours point to the least of them
        lower = large.where("u <> v").distinct()
        m = F.min("v").over(Window.partitionBy("u"))
        small = lower.select("u", "v", m.alias("m")).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = written(small, "cc")
        seen = after.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("pmod(xxhash64(v, u), 1000003)"))).first()
        dropped(now)
        now = after
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"no components after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def in_blocks(comps: DataFrame, one: DataFrame, blocks: Column) -> DataFrame:
    """``one``(node, id, weight, ...) of the nodes of ``comps``, with their component, its number of blocks and their own.

    blocks: an aggregate over a component's rows, 1 or more. Any two blocks of a component are to meet in a task, so a
    task holds a bounded part of it, however large it is.
    """
    sized = comps.join(one, "node")
    many = F.greatest(F.lit(1), F.ceil(blocks)).cast("bigint").alias("blocks")
    return sized.join(sized.groupBy("comp").agg(many), "comp").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))


def meeting(rows: DataFrame) -> DataFrame:
    """Each row once for every block that its own meets: blocks ``i`` <= ``j``."""
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return other.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")


def linked(label: np.ndarray, nodes: np.ndarray) -> None:
    """Gives all that carry a label of one of the nodes the least of these labels."""
    join = np.unique(label[nodes])
    if len(join) > 1:
        label[np.isin(label, join)] = join[0]


def classes(of: DataFrame, one: DataFrame, found: DataFrame, several: bool) -> DataFrame:
    """(id, class, links) of every id of ``of``(id, node); node is null for what has no content.

    ``one``(node, id, weight): least id and number of documents of a node. ``found``(node, links, up): what two blocks
    gave for a node, the weight linked to it and the least node joined to it there; with ``several`` blocks in some
    component these labels are joined. A class is named by its least id, and without links is an id of its own.
    """
    nodes = found.groupBy("node").agg(F.sum("links").alias("links"), F.min("up").alias("up"))
    if several:
        whole = connected_components(found.select(F.col("node").alias("a"), F.col("up").alias("b")))
        nodes = nodes.join(whole, "node", "left").select("node", "links", F.coalesce("comp", "up").alias("up"))
    each = written(one.select("node", "id", "weight").join(nodes, "node", "left").where("weight > 1 or links > 0").withColumn("up", F.coalesce("up", "node")), "each")
    least = each.groupBy("up").agg(F.min("id").alias("class"))
    told = written(each.join(least, "up").select("node", "class", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links")), "classes")
    dropped(each)
    return of.join(small_side(told), "node", "left").groupBy("id").agg(F.min(F.coalesce("class", "id")).alias("class"), F.sum(F.coalesce("links", F.lit(0))).alias("links"))
