"""Queries over a hierarchy: ancestors by predicate, filters, level roots, common ancestors, flat partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridgrove.operators.tree import Hierarchy, pointer_jumped, shared_checkpoint


ONE_TASK = 4_000_000  # nodes up to which those of all images may be resolved an image a task


def first_ancestor(tree: Hierarchy, stop: Column, one_task: bool | None = None) -> DataFrame:
    """(image_id, node_id, found_id): each node's first ancestor, itself included, where stop holds, or else its root.

    stop must hold for all ancestors of a node where it holds. Two numbers a node of an image go to one task where there are at most ONE_TASK nodes, or
    one_task asks for it; pointers are moved on by joins otherwise, in rounds whose number is far below the depth.
    """
    if one_task is None:
        one_task = tree.nodes.limit(ONE_TASK + 1).count() <= ONE_TASK
    here = F.coalesce(stop, F.lit(False)) | F.col("parent_id").isNull()
    jump = tree.nodes.select("image_id", "node_id", F.when(here, F.col("node_id")).otherwise(F.col("parent_id")).alias("to"))
    if not one_task:
        return pointer_jumped(shared_checkpoint(jump), "node_id").select("image_id", "node_id", F.col("to").alias("found_id"))

    def resolve(part: pd.DataFrame) -> pd.DataFrame:
        nodes = part.node_id.to_numpy()
        order = np.argsort(nodes)
        to = order[np.searchsorted(nodes, part.to.to_numpy(), sorter=order)]
        while (to != to[to]).any():
            to = to[to]
        return pd.DataFrame({"image_id": part.image_id, "node_id": nodes, "found_id": nodes[to]})

    return jump.groupBy("image_id").applyInPandas(resolve, "image_id bigint, node_id bigint, found_id bigint")


def roots(tree: Hierarchy) -> DataFrame:
    """The node of each image without a parent."""
    return tree.nodes.where("parent_id is null")


def _painted(tree: Hierarchy, found: DataFrame, value: str) -> DataFrame:
    """(image_id, p, y, x, value): each pixel with an attribute of what its leaf found."""
    values = tree.nodes.select("image_id", F.col("node_id").alias("found_id"), F.col(value).cast("double").alias("value"))
    by_leaf = found.join(values, ["image_id", "found_id"]).select("image_id", "node_id", "value")
    w = tree.grid.width
    return tree.leaves.join(by_leaf, ["image_id", "node_id"]).select("image_id", "p", F.expr(f"p div {w}").alias("y"), (F.col("p") % w).alias("x"), "value")


def area_filter(tree: Hierarchy, share: float) -> DataFrame:
    """Each pixel's level at the first ancestor whose area is at least a share of the image's, rounded down."""
    least = max(0, min(int(share * tree.grid.size), tree.grid.size))
    return _painted(tree, first_ancestor(tree, F.col("area") >= least), "alpha")


def level_filter(tree: Hierarchy, share: float) -> DataFrame:
    """Each pixel's area at the first ancestor whose level is at least a share of the root's."""
    top = roots(tree).select("image_id", (F.col("alpha").cast("double") * F.lit(float(share))).alias("_t"))
    nodes = tree.nodes.join(F.broadcast(top) if top.limit(10_001).count() <= 10_000 else top, "image_id")
    return _painted(tree, first_ancestor(Hierarchy(nodes, tree.leaves, tree.grid), F.col("alpha").cast("double") >= F.col("_t")), "area")


def level_root(tree: Hierarchy, level: float) -> DataFrame:
    """(image_id, node_id, found_id): each node's last ancestor of at most a level; a node above it is its own."""
    above = tree.nodes.select("image_id", F.col("node_id").alias("parent_id"), F.col("alpha").alias("_a"))
    nodes = tree.nodes.join(above, ["image_id", "parent_id"], "left")
    return first_ancestor(Hierarchy(nodes, tree.leaves, tree.grid), F.col("_a") > F.lit(float(level)))


def flat_partition(tree: Hierarchy, level: float) -> DataFrame:
    """(image_id, p, label): the components at a level, each named by its least pixel."""
    found = level_root(tree, level)
    names = tree.nodes.select("image_id", F.col("node_id").alias("found_id"), F.col("min_p").alias("label"))
    return tree.leaves.join(found.join(names, ["image_id", "found_id"]), ["image_id", "node_id"]).select("image_id", "p", "label")


def lifted(tree: Hierarchy) -> list[DataFrame]:
    """Tables (image_id, node_id, to) of the ancestors 1, 2, 4, ... steps up, of the nodes that have one: as many tables as the depth has binary digits."""
    step = shared_checkpoint(tree.nodes.where("parent_id is not null").select("image_id", "node_id", F.col("parent_id").alias("to")))
    out = []
    while step.limit(1).count():
        out.append(step)
        over = step.select("image_id", F.col("node_id").alias("to"), F.col("to").alias("further"))
        step = shared_checkpoint(step.join(over, ["image_id", "to"]).select("image_id", "node_id", F.col("further").alias("to")))
    return out


def _stepped(rows: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """The rows with, for each column of nodes, where one of `lifted`'s tables leads from it (null: nowhere) as <column>_to."""
    for c in columns:
        rows = rows.join(table.select("image_id", F.col("node_id").alias(c), F.col("to").alias(f"{c}_to")), ["image_id", c], "left")
    return rows


def common_ancestor(tree: Hierarchy, pairs: DataFrame) -> DataFrame:
    """(image_id, p, q, node_id, alpha) of pixel pairs (image_id, p, q): their lowest common ancestor, whose level is the least highest weight of a path between them.

    The deeper node is raised to the other's depth, and then both by the largest steps after which they are still apart. Pairs without a common ancestor have no row.
    """
    up = lifted(tree)
    leaf = tree.leaves.select("image_id", "p", "node_id")
    rows = pairs.select("image_id", "p", "q").distinct().join(leaf.withColumnRenamed("node_id", "a"), ["image_id", "p"])
    rows = shared_checkpoint(rows.join(leaf.select("image_id", F.col("p").alias("q"), F.col("node_id").alias("b")), ["image_id", "q"]))
    depth = rows.select("image_id", F.explode(F.array("a", "b")).alias("node_id")).distinct().select("image_id", "node_id", F.col("node_id").alias("at"), F.lit(0).cast("bigint").alias("depth"))
    for k in reversed(range(len(up))):
        moved = F.when(F.col("at_to").isNotNull(), F.col("depth") + (1 << k)).otherwise(F.col("depth"))
        depth = shared_checkpoint(_stepped(depth, up[k], "at").select("image_id", "node_id", F.coalesce("at_to", "at").alias("at"), moved.alias("depth")))
    for c in "ab":
        rows = rows.join(depth.select("image_id", F.col("node_id").alias(c), F.col("depth").alias(f"d{c}")), ["image_id", c])
    swap = F.col("da") < F.col("db")
    rows = rows.select("image_id", "p", "q", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), F.abs(F.col("da") - F.col("db")).alias("gap"))
    for k in reversed(range(len(up))):
        raised = F.when(F.col("gap").bitwiseAND(F.lit(1 << k)) != 0, F.col("a_to")).otherwise(F.col("a"))
        rows = shared_checkpoint(_stepped(rows, up[k], "a").select("image_id", "p", "q", raised.alias("a"), "b", "gap"))
    for k in reversed(range(len(up))):
        apart = F.coalesce(F.col("a_to") != F.col("b_to"), F.lit(False))
        rows = shared_checkpoint(_stepped(rows, up[k], "a", "b").select("image_id", "p", "q", *(F.when(apart, F.col(f"{c}_to")).otherwise(F.col(c)).alias(c) for c in "ab")))
    if up:
        rows = _stepped(rows, up[0], "a", "b").where("a = b or a_to = b_to").select("image_id", "p", "q", F.expr("if(a = b, a, a_to)").alias("a"), "b")
    else:
        rows = rows.where("a = b")
    levels = tree.nodes.select("image_id", F.col("node_id").alias("a"), "alpha")
    return rows.join(levels, ["image_id", "a"]).select("image_id", "p", "q", F.col("a").alias("node_id"), "alpha")


def canonical(nodes: DataFrame) -> DataFrame:
    """(image_id, node_id, found_id): each node's topmost ancestor of its own level, for trees with chains of equal levels."""
    above = nodes.select("image_id", F.col("node_id").alias("parent_id"), F.col("alpha").alias("_a"))
    return first_ancestor(Hierarchy(nodes.join(above, ["image_id", "parent_id"], "left"), None, None), F.col("_a") > F.col("alpha"))


def rolled_up(tree: Hierarchy) -> DataFrame:
    """(image_id, node_id, area, sum_pix): attributes gathered anew from the pixels, each summed over its leaf's ancestors.

    After k rounds a node has the sums of its descendants of fewer than 2^k steps down; a round adds those of the nodes that many steps below.
    """
    own = tree.leaves.join(tree.grid.pixels.select("image_id", "p", F.get("v", F.lit(0)).alias("v")), ["image_id", "p"])
    by_leaf = own.groupBy("image_id", "node_id").agg(F.count("*").alias("area"), F.sum("v").alias("sum_pix"))
    sums = tree.nodes.select("image_id", "node_id").join(by_leaf, ["image_id", "node_id"], "left").fillna({"area": 0, "sum_pix": 0.0})
    for table in lifted(tree):
        sums = shared_checkpoint(sums)
        below = sums.join(table, ["image_id", "node_id"]).groupBy("image_id", F.col("to").alias("node_id")).agg(F.sum("area").alias("n"), F.sum("sum_pix").alias("s"))
        both = sums.join(below, ["image_id", "node_id"], "left")
        sums = both.select("image_id", "node_id", (F.col("area") + F.coalesce("n", F.lit(0))).alias("area"), (F.col("sum_pix") + F.coalesce("s", F.lit(0.0))).alias("sum_pix"))
    return sums
