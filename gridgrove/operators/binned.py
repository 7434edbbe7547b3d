"""The hierarchy of images whose edges no single task can hold: bins of ranks, each over the components of the bins before it.

A task takes one bin of an image's edges and the topmost nodes of the components that these join, and gives back the nodes that
got a parent, the nodes that are topmost now, and the components' new names. Bins are halved again and again: the first half's names
are put into the second half's edges by a join, so that an edge is renamed as often as the number of bins has binary digits, not once a bin.
Nodes are named by a pixel, or by the rank of the edge that made them after the pixels, until the last step numbers them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgrove.operators.edges import ranked
from gridgrove.operators.lineage import shared_checkpoint
from gridgrove.operators.tree import Hierarchy, joined_nodes, path_ends, pointer_jumped, settled
from gridgrove.sources.grid import Grid

BIN = 200_000  # edges of an image that one task takes, with at most twice as many components
TOP = ("image_id", "c", "id", "alpha", "min_p", "area", "sum_pix", "min_pix", "max_pix")
OUT = "image_id bigint, c bigint, id bigint, alpha float, min_p bigint, area bigint, sum_pix double, min_pix double, max_pix double, kind string, to bigint"


def _bin_nodes(part: pd.DataFrame, pixels: int) -> pd.DataFrame:
    """Rows of a kind: `node` (to: its parent), `taken` (to: the node that took it over), `top` (of component c) and `name` (c is now called to)."""
    is_edge = part["rank"].notna()
    comps, edges = part[~is_edge].sort_values("c"), part[is_edge].sort_values("rank")
    c, image = comps.c.to_numpy(np.int64), part.image_id.iloc[0]
    lists = [comps[name].tolist() for name in ("alpha", "area", "sum_pix", "min_pix", "max_pix", "min_p")]
    ends = [np.searchsorted(c, edges[name].to_numpy(np.int64)).tolist() for name in ("c", "to")]
    up, top, parent, moved, made = joined_nodes(*lists, *ends, edges.alpha.astype(float).tolist())
    ids = np.concatenate([comps.id.to_numpy(np.int64), pixels + edges["rank"].to_numpy(np.int64)[np.array(made, np.int64)]])
    final, parents = settled(parent, moved)
    taken = final != np.arange(len(final))
    table = pd.DataFrame(dict(zip(("alpha", "area", "sum_pix", "min_pix", "max_pix", "min_p"), lists, strict=True)))
    table["image_id"], table["id"], table["c"] = image, ids, -1
    table["kind"] = np.where(taken, "taken", np.where(parents >= 0, "node", "top"))
    table["to"] = np.where(taken, ids[final], np.where(parents >= 0, ids[parents], -1))
    root = path_ends(np.array(up, np.int64))
    heads = np.flatnonzero(root == np.arange(len(root)))
    table.loc[np.array(top, np.int64)[heads], "c"] = c[heads]
    names = pd.DataFrame({"image_id": image, "c": c, "kind": "name", "to": c[root]})
    columns = [x.split()[0] for x in OUT.split(", ")]
    return pd.concat([table, names.reindex(columns=columns).astype({"alpha": "float64", "sum_pix": "float64", "min_pix": "float64", "max_pix": "float64"}).fillna({"id": -1, "min_p": -1, "area": 0, "alpha": 0.0, "sum_pix": 0.0, "min_pix": 0.0, "max_pix": 0.0})])[columns].astype({"id": "int64", "min_p": "int64", "area": "int64"})


def _one_bin(edges: DataFrame, comps: DataFrame, pixels: int) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    none = F.lit(None).cast("bigint")
    rows = comps.select(*TOP, none.alias("to"), none.alias("rank"))
    blank = [none.cast("double").alias(name) if name in ("sum_pix", "min_pix", "max_pix") else none.alias(name) for name in TOP[4:]]
    rows = rows.union(edges.select("image_id", F.col("c0").alias("c"), none.alias("id"), "alpha", *blank, F.col("c1").alias("to"), "rank"))
    out = shared_checkpoint(rows.groupBy("image_id").applyInPandas(lambda part: _bin_nodes(part, pixels), OUT))
    return [out.where("kind in ('node', 'taken')")], out.where("kind = 'name'").select("image_id", "c", "to"), out.where("kind = 'top'").select(*TOP)


def _renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """The edges between the components' new names, without those that join nothing any more."""
    for c in ("c0", "c1"):
        edges = edges.join(names.select("image_id", F.col("c").alias(c), F.col("to").alias("_n")), ["image_id", c], "left").withColumn(c, F.coalesce("_n", c)).drop("_n")
    return edges.where("c0 <> c1").select("image_id", "rank", "c0", "c1", "alpha", "bin")


def _touched(comps: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select("image_id", F.explode(F.array("c0", "c1")).alias("c")).distinct()
    return shared_checkpoint(comps.join(ends, ["image_id", "c"], "left_semi").select(*TOP))


def _packed(edges: DataFrame, size: int) -> tuple[DataFrame, int]:
    """The edges with the bins numbered anew from 0, and how many these are: neighbours that hold at most `size` edges of each image together become one."""
    number, held, last = {}, {}, -1
    counts: dict[int, dict[int, int]] = {}
    for r in edges.groupBy("bin", "image_id").count().collect():
        counts.setdefault(r[0], {})[r[1]] = r[2]
    for old in sorted(counts):
        if last < 0 or any(n + held.get(image, 0) > size for image, n in counts[old].items()):
            last, held = last + 1, {}
        for image, n in counts[old].items():
            held[image] = held.get(image, 0) + n
        number[old] = last
    if not number:
        return edges, 0
    anew = F.get(F.array(*(F.lit(number.get(k, -1)).cast("bigint") for k in range(max(number) + 1))), F.col("bin").cast("int"))
    return edges.withColumn("bin", anew), last + 1


def _bins(edges: DataFrame, comps: DataFrame, first: int, last: int, pixels: int, size: int) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Closed nodes, new names and topmost nodes of all the components given, after the bins from first up to last."""
    if last - first == 1:
        return _one_bin(edges, comps, pixels)
    middle = (first + last) // 2
    early = edges.where(F.col("bin") < middle)
    closed, names, tops = _bins(early, _touched(comps, early), first, middle, pixels, size)
    late, n = _packed(shared_checkpoint(_renamed(edges.where(F.col("bin") >= middle), names)), size)
    if not n:
        return closed, names, tops
    key = ["image_id", "c"]
    there = comps.join(names, key, "left_anti").select(*TOP).union(tops)
    closed_late, names_late, tops_late = _bins(late, _touched(there, late), 0, n, pixels, size)
    over = names_late.select("image_id", F.col("c").alias("to"), F.col("to").alias("_n"))
    through = names.join(over, ["image_id", "to"], "left").select("image_id", "c", F.coalesce("_n", "to").alias("to"))
    names_all = shared_checkpoint(through.union(names_late.join(names, key, "left_anti").select("image_id", "c", "to")))
    tops_all = shared_checkpoint(tops.join(names_late, key, "left_anti").select(*TOP).union(tops_late))
    return closed + closed_late, names_all, tops_all


def build_in_bins(grid: Grid, found: DataFrame, size: int = BIN, keep_leaves: bool = True) -> Hierarchy:
    """The same hierarchy as `build`, from edges that hold the spanning tree, by tasks that take at most `size` edges of an image each.

    All images' bins of a number run side by side; a pixel without edges is a node without a parent. Leaves that aren't kept are found when they are asked for.
    """
    edges = shared_checkpoint(ranked(found).select("image_id", "rank", F.col("p0").alias("c0"), F.col("p1").alias("c1"), "alpha", F.expr(f"rank div {int(size)}").alias("bin")))
    v, p = F.get("v", F.lit(0)).cast("double"), F.col("p")
    comps = grid.pixels.select("image_id", p.alias("c"), p.alias("id"), F.lit(0.0).cast("float").alias("alpha"), p.alias("min_p"), F.lit(1).cast("bigint").alias("area"), v.alias("sum_pix"), v.alias("min_pix"), v.alias("max_pix"))
    return _numbered(grid, shared_checkpoint(_joined(edges, comps, grid.size, int(size))), keep_leaves)


def _joined(edges: DataFrame, comps: DataFrame, pixels: int, size: int) -> DataFrame:
    """Rows (image_id, c, id, ..., kind, to) of all nodes that the edges, in bins, make of the components, and of those that were taken over."""
    last = edges.agg(F.max("bin")).first()[0]
    rows = comps.select(*TOP, F.lit("top").alias("kind"), F.lit(-1).cast("bigint").alias("to"))
    if last is not None:
        closed, names, tops = _bins(edges, _touched(comps, edges), 0, last + 1, pixels, size)
        rows = rows.join(names, ["image_id", "c"], "left_anti").select(*TOP, "kind", "to")
        rows = rows.union(tops.select(*TOP, F.lit("top").alias("kind"), F.lit(-1).cast("bigint").alias("to")))
        for part in closed:
            rows = rows.union(part.select(*TOP, "kind", "to"))
    return rows


def _ended(rows: DataFrame) -> DataFrame:
    """(image_id, id, to): the nodes that took over others, and these, with the node that each one ended up in."""
    taken = rows.where("kind = 'taken'").select("image_id", "id", "to")
    stay = taken.select("image_id", F.col("to").alias("id"), "to").distinct().join(taken.select("image_id", "id"), ["image_id", "id"], "left_anti")
    return pointer_jumped(shared_checkpoint(taken.union(stay.select("image_id", "id", "to"))), "id")


def named_tops(comps: DataFrame, found: DataFrame, pixels: int, size: int = BIN) -> tuple[DataFrame, DataFrame]:
    """What edges (image_id, edge_id, c0, c1, alpha) make of components, given with their topmost nodes, whose ids are under `pixels`.

    Returns the nodes, with their parents' levels and least pixels (NaN and -1: none), and the level and least pixel that each id stands for now.
    """
    edges = shared_checkpoint(ranked(found).select("image_id", "rank", "c0", "c1", "alpha", F.expr(f"rank div {int(size)}").alias("bin")))
    rows = shared_checkpoint(_joined(edges, shared_checkpoint(comps), pixels, int(size)))
    alive, into = rows.where("kind <> 'taken'"), _ended(rows)
    known = alive.select("image_id", "id", "alpha", "min_p")
    gone = into.where("id <> to").join(known.withColumnRenamed("id", "to"), ["image_id", "to"]).select(*known.columns)
    names = shared_checkpoint(known.union(gone))
    above = names.select("image_id", F.col("id").alias("to"), F.col("alpha").alias("up_alpha"), F.col("min_p").alias("up_min_p"))
    over = alive.join(above, ["image_id", "to"], "left").select(*(c for c in TOP if c not in ("c", "id")), F.coalesce("up_alpha", F.lit("NaN").cast("float")).alias("up_alpha"), F.coalesce("up_min_p", F.lit(-1)).alias("up_min_p"))
    return over, names


def _numbered(grid: Grid, rows: DataFrame, keep_leaves: bool) -> Hierarchy:
    """Nodes in the order of (alpha, least pixel), with what took them over in place of the nodes that were."""
    into = _ended(rows)
    nodes = rows.where("kind <> 'taken'").drop("c").withColumnRenamed("to", "parent")
    parent = into.select("image_id", F.col("id").alias("parent"), F.col("to").alias("_n"))
    nodes = nodes.join(parent, ["image_id", "parent"], "left").withColumn("parent", F.coalesce("_n", "parent")).drop("_n")
    nodes = shared_checkpoint(ranked(nodes.withColumnRenamed("min_p", "edge_id")).withColumnRenamed("edge_id", "min_p").withColumnRenamed("rank", "node_id"))
    number = nodes.select("image_id", "id", "node_id")
    above = number.select("image_id", F.col("id").alias("parent"), F.col("node_id").alias("parent_id"))
    made = nodes.join(above, ["image_id", "parent"], "left").select("image_id", "node_id", "alpha", "min_p", "area", "sum_pix", "min_pix", "max_pix", "parent_id")
    leaves = grid.pixels.select("image_id", "p", F.col("p").alias("id")).join(into, ["image_id", "id"], "left").select("image_id", "p", F.coalesce("to", "id").alias("id"))
    leaves = leaves.join(number, ["image_id", "id"]).select("image_id", "p", "node_id")
    return Hierarchy(shared_checkpoint(made), shared_checkpoint(leaves) if keep_leaves else leaves, grid)
