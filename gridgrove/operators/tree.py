"""The hierarchy of components: one node for each set that connects at some level, with its attributes.

Nodes are numbered by (alpha, least pixel) within their image. Edges are always taken in the order of (alpha, edge_id), which
makes the minimum spanning tree unique, and the hierarchy of a graph is that of its minimum spanning tree. `kruskal` sends every edge to the
grouped build, which leaves out those that close cycles; the other strategies shrink them first, to the tree's edges or to forests of tiles or of rank bins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgrove.functions.scalar import tile_grid, tile_of
from gridgrove.operators.contract import TILE, contracted, tile_columns
from gridgrove.operators.edges import both_ways, ranked
from gridgrove.operators.lineage import shared_checkpoint, shared_table
from gridgrove.sources.grid import Grid

EDGE = "image_id bigint, edge_id bigint, p0 bigint, p1 bigint, alpha float"
TAIL = 200_000  # edges between an image's components that one task joins


@dataclass(frozen=True)
class Hierarchy:
    """nodes (image_id, node_id, alpha, min_p, area, sum_pix, min_pix, max_pix, parent_id) and leaves (image_id, p, node_id)."""

    nodes: DataFrame
    leaves: DataFrame
    grid: Grid


def _forest(p0: np.ndarray, p1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the edges, already in order, join two components: the places of the minimum spanning forest's edges. Also all ends, and the least of each one's component."""
    pixels, ends = np.unique(np.concatenate([p0, p1]), return_inverse=True)
    up = list(range(len(pixels)))
    kept = []
    for k, (a, b) in enumerate(zip(ends[: len(p0)].tolist(), ends[len(p0) :].tolist(), strict=True)):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        while up[b] != b:
            up[b] = up[up[b]]
            b = up[b]
        if a != b:
            up[max(a, b)] = min(a, b)
            kept.append(k)
    return np.array(kept, np.int64), pixels, pixels[path_ends(np.array(up, np.int64))]


def local_forest(found: DataFrame, *keys: str) -> DataFrame:
    """Each group's minimum spanning forest, (image_id, edge_id, p0, p1, alpha)."""

    def build(edges: pd.DataFrame) -> pd.DataFrame:
        edges = edges.sort_values(["alpha", "edge_id"], kind="stable")
        return edges.iloc[_forest(edges.p0.to_numpy(), edges.p1.to_numpy())[0]]

    columns = ["image_id", "edge_id", "p0", "p1", "alpha"]
    grouped = found.select(*columns, *(k for k in keys if k not in columns)).groupBy(*keys)
    return grouped.applyInPandas(lambda e: build(e[columns]), EDGE)


def joined_nodes(level: list, area: list, total: list, low: list, high: list, least: list, x: list, y: list, alpha: list) -> tuple[list, list, list, list, list]:
    """What edges x - y, in order, make of components 0, 1, ... with one topmost node each: the lists grow by the nodes that edges make.

    Returns (up, top, parent, moved, made): a component's way to its root, a root's topmost node, each node's parent and the node that took it over (-1: none),
    and the edge that made each new node. A node that meets another of its own level takes over the other's children, so that no chain of equal levels is left.
    """
    n = len(level)
    up, top = list(range(n)), list(range(n))
    parent, moved, made = [-1] * n, [-1] * n, []
    for e, (x, y, t) in enumerate(zip(x, y, alpha, strict=True)):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        if x == y:
            continue
        i, j = top[x], top[y]
        if level[j] == t and level[i] != t:
            i, j = j, i
        if level[i] == t:  # i stays; j becomes its child or is taken into it
            if level[j] == t:
                moved[j] = i
            else:
                parent[j] = i
            area[i] += area[j]
            total[i] += total[j]
            low[i], high[i], least[i] = min(low[i], low[j]), max(high[i], high[j]), min(least[i], least[j])
            k = i
        else:
            k = len(level)
            level.append(t)
            area.append(area[i] + area[j])
            total.append(total[i] + total[j])
            low.append(min(low[i], low[j]))
            high.append(max(high[i], high[j]))
            least.append(min(least[i], least[j]))
            parent.append(-1)
            moved.append(-1)
            made.append(e)
            parent[i] = parent[j] = k
        root, child = (x, y) if x < y else (y, x)
        up[child] = root
        top[root] = k
    return up, top, parent, moved, made


def path_ends(way: np.ndarray) -> np.ndarray:
    """Where the path from each place ends."""
    while (way != way[way]).any():
        way = way[way]
    return way


def settled(parent: list, moved: list) -> tuple[np.ndarray, np.ndarray]:
    """The node that each one ended up in, itself where nothing took it over, and the parents with those in place of what was taken over."""
    gone, parents = np.array(moved, np.int64), np.array(parent, np.int64)
    final = path_ends(np.where(gone >= 0, gone, np.arange(len(gone))))
    return final, np.where(parents >= 0, final[parents], -1)


def _dendrogram(p: np.ndarray, v: np.ndarray, a: np.ndarray, b: np.ndarray, alpha: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    """Nodes with one parent each, and each pixel's leaf, from sorted pixels and the spanning tree's edges in order."""
    n = len(p)
    level, area, total, low, high, least = [0.0] * n, [1] * n, v.tolist(), v.tolist(), v.tolist(), p.tolist()
    _, _, parent, moved, _ = joined_nodes(level, area, total, low, high, least, np.searchsorted(p, a).tolist(), np.searchsorted(p, b).tolist(), alpha.tolist())
    final, parents = settled(parent, moved)
    kept = np.flatnonzero(np.array(moved) < 0)
    nodes = pd.DataFrame({"alpha": np.array(level, np.float32), "min_p": least, "area": area, "sum_pix": total, "min_pix": low, "max_pix": high, "old": np.arange(len(level)), "up": parents}).iloc[kept]
    nodes = nodes.sort_values(["alpha", "min_p"], kind="stable")
    number = np.full(len(level), -1)
    number[nodes.old.to_numpy()] = np.arange(len(nodes))
    nodes["node_id"] = np.arange(len(nodes))
    nodes["parent_id"] = pd.array(np.where(nodes.up.to_numpy() >= 0, number[nodes.up.to_numpy()], -1), dtype="Int64")
    nodes.loc[nodes.up < 0, "parent_id"] = pd.NA
    return nodes, number[final[:n]]


NODE = "image_id bigint, node_id bigint, alpha float, min_p bigint, area bigint, sum_pix double, min_pix double, max_pix double, parent_id bigint"


def build(grid: Grid, spanning: DataFrame) -> Hierarchy:
    """The hierarchy from each image's spanning tree, or from edges that hold it, in one task an image.

    Pixels and edges come as one grouped table. Nodes and leaves come back as one table, which is kept in the
    shared folder, so that the build runs once.
    """
    none = F.lit(None)
    rows = grid.pixels.select("image_id", "p", F.get("v", F.lit(0)).alias("v"), none.cast("bigint").alias("q"), none.cast("float").alias("alpha"), none.cast("bigint").alias("edge_id"))
    rows = rows.union(spanning.select("image_id", "p0", none.cast("double"), "p1", "alpha", "edge_id"))

    def tree(part: pd.DataFrame) -> pd.DataFrame:
        is_edge = part.edge_id.notna()
        pixels = part[~is_edge].sort_values("p")
        edges = part[is_edge].sort_values(["alpha", "edge_id"])
        nodes, leaf = _dendrogram(pixels.p.to_numpy(), pixels.v.to_numpy(float), edges.p.to_numpy(), edges.q.to_numpy(np.int64), edges.alpha.to_numpy(float))
        image = part.image_id.iloc[0]
        nodes = nodes[["node_id", "alpha", "min_p", "area", "sum_pix", "min_pix", "max_pix", "parent_id"]].assign(image_id=image, leaf=False)
        leaves = pd.DataFrame({"image_id": image, "min_p": pixels.p.to_numpy(), "node_id": leaf, "leaf": True, "parent_id": pd.array([pd.NA] * len(leaf), dtype="Int64")})
        return pd.concat([nodes, leaves])[[*(c.split()[0] for c in NODE.split(", ")), "leaf"]]

    made = shared_checkpoint(rows.groupBy("image_id").applyInPandas(tree, NODE + ", leaf boolean"))
    return Hierarchy(made.where("not leaf").drop("leaf"), made.where("leaf").select("image_id", F.col("min_p").alias("p"), "node_id"), grid)


COLUMNS = ("image_id", "edge_id", "p0", "p1", "alpha")


def spanning_kruskal(found: DataFrame, grid: Grid, whole: bool = True, **_) -> DataFrame:
    """One task an image takes all its edges in order. Where the whole tree isn't asked for, edges that close cycles may be left to the build."""
    return local_forest(found, "image_id") if whole else found.select(*COLUMNS)


def spanning_tiled(found: DataFrame, grid: Grid, parts: int = 16, whole: bool = True, **_) -> DataFrame:
    """Tiles first: edges within a tile shrink to its forest, side by side, and meet the edges between tiles in one task an image.

    An edge that is on no tile's minimum spanning forest is the heaviest of a cycle, and not in the whole tree. Tiles' forests and
    the edges between tiles are about as many as pixels, so that coarser tiles in between would not shrink them further.
    """
    rows, columns = tile_grid(grid.height, grid.width, parts)
    th, tw = -(-grid.height // rows), -(-grid.width // columns)

    def tile(p: str):
        return tile_of(F.floor(F.col(p) / grid.width), F.col(p) % grid.width, th, tw, rows, columns)

    placed = found.select(*COLUMNS, tile("p0").alias("t"), tile("p1").alias("u"))
    left = local_forest(placed.where("t = u"), "image_id", "t").union(placed.where("t <> u").select(*COLUMNS))
    return local_forest(left, "image_id") if whole else left


def spanning_ranked(found: DataFrame, grid: Grid, bins: int = 8, whole: bool = True, tile: int = TILE, **_) -> DataFrame:
    """Bins of the edges' ranks: each bin's forest by itself, and then the image's.

    A bin's cycles lose their heaviest edges wherever the other bins' edges are; what is left of all bins is a fraction of the edges.
    Of images of over `tile` pixels, a bin's edges within each tile, and those between each two, are a forest of their own, so that no task holds a whole bin.
    """
    large = grid.size > tile
    with_ranks = ranked(found.select(*COLUMNS), keep=shared_table) if large else ranked(found)
    size = max(1, -(-(grid.size * 4) // bins))
    placed = with_ranks.withColumn("b", F.floor(F.col("rank") / size).cast("bigint"))
    if large:
        placed = placed.withColumns(dict(zip(("t", "u"), tile_columns(grid, tile, "p0", "p1"), strict=True)))
    left = local_forest(placed, "image_id", "b", *(("t", "u") if large else ()))
    return local_forest(left, "image_id") if whole else left


def pointer_jumped(jump: DataFrame, node: str = "c") -> DataFrame:
    """(image_id, node, to) with `to` moved on to the end of each path; three doublings a round, and a round that changes nothing ends it."""
    while True:
        then = jump.withColumnRenamed("to", "was").withColumn("to", F.col("was"))
        for _ in range(3):
            over = jump.select("image_id", F.col(node).alias("to"), F.col("to").alias("further"))
            then = then.join(over, ["image_id", "to"]).select("image_id", node, "was", F.col("further").alias("to"))
        then = shared_checkpoint(then)
        moved = then.where("was <> to").limit(1).count()
        jump = then.select("image_id", node, "to")
        if not moved:
            return jump


def _round(active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges that a round takes, one for each component, and the components' names (image_id, c, to) after it."""
    first = F.min(F.struct("alpha", "edge_id", "p0", "p1", "d"))
    ends = active.select("image_id", F.inline(F.array(F.struct(F.col("c0").alias("c"), F.col("c1").alias("d")), F.struct(F.col("c1").alias("c"), F.col("c0").alias("d")))), "alpha", "edge_id", "p0", "p1")
    chosen = shared_checkpoint(ends.groupBy("image_id", "c").agg(first.alias("m")).select("image_id", "c", "m.*"))
    to = chosen.select("image_id", "c", F.col("d").alias("to"))
    back = to.select("image_id", F.col("c").alias("to"), F.col("to").alias("back"))
    # two components that chose one edge point at each other, and the smaller becomes the root
    own = F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to"))
    jump = shared_checkpoint(to.join(back, ["image_id", "to"]).select("image_id", "c", own.alias("to")))
    return chosen.select(*COLUMNS).distinct(), pointer_jumped(jump)


JOINED = EDGE + ", c bigint, to bigint"


def _in_one_task(active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of all edges of an image at once, in order."""

    def join(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["alpha", "edge_id"], kind="stable")
        kept, ends, least = _forest(part.c0.to_numpy(), part.c1.to_numpy())
        names = pd.DataFrame({"image_id": part.image_id.iloc[0], "edge_id": -1, "p0": -1, "p1": -1, "alpha": np.float32(0), "c": ends, "to": least})
        return pd.concat([part.iloc[kept][[*COLUMNS]].assign(c=-1, to=-1), names])

    out = shared_checkpoint(active.groupBy("image_id").applyInPandas(join, JOINED))
    return out.where("c < 0").select(*COLUMNS), out.where("c >= 0").select("image_id", "c", "to")


def _renamed(left: DataFrame, names: DataFrame) -> DataFrame:
    """The edges between the components' new names: of those between the same two, the first."""
    for c in ("c0", "c1"):
        left = left.join(names.select("image_id", F.col("c").alias(c), F.col("to").alias("_n")), ["image_id", c], "left").withColumn(c, F.coalesce("_n", c)).drop("_n")
    pair = (F.least("c0", "c1").alias("c0"), F.greatest("c0", "c1").alias("c1"))
    first = F.min(F.struct("alpha", "edge_id", "p0", "p1")).alias("m")
    return shared_checkpoint(left.where("c0 <> c1").groupBy("image_id", *pair).agg(first).select("image_id", "m.edge_id", "m.p0", "m.p1", "m.alpha", "c0", "c1"))


def _merged(left: DataFrame, tree: DataFrame, most: float | None = None, rounds: int = 0, tail: int = TAIL) -> tuple[DataFrame, DataFrame]:
    """The edges (..., c0, c1) of weights up to `most` join components until they join no two: what is left of the heavier edges, and the tree with those taken.

    Rounds, `rounds` at least, shrink the edges until no image has more than `tail` between its components; one task an image takes these. The heavier
    edges get the components' names once, after the rounds.
    """
    active = left if most is None else left.where(F.col("alpha") <= F.lit(most))
    names = None
    while True:
        size = active.groupBy("image_id").count().agg(F.max("count")).first()[0]
        if not size:
            break
        last = rounds <= 0 and size <= tail
        taken, then = _in_one_task(active) if last else _round(active)
        tree, rounds = tree.union(taken), rounds - 1
        if names is not None and most is not None:
            over = then.select("image_id", F.col("c").alias("to"), F.col("to").alias("_n"))
            names = shared_checkpoint(names.join(over, ["image_id", "to"], "left").select("image_id", "c", F.coalesce("_n", "to").alias("to")))
        else:
            names = then
        if last:
            break
        active = _renamed(active, then)
    if most is None:
        return left.limit(0), tree
    heavy = left.where(F.col("alpha") > F.lit(most))
    return heavy if names is None else _renamed(heavy, names), tree


def _unmerged(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = found.select(*COLUMNS, F.col("p0").alias("c0"), F.col("p1").alias("c1"))
    return left, found.select(*COLUMNS).limit(0)


def spanning_boruvka(found: DataFrame, grid: Grid, kept: bool = False, tail: int = TAIL, tile: int = TILE, **_) -> DataFrame:
    """Rounds in which every component takes its first edge, and components merge by pointer jumping; each takes at most half of the components to the next.

    After the first, edges between components are taken by one task an image where these are at most `tail`. Lineage is cut in the shared folder
    after each round; `kept` tells that the edges are there already. In images of over `tile` pixels, tiles go through rounds by themselves before.
    """
    if grid.size > tile:
        taken, left = contracted(found, grid, "rounds", tile)
        return _merged(shared_checkpoint(left), taken, tail=tail)[1]
    left, tree = _unmerged(found if kept else shared_checkpoint(found.select(*COLUMNS)))
    return shared_checkpoint(_merged(left, tree, rounds=1, tail=tail)[1])


def spanning_levels(found: DataFrame, grid: Grid, most: int = 64, bins: int = 8, kept: bool = False, tail: int = TAIL, tile: int = TILE, **_) -> DataFrame:
    """One level after the other, for up to `most` distinct weights: the edges of a level join the components of those below.

    More weights are taken in about `bins` ranges of levels, each until its edges join no two components: in one task an image where
    these are at most `tail`, or after rounds. In images of over `tile` pixels, tiles go through all levels by themselves before.
    """
    large = grid.size > tile
    if large:
        tree, left = contracted(found, grid, "levels", tile)
        found = left = shared_checkpoint(left)
    else:
        found = found if kept else shared_checkpoint(found.select(*COLUMNS))
        left, tree = _unmerged(found)
    levels = [r[0] for r in found.select("alpha").distinct().orderBy("alpha").limit(most + 1).collect()]
    if len(levels) > most:
        levels = [*sorted(set(found.approxQuantile("alpha", [k / bins for k in range(1, bins)], 0.25 / bins))), None]
    for level in levels:
        left, tree = _merged(left, tree, level, tail=tail)
    return tree if large else shared_checkpoint(tree)


def redundant(found: DataFrame, parts: int, grid: Grid) -> DataFrame:
    """Edges within tiles that no minimum spanning tree of the image holds: the heaviest of a cycle within their tile."""
    rows, columns = tile_grid(grid.height, grid.width, parts)
    th, tw = -(-grid.height // rows), -(-grid.width // columns)

    def tile(p: str):
        return tile_of(F.floor(F.col(p) / grid.width), F.col(p) % grid.width, th, tw, rows, columns)

    placed = found.withColumn("t", tile("p0")).where(F.col("t") == tile("p1"))
    kept = local_forest(placed, "image_id", "t").select("image_id", "edge_id")
    return placed.drop("t").join(kept, ["image_id", "edge_id"], "left_anti")


def component_labels(found: DataFrame, pixels: DataFrame, level: float) -> DataFrame:
    """(image_id, p, label): the least pixel that each pixel reaches over edges of at most a level."""
    light = found.where(F.col("alpha") <= F.lit(float(level)))
    label = shared_checkpoint(pixels.select("image_id", "p", F.col("p").alias("label")))
    ways = shared_checkpoint(both_ways(light).select("image_id", "p", "q"))
    while True:
        near = ways.join(label.withColumnRenamed("p", "q"), ["image_id", "q"]).groupBy("image_id", "p").agg(F.min("label").alias("m"))
        then = label.join(near, ["image_id", "p"], "left").select("image_id", "p", "label", F.least("label", F.coalesce("m", "label")).alias("m"))
        # a label is a pixel, and takes that pixel's own label
        further = then.select("image_id", F.col("p").alias("m"), F.col("m").alias("f"))
        then = shared_checkpoint(then.join(further, ["image_id", "m"]).select("image_id", "p", F.col("label").alias("was"), F.least("m", "f").alias("label")))
        changed = then.where("was <> label").limit(1).count()
        label = then.select("image_id", "p", "label")
        if not changed:
            return label


STRATEGIES = {"kruskal": spanning_kruskal, "tiled": spanning_tiled, "rank_bins": spanning_ranked, "boruvka": spanning_boruvka, "levels": spanning_levels}
