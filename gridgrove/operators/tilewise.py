"""Work on large images a tile at a time: what a tile settles by itself, and the little that its neighbours have a part in.

An edge between tiles is heavier than all edges that come before it in order. So a component that no such edge has met so far is whole: its nodes are the image's,
and its first edge is on the image's spanning tree. What other components do is left to steps over all tiles, which get a tile's borders, not its pixels.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgrove.operators.binned import BIN, TOP, named_tops
from gridgrove.operators.contract import TILE, root_of, tile_columns
from gridgrove.operators.lineage import shared_table
from gridgrove.operators.tree import settled
from gridgrove.sources.grid import Grid

NODE, TOPMOST, EDGE, HALF = range(4)
ROW = "image_id bigint, who bigint, kind tinyint, alpha float, min_p bigint, area bigint, sum_pix double, min_pix double, max_pix double, up_alpha float, up_min_p bigint, c bigint, to bigint, edge_id bigint"
COLUMNS = [x.split()[0] for x in ROW.split(", ")]
NAMED = ("alpha", "min_p", "area", "sum_pix", "min_pix", "max_pix", "up_alpha", "up_min_p")


def tile_nodes(p: np.ndarray, v: np.ndarray, x: np.ndarray, y: np.ndarray, alpha: np.ndarray, edge_id: np.ndarray, at: np.ndarray, cross: np.ndarray) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame, np.ndarray]:
    """What a tile makes of its edges, in order, between places of its sorted pixels; edges of weights `cross` lead from places `at` to other tiles.

    Returns nodes that have their parent in the tile, components' topmost nodes, edges that are left between components, and each pixel's component. Components that
    an edge between tiles has met, or one that is left, are open, and are joined to no other here. One that no such edge ever meets becomes, at the weight that joins it to an open
    one, a part of the node of that weight; all that come to the same node within the tile are one such part.
    """
    n = len(p)
    level, area, total, low, high, least = [0.0] * n, [1] * n, v.tolist(), v.tolist(), v.tolist(), p.tolist()
    up, around, top = list(range(n)), list(range(n)), list(range(n))  # around: components over all of the tile's edges
    parent, moved = [-1] * n, [-1] * n
    first = np.full(n, math.inf)
    np.minimum.at(first, at, cross)
    first = first.tolist()  # the weight from which on a component is open
    part: dict[int, tuple[float, int]] = {}  # by the root in `around`: the last part made, its weight and component
    left: list[tuple[int, int, int]] = []

    def joined(i: int, j: int, t: float) -> int:
        """Nodes i and j have become one node of level t."""
        if level[j] == t and level[i] != t:
            i, j = j, i
        if level[i] == t:
            if level[j] == t:
                moved[j] = i
            else:
                parent[j] = i
            area[i] += area[j]
            total[i] += total[j]
            low[i], high[i], least[i] = min(low[i], low[j]), max(high[i], high[j]), min(least[i], least[j])
            return i
        k = raised(i, t)
        area[k] += area[j]
        total[k] += total[j]
        low[k], high[k], least[k] = min(low[k], low[j]), max(high[k], high[j]), min(least[k], least[j])
        parent[j] = k
        return k

    def raised(i: int, t: float) -> int:
        """Node i, or its new parent, at level t."""
        if level[i] == t:
            return i
        for values, value in ((level, t), (area, area[i]), (total, total[i]), (low, low[i]), (high, high[i]), (least, least[i]), (parent, -1), (moved, -1)):
            values.append(value)
        parent[i] = len(level) - 1
        return parent[i]

    for e, (a, b, t) in enumerate(zip(x.tolist(), y.tolist(), alpha.tolist(), strict=True)):
        ra, rb = a, b
        while around[ra] != ra:
            around[ra] = around[around[ra]]
            ra = around[ra]
        while around[rb] != rb:
            around[rb] = around[around[rb]]
            rb = around[rb]
        if ra == rb:
            continue
        around[rb] = ra
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        while up[b] != b:
            up[b] = up[up[b]]
            b = up[b]
        if first[a] > t and first[b] > t:
            up[b] = a
            top[a] = joined(top[a], top[b], t)
            if first[b] < first[a]:
                first[a] = first[b]
            continue
        of_a, of_b = part.pop(ra, None), part.pop(rb, None)
        there = of_a if of_a and of_a[0] == t else of_b if of_b and of_b[0] == t else None
        shut = a if first[a] == math.inf else b if first[b] == math.inf else -1
        if shut >= 0 and there:
            up[shut] = there[1]
            top[there[1]] = joined(top[there[1]], top[shut], t)
        else:
            if shut >= 0:
                top[shut] = raised(top[shut], t)
                there = t, shut
            first[a] = first[b] = min(first[a], first[b])
            left.append((e, a, b))
        if there:
            part[ra] = there
    final, parents = settled(parent, moved)
    component = np.array([root_of(up, k) for k in range(n)], np.int64)
    made = pd.DataFrame({"alpha": np.array(level, np.float32), "min_p": least, "area": area, "sum_pix": total, "min_pix": low, "max_pix": high})
    heads = np.flatnonzero(component == np.arange(n))
    tops = final[np.array(top, np.int64)[heads]]
    named = np.full(len(level), -1)
    named[tops] = p[heads]
    made["c"] = named
    held = np.flatnonzero(parents >= 0)
    held = held[np.array(moved, np.int64)[held] < 0]
    over = parents[held]
    known = named[over] < 0
    nodes = made.iloc[held].assign(
        up_alpha=np.where(known, made.alpha.to_numpy()[over], np.float32(np.nan)), up_min_p=np.where(known, made.min_p.to_numpy()[over], -1), to=named[over], c=-1
    )
    e, a, b = np.array(left, np.int64).reshape(-1, 3).T
    edges = pd.DataFrame({"alpha": alpha[e].astype(np.float32), "c": p[a], "to": p[b], "edge_id": edge_id[e]})
    return nodes, made.iloc[tops], edges, p[component]


def _tile_rows(part: pd.DataFrame, n: int) -> pd.DataFrame:
    """A tile's rows of each kind, for n hierarchies. Nodes that several of them have are one row; `who` has a bit for each."""
    image = part.image_id.iloc[0]
    who = part.who.to_numpy()
    pixels = part[who < 0].sort_values("p")
    p, v = pixels.p.to_numpy(), pixels.v.to_numpy(float)
    nodes, rest = [], []
    for k in range(n):
        own = part[who == k]
        inner = own[own.side < 0].sort_values(["alpha", "edge_id"], kind="stable")
        outer = own[own.side >= 0]
        places = np.searchsorted(p, outer.p.to_numpy())
        made, tops, edges, component = tile_nodes(p, v, np.searchsorted(p, inner.p.to_numpy()), np.searchsorted(p, inner.q.to_numpy()), inner.alpha.to_numpy(float), inner.edge_id.to_numpy(), places, outer.alpha.to_numpy(float))
        ends = component[places]
        side = outer.side.to_numpy()
        halves = pd.DataFrame({"alpha": outer.alpha.to_numpy(np.float32), "edge_id": outer.edge_id.to_numpy(), "c": np.where(side == 0, ends, -1), "to": np.where(side == 1, ends, -1)})
        nodes.append(made.assign(who=1 << k))
        rest += [tops.assign(kind=TOPMOST, who=k), edges.assign(kind=EDGE, who=k), halves.assign(kind=HALF, who=k)]
    nodes = pd.concat(nodes)
    same = nodes[nodes["to"] < 0].drop(columns=["c", "to"]).groupby(list(NAMED), sort=False, dropna=False).who.sum().reset_index()
    out = pd.concat([same.assign(kind=NODE), nodes[nodes["to"] >= 0].assign(kind=NODE), *rest]).assign(image_id=image)
    for name in COLUMNS:
        if name not in out:
            out[name] = np.nan
    out = out[COLUMNS].astype({c: "float64" for c in ("sum_pix", "min_pix", "max_pix")} | {c: "float32" for c in ("alpha", "up_alpha")})
    return out.fillna({c: -1 for c in ("min_p", "area", "up_min_p", "c", "to", "edge_id")}).astype({c: "int64" for c in ("min_p", "area", "up_min_p", "c", "to", "edge_id", "who")})


def hierarchies_by_tile(grid: Grid, spanning: list[DataFrame], tile: int = TILE, size: int = BIN) -> DataFrame:
    """The nodes of the hierarchies that several sets of edges make of the same images: (image_id, who, alpha, min_p, ..., up_alpha, up_min_p).

    `who` has the bit k of the hierarchies that have a node, which may be on several rows. A node is named by its level and least pixel, as is its parent, whose name is
    empty (NaN and -1) for a root. A task holds a tile's pixels and edges, or a bin of at most `size` edges of what tiles leave.
    """
    n = len(spanning)
    none = F.lit(None)
    own, (mine, other) = tile_columns(grid, tile, "p")[0], tile_columns(grid, tile, "p0", "p1")
    rows = grid.pixels.select("image_id", own.alias("tile"), F.lit(-1).alias("who"), F.lit(-1).alias("side"), "p", none.cast("bigint").alias("q"), F.get("v", F.lit(0)).cast("double").alias("v"), none.cast("float").alias("alpha"), none.cast("bigint").alias("edge_id"))
    for k, found in enumerate(spanning):
        ends = [F.struct(F.col(t).alias("tile"), F.lit(side).alias("side"), F.col(a).alias("p"), F.col(b).alias("q")) for t, side, a, b in (("t", -1, "p0", "p1"), ("t", 0, "p0", "p1"), ("u", 1, "p1", "p0"))]
        placed = found.select("image_id", mine.alias("t"), other.alias("u"), "p0", "p1", "alpha", "edge_id")
        at = F.when(F.col("t") == F.col("u"), F.array(ends[0])).otherwise(F.array(ends[1], ends[2]))
        placed = placed.select("image_id", "alpha", "edge_id", F.inline(at))
        rows = rows.union(placed.select("image_id", "tile", F.lit(k), "side", "p", "q", none.cast("double"), "alpha", "edge_id"))
    made = shared_table(rows.groupBy("image_id", "tile").applyInPandas(lambda part: _tile_rows(part, n), ROW))
    image = (F.col("image_id") * n + F.col("who")).alias("image_id")
    tops = made.where(F.col("kind") == TOPMOST).select(image, "c", F.col("c").alias("id"), *TOP[3:])
    inner = made.where(F.col("kind") == EDGE).select(image, "edge_id", F.col("c").alias("c0"), F.col("to").alias("c1"), "alpha")
    halves = made.where(F.col("kind") == HALF).select(image, "edge_id", "c", "to", "alpha")
    outer = halves.groupBy("image_id", "edge_id").agg(F.max("c").alias("c0"), F.max("to").alias("c1"), F.first("alpha").alias("alpha"))
    over, names = named_tops(tops, inner.union(outer), grid.size, size)
    nodes = made.where(F.col("kind") == NODE)
    lost = nodes.where("to >= 0").select(*COLUMNS[:9], (F.col("image_id") * n + F.expr("bit_count(who - 1)")).alias("of"), "to")
    found = lost.join(names.select(F.col("image_id").alias("of"), F.col("id").alias("to"), F.col("alpha").alias("up_alpha"), F.col("min_p").alias("up_min_p")), ["of", "to"])
    columns = ["image_id", "who", *NAMED]
    return nodes.where("to < 0").select(*columns).union(found.select(*columns)).union(over.select(F.expr(f"image_id div {n}"), F.expr(f"shiftleft(1L, cast(image_id % {n} as int))"), *NAMED))
