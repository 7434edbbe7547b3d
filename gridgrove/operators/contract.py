"""Spanning trees of large images, a tile at a time: what a tile's edges settle whatever the other tiles hold, and the edges that this leaves.

A component's first edge is on the spanning tree, and a tile knows it where no edge to another tile comes before it. So the components that tiles leave are about as many as the pixels at their borders.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridgrove.functions.scalar import tile_grid, tile_of
from gridgrove.operators.lineage import shared_table
from gridgrove.sources.grid import Grid

TILE = 25_000  # pixels of a tile, about


def tile_columns(grid: Grid, pixels: int, *ends: str) -> list[Column]:
    """The tile of each of some pixels, where tiles have about so many pixels."""
    rows, columns = tile_grid(grid.height, grid.width, -(-grid.size // pixels))
    th, tw = -(-grid.height // rows), -(-grid.width // columns)
    return [tile_of(F.floor(F.col(p) / grid.width), F.col(p) % grid.width, th, tw, rows, columns) for p in ends]


def root_of(up: list[int], k: int) -> int:
    while up[k] != k:
        up[k] = up[up[k]]
        k = up[k]
    return k


def _first_edges(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rounds over edges in order, from places x to y, or to other tiles where y is -1: each component takes its first edge while that is within the tile. The edges taken, and the components."""
    n = int(max(x.max(initial=-1), y.max(initial=-1))) + 1
    component, taken = np.arange(n), []
    e = np.arange(len(x))
    while True:
        a, b = component[x[e]], np.where(y[e] >= 0, component[y[e]], -1)
        e, a, b = e[a != b], a[a != b], b[a != b]
        first = np.full(n + 1, -1)
        k = np.arange(len(e))[::-1]
        both = np.stack([k, k], 1).ravel()
        first[np.stack([a[k], b[k]], 1).ravel()] = both  # of several, the last one written stays: the first edge
        c = np.flatnonzero(first[:n] >= 0)
        k = first[c]
        c, k = c[b[k] >= 0], k[b[k] >= 0]
        if not len(c):
            return np.unique(np.concatenate(taken)) if taken else np.zeros(0, np.int64), component
        to = np.arange(n)
        to[c] = np.where(a[k] == c, b[k], a[k])
        root = (to[to] == np.arange(n)) & (np.arange(n) < to)
        to[root] = np.flatnonzero(root)
        while (to != to[to]).any():
            to = to[to]
        taken.append(e[k])
        component = to[component]


def _in_levels(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, level after level: each edge joins two components, unless both have met an edge to another tile before."""
    n = int(max(x.max(initial=-1), y.max(initial=-1))) + 1
    up, open_, taken = list(range(n)), [False] * n, []
    for e, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        if b < 0:
            open_[a] = True
            continue
        while up[b] != b:
            up[b] = up[up[b]]
            b = up[b]
        if a != b and not (open_[a] and open_[b]):
            up[b] = a
            open_[a] = open_[a] or open_[b]
            taken.append(e)
    return np.array(taken, np.int64), np.array([root_of(up, k) for k in range(n)], np.int64)


WAYS = {"rounds": _first_edges, "levels": _in_levels}
CONTRACTED = "image_id bigint, edge_id bigint, p0 bigint, p1 bigint, alpha float, c0 bigint, c1 bigint, kind string"


def contracted(found: DataFrame, grid: Grid, way: str, tile: int) -> tuple[DataFrame, DataFrame]:
    """The spanning tree's edges that tiles find by themselves, and the edges (..., c0, c1) between the components that these make; of those within a tile that join the same two, the first."""
    joins = WAYS[way]
    mine, other = tile_columns(grid, tile, "p0", "p1")
    placed = found.select("image_id", "edge_id", "p0", "p1", "alpha", mine.alias("t"), other.alias("u"))
    at = F.when(F.col("t") == F.col("u"), F.array(F.struct(F.col("t").alias("tile"), F.lit(-1).alias("side")))).otherwise(F.array(F.struct(F.col("t").alias("tile"), F.lit(0).alias("side")), F.struct(F.col("u").alias("tile"), F.lit(1).alias("side"))))
    placed = placed.select("image_id", "edge_id", "p0", "p1", "alpha", F.inline(at))

    def join(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["alpha", "edge_id"], kind="stable").reset_index(drop=True)
        side = part.side.to_numpy()
        a, b = np.where(side == 1, part.p1, part.p0), np.where(side < 0, part.p1, -1)
        p = np.unique(np.concatenate([a, b[b >= 0]]))
        x, y = np.searchsorted(p, a), np.where(b >= 0, np.searchsorted(p, b), -1)
        taken, component = joins(x, y)
        c, d = component[x], np.where(y >= 0, component[y], -1)
        part["c0"] = np.where(side == 1, -1, p[c])
        part["c1"] = np.where(side == 1, p[c], np.where(side == 0, -1, p[d]))
        part["kind"] = np.where(side < 0, "inner", "half")
        part.loc[taken, "kind"] = "taken"
        inner = part[(side < 0) & (c != d) & (part.kind != "taken")]
        pair = pd.DataFrame({"a": np.minimum(inner.c0, inner.c1), "b": np.maximum(inner.c0, inner.c1)})
        inner = inner[~pair.duplicated().to_numpy()]
        return pd.concat([part.iloc[taken], inner, part[side >= 0]])[[x.split()[0] for x in CONTRACTED.split(", ")]]

    out = shared_table(placed.groupBy("image_id", "tile").applyInPandas(join, CONTRACTED))
    columns = ("image_id", "edge_id", "p0", "p1", "alpha")
    halves = out.where("kind = 'half'").groupBy("image_id", "edge_id").agg(*(F.first(c).alias(c) for c in columns[2:]), F.max("c0").alias("c0"), F.max("c1").alias("c1"))
    left = out.where("kind = 'inner'").select(*columns, "c0", "c1").union(halves.select(*columns, "c0", "c1"))
    return out.where("kind = 'taken'").select(*columns), left
