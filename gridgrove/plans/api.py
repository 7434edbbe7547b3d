"""One call from a grid to its hierarchy: names of algorithms become strategies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgrove.functions.scalar import check_connectivity
from gridgrove.operators.binned import BIN, build_in_bins
from gridgrove.operators.edges import edges
from gridgrove.operators.contract import TILE
from gridgrove.operators.lineage import shared_checkpoint, shared_table
from gridgrove.operators.tilewise import hierarchies_by_tile
from gridgrove.operators.tree import COLUMNS, STRATEGIES, Hierarchy, build
from gridgrove.sources.grid import Grid

# Names that configurations use for algorithms. All give the same hierarchy; each stands for the strategy next to it.
ALGORITHMS = {
    "Unionfind": "kruskal",
    "FloodHierQueue": "kruskal",
    "FloodTrieQueue": "kruskal",
    "FloodHeapQueue": "kruskal",
    "FloodHierHeapQueue": "kruskal",
    "FloodLadderQueue": "kruskal",
    "FloodHierQueueParallel": "tiled",
    "HybridParallel": "rank_bins",
    "FloodHierQueueNoCache": "kruskal",
    "FloodTrieQueueNoCache": "kruskal",
    "FloodHeapQueueNoCache": "kruskal",
    "FloodHierQueueHypergraph": "boruvka",
    "FloodTrieQueueHypergraph": "boruvka",
    "FloodHierHeapQueueHisteq": "kruskal",
    "FloodHierHeapQueueNoCache": "kruskal",
    "FloodHeapQueueNaiveNoCache": "kruskal",
}
PART_PIXELS = 100_000
ONE_TASK = 1_000_000  # pixels up to which one task builds an image's hierarchy
NOT_BUILT = ("FloodHierQueueParalle", "FloodHierHeapQueuePar")


def strategy(algorithm: str) -> str:
    """The strategy of an algorithm's or a strategy's name; unknown names raise an error."""
    if algorithm in STRATEGIES:
        return algorithm
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    return ALGORITHMS[algorithm]


def _name(algorithm: str, large: bool) -> str:
    """The strategy that an algorithm's name stands for, by the images' size."""
    name = "kruskal" if algorithm == "auto" else strategy(algorithm)
    return "tiled" if name == "kruskal" != algorithm and large else name


def _built(grid: Grid, spanning: DataFrame, bin_edges: int | None, keep_leaves: bool = True) -> Hierarchy:
    return build_in_bins(grid, spanning, bin_edges or BIN, keep_leaves) if grid.size > ONE_TASK or bin_edges else build(grid, spanning)


def build_hierarchy(grid: Grid, connectivity: int = 4, metric: str | None = "L2", algorithm: str = "FloodHierHeapQueue", parts: int | None = None, bins: int = 8, bin_edges: int | None = None) -> Hierarchy:
    """The hierarchy of each of the grid's images. `auto`, and names that stand for kruskal, choose by the images' size. Tiles, where no number of them is given, have about PART_PIXELS pixels.

    Images of over ONE_TASK pixels are built in bins of at most `bin_edges` edges a task (BIN where none is given), as are smaller ones where it is given.
    """
    check_connectivity(connectivity)
    parts = parts or max(16, grid.size // PART_PIXELS)
    name = _name(algorithm, grid.size > ONE_TASK)
    return _built(grid, STRATEGIES[name](edges(grid, connectivity, metric), grid, parts=parts, bins=bins, whole=False), bin_edges)


def build_hierarchies(grid: Grid, algorithms: tuple[str, ...], connectivity: int = 4, metric: str | None = "L2", parts: int | None = None, bins: int = 8, bin_edges: int | None = None) -> Hierarchy:
    """What `build_hierarchy` makes by each of several algorithms, built side by side as images of one grid: image i by the k-th of n is image i * n + k.

    Each algorithm finds its own edges and each image is built by itself; the edges' weights are computed once, and the builds' steps are shared jobs.
    """
    check_connectivity(connectivity)
    found = shared_checkpoint(edges(grid, connectivity, metric).select(*COLUMNS))

    def image(k: int):
        return (F.col("image_id") * len(algorithms) + k).alias("image_id")

    spanning = [own.select(image(k), *COLUMNS[1:]) for k, own in enumerate(_spanning(found, grid, algorithms, parts or max(16, grid.size // PART_PIXELS), bins))]
    pixels = grid.pixels.withColumn("image_id", F.explode(F.array(*(image(k) for k in range(len(algorithms))))))
    return _built(Grid(pixels, grid.height, grid.width, grid.channels, grid.bits), reduce(DataFrame.union, spanning), bin_edges, keep_leaves=False)


def _spanning(found: DataFrame, grid: Grid, algorithms: tuple[str, ...], parts: int, bins: int, **sizes) -> list[DataFrame]:
    return [STRATEGIES[_name(a, grid.size > ONE_TASK)](found, grid, parts=parts, bins=bins, whole=False, kept=True, **sizes).select(*COLUMNS) for a in algorithms]


def named_hierarchies(grid: Grid, algorithms: tuple[str, ...], connectivity: int = 4, metric: str | None = "L2", bins: int = 8, tile: int = TILE) -> DataFrame:
    """The nodes that each of several algorithms' edges make of the same images, without numbers: see `hierarchies_by_tile`. Bit k of `who` stands for the k-th.

    No task holds more than a tile of about `tile` pixels, or a bin of the edges that tiles leave.
    """
    check_connectivity(connectivity)
    found = shared_table(edges(grid, connectivity, metric).select(*COLUMNS))
    return hierarchies_by_tile(grid, _spanning(found, grid, algorithms, max(4, grid.size // tile), bins, tile=tile), tile)
