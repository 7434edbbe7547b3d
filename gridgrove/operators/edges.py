"""Edges between neighbouring pixels, their order, and statistics of their weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridgrove.functions.scalar import OFFSETS, check_connectivity, dissimilarity, edge_number, linear_level, log_level, rank_bin, size_curve, tile_of
from gridgrove.functions.scalar import SIZE_LEAST
from gridgrove.operators.lineage import shared_checkpoint
from gridgrove.sources.grid import Grid


def edges(grid: Grid, connectivity: int = 4, metric: str | Column | None = "L2") -> DataFrame:
    """(image_id, edge_id, p0, p1, dir, alpha): each pair of neighbours once.

    Each pixel is paired by number with the neighbours that its directions reach; pixels at the border have fewer.
    A missing pixel has no edges.
    """
    ways = OFFSETS[check_connectivity(connectivity)]
    w, h = grid.width, grid.height
    y, x = F.col("y"), F.col("x")
    reach = F.array(*(F.when((y + dy >= 0) & (y + dy < h) & (x + dx < w), F.struct(F.lit(d).cast("tinyint").alias("dir"), (F.col("p") + dy * w + dx).alias("p1"))) for d, (dy, dx) in enumerate(ways)))
    own = grid.pixels.select("image_id", F.col("p").alias("p0"), F.col("v").alias("v0"), F.inline(F.filter(reach, lambda r: r.isNotNull())))
    other = grid.pixels.select("image_id", F.col("p").alias("p1"), F.col("v").alias("v1"))
    joined = own.join(other, ["image_id", "p1"])
    alpha = dissimilarity(metric, grid.channels)(F.col("v0"), F.col("v1"))
    return joined.select("image_id", edge_number(F.col("p0"), F.col("dir"), connectivity).alias("edge_id"), "p0", "p1", "dir", alpha.alias("alpha"))


def edge_count(height: int, width: int, connectivity: int) -> int:
    """How many edges a full image has."""
    straight = width * (height - 1) + (width - 1) * height
    return straight + (2 * (width - 1) * (height - 1) if check_connectivity(connectivity) == 8 else 0)


def ranked(found: DataFrame, parts: int | None = None, keep: Callable[[DataFrame], DataFrame] = shared_checkpoint) -> DataFrame:
    """Edges with a rank from 0 by (alpha, edge_id) within their image.

    The edges are range-partitioned; a partition's ranks begin after the counts of those before it, so that no image
    is gathered in one task. Images may share partitions. The partitions are written once: sampled anew, or coalesced
    otherwise, a second use could have others. `keep` writes them.
    """
    order = ["image_id", "alpha", "edge_id"]
    placed = (found.repartitionByRange(parts, *order) if parts else found.repartitionByRange(*order)).withColumn("_part", F.spark_partition_id())
    placed = keep(placed)
    local = placed.withColumn("_local", F.row_number().over(Window.partitionBy("_part", "image_id").orderBy("alpha", "edge_id")) - 1)
    sizes = placed.groupBy("_part", "image_id").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("image_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", "image_id", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return local.join(sizes, ["_part", "image_id"]).withColumn("rank", (F.col("_local") + F.col("_before")).cast("bigint")).drop("_part", "_local", "_before")


def rank_to_edge(found: DataFrame) -> DataFrame:
    """(image_id, rank, edge_id)."""
    return ranked(found).select("image_id", "rank", "edge_id")


def sorted_edges(found: DataFrame) -> DataFrame:
    """Edges in the order of their weights."""
    return found.orderBy("image_id", "alpha", "edge_id")


def with_rank_bins(with_ranks: DataFrame, bins: int) -> DataFrame:
    """Edges with qrank, their rank over the size of a bin, of which there are `bins` at most for each image."""
    size = with_ranks.groupBy("image_id").agg(F.ceil((F.max("rank") + 1) / F.lit(bins)).cast("bigint").alias("_size"))
    return with_ranks.join(size, "image_id").withColumn("qrank", F.floor(F.col("rank") / F.col("_size")).cast("bigint")).drop("_size")


def histogram(found: DataFrame, level: Column | None = None) -> DataFrame:
    """(image_id, level, n): edges by the whole part of alpha, or by another level."""
    return found.groupBy("image_id", (linear_level(F.col("alpha")) if level is None else level).cast("bigint").alias("level")).agg(F.count("*").alias("n"))


def log_histogram(found: DataFrame, a: float = 15.0, levels: int | None = None) -> DataFrame:
    """(image_id, level, n) by the logarithm of alpha."""
    return histogram(found, log_level(F.col("alpha"), a, levels))


def _levels() -> Window:
    return Window.partitionBy("image_id").orderBy("level")


def cumulated(hist: DataFrame) -> DataFrame:
    """The histogram with cum, how many edges have at most a level; levels are few, so one task an image suffices."""
    return hist.withColumn("cum", F.sum("n").over(_levels().rowsBetween(Window.unboundedPreceding, 0)))


def offsets(hist: DataFrame) -> DataFrame:
    """The histogram with start, how many edges have a lower level: where a level's bucket begins."""
    return hist.withColumn("start", F.coalesce(F.sum("n").over(_levels().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def last_level(hist: DataFrame) -> DataFrame:
    """(image_id, level): the highest level that has edges."""
    return hist.where("n > 0").groupBy("image_id").agg(F.max("level").alias("level"))


def equalised(hist: DataFrame, bins: int) -> DataFrame:
    """(image_id, level, n, bin): each level's place among so many bins of like size."""
    total = F.sum("n").over(Window.partitionBy("image_id"))
    return cumulated(hist).withColumn("bin", F.floor(F.col("cum") * F.lit(bins - 1) / total).cast("bigint")).drop("cum")


def equalised_histogram(hist: DataFrame, bins: int) -> DataFrame:
    """(image_id, level, n) with the bins as levels."""
    return equalised(hist, bins).groupBy("image_id", F.col("bin").alias("level")).agg(F.sum("n").alias("n"))


def level_quantile(hist: DataFrame, share: float) -> DataFrame:
    """(image_id, level): the first level up to which more than a share of the edges lie."""
    total = F.sum("n").over(Window.partitionBy("image_id"))
    return cumulated(hist).withColumn("_t", total).where(F.col("cum") > F.col("_t") * F.lit(float(share))).groupBy("image_id").agg(F.min("level").alias("level"))


def edge_range(found: DataFrame) -> DataFrame:
    """(image_id, n, min_alpha, max_alpha, min_edge, max_edge), the first edges of the least and the largest weight."""
    first = F.struct("alpha", "edge_id")
    last = F.struct("alpha", (-F.col("edge_id")).alias("e"))
    out = found.groupBy("image_id").agg(F.count("*").alias("n"), F.min(first).alias("lo"), F.max(last).alias("hi"))
    return out.select("image_id", "n", F.col("lo.alpha").alias("min_alpha"), F.col("hi.alpha").alias("max_alpha"), F.col("lo.edge_id").alias("min_edge"), (-F.col("hi.e")).alias("max_edge"))


def both_ways(found: DataFrame) -> DataFrame:
    """(image_id, p, q, alpha, edge_id) of each edge from both ends, without a second scan."""
    ends = F.array(F.struct(F.col("p0").alias("p"), F.col("p1").alias("q")), F.struct(F.col("p1").alias("p"), F.col("p0").alias("q")))
    return found.select("image_id", F.inline(ends), "alpha", "edge_id")


def least_incident(found: DataFrame) -> DataFrame:
    """(image_id, p, edge_id, alpha): each pixel's first edge by weight and number."""
    out = both_ways(found).groupBy("image_id", "p").agg(F.min(F.struct("alpha", "edge_id")).alias("m"))
    return out.select("image_id", "p", F.col("m.edge_id").alias("edge_id"), F.col("m.alpha").alias("alpha"))


def largest_rank(with_ranks: DataFrame) -> DataFrame:
    """(image_id, p, edge_id, rank): each pixel's edge of the highest rank."""
    ends = with_ranks.select("image_id", F.explode(F.array("p0", "p1")).alias("p"), F.struct("rank", "edge_id").alias("r"))
    out = ends.groupBy("image_id", "p").agg(F.max("r").alias("m"))
    return out.select("image_id", "p", F.col("m.edge_id").alias("edge_id"), F.col("m.rank").alias("rank"))


def line_graph(found: DataFrame) -> DataFrame:
    """(image_id, e0, e1, alpha): edges that share a pixel, e0 < e1, weighted by the heavier one.

    A pixel has eight edges at most, so the pairs grow in proportion to the pixels.
    """
    at = found.select("image_id", F.explode(F.array("p0", "p1")).alias("p"), "edge_id", "alpha")
    own = at.select("image_id", "p", F.col("edge_id").alias("e0"), F.col("alpha").alias("a0"))
    other = at.select("image_id", "p", F.col("edge_id").alias("e1"), F.col("alpha").alias("a1"))
    return own.join(other, ["image_id", "p"]).where("e0 < e1").select("image_id", "e0", "e1", F.greatest("a0", "a1").alias("alpha"))


def size_estimate(hist: DataFrame, pixels: int, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(image_id, n_edges, nrmsd, estimate): how many nodes a hierarchy will have, by its histogram's spread.

    Small images, of under 10,000 pixels, are given the most that there can be: edges and pixels and 10.
    """
    sums = hist.groupBy(*by).agg(F.sum("n").alias("n_edges"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    n = F.col("n_edges").cast("double")
    nrmsd = F.when(n > 1, F.sqrt(F.greatest((F.col("squares") - n) / (n * (n - 1)), F.lit(0.0)))).otherwise(F.lit(0.0))
    out = sums.withColumn("nrmsd", nrmsd)
    most = F.lit(2.0 * pixels)
    size = F.when(F.lit(pixels) < SIZE_LEAST, 10 + n + pixels).otherwise(F.least(most, most * size_curve(F.col("nrmsd"))))
    return out.select(*by, "n_edges", "nrmsd", size.alias("estimate"))


def tiled(found: DataFrame, width: int, tile_height: int, tile_width: int, rows: int, columns: int) -> DataFrame:
    """Edges with t0 and t1, the tiles of their ends."""

    def tile(p: str) -> Column:
        return tile_of(F.floor(F.col(p) / width), F.col(p) % width, tile_height, tile_width, rows, columns)

    return found.withColumn("t0", tile("p0")).withColumn("t1", tile("p1"))


def tile_histogram(with_tiles: DataFrame) -> DataFrame:
    """(image_id, tile_id, level, n): edges within each tile by the whole part of alpha; with_tiles has t0 and t1."""
    return with_tiles.where("t0 = t1").groupBy("image_id", F.col("t0").alias("tile_id"), linear_level(F.col("alpha")).alias("level")).agg(F.count("*").alias("n"))


def tile_size_estimate(with_tiles: DataFrame, pixels: int) -> DataFrame:
    """(image_id, tile_id, n_edges, nrmsd, estimate) of each tile of so many pixels."""
    return size_estimate(tile_histogram(with_tiles), pixels, ("image_id", "tile_id"))


def tile_rank_histogram(with_bins: DataFrame) -> DataFrame:
    """(image_id, tile_id, qrank, n): edges within each tile by their ranks' bin; with_bins has t0, t1 and qrank."""
    return with_bins.where("t0 = t1").groupBy("image_id", F.col("t0").alias("tile_id"), "qrank").agg(F.count("*").alias("n"))


def tile_largest_bin(with_bins: DataFrame) -> DataFrame:
    """(image_id, tile_id, qrank): the highest bin within each tile."""
    return with_bins.where("t0 = t1").groupBy("image_id", F.col("t0").alias("tile_id")).agg(F.max("qrank").alias("qrank"))


def bin_offsets(with_bins: DataFrame) -> DataFrame:
    """(image_id, tile_id, qrank, n, start): where each tile's bins begin, tiles and then bins in order."""
    hist = tile_rank_histogram(with_bins)
    per_tile = hist.groupBy("image_id", "tile_id").agg(F.sum("n").alias("t"))
    before = Window.partitionBy("image_id").orderBy("tile_id").rowsBetween(Window.unboundedPreceding, -1)
    per_tile = per_tile.select("image_id", "tile_id", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("b"))
    within = Window.partitionBy("image_id", "tile_id").orderBy("qrank").rowsBetween(Window.unboundedPreceding, -1)
    return hist.join(per_tile, ["image_id", "tile_id"]).select("image_id", "tile_id", "qrank", "n", (F.col("b") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("start"))


def binned(found: DataFrame, size: int) -> DataFrame:
    """Ranked edges with qrank, the rank over a fixed size."""
    return found.withColumn("qrank", rank_bin(F.col("rank"), size))
