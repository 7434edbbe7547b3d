"""Pictures of grids and hierarchies as tables of lines, and a run's report."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgrove.functions.scalar import OFFSETS
from gridgrove.operators.tree import Hierarchy
from gridgrove.sources.grid import Grid


def node_lines(tree: Hierarchy) -> DataFrame:
    """(image_id, node_id, line) of each node that has an area."""
    parent = F.coalesce(F.col("parent_id").cast("string"), F.lit("none"))
    line = F.format_string("node %d: alpha %.6g, area %d, sum %.6g, min %.6g, max %.6g, parent %s", "node_id", F.col("alpha").cast("double"), "area", "sum_pix", "min_pix", "max_pix", parent)
    return tree.nodes.where("area > 0").select("image_id", "node_id", line.alias("line"))


def image_lines(grid: Grid, digits: int = 4) -> DataFrame:
    """(image_id, y, line): the first channel, a line a row."""
    cell = F.lpad(F.get("v", F.lit(0)).cast("bigint").cast("string"), digits, " ")
    rows = grid.pixels.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", cell.alias("s")))).alias("cells"))
    return rows.select("image_id", "y", F.array_join(F.col("cells.s"), " ").alias("line"))


def leaf_lines(tree: Hierarchy, digits: int = 5) -> DataFrame:
    """(image_id, y, line): the number of each pixel's leaf."""
    w = tree.grid.width
    cell = F.struct((F.col("p") % w).alias("x"), F.lpad(F.col("node_id").cast("string"), digits, " ").alias("s"))
    rows = tree.leaves.groupBy("image_id", F.expr(f"p div {w}").alias("y")).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return rows.select("image_id", "y", F.array_join(F.col("cells.s"), " ").alias("line"))


def graph_lines(grid: Grid, found: DataFrame, connectivity: int = 4) -> DataFrame:
    """(image_id, y, line): each pixel with the weights of its own edges, by direction."""
    arrows = F.array(*(F.lit({(1, 0): "v", (0, 1): ">", (1, 1): "\\", (-1, 1): "/"}[o]) for o in OFFSETS[connectivity]))
    weights = found.groupBy("image_id", F.col("p0").alias("p")).agg(F.array_sort(F.collect_list(F.struct("dir", F.concat(F.get(arrows, F.col("dir").cast("int")), F.format_string("%.4g", F.col("alpha").cast("double"))).alias("s")))).alias("e"))
    cell = F.concat(F.get("v", F.lit(0)).cast("bigint").cast("string"), F.lit("("), F.coalesce(F.array_join(F.col("e.s"), " "), F.lit("")), F.lit(")"))
    rows = grid.pixels.join(weights, ["image_id", "p"], "left").groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", cell.alias("s")))).alias("cells"))
    return rows.select("image_id", "y", F.array_join(F.col("cells.s"), " ").alias("line"))


def binary(column: str):
    """A whole number's binary digits."""
    return F.bin(F.col(column).cast("bigint"))


def report(work: Callable[[], object], pixels: int, iterations: int = 1) -> dict[str, float]:
    """Seconds of the fastest run, and millions of pixels a second at that speed."""
    seconds = []
    for _ in range(max(1, iterations)):
        began = time.perf_counter()
        work()
        seconds.append(time.perf_counter() - began)
    return {"seconds": min(seconds), "mpix_per_second": pixels / min(seconds) * 1e-6}
