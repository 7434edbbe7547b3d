"""Hierarchies built a bin of edges at a time, and queries by doubled steps, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_core import GOLDEN, brute_edges, brute_nodes, grid_of, nodes_of

from gridgrove.operators import query as Q
from gridgrove.operators import tree as T
from gridgrove.operators.binned import build_in_bins
from gridgrove.operators.edges import edges
from gridgrove.plans.api import build_hierarchy
from gridgrove.sources.grid import Grid, random_grid


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("image, size", [(GOLDEN, 4), (np.zeros((4, 5), int), 9), ([[3]], 2), (np.random.default_rng(1).integers(0, 4, (7, 6)), 25)])
def test_bins_equal_one_task(spark, image, size):
    grid = grid_of(spark, image)
    one, many = build_hierarchy(grid, 8), build_hierarchy(grid, 8, bin_edges=size)
    assert nodes_of(many) == brute_nodes(image, 8)
    assert one.nodes.dtypes == many.nodes.dtypes and rows(one.nodes, *one.nodes.columns) == rows(many.nodes, *one.nodes.columns)
    assert rows(one.leaves, "p", "node_id") == rows(many.leaves, "p", "node_id")


def test_bins_of_several_images_with_missing_pixels(spark):
    grid = random_grid(spark, 5, 6, 3, seed=4, images=3)
    grid = Grid(grid.pixels.where("not (image_id = 1 and x = 2)").where("not (image_id = 2 and p in (1, 6))"), 5, 6)  # two halves, and a lone corner
    one, many = T.build(grid, edges(grid)), build_in_bins(grid, edges(grid), 17)
    assert rows(one.nodes, *one.nodes.columns) == rows(many.nodes, *one.nodes.columns)
    assert rows(one.leaves, "image_id", "p", "node_id") == rows(many.leaves, "image_id", "p", "node_id")
    assert Q.roots(many).groupBy("image_id").count().orderBy("image_id").collect()[1]["count"] == 2
    pairs = grid.pixels.select("image_id", F.lit(0).cast("bigint").alias("p"), F.col("p").alias("q"))
    assert {r.q % 6 for r in Q.common_ancestor(many, pairs).where("image_id = 1").collect()} == {0, 1}


def test_common_ancestors_of_a_deep_tree(spark):
    image = [[(k * k) // 2 for k in range(14)], [900 + 50 * k * k for k in range(14)]]
    tree = build_hierarchy(grid_of(spark, image))
    found = brute_edges(image, 4)
    pairs = [(0, int(p), int(q)) for p, q in np.random.default_rng(2).integers(0, 28, (40, 2))]

    def joined_at(p, q):
        reached = {p}
        for level in sorted({0.0, *(a for _, _, a in found.values())}):
            grown = True
            while grown:
                more = {x for a, b, w in found.values() if w <= level for x in (a, b) if a in reached or b in reached}
                grown, reached = not more <= reached, reached | more
            if q in reached:
                return level

    got = Q.common_ancestor(tree, spark.createDataFrame(pairs, "image_id bigint, p bigint, q bigint"))
    assert sorted((r.p, r.q, r.alpha) for r in got.collect()) == sorted({(p, q, joined_at(p, q)) for _, p, q in pairs})
    assert rows(Q.rolled_up(tree), "node_id", "area", "sum_pix") == rows(tree.nodes, "node_id", "area", "sum_pix")
