"""Work on a tile at a time, against brute force: spanning trees, and the nodes of several hierarchies at once."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData
from test_core import brute_edges, brute_nodes, grid_of

from gridgrove.operators import tree as T
from gridgrove.operators.contract import contracted
from gridgrove.operators.edges import edges
from gridgrove.operators.tilewise import hierarchies_by_tile
from gridgrove.plans.api import named_hierarchies
from gridgrove.plans.queries import strategies_agree
from gridgrove.sources.grid import Grid, random_grid

NAMES = ("kruskal", "tiled", "rank_bins", "boruvka", "levels")
RNG = np.random.default_rng(8)
IMAGES = {
    "plain": np.zeros((6, 7), int),
    "few": RNG.integers(0, 4, (13, 11)),
    "many": RNG.integers(0, 400, (12, 13)),
    "zeros": RNG.integers(0, 300, (14, 9)) // 3 * (RNG.random((14, 9)) < 0.6),
    "one": np.array([[3]]),
}


def spanning_tree(image, connectivity):
    label, tree = np.arange(np.size(image)), set()
    for e, (p, q, _) in sorted(brute_edges(image, connectivity).items(), key=lambda x: (x[1][2], x[0])):
        if label[p] != label[q]:
            label[label == label[q]] = label[p]
            tree.add(e)
    return tree


def named(nodes, k=0, image=0):
    """Nodes of one hierarchy, with their parents' names."""
    return sorted(tuple(r)[2:] if not math.isnan(r.up_alpha) else (*tuple(r)[2:8], None, None) for r in nodes.where((F.shiftright("who", k) % 2 == 1) & (F.col("image_id") == image)).collect())


def by_one_task(tree, image=0):
    nodes = tree.nodes.where(F.col("image_id") == image)
    up = nodes.select(F.col("node_id").alias("parent_id"), F.col("alpha").alias("up_alpha"), F.col("min_p").alias("up_min_p"))
    return sorted(map(tuple, nodes.join(up, "parent_id", "left").select("alpha", "min_p", "area", "sum_pix", "min_pix", "max_pix", "up_alpha", "up_min_p").collect()), key=str)


@pytest.mark.parametrize("name, image, tail", [("rank_bins", "many", 0), ("boruvka", "many", 0), ("boruvka", "few", 10_000), ("levels", "many", 10_000), ("levels", "few", 10_000)])
def test_tiles_find_the_tree(spark, name, image, tail):
    grid = grid_of(spark, IMAGES[image])
    got = [r.edge_id for r in T.local_forest(T.STRATEGIES[name](edges(grid, 8), grid, bins=3, tail=tail, tile=30, whole=False), "image_id").collect()]
    assert sorted(got) == sorted(spanning_tree(IMAGES[image], 8))


@pytest.mark.parametrize("way", ["rounds", "levels"])
def test_what_tiles_take_is_on_the_tree(spark, way):
    grid = grid_of(spark, IMAGES["many"])
    taken, left = contracted(edges(grid, 8), grid, way, 40)
    tree = spanning_tree(IMAGES["many"], 8)
    got = {r.edge_id for r in taken.collect()}
    assert got <= tree and len(got) > 70
    assert tree - got <= {r.edge_id for r in left.collect()}


@pytest.mark.parametrize("name, tile, size, connectivity", [("plain", 10, 9, 8), ("few", 20, 1000, 4), ("few", 20, 1000, 8), ("many", 25, 40, 8), ("zeros", 25, 1000, 4), ("zeros", 1000, 1000, 8), ("one", 5, 9, 8)])
def test_tiles_equal_one_task(spark, name, tile, size, connectivity):
    image = IMAGES[name]
    grid = grid_of(spark, image)
    found = edges(grid, connectivity)
    got = hierarchies_by_tile(grid, [T.spanning_kruskal(found, grid), found.select(*T.COLUMNS)], tile, size)
    whole = by_one_task(T.build(grid, found))
    assert sorted(named(got, 0), key=str) == whole and sorted(named(got, 1), key=str) == whole
    assert len(whole) == len(brute_nodes(image, connectivity))


def test_tiles_of_several_images_with_missing_pixels(spark):
    grid = random_grid(spark, 9, 8, 4, seed=4, images=3)
    grid = Grid(grid.pixels.where("not (image_id = 1 and x = 2)").where("not (image_id = 2 and p in (1, 8))"), 9, 8)  # two halves, and a lone corner
    tree = T.build(grid, edges(grid))
    got = spark.createDataFrame(named_hierarchies(grid, NAMES, bins=3, tile=20).toPandas())
    for image in range(3):
        for k in range(len(NAMES)):
            assert sorted(named(got, k, image), key=str) == by_one_task(tree, image)


def test_no_task_gets_a_whole_image(spark, tmp_path, monkeypatch):
    """Rows of the largest group that a task gets, on an image of 204,800 pixels and 809,410 edges."""
    image = np.random.default_rng(3).integers(0, 256, (3200, 64))
    pd.DataFrame({"vec_id": np.arange(3200), "embedding": list(image / 256 - 0.5)}).to_parquet(tmp_path / "embeddings.parquet")
    largest, given = [], GroupedData.applyInPandas
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, *a: largest.append(self.count().agg(F.max("count")).first()[0] or 0) or given(self, *a))
    got = sorted(map(tuple, strategies_agree(spark, str(tmp_path)).collect()))
    assert got == [("boruvka", 0), ("levels", 0), ("rank_bins", 0), ("tiled", 0)]
    assert max(largest) < 300_000
