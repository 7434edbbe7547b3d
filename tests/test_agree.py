"""Strategies side by side: rounds and their last task, packed bins, and the comparison of their nodes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_core import brute_edges, brute_nodes, grid_of, nodes_of

from gridgrove.operators import tree as T
from gridgrove.operators.edges import edges
from gridgrove.plans.api import build_hierarchies
from gridgrove.plans.queries import strategies_agree

NAMES = ("kruskal", "tiled", "rank_bins", "boruvka", "levels")
IMAGE = np.random.default_rng(6).integers(0, 400, (12, 11)) // 3 * (np.random.default_rng(7).random((12, 11)) < 0.7)


def embeddings(path, height):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (height, 64)) * (rng.random((height, 64)) < 0.8)
    pd.DataFrame({"vec_id": np.arange(height), "embedding": list(image / 256 - 0.5)}).to_parquet(path / "embeddings.parquet")


@pytest.mark.parametrize("tail", [0, 20, 10_000])
@pytest.mark.parametrize("name", ["boruvka", "levels"])
def test_rounds_and_last_task_find_the_tree(spark, name, tail):
    found = brute_edges(IMAGE, 8)
    assert len({a for _, _, a in found.values()}) > 64
    label, tree = np.arange(IMAGE.size), set()
    for e, (p, q, _) in sorted(found.items(), key=lambda x: (x[1][2], x[0])):
        if label[p] != label[q]:
            label[label == label[q]] = label[p]
            tree.add(e)
    grid = grid_of(spark, IMAGE)
    got = [r.edge_id for r in T.STRATEGIES[name](edges(grid, 8), grid, bins=3, tail=tail).collect()]
    assert sorted(got) == sorted(tree)


@pytest.mark.parametrize("size", [None, 120])
def test_side_by_side_equals_brute_force(spark, size):
    many = build_hierarchies(grid_of(spark, IMAGE), NAMES, 8, parts=4, bins=3, bin_edges=size)
    for k in range(len(NAMES)):
        own = T.Hierarchy(many.nodes.where(F.col("image_id") == k), many.leaves.where(F.col("image_id") == k), many.grid)
        assert nodes_of(own) == brute_nodes(IMAGE, 8)
        assert own.leaves.count() == IMAGE.size


def test_nodes_of_a_wrong_strategy_are_counted(spark, tmp_path, monkeypatch):
    embeddings(tmp_path, 5)
    right = T.STRATEGIES["tiled"]
    monkeypatch.setitem(T.STRATEGIES, "tiled", lambda found, grid, **kw: right(found, grid, **kw).where("p0 <> 70 and p1 <> 70"))
    got = dict(map(tuple, strategies_agree(spark, str(tmp_path)).collect()))
    assert got.pop("tiled") > 0 and got == {"rank_bins": 0, "boruvka": 0, "levels": 0}


def test_few_jobs(spark, tmp_path):
    """Jobs are what an image of any size costs at least."""
    embeddings(tmp_path, 40)
    context = spark.sparkContext
    context.setJobGroup("agree", "strategies_agree")
    got = sorted(map(tuple, strategies_agree(spark, str(tmp_path)).collect()))
    jobs = len(context.statusTracker().getJobIdsForGroup("agree"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert got == [("boruvka", 0), ("levels", 0), ("rank_bins", 0), ("tiled", 0)]
    assert jobs < 150
