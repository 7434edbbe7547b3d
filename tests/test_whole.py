"""The queries over the whole hierarchy against brute force, on a whole image with many levels."""

import numpy as np
import pandas as pd
from test_core import brute_edges, brute_nodes, grid_of, nodes_of

from gridgrove.plans.api import build_hierarchy
from gridgrove.plans.queries import LEVEL, QUERIES

RUN = ("line_graph", "hierarchy_nodes", "hierarchy_nodes_tiled", "hierarchy_nodes_rank_bins", "flat_partition", "mst_edges", "redundant_edges")


def test_whole_queries_read_all_pixels(spark, tmp_path):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (18, 64)) * (rng.random((18, 64)) < 0.5)  # over 64 distinct weights, and plateaus
    pd.DataFrame({"vec_id": np.arange(18), "embedding": list(image / 256 - 0.5)}).to_parquet(tmp_path / "embeddings.parquet")
    got = {name: [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()] for name in RUN}
    found = brute_edges(image, 4)

    def joined(edges):
        """Each pixel's label, and which of the edges, in order, join two components."""
        label, kept = np.arange(image.size), []
        for edge, (p, q, a) in edges:
            if label[p] != label[q]:
                x, y = sorted((label[p], label[q]))
                label[label == y] = x
                kept.append((edge, a))
        return label, kept

    in_order = sorted(found.items(), key=lambda e: (e[1][2], e[0]))
    nodes = {}  # (least pixel, area) of every component at every level -> its first level
    for t in sorted({0.0, *(a for _, _, a in found.values())}):
        label, _ = joined([e for e in in_order if e[1][2] <= t])
        for x, n in zip(*np.unique(label, return_counts=True), strict=True):
            nodes.setdefault((int(x), int(n)), t)
    for name in ("", "_tiled", "_rank_bins"):
        assert sorted(got[f"hierarchy_nodes{name}"]) == sorted((*k, t) for k, t in nodes.items())
    label, _ = joined([e for e in in_order if e[1][2] <= LEVEL])
    assert dict(got["flat_partition"]) == dict(enumerate(label.tolist()))
    assert sorted(got["mst_edges"]) == sorted(joined(in_order)[1])
    inside = [e for e in in_order if e[1][0] % 64 // 16 == e[1][1] % 64 // 16]  # four tiles side by side
    assert {r[0] for r in got["redundant_edges"]} == {e for e, _ in inside} - {e for e, _ in joined(inside)[1]}
    degree = np.bincount([p for x in found.values() for p in x[:2]])
    assert len(got["line_graph"]) == (degree * (degree - 1) // 2).sum()


def test_levels_of_many_weights(spark):
    image = (np.arange(90) ** 2 % 257).reshape(9, 10)
    assert len({a for _, _, a in brute_edges(image, 4).values()}) > 64
    assert nodes_of(build_hierarchy(grid_of(spark, image), algorithm="levels", bins=2)) == brute_nodes(image, 4)
