"""Small functions and lines of text, by content."""

import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gridgrove.functions import scalar
from gridgrove.operators import edges, inspect, lineage, query
from gridgrove.plans.api import build_hierarchy
from gridgrove.sources.grid import Grid


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(0, 0, 0, 0, [0.0]), (0, 0, 1, 1, [1.0]), (0, 1, 0, 2, [5.0]), (0, 1, 1, 3, [5.0])]
    return Grid(spark.createDataFrame(rows, "image_id bigint, y bigint, x bigint, p bigint, v array<double>"), 2, 2)


def test_bits_and_ranges(spark):
    got = spark.range(8).select("id", scalar.has_bit(F.col("id"), 1).alias("b"), scalar.in_range(F.col("id"), 2, 5).alias("r"), inspect.binary("id").alias("t")).collect()
    for r in got:
        assert r.b == bool(r.id & 2) and r.r == (2 <= r.id < 5) and r.t == f"{r.id:b}"


def test_sorted_edges(grid):
    got = [(r.alpha, r.edge_id) for r in edges.sorted_edges(edges.edges(grid, 8)).collect()]
    assert got == sorted(got) and len(got) == edges.edge_count(2, 2, 8) == 6


def plain(line):
    return re.sub(r"\d+\.\d+", lambda m: f"{float(m[0]):g}", line)


def test_lines(grid):
    tree = build_hierarchy(grid)
    assert [r.line for r in inspect.image_lines(grid, 2).orderBy("y").collect()] == [" 0  1", " 5  5"]
    assert [plain(r.line) for r in inspect.graph_lines(grid, edges.edges(grid, 4)).orderBy("y").collect()] == ["0(v5 >1) 1(v4)", "5(>0) 5()"]
    assert [r.line.split() for r in inspect.leaf_lines(tree).orderBy("y").collect()] == [["0", "1"], ["2", "2"]]
    lines = [plain(r.line) for r in inspect.node_lines(tree).orderBy("node_id").collect()]
    assert lines[2] == "node 2: alpha 0, area 2, sum 10, min 5, max 5, parent 4" and lines[-1] == "node 4: alpha 4, area 4, sum 11, min 0, max 5, parent none"


def test_ancestors_by_joins_and_in_one_task(grid):
    tree = build_hierarchy(grid)
    found = [sorted((r.node_id, r.found_id) for r in query.first_ancestor(tree, F.col("area") >= 2, one_task=way).collect()) for way in (None, True, False)]
    assert found[0] == found[1] == found[2] == [(0, 3), (1, 3), (2, 2), (3, 3), (4, 4)]


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    class Frame:
        sparkSession = Session()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.shared_checkpoint(Frame())


def test_rest_works_where_the_folders_are_deleted(tmp_path):
    """A copy without the operators' folder and the pipeline has the engine's own queries."""
    import shutil

    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "gridgrove", tmp_path / "gridgrove", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'edges4_l2' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, timeout=120).returncode == 0
