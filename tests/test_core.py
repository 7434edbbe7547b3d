"""The engine against golden images, brute force and its own invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridgrove.functions import scalar as S
from gridgrove.operators import edges as E
from gridgrove.operators import inspect as I
from gridgrove.operators import query as Q
from gridgrove.operators import tree as T
from gridgrove.plans.api import ALGORITHMS, NOT_BUILT, build_hierarchy, strategy
from gridgrove.sources import codec, config
from gridgrove.sources.grid import Grid, planar_to_grid, random_grid, random_samples, swap_red_blue
from gridgrove.streaming.tiles import line_histogram

GOLDEN = [[0, 1, 5], [0, 2, 5], [9, 9, 6]]


def grid_of(spark, image) -> Grid:
    image = np.asarray(image, float)
    if image.ndim == 2:
        image = image[:, :, None]
    h, w, c = image.shape
    rows = [(0, y, x, y * w + x, image[y, x].tolist()) for y in range(h) for x in range(w)]
    return Grid(spark.createDataFrame(rows, "image_id bigint, y bigint, x bigint, p bigint, v array<double>"), h, w, c)


def brute_edges(image, connectivity):
    h, w = np.shape(image)[:2]
    ways = S.OFFSETS[connectivity]
    out = {}
    for y in range(h):
        for x in range(w):
            for d, (dy, dx) in enumerate(ways):
                if 0 <= y + dy < h and 0 <= x + dx < w:
                    out[(y * w + x) * len(ways) + d] = (y * w + x, (y + dy) * w + x + dx, float(np.float32(abs(image[y][x] - image[y + dy][x + dx]))))
    return out


def brute_nodes(image, connectivity):
    """Every component at every level, by label propagation: (alpha, min_p) -> (area, sum, min, max)."""
    values = np.asarray(image, float).ravel()
    found = brute_edges(image, connectivity)
    out = {}
    for t in sorted({0.0, *(a for _, _, a in found.values())}):
        label = np.arange(len(values))
        changed = True
        while changed:
            changed = False
            for p, q, a in found.values():
                if a <= t and label[p] != label[q]:
                    label[[p, q]] = min(label[p], label[q])
                    changed = True
        for m in np.unique(label):
            own = values[label == m]
            known = [k for k in out if k[1] == m and out[k][0] == len(own)]
            if not known:
                out[(t, int(m))] = (len(own), own.sum(), own.min(), own.max())
    return out


def nodes_of(tree):
    return {(r.alpha, r.min_p): (r.area, r.sum_pix, r.min_pix, r.max_pix) for r in tree.nodes.collect()}


def test_golden_edges_and_ranks(spark):
    grid = grid_of(spark, GOLDEN)
    for connectivity, ranks in ((4, [0, 4, 13, 1, 2, 10, 7, 9, 15, 3, 8, 6]), (8, [0, 8, 26, 2, 4, 15, 20, 1, 14, 18, 19, 30, 5, 6, 17, 31, 16, 27, 12, 13])):
        found = E.edges(grid, connectivity)
        assert {r.edge_id: (r.p0, r.p1, r.alpha) for r in found.collect()} == brute_edges(GOLDEN, connectivity)
        assert found.count() == E.edge_count(3, 3, connectivity)
        assert [r.edge_id for r in E.ranked(found, 3).orderBy("rank").collect()] == ranks
        ends = found.select("p0", "p1", *(c.alias(n) for n, c in zip("ab", S.edge_ends(F.col("edge_id"), 3, connectivity), strict=True)))
        assert ends.where("p0 <> a or p1 <> b").count() == 0


@pytest.mark.parametrize("algorithm", ["kruskal", "tiled", "rank_bins", "boruvka", "levels"])
def test_golden_hierarchy(spark, algorithm):
    tree = build_hierarchy(grid_of(spark, GOLDEN), 4, algorithm=algorithm, parts=4, bins=3)
    assert nodes_of(tree) == {(0.0, 0): (2, 0, 0, 0), (0.0, 1): (1, 1, 1, 1), (0.0, 2): (2, 10, 5, 5), (0.0, 4): (1, 2, 2, 2), (0.0, 6): (2, 18, 9, 9), (0.0, 8): (1, 6, 6, 6), (1.0, 0): (4, 3, 0, 2), (1.0, 2): (3, 16, 5, 6), (3.0, 0): (9, 37, 0, 9)}
    assert [r.parent_id for r in tree.nodes.orderBy("node_id").collect()] == [6, 6, 7, 6, 8, 7, 8, 8, None]


def test_golden_filters(spark):
    tree = build_hierarchy(grid_of(spark, GOLDEN), 4)

    def values(df):
        return [r.value for r in df.orderBy("p").collect()]

    assert values(Q.area_filter(tree, 0.5)) == [1, 1, 3, 1, 1, 3, 3, 3, 3]
    assert values(Q.level_filter(tree, 0.5)) == [9] * 9
    assert values(Q.level_filter(tree, 0.3)) == [4, 4, 3, 4, 4, 3, 9, 9, 3]
    assert [r.label for r in Q.flat_partition(tree, 1.0).orderBy("p").collect()] == [0, 0, 2, 0, 0, 2, 6, 6, 2]
    assert Q.roots(tree).count() == 1
    assert Q.canonical(tree.nodes).where("node_id <> found_id").count() == 0


@pytest.mark.parametrize("shape", [(6, 7), (1, 9), (9, 1), (1, 1), (5, 5)])
@pytest.mark.parametrize("connectivity", [4, 8])
def test_hierarchy_is_brute_force(spark, shape, connectivity):
    rng = np.random.default_rng(sum(shape) + connectivity)
    image = rng.integers(0, 4, shape) if shape != (5, 5) else np.zeros(shape, int)
    tree = build_hierarchy(grid_of(spark, image), connectivity, algorithm="tiled", parts=4)
    assert nodes_of(tree) == brute_nodes(image, connectivity)
    assert tree.leaves.count() == image.size
    up = tree.nodes.alias("a").join(tree.nodes.alias("b"), F.expr("a.parent_id = b.node_id"))
    assert up.where("a.alpha >= b.alpha or a.area >= b.area").count() == 0


def test_strategies_agree_on_colours(spark):
    grid = random_grid(spark, 9, 11, 3, 3, seed=4)
    first = None
    for name in ("kruskal", "tiled", "rank_bins"):
        rows = sorted(map(str, build_hierarchy(grid, 8, "LInfinity", name, 6, 3).nodes.collect()))
        first = first or rows
        assert rows == first


def test_metrics(spark):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 200, (4, 5, 3)).astype(float)
    for name, f in (("L1", lambda d: np.abs(d).mean()), ("L2", lambda d: np.sqrt((d * d).mean())), ("LInfinity", lambda d: np.abs(d).max()), ("l2_sum", lambda d: np.sqrt((d * d).sum()))):
        flat = image.reshape(-1, 3)
        for r in E.edges(grid_of(spark, image), 8, name).collect():
            assert r.alpha == pytest.approx(f(flat[r.p0] - flat[r.p1]), rel=1e-6)


def test_statistics(spark):
    image = np.random.default_rng(2).integers(0, 50, (12, 10))
    found = E.edges(grid_of(spark, image), 4)
    hist = E.histogram(found)
    n = {r.level: r.n for r in hist.collect()}
    cum = E.cumulated(hist).orderBy("level").collect()
    assert [r.cum for r in cum] == np.cumsum([n[k] for k in sorted(n)]).tolist()
    assert [r.start for r in E.offsets(hist).orderBy("level").collect()] == [c.cum - c.n for c in cum]
    assert E.last_level(hist).first().level == max(n)
    assert E.level_quantile(hist, 0.3).first().level == next(c.level for c in cum if c.cum > 0.3 * sum(n.values()))
    assert sum(r.n for r in E.equalised_histogram(hist, 8).collect()) == sum(n.values())
    assert E.size_estimate(hist, 120).first().estimate == 10 + sum(n.values()) + 120
    big = E.size_estimate(hist, 20_000).first()
    spread = np.sqrt((sum(v * v for v in n.values()) - sum(n.values())) / (sum(n.values()) * (sum(n.values()) - 1)))
    assert big.estimate == pytest.approx(min(40_000, 40_000 * (1.3901 * np.exp(-2.1989 * spread) - 0.1906 + 0.05)))
    by_bin = E.with_rank_bins(E.ranked(found), 7)
    assert by_bin.agg(F.max("qrank")).first()[0] == 6
    tiled = E.tiled(by_bin, 10, 6, 5, 2, 2)
    sizes = E.bin_offsets(tiled).orderBy("tile_id", "qrank").collect()
    assert [r.start for r in sizes] == (np.cumsum([r.n for r in sizes]) - [r.n for r in sizes]).tolist()
    assert E.tile_largest_bin(tiled).count() == 4
    assert E.largest_rank(E.ranked(found)).count() == 120


def test_labels_equal_the_trees(spark):
    grid = grid_of(spark, np.random.default_rng(5).integers(0, 6, (8, 9)))
    found = E.edges(grid, 4)
    tree = build_hierarchy(grid, 4)
    for level in (0.0, 1.0, 2.0):
        assert sorted(map(tuple, T.component_labels(found, grid.pixels, level).collect())) == sorted(map(tuple, Q.flat_partition(tree, level).collect()))
    for stop in (F.col("area") >= 9, F.col("alpha") >= 2):
        assert sorted(map(tuple, Q.first_ancestor(tree, stop).collect())) == sorted(map(tuple, Q.first_ancestor(tree, stop, one_task=False).collect()))
    assert sorted(map(tuple, Q.rolled_up(tree).collect())) == sorted(map(tuple, tree.nodes.select("image_id", "node_id", "area", "sum_pix").collect()))
    left = E.edges(grid, 4).join(T.redundant(found, 4, grid).select("image_id", "edge_id"), ["image_id", "edge_id"], "left_anti")
    assert nodes_of(T.build(grid, T.spanning_kruskal(left, grid))) == nodes_of(tree)


def test_several_images_stay_apart(spark):
    grid = random_grid(spark, 4, 5, 3, seed=9, images=3)
    tree = build_hierarchy(grid, 4)
    assert Q.roots(tree).where("area = 20").count() == 3


def test_names(spark):
    assert all(strategy(a) in T.STRATEGIES for a in ALGORITHMS)
    for name in (*NOT_BUILT, "UnionFind", ""):
        with pytest.raises(ValueError):
            strategy(name)
    with pytest.raises(ValueError):
        build_hierarchy(grid_of(spark, GOLDEN), 6)


def test_random_samples(spark):
    for bits in (5, 12, 30, 64):
        got = random_samples(spark, 20, 20, bits, 2, seed=3)
        lo, hi = got.agg(F.min("sample"), F.max("sample")).first()
        assert 0 <= int(lo) and (1 << bits) * 0.9 < int(hi) < 1 << bits
    same = [random_grid(spark, 5, 5, 8, seed=s).pixels.orderBy("p").collect() for s in (1, 1, 2)]
    assert same[0] == same[1] != same[2]


def test_config():
    text = "ImageFileName = a.png # x\nSomeAlgorithm = FloodHierQueue\nBitDepth=12\nConnectivity = 8\nParameterFloat2 = 0.5\n# comment\nDissimilarityMetric = L1"
    made = config.load(text)
    assert (made.image_file, made.algorithm, made.bits, made.connectivity, made.metric, made.floats) == ("a.png", "FloodHierQueue", 12, 8, "L1", (15.0, 0.5, 0.3))
    assert config.load("").algorithm == "FloodHierHeapQueue"
    for bad in ("MyAlgorithm = nonsense", "BitDepth = many"):
        with pytest.raises(ValueError):
            config.load(bad)


def test_images_round_trip(spark, tmp_path):
    image = np.random.default_rng(3).integers(0, 65536, (7, 5, 3)).astype(np.uint16)
    assert (codec.decode_png(codec.encode_png(image)) == image).all()
    grey = image[:, :, :1]
    assert (codec.decode_pgm(codec.encode_pgm(grey)) == grey).all()
    assert (codec.decode(b"P2\n# x\n2 1\n255\n3 4") == [[[3], [4]]]).all()
    (tmp_path / "a.png").write_bytes(codec.encode_png(image))
    grid = codec.read_images(spark, str(tmp_path / "*.png"))
    back = codec.to_images(grid).first().content
    assert (codec.decode_png(bytes(back)) == image).all()
    again = planar_to_grid(codec.planes(grid), 7, 5, 3)
    assert sorted(map(str, again.pixels.select("p", "v").collect())) == sorted(map(str, grid.pixels.select("p", "v").collect()))
    assert swap_red_blue(grid).pixels.where("p = 0").first().v == image[0, 0, ::-1].astype(float).tolist()


def test_png_filters():
    """Every line filter is undone."""
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (5, 12))
    out = []
    for y, kind in enumerate((0, 1, 2, 3, 4)):
        up = image[y - 1] if y else np.zeros(12, int)
        left, corner = np.r_[[0] * 3, image[y][:-3]], np.r_[[0] * 3, up[:-3]]
        a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
        guess = [0, left, up, (left + up) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))][kind]
        out.append(np.r_[kind, (image[y] - guess) % 256])
    assert (codec._unfilter(np.array(out, np.uint8).tobytes(), 5, 12, 3) == image).all()


def test_inspection(spark):
    grid = grid_of(spark, GOLDEN)
    tree = build_hierarchy(grid, 4)
    assert I.node_lines(tree).count() == 9
    assert [r.line.split() for r in I.image_lines(grid).orderBy("y").collect()] == [[str(v) for v in row] for row in GOLDEN]
    assert I.leaf_lines(tree).count() == I.graph_lines(grid, E.edges(grid, 4)).count() == 3
    assert I.report(lambda: None, 100, 2)["mpix_per_second"] > 0


def test_scalars(spark):
    rows = spark.createDataFrame([(0,), (1,), (5,), (255,), (1023,)], "n bigint")
    got = rows.select(S.bit_depth(F.col("n")).alias("d"), S.log_level(F.col("n"), 15.0).alias("l"), S.log_level(F.col("n"), 15.0, 40).alias("c"), S.power_bin(F.col("n"), 10).alias("q"), S.clip(F.col("n"), 2, 9).alias("k")).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 2), (1, 15, 15, 0, 2), (3, int(15 * np.log2(6)), int(15 * np.log2(6)), 2, 5), (8, 120, 39, 6502, 9), (10, 150, 39, 104652, 9)]
    assert S.tile_grid(100, 50, 8) == (4, 2)
    assert S.largest_dissimilarity(12) == 65535


def test_stream_histogram(spark, tmp_path):
    lines = spark.createDataFrame([(0, 0, [0.0, 3.0, 3.0]), (0, 1, [9.0, 8.0, 8.0]), (0, 2, [4.0])], "image_id bigint, y bigint, values array<double>")
    lines.write.parquet(str(tmp_path / "in"))
    stream = line_histogram(spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("hist").start()
    query.processAllAvailable()
    query.stop()
    assert {r.level: r.n for r in spark.table("hist").collect()} == {0: 2, 1: 1, 3: 1}
