"""Named queries over the driver tables and their SQL twins. The embeddings table is the image: a vector a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridgrove.functions import scalar as S
from gridgrove.operators import edges as E
from gridgrove.operators import query as Q
from gridgrove.operators import tree as T
from gridgrove.plans.api import PART_PIXELS, build_hierarchy, named_hierarchies
from gridgrove.sources.grid import Grid, embeddings_grid, random_grid

LEVEL = 1.0


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pixel's level where its component covers a hundredth of the image."""
    return Q.area_filter(build_hierarchy(embeddings_grid(spark, sf_dir), algorithm="auto"), 0.01)


def _grid(spark, sf_dir, channels: int = 1) -> Grid:
    return embeddings_grid(spark, sf_dir, channels)


def grid_scan(spark, sf_dir):
    return _grid(spark, sf_dir).pixels.select("y", "x", "p", F.get("v", F.lit(0)).alias("v"))


def _edges(connectivity: int, metric: str, channels: int = 1):
    def query(spark, sf_dir):
        return E.edges(_grid(spark, sf_dir, channels), connectivity, metric).select("edge_id", "p0", "p1", F.col("dir").cast("int").alias("dir"), F.round(F.col("alpha").cast("double"), 3).alias("alpha"))

    return query


def _found(spark, sf_dir) -> DataFrame:
    return E.edges(_grid(spark, sf_dir), 4)


def _hist(spark, sf_dir) -> DataFrame:
    return E.histogram(_found(spark, sf_dir))


def rank_bins(spark, sf_dir):
    with_bins = E.binned(E.ranked(_found(spark, sf_dir)), 1000)
    return with_bins.groupBy("qrank").agg(F.count("*").alias("n"), F.min("alpha").cast("double").alias("lo"), F.max("alpha").cast("double").alias("hi"))


def tile_rank_hist(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    with_bins = E.binned(E.ranked(E.edges(grid, 4)), 1000)
    return E.tile_rank_histogram(E.tiled(with_bins, grid.width, 100, 16, 1000000, 4)).drop("image_id")


def _tiles(spark, sf_dir) -> DataFrame:
    grid = _grid(spark, sf_dir)
    return E.tiled(E.binned(E.ranked(E.edges(grid, 4)), 1000), grid.width, 250, 32, 1000000, 2)


def tile_size_estimate(spark, sf_dir):
    return E.tile_size_estimate(_tiles(spark, sf_dir), 12_000).select("tile_id", "n_edges", F.round("nrmsd", 9).alias("nrmsd"), F.round("estimate", 3).alias("estimate"))


def tree_size_estimate(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    return E.size_estimate(E.histogram(E.edges(grid, 4)), grid.size).select("n_edges", F.round("nrmsd", 9).alias("nrmsd"), F.round("estimate", 3).alias("estimate"))


def line_graph(spark, sf_dir, of=_grid):
    return E.line_graph(E.edges(of(spark, sf_dir), 4)).select("e0", "e1", F.col("alpha").cast("double").alias("alpha"))


def acc_labels(spark, sf_dir, of=_grid):
    grid = of(spark, sf_dir)
    return T.component_labels(E.edges(grid, 4), grid.pixels, LEVEL).select("p", "label")


def acc_attributes(spark, sf_dir, of=_grid):
    grid = of(spark, sf_dir)
    labels = T.component_labels(E.edges(grid, 4), grid.pixels, LEVEL)
    own = labels.join(grid.pixels, ["image_id", "p"]).withColumn("s", F.get("v", F.lit(0)))
    return own.groupBy("label").agg(F.count("*").alias("area"), F.sum("s").alias("sum_pix"), F.min("s").alias("min_pix"), F.max("s").alias("max_pix"))


def _tree(spark, sf_dir, of=_grid, algorithm: str = "FloodHierHeapQueue"):
    return build_hierarchy(of(spark, sf_dir), 4, algorithm=algorithm)


def hierarchy_nodes(algorithm: str):
    def query(spark, sf_dir, of=_grid):
        return _tree(spark, sf_dir, of, algorithm).nodes.select("min_p", "area", F.col("alpha").cast("double").alias("alpha"))

    return query


def hierarchy_tree(spark, sf_dir, of=_grid):
    """Every node with its attributes and its parent, both named by least pixel and level."""
    nodes = _tree(spark, sf_dir, of).nodes
    up = nodes.select("image_id", F.col("node_id").alias("parent_id"), F.col("min_p").alias("parent_min_p"), F.col("alpha").cast("double").alias("parent_alpha"))
    return nodes.join(up, ["image_id", "parent_id"], "left").select("min_p", "area", F.col("alpha").cast("double").alias("alpha"), "sum_pix", "min_pix", "max_pix", "parent_min_p", "parent_alpha")


def area_filter(spark, sf_dir, of=_grid, share=0.001):
    return Q.area_filter(_tree(spark, sf_dir, of), share).select("p", "value")


def level_filter(spark, sf_dir, of=_grid):
    return Q.level_filter(_tree(spark, sf_dir, of), 0.2).select("p", F.col("value").cast("bigint").alias("value"))


def flat_partition(spark, sf_dir, of=_grid):
    return Q.flat_partition(_tree(spark, sf_dir, of), LEVEL).select("p", "label")


def common_ancestors(spark, sf_dir, of=_grid):
    """The level that joins each pixel to the next of its line."""
    tree = _tree(spark, sf_dir, of)
    pairs = tree.grid.pixels.where(F.col("x") > 0).select("image_id", (F.col("p") - 1).alias("p"), F.col("p").alias("q"))
    return Q.common_ancestor(tree, pairs).select("q", F.col("alpha").cast("double").alias("alpha"))


def _parts(grid: Grid) -> int:
    """Tiles of an image: four, or more where they would be large."""
    return max(4, grid.size // PART_PIXELS)


def mst_edges(spark, sf_dir, of=_grid):
    grid = of(spark, sf_dir)
    return T.spanning_tiled(E.edges(grid, 4), grid, parts=_parts(grid)).select("edge_id", F.col("alpha").cast("double").alias("alpha"))


def strategies_agree(spark, sf_dir, of=_grid):
    """How many nodes of each strategy the others don't have: none."""
    names = ("kruskal", "tiled", "rank_bins", "boruvka", "levels")
    nodes = named_hierarchies(of(spark, sf_dir), names, 8, bins=4)
    held = (F.sum(F.shiftrightunsigned("who", k).bitwiseAND(F.lit(1))).alias(name) for k, name in enumerate(names))
    apart = nodes.groupBy(*(c for c in nodes.columns if c != "who")).agg(*held)
    sums = apart.agg(*(F.coalesce(F.sum(F.abs(F.col(name) - F.col(names[0]))), F.lit(0)).alias(name) for name in names[1:]))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(name).alias("strategy"), F.col(name).alias("mismatches")) for name in names[1:]))))


def area_filter_whole(spark, sf_dir):
    return flagship(spark, sf_dir).select("p", "value")


def redundant_edges(spark, sf_dir, of=_grid):
    grid = of(spark, sf_dir)
    return T.redundant(E.edges(grid, 4), _parts(grid), grid).select("edge_id")


def random_samples_range(spark, sf_dir):
    """Each depth's samples stay within it."""
    out = None
    for bits in (1, 8, 12, 16, 32):
        grid = random_grid(spark, 64, 64, bits, seed=5)
        one = grid.pixels.agg(F.count("*").alias("n"), F.count_if((F.get("v", F.lit(0)) < 0) | (F.get("v", F.lit(0)) >= float(1 << bits))).alias("outside")).select(F.lit(bits).alias("bits"), "n", "outside")
        out = one if out is None else out.union(one)
    return out


def availability(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    mask = S.availability_mask(F.col("y"), F.col("x"), grid.height, grid.width, 8)
    return grid.pixels.groupBy(mask.alias("mask")).agg(F.count("*").alias("n"))


QUERIES = {
    "grid_scan": grid_scan,
    "edges4_l2": _edges(4, "L2"),
    "edges8_l2": _edges(8, "L2"),
    "edges8_l1": _edges(8, "L1", 4),
    "edges8_l2_multi": _edges(8, "L2", 4),
    "edges8_linf": _edges(8, "LInfinity", 4),
    "diff_hist": lambda s, d: _hist(s, d).select("level", "n"),
    "log_diff_hist": lambda s, d: E.log_histogram(_found(s, d), 15.0).select("level", "n"),
    "diff_cumsum": lambda s, d: E.cumulated(_hist(s, d)).select("level", "n", "cum"),
    "queue_offsets": lambda s, d: E.offsets(_hist(s, d)).select("level", "n", "start"),
    "histeq_map": lambda s, d: E.equalised(_hist(s, d), 32).select("level", "n", "bin"),
    "edge_rank": lambda s, d: E.ranked(_found(s, d)).select("edge_id", "rank"),
    "rank_bins": rank_bins,
    "tile_rank_hist": tile_rank_hist,
    "tile_hist": lambda s, d: E.tile_histogram(_tiles(s, d)).drop("image_id"),
    "tile_bin_offsets": lambda s, d: E.bin_offsets(_tiles(s, d)).drop("image_id"),
    "tile_largest_bin": lambda s, d: E.tile_largest_bin(_tiles(s, d)).drop("image_id"),
    "tile_size_estimate": tile_size_estimate,
    "histeq_hist": lambda s, d: E.equalised_histogram(_hist(s, d), 32).select("level", "n"),
    "max_rank_edge": lambda s, d: E.largest_rank(E.ranked(_found(s, d))).select("p", "edge_id", "rank"),
    "tree_size_estimate": tree_size_estimate,
    "min_incident_edge": lambda s, d: E.least_incident(_found(s, d)).select("p", "edge_id", F.col("alpha").cast("double").alias("alpha")),
    "edge_minmax": lambda s, d: E.edge_range(_found(s, d)).select("n", F.col("min_alpha").cast("double").alias("min_alpha"), F.col("max_alpha").cast("double").alias("max_alpha"), "min_edge", "max_edge"),
    "level_quantile": lambda s, d: E.level_quantile(_hist(s, d), 0.3).select("level"),
    "line_graph": line_graph,
    "availability": availability,
    "random_samples_range": random_samples_range,
    "acc_labels_t": acc_labels,
    "acc_attributes_t": acc_attributes,
    "hierarchy_nodes": hierarchy_nodes("FloodHierHeapQueue"),
    "hierarchy_nodes_tiled": hierarchy_nodes("FloodHierQueueParallel"),
    "hierarchy_nodes_rank_bins": hierarchy_nodes("HybridParallel"),
    "hierarchy_nodes_boruvka": hierarchy_nodes("FloodTrieQueueHypergraph"),
    "hierarchy_nodes_levels": hierarchy_nodes("levels"),
    "hierarchy_tree": hierarchy_tree,
    "area_filter": area_filter,
    "level_filter": level_filter,
    "flat_partition": flat_partition,
    "common_ancestors": common_ancestors,
    "mst_edges": mst_edges,
    "redundant_edges": redundant_edges,
    "strategies_agree": strategies_agree,
    "area_filter_whole": area_filter_whole,
}

_GRID = """g AS (
  SELECT CAST(vec_id AS BIGINT) AS y, CAST(i - 1 AS BIGINT) AS x, CAST(vec_id * 64 + i - 1 AS BIGINT) AS p,
    GREATEST(0.0::DOUBLE, LEAST(255.0::DOUBLE, FLOOR((CAST(embedding[i] AS DOUBLE) + 0.5) * 256))) AS v
  FROM embeddings, (SELECT UNNEST(RANGE(1, 65)) AS i)
)"""


def _edge_sql(table: str, width: int, connectivity: int) -> str:
    """A join by number for each direction; the last column has no neighbour to its right."""
    ways = S.OFFSETS[connectivity]
    each = (
        f"""SELECT a.p * {len(ways)} + {k} AS edge_id, a.p AS p0, b.p AS p1, {k} AS dir, CAST(CAST(ABS(a.v - b.v) AS REAL) AS DOUBLE) AS alpha
  FROM {table} a JOIN {table} b ON b.p = a.p + {dy * width + dx} WHERE a.x + {dx} < {width}"""
        for k, (dy, dx) in enumerate(ways)
    )
    return "e AS (" + " UNION ALL ".join(each) + ")"


def _multi_sql(metric: str) -> str:
    """Edges of 4 channels: sums over channels of each pair of neighbours."""
    values = ", ".join(f"({k}, {dy}, {dx})" for k, (dy, dx) in enumerate(S.OFFSETS[8]))
    made = {"L1": "SUM(ABS(a.v - b.v)) / 4", "L2": "SQRT(SUM((a.v - b.v) * (a.v - b.v)) / 4)", "LInfinity": "MAX(ABS(a.v - b.v))"}[metric]
    return f"""WITH {_GRID}, c AS (SELECT y, x // 4 AS x, x % 4 AS ch, v FROM g)
SELECT (a.y * 16 + a.x) * 4 + d.k AS edge_id, a.y * 16 + a.x AS p0, b.y * 16 + b.x AS p1, d.k AS dir, ROUND(CAST(CAST({made} AS REAL) AS DOUBLE), 3) AS alpha
FROM c a CROSS JOIN (VALUES {values}) d(k, dy, dx) JOIN c b ON b.y = a.y + d.dy AND b.x = a.x + d.dx AND a.ch = b.ch GROUP BY a.y, a.x, b.y, b.x, d.k"""


_E4 = f"WITH {_GRID}, {_edge_sql('g', 64, 4)}"
_E8 = f"WITH {_GRID}, {_edge_sql('g', 64, 8)}"
_H4 = _E4 + ", h AS (SELECT CAST(FLOOR(alpha) AS BIGINT) AS level, COUNT(*) AS n FROM e GROUP BY 1)"
_R4 = _E4 + ", r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY alpha, edge_id) - 1 AS rank FROM e)"
_T4 = _R4 + ", t AS (SELECT *, p0 // 64 // 250 * 2 + p0 % 64 // 32 AS t0, p1 // 64 // 250 * 2 + p1 % 64 // 32 AS t1 FROM r)"
_AT = f"WITH RECURSIVE {_GRID}, {_edge_sql('g', 64, 4)}" + f""", w AS (SELECT p0 AS p, p1 AS q FROM e WHERE alpha <= {LEVEL} UNION ALL SELECT p1, p0 FROM e WHERE alpha <= {LEVEL}),
reach AS (SELECT p, p AS q FROM g UNION SELECT r.p, w.q FROM reach r JOIN w ON w.p = r.q),
lab AS (SELECT p, MIN(q) AS label FROM reach GROUP BY p)"""
_MASK = " + ".join(f"CASE WHEN y + ({dy}) BETWEEN 0 AND m.h AND x + ({dx}) BETWEEN 0 AND 63 THEN {1 << k} ELSE 0 END" for k, (dy, dx) in enumerate([*S.OFFSETS[8], *((-a, -b) for a, b in S.OFFSETS[8])]))

SQL = {
    "grid_scan": f"WITH {_GRID} SELECT y, x, p, v FROM g",
    "edges4_l2": _E4 + " SELECT edge_id, p0, p1, dir, ROUND(alpha, 3) AS alpha FROM e",
    "edges8_l2": _E8 + " SELECT edge_id, p0, p1, dir, ROUND(alpha, 3) AS alpha FROM e",
    "edges8_l1": _multi_sql("L1"),
    "edges8_l2_multi": _multi_sql("L2"),
    "edges8_linf": _multi_sql("LInfinity"),
    "diff_hist": _H4 + " SELECT level, n FROM h",
    "log_diff_hist": _E4 + " SELECT CAST(FLOOR(15.0::DOUBLE * LOG2(1.0 + alpha)) AS BIGINT) AS level, COUNT(*) AS n FROM e GROUP BY 1",
    "diff_cumsum": _H4 + " SELECT level, n, CAST(SUM(n) OVER (ORDER BY level) AS BIGINT) AS cum FROM h",
    "queue_offsets": _H4 + " SELECT level, n, CAST(COALESCE(SUM(n) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM h",
    "histeq_map": _H4 + " SELECT level, n, CAST(SUM(n) OVER (ORDER BY level) * 31 // SUM(n) OVER () AS BIGINT) AS bin FROM h",
    "edge_rank": _R4 + " SELECT edge_id, rank FROM r",
    "rank_bins": _R4 + " SELECT rank // 1000 AS qrank, COUNT(*) AS n, MIN(alpha) AS lo, MAX(alpha) AS hi FROM r GROUP BY 1",
    "tile_rank_hist": _R4
    + """, t AS (SELECT rank // 1000 AS qrank, p0 // 64 // 100 * 4 + p0 % 64 // 16 AS t0, p1 // 64 // 100 * 4 + p1 % 64 // 16 AS t1 FROM r)
SELECT t0 AS tile_id, qrank, COUNT(*) AS n FROM t WHERE t0 = t1 GROUP BY ALL""",
    "tile_hist": _T4 + " SELECT t0 AS tile_id, CAST(FLOOR(alpha) AS BIGINT) AS level, COUNT(*) AS n FROM t WHERE t0 = t1 GROUP BY ALL",
    "tile_bin_offsets": _T4
    + """, b AS (SELECT t0 AS tile_id, rank // 1000 AS qrank, COUNT(*) AS n FROM t WHERE t0 = t1 GROUP BY ALL)
SELECT tile_id, qrank, n, CAST(COALESCE(SUM(n) OVER (ORDER BY tile_id, qrank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM b""",
    "tile_largest_bin": _T4 + " SELECT t0 AS tile_id, MAX(rank // 1000) AS qrank FROM t WHERE t0 = t1 GROUP BY t0",
    "tile_size_estimate": _T4
    + f""", h AS (SELECT t0 AS tile_id, FLOOR(alpha) AS level, COUNT(*) AS n FROM t WHERE t0 = t1 GROUP BY ALL),
u AS (SELECT tile_id, CAST(SUM(n) AS BIGINT) AS n_edges, SQRT((SUM(CAST(n AS DOUBLE) * n) - SUM(n)) / (CAST(SUM(n) AS DOUBLE) * (SUM(n) - 1))) AS nrmsd FROM h GROUP BY tile_id)
SELECT tile_id, n_edges, ROUND(nrmsd, 9) AS nrmsd, ROUND(LEAST(24000, 24000 * ({S.SIZE_A} * EXP({S.SIZE_SIGMA} * nrmsd) + {S.SIZE_B} + {S.SIZE_MARGIN})), 3) AS estimate FROM u""",
    "histeq_hist": _H4 + ", b AS (SELECT n, CAST(SUM(n) OVER (ORDER BY level) * 31 // SUM(n) OVER () AS BIGINT) AS bin FROM h) SELECT bin AS level, CAST(SUM(n) AS BIGINT) AS n FROM b GROUP BY bin",
    "max_rank_edge": _R4
    + """, i AS (SELECT p0 AS p, edge_id, rank FROM r UNION ALL SELECT p1, edge_id, rank FROM r)
SELECT p, edge_id, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY p ORDER BY rank DESC) AS k FROM i) WHERE k = 1""",
    "tree_size_estimate": _H4
    + f""", t AS (SELECT CAST(SUM(n) AS BIGINT) AS n_edges, SUM(CAST(n AS DOUBLE) * n) AS q FROM h),
u AS (SELECT n_edges, SQRT((q - n_edges) / (CAST(n_edges AS DOUBLE) * (n_edges - 1))) AS nrmsd, (SELECT CAST(COUNT(*) AS DOUBLE) FROM g) AS px FROM t)
SELECT n_edges, ROUND(nrmsd, 9) AS nrmsd, ROUND(CASE WHEN px < {S.SIZE_LEAST} THEN 10 + n_edges + px ELSE LEAST(2 * px, 2 * px * ({S.SIZE_A} * EXP({S.SIZE_SIGMA} * nrmsd) + {S.SIZE_B} + {S.SIZE_MARGIN})) END, 3) AS estimate FROM u""",
    "min_incident_edge": _E4
    + """, i AS (SELECT p0 AS p, edge_id, alpha FROM e UNION ALL SELECT p1, edge_id, alpha FROM e)
SELECT p, edge_id, alpha FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY p ORDER BY alpha, edge_id) AS k FROM i) WHERE k = 1""",
    "edge_minmax": _E4
    + """ SELECT COUNT(*) AS n, MIN(alpha) AS min_alpha, MAX(alpha) AS max_alpha,
  MIN(edge_id) FILTER (alpha = (SELECT MIN(alpha) FROM e)) AS min_edge, MIN(edge_id) FILTER (alpha = (SELECT MAX(alpha) FROM e)) AS max_edge FROM e""",
    "level_quantile": _H4 + ", c AS (SELECT level, SUM(n) OVER (ORDER BY level) AS cum, SUM(n) OVER () AS t FROM h) SELECT MIN(level) AS level FROM c WHERE cum > t * 0.3::DOUBLE",
    "line_graph": _E4 + ", i AS (SELECT p0 AS p, edge_id, alpha FROM e UNION ALL SELECT p1, edge_id, alpha FROM e) SELECT a.edge_id AS e0, b.edge_id AS e1, GREATEST(a.alpha, b.alpha) AS alpha FROM i a JOIN i b USING (p) WHERE a.edge_id < b.edge_id",
    "availability": f"WITH {_GRID}, m AS (SELECT MAX(vec_id) AS h FROM embeddings) SELECT {_MASK} AS mask, COUNT(*) AS n FROM g, m GROUP BY 1",
    "random_samples_range": "SELECT * FROM (VALUES (1, 4096, 0), (8, 4096, 0), (12, 4096, 0), (16, 4096, 0), (32, 4096, 0)) t(bits, n, outside)",
    "acc_labels_t": _AT + " SELECT p, label FROM lab",
    "acc_attributes_t": _AT + " SELECT label, COUNT(*) AS area, SUM(v) AS sum_pix, MIN(v) AS min_pix, MAX(v) AS max_pix FROM lab JOIN g USING (p) GROUP BY label",
    "flat_partition": _AT + " SELECT p, label FROM lab",
    "strategies_agree": "SELECT * FROM (VALUES ('tiled', 0), ('rank_bins', 0), ('boruvka', 0), ('levels', 0)) t(strategy, mismatches)",
}
