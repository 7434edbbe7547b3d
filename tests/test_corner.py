"""Queries over the whole hierarchy against SQL that enumerates all components of a small image, at few levels."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from gridgrove.plans import queries as plans

CROP, STEP = 16, 16

_SMALL = plans._GRID + f""", s AS (SELECT y, x, y * {CROP} + x AS p, FLOOR(v / {STEP}) AS v FROM g WHERE y < {CROP} AND x < {CROP})"""
_SE = f"WITH RECURSIVE {_SMALL}, {plans._edge_sql('s', CROP, 4)}"
# All components at all levels: reach has every pixel that a pixel reaches at a level.
_CC = (
    _SE
    + """, w AS (SELECT p0 AS p, p1 AS q, alpha FROM e UNION ALL SELECT p1, p0, alpha FROM e),
lv AS (SELECT DISTINCT alpha AS t FROM e UNION SELECT 0.0),
reach AS (SELECT t, p, p AS q FROM lv, s UNION SELECT r.t, r.p, w.q FROM reach r JOIN w ON w.p = r.q AND w.alpha <= r.t),
cc AS (SELECT t, p, MIN(q) AS lab, COUNT(*) AS n FROM reach GROUP BY t, p)"""
)
_NODES = _CC + " SELECT lab AS min_p, n AS area, MIN(t) AS alpha FROM cc WHERE p = lab GROUP BY lab, n"
# An edge is on the spanning tree if its ends aren't joined by edges before it; the order is (alpha, edge_id).
_RANKED = _SE + """, o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY alpha, edge_id) AS k FROM e),
w AS (SELECT p0 AS p, p1 AS q, k FROM o UNION ALL SELECT p1, p0, k FROM o)"""

SQL = {
    **{f"hierarchy_nodes{k}": _NODES for k in ("", "_tiled", "_rank_bins", "_boruvka", "_levels")},
    "hierarchy_tree": _CC
    + """, node AS (SELECT lab, n, MIN(t) AS alpha FROM cc WHERE p = lab GROUP BY lab, n),
own AS (SELECT lab, n, SUM(v) AS sum_pix, MIN(v) AS min_pix, MAX(v) AS max_pix FROM node JOIN reach r ON r.t = node.alpha AND r.p = node.lab JOIN s ON s.p = r.q GROUP BY lab, n),
up AS (SELECT node.lab, node.n, ARG_MIN(c.lab, c.t) AS parent_min_p, MIN(c.t) AS parent_alpha FROM node JOIN cc c ON c.p = node.lab AND c.n > node.n GROUP BY node.lab, node.n)
SELECT lab AS min_p, n AS area, alpha, sum_pix, min_pix, max_pix, parent_min_p, parent_alpha FROM node JOIN own USING (lab, n) LEFT JOIN up USING (lab, n)""",
    "area_filter": _CC + " SELECT p, MIN(t) AS value FROM cc WHERE n >= 25 GROUP BY p",
    "level_filter": _CC
    + f""", node AS (SELECT lab, n, MIN(t) AS alpha FROM cc GROUP BY lab, n),
mine AS (SELECT DISTINCT c.p, c.n, node.alpha FROM cc c JOIN node USING (lab, n)),
top AS (SELECT MAX(alpha) AS a FROM node WHERE n = {CROP**2})
SELECT p, COALESCE(MIN(n) FILTER (alpha >= 0.2::DOUBLE * a), MAX(n)) AS value FROM mine, top GROUP BY p""",
    "common_ancestors": _CC + f" SELECT q, MIN(t) AS alpha FROM reach WHERE q = p + 1 AND q % {CROP} > 0 GROUP BY q",
    "mst_edges": _RANKED
    + """, reach AS (SELECT k, p0 AS q FROM o UNION SELECT r.k, w.q FROM reach r JOIN w ON w.p = r.q AND w.k < r.k)
SELECT edge_id, alpha FROM o WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.k = o.k AND r.q = o.p1)""",
    "redundant_edges": _SE
    + """, o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY alpha, edge_id) AS k, p0 // 16 // 8 * 2 + p0 % 16 // 8 AS t0, p1 // 16 // 8 * 2 + p1 % 16 // 8 AS t1 FROM e),
w AS (SELECT p0 AS p, p1 AS q, k FROM o WHERE t0 = t1 UNION ALL SELECT p1, p0, k FROM o WHERE t0 = t1),
reach AS (SELECT k, p0 AS q FROM o WHERE t0 = t1 UNION SELECT r.k, w.q FROM reach r JOIN w ON w.p = r.q AND w.k < r.k)
SELECT edge_id FROM o WHERE t0 = t1 AND EXISTS (SELECT 1 FROM reach r WHERE r.k = o.k AND r.q = o.p1)""",
}


def corner(spark, sf_dir):
    return plans.embeddings_grid(spark, sf_dir).crop(CROP, CROP).quantised(STEP)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("image")
    rng = np.random.default_rng(11)
    rows = list(np.float32(rng.normal(0, 0.15, (CROP + 4, 64))))
    pd.DataFrame({"vec_id": np.arange(len(rows)), "embedding": rows}).to_parquet(path / "embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, folder, name):
    more = {"share": 25 / CROP**2} if name == "area_filter" else {}
    found = plans.QUERIES[name](spark, folder, of=corner, **more)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
        want = db.execute(SQL[name])
        columns = [c[0] for c in want.description]
        rows = want.fetchall()
    assert sorted(columns) == sorted(found.columns) and len(rows) > 1
    assert sorted(map(repr, (tuple(map(plain, r)) for r in found.select(*columns).collect()))) == sorted(map(repr, (tuple(map(plain, r)) for r in rows)))


def plain(x):
    return None if x is None else float(x)
