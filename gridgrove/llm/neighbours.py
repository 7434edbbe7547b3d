"""Embedding near-dedup by spherical-cap filters of a structured random product code.

A vector is cut into BLOCKS sub-vectors; each block has `width` random directions, and a filter is one direction
of each block. A filter's value for a vector is the sum of its blocks' products, so that the filters
over a threshold can be listed from the blocks' products without looking at the others. A vector belongs to
all filters whose value is at most MARGIN below its largest one, in each of CODES codes. Measured on random pairs at a cosine of
0.98, two lists of one code have no filter in common for fewer than 1 pair in 1000, and two codes are independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgrove.llm.common import checkpoint, components, read, table

COSINE = 0.98
BLOCKS = 3
CODES = 2
MARGIN = 0.25  # of the distance of two unit vectors at the cosine asked for
PER_FILTER = 64  # vectors of a length for each filter; recall doesn't depend on it, as the margin is that below the largest filter
TILE = 1024  # vectors of one filter that are compared with another such tile at once


class Code:
    """Random unit directions of each block of a vector of `dims` numbers."""

    def __init__(self, dims: int, width: int, seed: int = 7, blocks: int = BLOCKS):
        self.cuts = np.linspace(0, dims, min(blocks, dims) + 1).astype(int)
        rng = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        self.books = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            book = rng.standard_normal((width, b - a))
            self.books.append(book / np.linalg.norm(book, axis=1, keepdims=True))
        self.width = width

    def filters(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """(vector, filter) pairs of unit vectors x and the filters at most `margin` below each one's largest, by list decoding."""
        x = x @ self.rotation
        products = [x[:, a:b] @ book.T for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)]
        order = [np.argsort(-p, axis=1) for p in products]
        ranked = [np.take_along_axis(p, o, 1) for p, o in zip(products, order, strict=True)]
        slack = np.full(len(x), margin)
        row, code = np.arange(len(x)), np.zeros(len(x), np.int64)
        for ranks, names in zip(ranked, order, strict=True):  # what is lost against the best of each block must fit in the margin
            lost = ranks[row, :1] - ranks[row]
            kept = lost <= slack[:, None]
            at, k = np.nonzero(kept)
            slack = slack[at] - lost[at, k]
            code = code[at] * self.width + names[row[at], k]
            row = row[at]
        return row, code


def unit(lists: pa.ListArray) -> np.ndarray:
    """Unit vectors, in doubles, of equally long lists of finite numbers that aren't all zero."""
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, v) of the rows that can link, v as floats where it is of floats and else as doubles; the label begins with the vector's length, as only equally long ones can."""
    floats = vectors.schema[vector].dataType.simpleString() == "array<float>"
    v = F.col(vector) if floats else F.transform(vector, lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.concat(F.size(vector), F.lit(":"), F.col(label).cast("string")).alias("label"), v.alias("v")).where("id is not null and label is not null and v is not null")
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))


def listed(classes: DataFrame, cosine: float) -> DataFrame:
    """(id, label, weight, v, filters) of each class: its vector and the sorted numbers of its filters; width is that of its length's codes."""
    part = MARGIN * np.sqrt(max(0.0, 2 - 2 * cosine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[int, int], list[Code]] = {}
        for whole in batches:
            lengths = np.asarray(pa.compute.list_value_length(whole.column("v")))
            for dims in np.unique(lengths):
                same = whole.take(pa.array(np.flatnonzero(lengths == dims)))
                width = same.column("width")[0].as_py()
                if (dims, width) not in made:
                    if len(made) > 3:
                        made.clear()
                    made[dims, width] = [Code(int(dims), width, seed) for seed in range(CODES)]
                codes = made[dims, width]
                for begin in range(0, same.num_rows, 500):
                    b = same.slice(begin, 500)
                    x = unit(b.column("v"))
                    found = [code.filters(x, part) for code in codes]
                    row = np.concatenate([r for r, _ in found])
                    number = np.concatenate([f * len(found) + k for k, (_, f) in enumerate(found)])
                    order = np.lexsort((number, row))
                    cut = np.searchsorted(row[order], np.arange(len(x) + 1))
                    lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(number[order], pa.int64()))
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "label", "weight", "v")), lists], ["id", "label", "weight", "v", "filters"])

    kind = classes.schema["v"].dataType.simpleString()
    rows = classes.select("id", "label", "weight", "v", "width").mapInArrow(run, f"id bigint, label string, weight bigint, v {kind}, filters array<bigint>")
    return table(rows, "filters")


def tiles(rows: DataFrame) -> DataFrame:
    """(label, f, i, j, tile, id, weight, v, filters): for each filter with two members or more, pairs of tiles i <= j of about TILE members."""
    each = rows.select("id", "label", F.explode("filters").alias("f"))
    groups = each.groupBy("label", "f").agg(F.count("*").alias("c")).where("c > 1").withColumn("t", F.expr(f"cast(1 + (c - 1) div {TILE} as int)"))
    own = each.join(groups, ["label", "f"]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("t")).cast("int"))
    first = own.select("id", "f", "tile", F.explode(F.expr("sequence(tile, t - 1)")).alias("j")).withColumn("i", F.col("tile"))
    second = own.where("tile > 0").select("id", "f", "tile", F.explode(F.expr("sequence(0, tile - 1)")).alias("i")).withColumn("j", F.col("tile"))
    both = first.select("id", "f", "i", "j", "tile").union(second.select("id", "f", "i", "j", "tile"))
    return both.join(rows, "id")


def compare(found: DataFrame, cosine: float) -> DataFrame:
    """(id, n, least): for each tile pair, how many rows a class links with there, and the smallest class of those it reaches there."""
    rows = found.repartition("label", "f", "i", "j").sortWithinPartitions("label", "f", "i", "j", "tile", "id")

    def flush(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        column = {c: group.column(c).combine_chunks() for c in group.schema.names}
        x = unit(column["v"])
        f, i, j = (column[c][0].as_py() for c in ("f", "i", "j"))
        ids, weights, tile = (column[c].to_numpy() for c in ("id", "weight", "tile"))
        size = column["filters"].value_lengths().to_numpy()
        longest = size.max()
        padded = np.full((len(ids), longest), -1, np.int64)
        padded[np.arange(longest) < size[:, None]] = column["filters"].flatten().to_numpy()
        n, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        pairs = []
        for begin in range(0, len(ids), TILE):
            a, b = np.nonzero(x[begin : begin + TILE] @ x.T >= cosine - 1e-9)
            a += begin
            good = (a < b) & ((tile[a] != tile[b]) | (i == j))
            a, b = a[good], b[good]
            for s in range(0, len(a), 1 << 16):  # exact products, and only in the pair's first common filter
                p, q = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
                good = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                p, q = p[good], q[good]
                before = np.where(padded[p] < f, padded[p], -1)
                earlier = np.zeros(len(p), bool)
                for c in range(longest):
                    v = before[:, c]
                    some = np.flatnonzero((v >= 0) & ~earlier)
                    if not len(some):
                        break
                    earlier[some] = (padded[q[some]] == v[some, None]).any(axis=1)
                pairs.append((p, q))
                np.add.at(n, p[~earlier], weights[q[~earlier]])
                np.add.at(n, q[~earlier], weights[p[~earlier]])
        if pairs:
            p, q = (np.concatenate(z) for z in zip(*pairs, strict=True))
            while True:  # rows are in the order of ids: the smallest number is the smallest id within a tile
                was = label.copy()
                np.minimum.at(label, p, label[q])
                np.minimum.at(label, q, label[p])
                label = label[label]
                if (was == label).all():
                    break
        some = np.flatnonzero((n > 0) | (label != np.arange(len(ids))))
        return ids[some], n[some], ids[label[some]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done():
            group = pa.Table.from_batches(held) if held else None
            if group is not None and group.num_rows > 1:
                out = flush(group)
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in out], ["id", "n", "least"])

        for whole in batches:
            if not whole.num_rows:
                continue
            names = [whole.column(c) for c in ("label", "f", "i", "j")]
            apart = np.zeros(whole.num_rows - 1, bool)
            for name in names:
                apart |= pa.compute.not_equal(name[1:], name[:-1]).to_numpy(zero_copy_only=False)
            begins = np.concatenate([[0], np.flatnonzero(apart) + 1])
            for begin, end in zip(begins, np.append(begins[1:], whole.num_rows), strict=True):
                this = tuple(name[begin].as_py() for name in names)
                if key != this:
                    yield from done()
                    key, held = this, []
                held.append(whole.slice(begin, end - begin))
        yield from done()

    return rows.select("label", "f", "i", "j", "id", "weight", "filters", "v", "tile").mapInArrow(run, "id bigint, n bigint, least bigint")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row of vectors.

    Rows link when their labels are equal and the cosine of their vectors, in double precision, is `cosine` at least. Null
    vectors, labels and ids, vectors of zeros, and those with null, NaN or infinite components link with nothing. Vectors of any length
    are compared with those of the same length. An empty table gives no rows. Equal vectors are one class, compared once; n_links counts each of its rows. A hot filter's
    members are compared in pairs of tiles, by many tasks. ids stand for one vector; repeated rows count as links of each other.
    """
    good = usable(vectors, key, vector, label)
    classes = checkpoint(good.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("weight")))
    # fewer filters mean more vectors to compare in each, which is cheap, and fewer rows to send
    width = F.greatest(F.lit(2), F.ceil(F.pow(F.count("*") / F.lit(float(PER_FILTER)), 1.0 / F.least(F.lit(BLOCKS), F.greatest(F.lit(1), F.first(F.size("v")))))).cast("int"))
    widths = classes.groupBy(F.size("v").alias("dims")).agg(width.alias("width"))
    rows = listed(classes.withColumn("dims", F.size("v")).join(widths, "dims"), cosine)
    found = checkpoint(compare(tiles(rows), cosine))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    group = components(found.select(F.col("id").alias("a"), F.col("least").alias("b")))
    by_class = classes.join(counts, "id", "left").join(group.withColumnRenamed("node", "id"), "id", "left")
    by_class = by_class.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "id").alias("component"))
    linked = good.join(by_class, ["label", "v"]).select("id", "n", "component").groupBy("id").agg(F.max("n").alias("n"), F.min("component").alias("component"))
    ids = vectors.select(F.col(key).cast("bigint").alias("id"))
    out = ids.join(linked, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def op8_neighbours(spark, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return near_duplicates(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND LEN([x FOR x IN embedding IF x IS NULL OR NOT ISFINITE(x)]) = 0
), n AS (SELECT vec_id, label, e, SQRT(LIST_INNER_PRODUCT(e, e)) AS norm FROM v WHERE LIST_INNER_PRODUCT(e, e) > 0),
link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE LIST_INNER_PRODUCT(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
comp AS (SELECT x AS vec_id, LEAST(x, MIN(y)) AS component_id FROM reach GROUP BY x),
links AS (SELECT x AS vec_id, COUNT(*) AS n_links FROM link GROUP BY x)
SELECT vec_id, COALESCE(n_links, 0) AS n_links, COALESCE(component_id, vec_id) AS component_id, COALESCE(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN links USING (vec_id) LEFT JOIN comp USING (vec_id)
"""
