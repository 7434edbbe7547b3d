"""Scalar functions over pixels and edges, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def l1(a: Column, b: Column) -> Column:
    """Mean absolute difference over the channels."""
    return (_sum(_parts(a, b)) / F.size(a)).cast("float")


def l2(a: Column, b: Column) -> Column:
    """Root of the mean squared difference over the channels."""
    return F.sqrt(_sum(F.transform(_parts(a, b), lambda x: x * x)) / F.size(a)).cast("float")


def linf(a: Column, b: Column) -> Column:
    """Largest absolute difference over the channels."""
    return F.array_max(_parts(a, b)).cast("float")


def l2_sum(a: Column, b: Column) -> Column:
    """Root of the sum of squared differences, not divided by the channels."""
    return F.sqrt(_sum(F.transform(_parts(a, b), lambda x: x * x))).cast("float")


METRICS: dict[str, Callable[[Column, Column], Column]] = {"L1": l1, "L2": l2, "LInfinity": linf, "l2_sum": l2_sum}


def dissimilarity(name: str | None, channels: int = 1) -> Callable[[Column, Column], Column]:
    """The metric of a name; L2 for an empty or unknown one. One channel's metrics are all the absolute difference."""
    if channels == 1:
        return lambda a, b: absolute(F.get(a, F.lit(0)), F.get(b, F.lit(0)))
    return METRICS.get(name or "L2", l2)


def absolute(a: Column, b: Column) -> Column:
    """|a - b| between doubles, as a float."""
    return F.abs(a.cast("double") - b.cast("double")).cast("float")


def largest_dissimilarity(bits: int) -> float:
    """The largest sample of the unsigned type that holds a depth."""
    from gridgrove.sources.grid import word_bits

    return float((1 << word_bits(bits)) - 1)


def log_level(alpha: Column, a: float, levels: int | None = None) -> Column:
    """floor(a * log2(1 + alpha)), at most the last of so many levels."""
    level = (F.lit(float(a)) * F.log2(F.lit(1.0) + alpha.cast("double"))).cast("int")
    return level if levels is None else F.least(level, F.lit(levels - 1))


def linear_level(alpha: Column) -> Column:
    """The whole part of alpha."""
    return alpha.cast("bigint")


def bit_depth(n: Column) -> Column:
    """How many binary digits a positive whole number has."""
    return F.length(F.bin(n.cast("bigint")))


def rank_bin(rank: Column, size: int) -> Column:
    """rank div size."""
    return F.floor(rank / F.lit(int(size))).cast("bigint")


def power_bin(rank: Column, step: float) -> Column:
    """The whole part of rank squared over step."""
    return (rank.cast("double") * rank / F.lit(float(step))).cast("bigint")


def clip(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def in_range(x: Column, low, high) -> Column:
    """Whether low <= x < high."""
    return (x >= low) & (x < high)


# Fixed values: (dy, dx) of each direction's neighbour, in the order of the edges' numbers.
OFFSETS = {4: ((1, 0), (0, 1)), 8: ((1, 0), (1, 1), (0, 1), (-1, 1))}
SHIFT = {4: 1, 8: 2}


def check_connectivity(connectivity: int) -> int:
    if connectivity not in OFFSETS:
        raise ValueError("connectivity must be 4 or 8")
    return connectivity


def edge_number(p: Column, direction: Column, connectivity: int) -> Column:
    """p * 2 + dir with four neighbours, p * 4 + dir with eight."""
    return F.shiftleft(p.cast("bigint"), SHIFT[check_connectivity(connectivity)]) + direction


def edge_ends(edge_id: Column, width: int, connectivity: int) -> tuple[Column, Column]:
    """Both pixels of an edge's number."""
    s = SHIFT[check_connectivity(connectivity)]
    p = F.shiftright(edge_id, s)
    d = edge_id.bitwiseAND((1 << s) - 1)
    step = F.get(F.array(*(F.lit(dy * width + dx).cast("bigint") for dy, dx in OFFSETS[connectivity])), d.cast("int"))
    return p, p + step


def available(y: Column, x: Column, height: int, width: int, dy: int, dx: int) -> Column:
    """Whether a neighbour is within the image."""
    return in_range(y + dy, 0, height) & in_range(x + dx, 0, width)


def availability_mask(y: Column, x: Column, height: int, width: int, connectivity: int) -> Column:
    """A bit for each direction's neighbour that is within the image, and then one for each opposite direction's."""
    ways = OFFSETS[check_connectivity(connectivity)]
    ways = (*ways, *((-dy, -dx) for dy, dx in ways))
    return sum((F.when(available(y, x, height, width, dy, dx), 1 << k).otherwise(0) for k, (dy, dx) in enumerate(ways)), F.lit(0))


def has_bit(mask: Column, k: int) -> Column:
    return F.getbit(mask.cast("bigint"), F.lit(k)) == 1


# Parameters of the estimate of a hierarchy's size.
SIZE_A, SIZE_SIGMA, SIZE_B, SIZE_MARGIN, SIZE_LEAST = 1.3901, -2.1989, -0.1906, 0.05, 10_000


def size_curve(nrmsd: Column) -> Column:
    """Nodes over edges and pixels, by the spread of the histogram."""
    return F.lit(SIZE_A) * F.exp(F.lit(SIZE_SIGMA) * nrmsd) + F.lit(SIZE_B) + F.lit(SIZE_MARGIN)


def tile_of(y: Column, x: Column, tile_height: int, tile_width: int, rows: int, columns: int) -> Column:
    """The number of a pixel's tile; the last row and column take what is left over."""
    ty = F.least(F.floor(y / tile_height).cast("bigint"), F.lit(rows - 1))
    tx = F.least(F.floor(x / tile_width).cast("bigint"), F.lit(columns - 1))
    return ty * columns + tx


def tile_grid(height: int, width: int, parts: int) -> tuple[int, int]:
    """(rows, columns) of about `parts` tiles with the shortest borders between them."""
    parts = max(1, min(parts, height * width))
    best = None
    for rows in range(1, parts + 1):
        if parts % rows == 0 and rows <= height and parts // rows <= width:
            border = (rows - 1) * width + (parts // rows - 1) * height
            if best is None or border < best[0]:
                best = border, rows, parts // rows
    return best[1:] if best else (min(height, parts), 1) if height >= width else (1, min(width, parts))
