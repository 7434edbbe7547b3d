"""Histograms of edges over a stream of image lines.

The engine's queries are over whole images; what can follow a stream are sums over edges, of lines as they arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgrove.functions.scalar import absolute, linear_level


def line_differences(lines: DataFrame) -> DataFrame:
    """(image_id, y, x, alpha) between neighbours within each line of a stream (image_id, y, values)."""
    pairs = F.arrays_zip(F.expr("slice(values, 1, greatest(size(values) - 1, 0))").alias("a"), F.expr("slice(values, 2, greatest(size(values) - 1, 0))").alias("b"))
    each = lines.select("image_id", "y", F.posexplode(pairs).alias("x", "ab"))
    return each.select("image_id", "y", F.col("x").cast("bigint").alias("x"), absolute(F.col("ab").getField("a"), F.col("ab").getField("b")).alias("alpha"))


def line_histogram(lines: DataFrame) -> DataFrame:
    """(image_id, level, n) of the differences within lines; a stream's is kept up to date in complete or update mode."""
    return line_differences(lines).groupBy("image_id", linear_level(F.col("alpha")).alias("level")).agg(F.count("*").alias("n"))
