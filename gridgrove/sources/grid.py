"""Grids of pixels: generators, and grids laid out from arrays.

A grid is a DataFrame (image_id, y, x, p, v) with p = y * width + x and v an array of one number a channel.
Its height, width and channels travel beside it as a Grid.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Grid:
    """Pixels of images of one size. bits is the depth of a sample, where it is known."""

    pixels: DataFrame
    height: int
    width: int
    channels: int = 1
    bits: int | None = None

    @property
    def size(self) -> int:
        return self.height * self.width

    def crop(self, height: int, width: int) -> Grid:
        """The upper left corner of each image."""
        kept = self.pixels.where((F.col("y") < height) & (F.col("x") < width)).withColumn("p", F.col("y") * width + F.col("x"))
        return Grid(kept, height, width, self.channels, self.bits)

    def quantised(self, step: int) -> Grid:
        """Values divided by step, rounded down."""
        return Grid(self.pixels.withColumn("v", F.transform("v", lambda c: F.floor(c / step).cast("double"))), self.height, self.width, self.channels)


def sample_type(bits: int) -> T.DataType:
    """The type that holds unsigned samples of a depth from 1 to 64."""
    if not 0 < bits <= 64:
        raise ValueError("the bit depth must be from 1 to 64")
    return T.ShortType() if bits <= 8 else T.IntegerType() if bits <= 16 else T.LongType() if bits <= 32 else T.DecimalType(20, 0)


def word_bits(bits: int) -> int:
    """The width of the unsigned type that samples of a depth are kept in."""
    return next(w for w in (8, 16, 32, 64) if bits <= w)


def unsigned(hashed: Column, bits: int) -> Column:
    """The top `bits` bits of a 64-bit hash as a number that isn't negative."""
    if bits == 64:
        low = hashed.cast("decimal(20,0)")
        return F.when(low < 0, low + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(low).cast("decimal(20,0)")
    return F.shiftrightunsigned(hashed, 64 - bits)


def random_grid(spark: SparkSession, height: int, width: int, bits: int = 8, channels: int = 1, seed: int = 0, images: int = 1) -> Grid:
    """Uniform random samples of a depth, a function of seed, image, channel and pixel alone.

    Samples over 53 bits are rounded to doubles in v, as the dissimilarities are taken between doubles.
    """
    if min(height, width, channels, images) < 1:
        raise ValueError("height, width, channels and images must be positive")
    sample_type(bits)
    n = height * width
    rows = spark.range(images * n).select((F.col("id") / n).cast("bigint").alias("image_id"), (F.col("id") % n).alias("p"))
    v = F.array(*(unsigned(F.xxhash64("image_id", "p", F.lit(c), F.lit(seed)), bits).cast("double") for c in range(channels)))
    rows = rows.select("image_id", F.expr(f"p div {width}").alias("y"), (F.col("p") % width).alias("x"), "p", v.alias("v"))
    return Grid(rows, height, width, channels, bits)


def random_samples(spark: SparkSession, height: int, width: int, bits: int, channels: int = 1, seed: int = 0) -> DataFrame:
    """(image_id, p, channel, sample) with samples in the narrowest type that holds the depth."""
    n = height * width
    rows = spark.range(n * channels).select(F.lit(0).cast("bigint").alias("image_id"), (F.col("id") % n).alias("p"), (F.col("id") / n).cast("int").alias("channel"))
    return rows.withColumn("sample", unsigned(F.xxhash64("image_id", "p", "channel", F.lit(seed)), bits).cast(sample_type(bits)))


def grid_from_arrays(rows: DataFrame, key: str, values: str, height: int, width: int, channels: int = 1, scale: float = 256.0, offset: float = 0.5, top: float = 255.0) -> Grid:
    """A row of arrays a line: y is the key, x the position over the channels, v the value shifted, scaled and clipped to whole numbers."""
    cells = rows.select(F.col(key).cast("bigint").alias("y"), F.posexplode(values).alias("at", "e"))
    v = F.greatest(F.lit(0.0), F.least(F.lit(top), F.floor((F.col("e").cast("double") + offset) * scale).cast("double")))
    cells = cells.where(f"at < {width * channels}").withColumn("x", F.expr(f"cast(at div {channels} as bigint)"))
    if channels == 1:
        pixels = cells.select(F.lit(0).cast("bigint").alias("image_id"), "y", "x", (F.col("y") * width + F.col("x")).alias("p"), F.array(v).alias("v"))
    else:  # the channels of a pixel are neighbours in one array: no shuffle is needed
        part = F.transform(F.col(values), lambda e: F.greatest(F.lit(0.0), F.least(F.lit(top), F.floor((e.cast("double") + offset) * scale).cast("double"))))
        lines = rows.select(F.col(key).cast("bigint").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"), part.alias("all"))
        pixels = lines.select(F.lit(0).cast("bigint").alias("image_id"), "y", F.col("x").cast("bigint").alias("x"), (F.col("y") * width + F.col("x")).alias("p"), F.expr(f"slice(all, x * {channels} + 1, {channels})").alias("v"))
    return Grid(pixels, height, width, channels)


def planar_to_grid(samples: DataFrame, height: int, width: int, channels: int) -> Grid:
    """Rows (image_id, i, sample) of planes one after the other, i = p + channel * height * width."""
    n = height * width
    placed = samples.select("image_id", (F.col("i") % n).alias("p"), F.struct(F.expr(f"i div {n}").alias("c"), F.col("sample").cast("double").alias("s")).alias("cs"))
    pixels = placed.groupBy("image_id", "p").agg(F.array_sort(F.collect_list("cs")).alias("all"))
    return Grid(pixels.select("image_id", F.expr(f"p div {width}").alias("y"), (F.col("p") % width).alias("x"), "p", F.col("all.s").alias("v")), height, width, channels)


def swap_red_blue(grid: Grid) -> Grid:
    """Three channels in the opposite order."""
    if grid.channels != 3:
        raise ValueError("three channels are needed")
    return Grid(grid.pixels.withColumn("v", F.reverse("v")), grid.height, grid.width, 3, grid.bits)


def embeddings_grid(spark: SparkSession, sf_dir: str, channels: int = 1) -> Grid:
    """The embeddings table as an image, a vector a line of 64 samples of 8 bits."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    height = rows.agg(F.coalesce(F.max("vec_id"), F.lit(-1)) + 1).first()[0]
    return grid_from_arrays(rows, "vec_id", "embedding", int(height), 64 // channels, channels)
