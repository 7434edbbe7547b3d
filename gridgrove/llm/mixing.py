"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridgrove.llm.common import checkpoint, small

MOST_RATE = 500.0  # up to which probabilities are summed from 0 copies on, and beyond which around the mode
PART_SIZE = 64 << 20  # code points of a partition of the mix, about
MOST_PARTS = 1_000_000


def uniform(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the seed and the columns."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def around_mode(rate: float) -> tuple[int, np.ndarray]:
    """The Poisson distribution's cumulative probabilities from `first` copies on, for a mean whose exp(-mean) may be no double.

    Terms are taken in log space, and then in proportion to their sum; below `first` and after the last are under 1e-30 of it.
    """
    spread = 12 * np.sqrt(rate) + 30
    first, last = max(0, int(rate - spread)), int(np.ceil(rate + spread))
    logs = np.concatenate([[0.0], np.cumsum(np.log(rate / np.arange(first + 1, last + 1)))])
    c = np.cumsum(np.exp(logs - logs.max()))
    return first, c / c[-1]


def target_rates(docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5, budget: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """(source, size, rate, cdf): the mean number of copies of a source's documents.

    The mix has `budget` times the corpus' code points, of which a source gets the share of its weight:
    that in `weights` (source, weight), 0 where it is missing there, or else its size raised to `power`.
    A source without text has rate 0. cdf holds the Poisson distribution's cumulative probabilities, from `first` copies on.
    Weights may come to any rate.
    """
    size = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).cast("bigint").alias("size"))
    if weights is None:
        sized = size.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(float(power))) if power != 0.5 else F.sqrt(F.col("size").cast("double")))
    else:
        w = weights.select(F.col("source").alias("ws"), F.col("weight").cast("double").alias("weight"))
        sized = size.join(w, F.col("source").eqNullSafe(F.col("ws")), "left").drop("ws").fillna(0.0, ["weight"])
    sized = checkpoint(sized)
    total = sized.agg(F.sum("size").cast("double").alias("total"), F.sum("weight").alias("weights")).first()
    share = F.lit(float(budget)) * F.lit(total["total"] or 0.0) * F.col("weight") / F.lit(total["weights"] or 1.0)
    rates = sized.withColumn("rate", F.when(F.col("size") > 0, share / F.col("size")).otherwise(F.lit(0.0)))
    few = rates.where(F.col("rate") <= MOST_RATE)
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    step = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(F.exp(-F.col("rate")).alias("p"), F.exp(-F.col("rate")).alias("c"), F.array(F.exp(-F.col("rate"))).alias("all")),
        lambda s, k: F.struct((s["p"] * F.col("rate") / k).alias("p"), (s["c"] + s["p"] * F.col("rate") / k).alias("c"), F.concat(s["all"], F.array(s["c"] + s["p"] * F.col("rate") / k)).alias("all")),
    )
    out = few.select("source", "size", "rate", step["all"].alias("cdf"), F.lit(0).cast("bigint").alias("first"))
    many = rates.where(F.col("rate") > MOST_RATE)
    if not small(many, 0):

        def run(parts):
            for part in parts:
                made = [around_mode(r) for r in part["rate"]]
                yield pd.DataFrame({"source": part["source"], "size": part["size"], "rate": part["rate"], "cdf": [c for _, c in made], "first": [f for f, _ in made]})

        kind = dict(rates.dtypes)["source"]
        out = out.union(many.select("source", "size", "rate").mapInPandas(run, f"source {kind}, size bigint, rate double, cdf array<double>, first bigint"))
    return checkpoint(out)


def poisson_mix(docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5, budget: float = 1.0, seed: int = 17, source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each document as many times as its hash-seeded Poisson number says, in one global random order.

    Adds replica (1, 2, ...), n_copies and shuffle_key, by which the whole result is ordered.
    Null texts count as empty. Rows of a null source form a source of their own. Rows that share an id
    get the same number. Other columns are kept; added names replace columns of the same name.
    Rates are broadcast when there are at most 50,000 sources, and joined by shuffle beyond that,
    where Spark splits the partitions of a hot source. An empty table gives an empty mix; texts of any length are kept whole.
    The order's keys are hashes, spread evenly, so that their first digits tell the partition: no range has to be sampled for.
    """
    rates = target_rates(docs, weights, power, budget, source, text)
    size = rates.agg(F.coalesce(F.sum(F.col("size") * F.col("rate")), F.lit(0.0))).first()[0]
    parts = min(MOST_PARTS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size) // PART_SIZE + 1))
    rates = rates.select(F.col("source").alias("_s"), F.col("cdf").alias("_cdf"), F.col("first").alias("_first"))
    rates = F.broadcast(rates) if small(rates, 50_000) else rates
    docs = docs.drop("replica", "n_copies", "shuffle_key")
    drawn = docs.join(rates, F.col(source).eqNullSafe(F.col("_s"))).withColumn("_u", uniform(seed, F.col(key)))
    drawn = drawn.withColumn("n_copies", (F.col("_first") + F.size(F.filter("_cdf", lambda c: c <= F.col("_u")))).cast("int")).where("n_copies > 0").drop("_s", "_cdf", "_first", "_u")
    copies = drawn.withColumn("replica", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    named = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, "replica"))
    copies = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"order {seed}"), *named)))
    place = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("double") * F.lit(float(parts)) / F.lit(float(1 << 32)))
    return copies.repartitionById(parts, place.cast("int")).sortWithinPartitions("shuffle_key")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed so that a source's share of text follows the square root of its size."""
    from gridgrove.llm.common import read

    return poisson_mix(read(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE sized AS (
  SELECT source, CAST(SUM(COALESCE(LENGTH(text), 0)) AS BIGINT) AS size FROM {docs} GROUP BY source
), total AS (SELECT CAST(SUM(size) AS DOUBLE) AS total, SUM(SQRT(CAST(size AS DOUBLE))) AS weights FROM sized),
rates AS (
  SELECT source, CASE WHEN size > 0 THEN 1.0::DOUBLE * total * SQRT(CAST(size AS DOUBLE)) / weights / size ELSE 0.0::DOUBLE END AS rate
  FROM sized, total
), cdf AS (
  SELECT source, rate, 0 AS k, EXP(-rate) AS p, EXP(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf
  WHERE k + 1 <= CEIL(rate + 12 * SQRT(rate) + 30)
), steps AS (SELECT source, LIST(c ORDER BY k) AS cdf FROM cdf GROUP BY source),
u AS (
  SELECT *, CAST(CAST('0x' || SUBSTR(MD5('17:' || COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM {docs}
), drawn AS (
  SELECT d.*, CAST(LEN([c FOR c IN s.cdf IF c <= d.u]) AS INTEGER) AS n_copies
  FROM u d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, text, lang, source, n_chars, n_copies, CAST(replica AS INTEGER) AS replica,
  MD5('order 17:' || COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || replica) AS shuffle_key
FROM (SELECT *, UNNEST(GENERATE_SERIES(1, n_copies)) AS replica FROM drawn WHERE n_copies > 0)
"""
