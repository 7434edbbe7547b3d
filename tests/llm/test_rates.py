"""Mixing at any mean rate."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridgrove.llm import mixing


def test_mixing_of_a_tiny_source(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "x").otherwise(F.repeat(F.lit("y"), 200_000)).alias("text"), F.when(F.col("id") > 0, "big").alias("source"))
    rate = {r.source: r.rate for r in mixing.target_rates(docs).collect()}[None]
    assert rate > 2000
    got = {r.doc_id: r.n_copies for r in mixing.poisson_mix(docs).select("doc_id", "n_copies").distinct().collect()}
    assert abs(got[0] - rate) < 6 * rate**0.5
    for mean in (600.0, 1e6):  # the exact distribution's mean and variance
        first, c = mixing.around_mode(mean)
        p, k = np.diff(c, prepend=0.0), first + np.arange(len(c))
        assert (p * k).sum() == pytest.approx(mean, rel=1e-9) and (p * (k - mean) ** 2).sum() == pytest.approx(mean, rel=1e-6)
