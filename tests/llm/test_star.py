"""A star of edited copies that only their base links."""

import random

from test_joins import brute_jaccard

from gridgrove.llm import jaccard


def test_jaccard_star_of_edited_copies(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(384)]
    texts = [" ".join(base)] + [" ".join(base + [f"u{c}x{k}" for k in range(rng.randint(95, 126))]) for c in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    n, component = brute_jaccard(texts)
    assert len(set(component)) == 1
    assert {r.id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(docs).collect()} == dict(enumerate(zip(n, component, strict=True)))
