"""Copies of a text that each add shingles of their own, at the limit, some of them twice."""

import random

from test_joins import brute_jaccard

from gridgrove.llm import jaccard


def test_jaccard_of_a_template_and_its_copies(spark):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join(base)] + [" ".join(base + [f"u{c}x{k}" for k in range(32)]) for c in range(300)]  # 96 shingles, and 128: exactly 0.75
    texts += [t.replace("x31", "y31") for t in texts[1:40]]  # their own parts are shared, too
    texts += [" ".join(rng.choices(base, k=300)) + " " + " ".join(base[:30]) for _ in range(40)]  # unlike texts with a passage in common
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    n, component = brute_jaccard(texts)
    assert max(component.count(c) for c in component) == 340
    assert {r.id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(docs).collect()} == dict(enumerate(zip(n, component, strict=True)))
