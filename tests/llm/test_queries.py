"""The queries' columns and folds, and plain versions of what SQL can't express."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_joins import closure
from test_text import DOCS

from gridgrove.llm import jaccard, language, lmscore, neighbours, toxicity


def crc(doc_id, parts):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    path = str(tmp_path_factory.mktemp("sf"))
    alphabets = {"aa": "abcdefgh", "bb": "ijklmnop"}
    rows = []
    for k in range(240):
        code = rng.choice(list(alphabets))
        t = ["".join(rng.choices(alphabets[code], k=rng.randint(2, 7))) for _ in range(rng.randint(3, 60))]
        rows.append((k, " ".join(t) + (" vileword" * 3 if k % 5 == 0 else ""), code, "s", 1))
    rows += [(300, None, None, None, None), (301, "", "aa", "s", 0), (302, "12 34", "bb", "s", 5), (None, rows[0][1], "aa", "s", 1), (0, rows[0][1], "aa", "s", 1), (303, "é" * 300_000 + " " + (rows[3][1] + " ") * 2000, rows[3][2], "s", 1)]
    spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit("clash"), "id": F.lit("clash"), "held_out": F.lit("clash"), "n": F.lit("clash")}).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(240)] + [(None, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_op2_query(spark, folder):
    path, rows = folder
    got = toxicity.op2_toxicity(spark, path)
    assert [t for t in got.dtypes[:4]] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_toxicity_is_a_plain_sum(spark):
    """Scores from learned weights, and the weights themselves, by an update a coordinate at a time."""
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["one", "two", "three", "four", "vile"], k=rng.randint(1, 8))) for _ in range(60)]
    labels = [float("vile" in t) for t in texts]
    at, w = toxicity.fit(texts, labels, epochs=2, min_docs=3)
    features = toxicity.Features()
    docs = []
    for t in texts:
        docs.append([*features.of([t])[1].tolist(), 1 << toxicity.BITS])
    seen = Counter(f for d in docs for f in d)
    z, n = Counter(), Counter()
    model = toxicity.Ftrl()

    def weight(f):
        return 0.0 if abs(z[f]) <= model.l1 else (math.copysign(model.l1, z[f]) - z[f]) / ((model.beta + math.sqrt(n[f])) / model.alpha + model.l2)

    for epoch in range(2):
        for k in np.random.default_rng(epoch).permutation(len(docs)):
            own = [f for f in docs[k] if seen[f] >= 3 or f == 1 << toxicity.BITS]
            ws = {f: weight(f) for f in own}
            g = 1 / (1 + math.exp(-sum(ws.values()))) - labels[k]
            for f in own:
                sigma = (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / model.alpha
                z[f] += g - sigma * ws[f]
                n[f] += g * g
    want = {f: weight(f) for f in seen if weight(f)}
    assert dict(zip(at.tolist(), w, strict=True)) == pytest.approx(want)
    docs_frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    for r in toxicity.score(docs_frame, (at, w)).collect():
        assert r.score == pytest.approx(1 / (1 + math.exp(-sum(want.get(f, 0) for f in docs[r.doc_id]))), abs=1e-6)


def test_op3_query(spark, folder):
    path, rows = folder
    got = lmscore.op3_lmscore(spark, path)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    got = got.collect()
    assert len(got) == len(rows) and all(r.held_out == (crc(r.doc_id, 7) == 2) and r.score <= 0 for r in got)
    long = next(r for r in got if r.doc_id == 303)
    assert long.n_tokens == len(rows[-1][1].split()) + 1


def test_op6_query(spark, folder):
    path, rows = folder
    got = language.op6_language(spark, path)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    got = got.collect()
    assert len(got) == len(rows) and all(r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (300, 301, 302)} == dict.fromkeys((300, 301, 302), "und")
    known = {r[0]: r[2] for r in rows}
    right = [r.lang_pred == known[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 240]
    assert sum(right) / len(right) > 0.95


def test_language_hits_are_plain_sets():
    """Filters against sets of n-grams of bytes."""
    texts = {"aa": ["abc abd é", "abe xyz"], "bb": ["xyz xyw", "abq 1 9 xyz"]}
    found = {}
    for n in language.SIZES:
        for code, own in texts.items():
            c = Counter()
            for t in own:
                clean = b" " + b" ".join(bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in t.lower().encode()).split()) + b" "
                c.update(clean[k : k + n] for k in range(len(clean) - n + 1))
            found[n, code] = c
    filters = {}
    for n in language.SIZES:
        lists = []
        for own in texts.values():
            g, c = np.unique(language.codes(own, n)[1], return_counts=True)
            lists.append((g, c.astype(float)))
        filters[n] = lists
    f = language.Filters(list(texts), {n: [g for g, _ in x] for n, x in filters.items()}, own={n: language.own_grams(x) for n, x in filters.items()})
    asked = "abc xyz abq"
    hits = f.hits([asked])[0]
    for k, code in enumerate(texts):
        want = 0.0
        for n in language.SIZES:
            clean = f" {asked} ".encode()
            rate = {c: {g: v / sum(found[n, c].values()) for g, v in found[n, c].items()} for c in texts}
            for at in range(len(clean) - n + 1):
                g = clean[at : at + n]
                own = rate[code].get(g, 0)
                want += language.HELD * (own > 0) + (own > 0 and own >= language.OWN_SHARE * max(rate[c].get(g, 0) for c in texts))
        assert hits[k] == pytest.approx(want, abs=0.05)
    for n in language.SIZES:  # every n-gram of training is held
        for k, (g, _) in enumerate(filters[n]):
            assert (f.masks(g, n)[:, 0] >> np.uint64(k) & np.uint64(1)).all()


def test_op7_query(spark, folder):
    path, rows = folder
    got = jaccard.op7_jaccard(spark, path)
    assert got.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")] and got.count() == len(rows)


def test_op8_query_and_lengths(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = []
    for dims, count in ((3, 30), (2, 12), (1, 4), (70, 10)):
        for _ in range(count):
            base = rng.standard_normal(dims)
            for _ in range(2):
                rows.append((len(rows), (base + rng.standard_normal(dims) * 0.02).tolist(), int(rng.integers(0, 2))))
    rows += [(500, [], 1), (501, None, 1), (502, [1.0], None)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = neighbours.op8_neighbours(spark, str(tmp_path))
    assert got.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    got = {r.vec_id: r for r in got.collect()}
    links = []
    for a, (_, v, x) in enumerate(rows[:-3]):
        for b, (_, w, y) in enumerate(rows[:a]):
            if x == y and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links.append((a, b))
    n = Counter(k for pair in links for k in pair)
    component = closure(len(rows), links)
    assert len(links) > 20
    for k, (vec, *_) in enumerate(rows):
        assert got[vec].n_links == n[k] and got[vec].component_id == (component[k] if vec < 500 else vec)
