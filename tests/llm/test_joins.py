"""Similarity joins, components and the pipeline: brute force and odd rows."""

import random
import subprocess
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from gridgrove.llm import jaccard, neighbours
from gridgrove.llm.common import components, fold, pieces, space_words

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def closure(n, links):
    up = list(range(n))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(a) for a in range(n)]


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = closure(300, links)
    assert got == {k: want[k] for k in {x for a, b in links if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_jaccard(texts):
    sets = []
    for t in texts:
        w = [x.decode() for x in space_words(t)]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return [len(s) for s in sets], closure(len(texts), links)


def test_jaccard_is_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"v{k}" for k in range(500)]
    license_line = " ".join(rng.choices(vocabulary, k=25))
    texts = []
    for size in (1, 3, 5, 8, 20, 33, 60, 64, 90, 200, 700):
        for _ in range(4):
            base = rng.choices(vocabulary, k=size)
            texts.append(" ".join(base))
            for _ in range(3):
                copy = list(base)
                for _ in range(max(0, int(size * rng.choice((0, 0.01, 0.02, 0.03, 0.04))))):
                    copy[rng.randrange(size)] = rng.choice(vocabulary)
                texts.append(" ".join(copy))
    base = rng.choices(vocabulary, k=80)
    for k in range(60):  # a large group of near copies, of which not all are alike
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(80)] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    for k in range(50):  # many texts that share most of their words, at or below the limit
        texts.append(license_line + " " + " ".join(rng.choices(vocabulary, k=rng.randint(3, 12))))
    texts += [None, "", "  \n", texts[0], texts[9].upper(), texts[9]] + [texts[40]] * 30
    rng.shuffle(texts)
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id bigint, text string, n bigint")
    n, component = brute_jaccard(texts)
    got = {r.id: r for r in jaccard.jaccard_join(docs).collect()}
    assert len(got) == len(texts)
    assert [got[k].n_shingles for k in range(len(texts))] == n
    assert [got[k].component_id for k in range(len(texts))] == component


def test_jaccard_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (0, "a b c d e f"), (5, None)], "doc_id bigint, text string")
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(docs).collect()), key=str)
    assert got == sorted([(1, 2, 0), (1, 2, 0), (None, 2, None), (0, 2, 0), (5, 0, 5)], key=str)
    assert jaccard.jaccard_join(docs.limit(0)).count() == 0


def test_sketch_bounds():
    """Hamming distances of sketches never exceed symmetric differences."""
    rng = np.random.default_rng(2)
    for n in (40, 300, 2000):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.append(a[n // 10 :], rng.integers(0, 1 << 62, n // 20).astype(np.uint64)))
        apart = len(np.setxor1d(a, b))
        doc = np.repeat([0, 1], [len(a), len(b)])
        (band, owner, keys), _ = jaccard.sketch_keys(doc, np.concatenate([a, b]), 2)
        if band[0] == band[1]:
            one, two = set(keys[owner == 0].tolist()), set(keys[owner == 1].tolist())
            assert max(len(one - two), len(two - one)) <= apart


def brute_neighbours(rows):
    good = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good[k] = x / np.linalg.norm(x)
    links = [(a, b) for a in good for b in good if b < a and rows[a][2] == rows[b][2] and good[a] @ good[b] >= 0.98]
    n = [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return n, closure(len(rows), links)


def test_neighbours_are_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(60):
        base = rng.standard_normal(8)
        for _ in range(int(rng.integers(1, 6))):
            rows.append([0, (base + rng.standard_normal(8) * rng.choice([0, 0.02, 0.06])).astype(np.float32).tolist(), int(rng.integers(0, 2))])
    base = rng.standard_normal(8)
    rows += [[0, (base + rng.standard_normal(8) * 0.03).astype(np.float32).tolist(), 3] for _ in range(90)]
    rows += [[0, rows[0][1], rows[0][2]]] * 3 + [[0, [2 * x for x in rows[1][1]], rows[1][2]]]
    rows += [[0, None, 1], [0, [0.0] * 8, 1], [0, [float("nan")] * 8, 1], [0, [float("inf"), *[1.0] * 7], 1], [0, [None, *[1.0] * 7], 1], [0, rows[0][1], None], [0, [1.0, 2.0], 1]]
    for k, r in enumerate(rows):
        rows[k] = (k, *r[1:])
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("id", F.lit("clash"))
    n, component = brute_neighbours(rows)
    monkeypatch.setattr(neighbours, "TILE", 16)  # the large group is cut into tiles
    got = {r.id: r for r in neighbours.near_duplicates(vectors).collect()}
    assert [got[k].n_links for k in range(len(rows))] == n
    assert [got[k].component_id for k in range(len(rows))] == component
    assert all(r.kept == (r.id == r.component_id) for r in got.values())
    assert neighbours.near_duplicates(vectors.limit(0)).count() == 0


def test_filter_recall():
    """Pairs at the cosine asked for have a filter in common."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.standard_normal(x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    y = 0.98 * x + (1 - 0.98**2) ** 0.5 * u / np.linalg.norm(u, axis=1, keepdims=True)
    met = np.zeros(len(x), bool)
    for seed in range(neighbours.CODES):
        code = neighbours.Code(64, 22, seed)
        (r, f), (s, g) = (code.filters(z, neighbours.MARGIN * 0.2) for z in (x, y))
        met[np.intersect1d(r * 22**3 + f, s * 22**3 + g) // 22**3] = True
    assert met.mean() >= 0.9995


def test_pieces(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"t": pa.array(["a" * n for n in (3, 9, 1, 1)] + [None])})
    assert [p.num_rows for p in pieces(iter([batch]), "t", 5)] == [1, 1, 3]


def test_fold(spark):
    import zlib

    rows = spark.createDataFrame([(5,), (None,)], "doc_id bigint").select(fold("doc_id", 7)).collect()
    assert [r[0] for r in rows] == [zlib.crc32(b"5") % 7, zlib.crc32(b"") % 7]


def test_pipeline_stages(spark, tmp_path):
    """Each stage against a brute-force version over its own input."""
    from test_text import brute_hits

    rng = random.Random(8)
    vocabulary = [f"v{k}" for k in range(400)]
    rows = []
    for k in range(700):
        t = rng.choices(vocabulary, k=rng.randint(20, 90))
        if k % 6 == 0:
            t[3:3] = ["vileword"] * 3
        rows.append([k, " ".join(t), "en", f"s{k % 3}", 0])
    item = " ".join(rng.choices(vocabulary, k=30))
    for k in (7, 13):
        rows[k][1] += " " + item
    rows[19][1] = rows[8][1] + " tail"
    rows[20][1] += " mail a.b@c.example.com now"
    rows += [[800, None, None, None, None], [801, "", "en", "s1", 0]]
    docs = spark.createDataFrame([tuple(r) for r in rows], DOCS)
    docs.withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(700)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    texts = {r[0]: r[1] for r in rows}
    assert list(stages) == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "PII", "mixing sources to target weights"]

    kept = stages["toxicity"](spark, docs, str(tmp_path))
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == corpus_pipeline.COLUMNS and ids == {k for k in texts if k >= 700 or k % 6}
    kept = stages["n-gram Jaccard join"](spark, kept, str(tmp_path))
    order = sorted(ids)
    _, component = brute_jaccard([texts[k] for k in order])
    ids = {order[c] for c in component}
    assert {r.doc_id for r in kept.collect()} == ids and 19 not in ids
    kept = stages["benchmark decontamination"](spark, kept, str(tmp_path))
    ids = {k for k, (_, n, _) in brute_hits([(k, texts[k]) for k in sorted(ids)], [(1, item)]).items() if not n}
    assert {r.doc_id for r in kept.collect()} == ids and not ids & {7, 13}
    kept = stages["PII"](spark, kept, str(tmp_path))
    got = {r.doc_id: r.text for r in kept.collect()}
    assert set(got) == ids and [k for k in ids if got[k] != texts[k]] == [20] and "a.b@c" not in got[20]
    out = stages["mixing sources to target weights"](spark, kept, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= ids and len({(r.doc_id, r.replica) for r in out}) == len(out)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.replica, r.text) for r in whole.collect()) == sorted((r.doc_id, r.replica, r.text) for r in out)


def test_rest_works_without_this_subpackage():
    """Without the operators' folder the entry still has the engine's own queries."""
    code = "import sys; sys.modules['gridgrove.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'edges4_l2' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__spark_entry__.__file__).parent, capture_output=True, timeout=120).returncode == 0
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {k.split("_")[0] for k in __spark_entry__.queries()}
