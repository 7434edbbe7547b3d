"""Toxicity, language, LM scoring, HTML: brute force, held-out accuracy, odd rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridgrove.llm import html, language, lmscore, toxicity
from gridgrove.llm.common import space_words


def words(rng, n, letters="abcdefghij", size=(2, 7)):
    return ["".join(rng.choices(letters, k=rng.randint(*size))) for _ in range(n)]


def test_toxicity(spark):
    rng = random.Random(1)
    vocabulary, bad = words(rng, 300), ["vilex", "nastyo", "gruffa"]
    rows = []
    for k in range(900):
        t = rng.choices(vocabulary, k=rng.randint(5, 120))
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(bad) + rng.choice(("", "x", "yz")))
        rows.append((k, " ".join(t), int(toxic)))
    docs = spark.createDataFrame([(k, t, 5.0) for k, t, _ in rows] + [(1000, None, 1.0), (1001, "", 1.0), (1001, "", 1.0)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if k % 2] + [(3, None), (None, 1)], "doc_id bigint, toxic int")
    weights = toxicity.train(docs, labels)
    assert 0 < len(weights[0]) < 2000
    got = {r.doc_id: r.score for r in toxicity.score(docs, weights).collect()}
    assert len(got) == 902 and all(0 <= s <= 1 for s in got.values())
    held = [(got[k] >= toxicity.THRESHOLD) == bool(y) for k, _, y in rows if k % 2 == 0]
    assert sum(held) / len(held) > 0.97
    assert got[1000] == got[1001] < 0.5
    empty = toxicity.train(docs.limit(0), labels.limit(0))
    assert toxicity.score(docs, empty).count() == 903 and toxicity.score(docs.limit(0), weights).count() == 0


def test_ftrl_keeps_few_weights():
    model = toxicity.Ftrl(bits=6, alpha=0.5, l1=3.0)
    rng = np.random.default_rng(0)
    for _ in range(400):
        at = np.unique(np.append(rng.integers(0, 60, 8), 64))
        model.learn(at, float(5 in at))
    w = model.weights(slice(None))
    assert w[5] == w.max() > 1 and (w[:60] == 0).sum() > 20


def test_language(spark):
    rng = random.Random(2)
    alphabets = {"aa": "abcdefgh", "bb": "abcdmnop", "cc": "qrstuabé"}
    rows = [(k, " ".join(words(rng, rng.randint(5, 60), alphabets[code])).title(), code) for k, code in enumerate(rng.choices(list(alphabets), k=400))]
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !!", "cc"), (1003, "日本", "aa"), (1004, "abc", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string").withColumn("lang_pred", F.lit("clash"))
    filters = language.train(docs.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in language.predict(docs, filters).collect()}
    assert len(got) == 405
    held = [got[k].lang_pred == code for k, _, code in rows if k % 3 == 1]
    assert sum(held) / len(held) > 0.97
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred in alphabets
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = language.train(docs.limit(0))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}


def test_bloom_filters_hold_what_was_put_in():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 24, 3000).astype(np.uint64) for _ in range(70)]  # more than one word of bits
    f = language.Filters([str(k) for k in range(70)], {3: sets, 5: []})
    for k in (0, 1, 63, 64, 69):
        mask = f.masks(sets[k], 3)
        assert (mask[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).all()
    other = f.masks(rng.integers(1 << 24, 1 << 25, 20000).astype(np.uint64), 3)
    assert (other[:, 0] & np.uint64(1)).mean() == pytest.approx(f.false_rate[3][0], abs=0.002)


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)


class PlainTree:
    """Context-tree weighting one bit at a time."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.below, self.known = depth, defaultdict(lambda: [0, 0]), defaultdict(set), {}
        for t in texts:
            for context, node, bit in self.bits(t):
                for d in range(depth + 1):
                    self.counts[context[:d], node][bit] += 1
                    if d < depth:
                        self.below[context[:d], node].add(context[: d + 1])

    def bits(self, text):
        b = text.encode()
        p = bytes(self.depth) + b
        for i, byte in enumerate(b):
            node = 1
            for k in range(7, -1, -1):
                bit = byte >> k & 1
                yield p[i : i + self.depth][::-1], node, bit
                node = 2 * node + bit

    def log_weight(self, context, node):
        if (context, node) not in self.known:
            own = log_kt(*self.counts.get((context, node), (0, 0)))
            if len(context) < self.depth:
                own = np.logaddexp(own, sum(self.log_weight(c, node) for c in self.below.get((context, node), ()))) - math.log(2)
            self.known[context, node] = own
        return self.known[context, node]

    def score(self, text):
        total = 0.0
        for context, node, bit in self.bits(text):
            left, p = 1.0, 0.0
            for d in range(self.depth + 1):
                n = self.counts.get((context[:d], node), (0, 0))
                stop = 0.5 * math.exp(log_kt(*n) - self.log_weight(context[:d], node)) if d < self.depth else 1
                p += left * stop * (n[bit] + 0.5) / (sum(n) + 1)
                left *= 1 - stop
            total += math.log10(p)
        return total


def test_lm_scores_are_brute_force(spark):
    rng = random.Random(4)
    vocabulary = words(rng, 40) + ["Été", "x"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 30))) for _ in range(40)] + [None, "", "\n", "日本 zz", "a" * 3000]
    docs = spark.createDataFrame([(k, t, k % 7 == 2, "clash") for k, t in enumerate(texts)] + [(0, texts[0], False, "clash")], "doc_id bigint, text string, held_out boolean, score string")
    got = lmscore.lm_scores(docs, ~F.col("held_out"), block_bytes=300).collect()
    learned = [t or "" for k, t in enumerate(texts) if k % 7 != 2] + [texts[0]]
    tree = PlainTree(learned, lmscore.DEPTH)
    tokens = Counter(w for t in learned for w in [*space_words(t), None])
    n, v = sum(tokens.values()), len(tokens)
    assert len(got) == len(texts) + 1
    for r in got:
        t = texts[r.doc_id] or ""
        own = [*space_words(t), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(tokens[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in own))
        assert r.score == pytest.approx(tree.score(t), rel=1e-9)
    nothing = lmscore.lm_scores(docs, F.lit(False)).collect()
    assert {r.doc_id: r.score for r in nothing}[44] == pytest.approx(3000 * 8 * math.log10(0.5))
    assert lmscore.lm_scores(docs.limit(0), ~F.col("held_out")).count() == 0


def test_stirling():
    x = np.array([0.5, 1, 1.5, 3, 9.5, 10, 1e3, 1e9])
    assert lmscore.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a><li><a href='/b'>News</a></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy now, cheap things.</div>
<article><h1>A  title\n here</h1><p>First &lt;b&gt; para&shy;graph with <b>bold</b> words &#38; more of them.<p>Second&nbsp;one follows here, and it is longer.
<ul><li>point one is here<li>point two is there</ul></article>
<div id="comments"><div class="comment">I liked it a lot, thanks!</div></div><form><label>Name</label><select><option>one<option>two</select></form>
<footer>&copy; Somebody 2020</footer>"""


def test_blocks():
    got = html.blocks(PAGE)
    assert [b.text for b in got] == ["T & x", "Home", "News", "Buy now, cheap things.", "A title here", "First <b> para\xadgraph with bold words & more of them.", "Second one follows here, and it is longer.", "point one is here", "point two is there", "I liked it a lot, thanks!", "Name", "one", "two", "© Somebody 2020"]
    assert got[5].path[-2:] == ("article", "p") and got[8].path[-2:] == ("ul", "li")
    assert html.blocks(None) == html.blocks("") == html.blocks("<p></p><!-- x") == []
    assert [b.text for b in html.blocks("1 < 2 <b")] == ["1 < 2"]


def test_gradients():
    rng = np.random.default_rng(0)
    model = html.BiLstm(width=5, hidden=3, seed=1)
    model.p = {k: w.astype(float) for k, w in model.p.items()}
    x, mask = rng.standard_normal((2, 4, 5)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    y = rng.integers(0, 2, (2, 4)).astype(float)

    def loss():
        p = model.forward(x, mask)[0]
        return -np.where(mask, y * np.log(p) + (1 - y) * np.log(1 - p), 0).sum() / mask.sum()

    for name, g in model.gradients(x, mask, y).items():
        flat = model.p[name].reshape(-1)
        for k in rng.integers(0, len(flat), 4):
            keep, step = flat[k], 1e-3
            flat[k] = keep + step
            up = loss()
            flat[k] = keep - step
            down = loss()
            flat[k] = keep
            assert g.reshape(-1)[k] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-4)


def test_html_extraction(spark):
    vocabulary = words(random.Random(6), 400)
    model = html.train(vocabulary, pages=400)
    maker, reader, wrong, total = html.PageMaker(vocabulary, 77), html.Reader(), 0, 0
    for _ in range(80):
        page, y = maker.labelled()
        if page:
            p = model.label([reader.vectors(page)])[0]
            wrong, total = wrong + ((p >= 0.5) != (y > 0)).sum(), total + len(y)
    assert wrong / total < 0.05
    rows = spark.createDataFrame([(1, "u", PAGE, "clash"), (2, "u", None, ""), (3, None, "", ""), (4, "u", "<footer>x", ""), (1, "u", PAGE, "")], "page_id bigint, url string, html string, text string")
    got = html.extract(rows, model).collect()
    assert len(got) == 5 and [r.text for r in got if r.page_id in (2, 3)] == ["", ""]
    first = next(r.text for r in got if r.page_id == 1)
    assert "Second one follows" in first and "Home" not in first and "Somebody" not in first
    assert html.extract(rows.limit(0), model).count() == 0
