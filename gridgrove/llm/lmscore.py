"""LM scoring by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions, each with its own context tree: a node is a context of 0 to DEPTH bytes and the decisions
taken so far (1 to 255). A node's estimate is that of Krichevsky and Trofimov; its weighted probability is the mean
of its estimate's and of the product of its children's. After training the mixture is fixed: the probability of a bit is
the sum over the depths of its node's estimate times the posterior weight of stopping there.

Counts of (DEPTH + 1)-grams of bytes are gathered by block, a set of documents of bounded size, and summed over the
corpus; all probabilities are computed once for each distinct gram, and go back to the blocks that hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgrove.llm.common import WordIds, checkpoint, fold, mix64, pieces, read, space_words, table, text_bytes

DEPTH = 4  # bytes of context
BLOCK_BYTES = 64 << 20  # text of a block, at most about
PART_BYTES = 1 << 19  # text that is turned into grams at once, at least one document
NEAR = 3  # recent context bytes below which all depths of a subtree are worked out in one task: at most 256 ** (DEPTH + 1 - NEAR) grams
BUCKET = 50_000  # grams of a task, about, that works out subtrees

LN2, LN10 = np.log(2.0), np.log(10.0)


def grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram) of every byte: its context, most recent byte first, and then the byte itself in the lowest place; a text begins after zeros."""
    joined = np.frombuffer(b"".join(bytes(depth) + t for t in texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    at = np.arange(len(text)) + (text.astype(np.int64) + 1) * depth
    code = np.zeros(len(at), np.uint64)
    for k in range(1, depth + 1):
        code = code << np.uint64(8) | joined[at - k]
    return text, code << np.uint64(8) | joined[at]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, by Stirling's series above 10."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(10):
        low = y < 10
        shift[low] += np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability of a zeros and b ones by Krichevsky and Trofimov's estimator."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - 2 * 0.5723649429247001 - log_gamma(a + b + 1.0)


def weighted(log_own: np.ndarray, log_children: np.ndarray) -> np.ndarray:
    return np.logaddexp(log_own, log_children) - LN2


def bit_nodes(byte: np.ndarray) -> np.ndarray:
    """(8, len) the node of each of a byte's bits: a one and the bits before."""
    one = np.uint64(1)
    return np.array([(one << np.uint64(k)) | (byte >> np.uint64(8 - k)) for k in range(8)], np.uint64)


class Subtrees:
    """All nodes at depths `near` to `depth` of some grams and their training counts: zeros, ones and weighted probabilities.

    Grams are sorted, so a context's are together, and so are those of each of its ends.
    """

    def __init__(self, gram: np.ndarray, count: np.ndarray, near: int = NEAR, depth: int = DEPTH):
        self.gram, self.near, self.depth = gram, near, depth
        byte = gram & np.uint64(0xFF)
        nodes = bit_nodes(byte)
        bits = np.array([byte >> np.uint64(7 - k) & np.uint64(1) for k in range(8)])
        self.at, self.zeros, self.ones, self.logw, self.keys = {}, {}, {}, {}, {}
        children = None
        for d in range(depth, near - 1, -1):
            context = gram >> np.uint64(8 * (depth - d + 1))
            key = (context << np.uint64(8))[None, :] | nodes
            keys, at = np.unique(key.ravel(), return_inverse=True)
            self.keys[d], self.at[d] = keys, at.reshape(key.shape)
            weights = np.broadcast_to(count, key.shape).ravel().astype(float)
            ones = np.bincount(at.ravel(), weights * bits.ravel(), len(keys))
            zeros = np.bincount(at.ravel(), weights, len(keys)) - ones
            own = log_kt(zeros, ones)
            if children is None:
                w = own
            else:
                k_child, w_child = children  # parents: the context without its oldest byte, which is lowest
                parent = (k_child >> np.uint64(16) << np.uint64(8)) | (k_child & np.uint64(0xFF))
                w = weighted(own, np.bincount(np.searchsorted(keys, parent), w_child, len(keys)))
            self.zeros[d], self.ones[d], self.logw[d] = zeros, ones, w
            children = (keys, w)

    def scores(self, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """log10 of each gram's byte, given what depths below `near` add to the probability of a one, and their rest, for each node of depth near."""
        p, left = base[self.at[self.near]], rest[self.at[self.near]]
        for d in range(self.near, self.depth + 1):
            zeros, ones, own = self.zeros[d], self.ones[d], log_kt(self.zeros[d], self.ones[d])
            stop = np.exp(np.minimum(own - LN2 - self.logw[d], 0)) if d < self.depth else np.ones(len(zeros))
            at = self.at[d]
            p = p + left * (stop * (ones + 0.5) / (zeros + ones + 1))[at]
            left = left * (1 - stop)[at]
        byte = self.gram & np.uint64(0xFF)
        bits = np.array([byte >> np.uint64(7 - k) & np.uint64(1) for k in range(8)]) == 1
        p = np.clip(p, 1e-300, 1)
        return np.log10(np.where(bits, p, np.maximum(1 - p, 1e-300))).sum(axis=0)


def packed(batch: pa.RecordBatch) -> bytes:
    """A batch as compressed bytes, about a third of its texts' size."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def blocked(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, data): the rows of docs (text, learned, ...) in packed batches; a block has those of a partition up to block_bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, before = TaskContext.get().partitionId() << 32, 0
        for batch in pieces(batches, "text", PART_BYTES):
            yield pa.RecordBatch.from_pydict({"block": pa.array([first + before // block_bytes], pa.int64()), "data": pa.array([packed(batch)], pa.binary())})
            before += int(pa.compute.sum(pa.compute.binary_length(batch.column("text"))).as_py() or 0)

    return docs.mapInArrow(run, "block bigint, data binary")


def counted(x: np.ndarray, weight: int) -> tuple[np.ndarray, np.ndarray]:
    u, c = np.unique(x, return_counts=True)
    return u, c * weight


def runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that are equal in all columns and come one after the other."""
    n = len(columns[0])
    if n:
        change = np.zeros(n - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        ends = [*(np.flatnonzero(change) + 1).tolist(), n]
        yield from zip([0, *ends[:-1]], ends, strict=True)


def gathered(placed: DataFrame) -> DataFrame:
    """(block, kind, key, n): each gram (kind 0) and token (kind 1) of a block's texts, and how often its training texts hold it.

    A block that two tasks read parts of has rows of both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, key, held = WordIds(100_000), None, {0: [], 1: []}

        def out():
            for kind in (0, 1):
                g, c = merge(held[kind])
                held[kind] = []
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), key)), pa.array(np.full(len(g), kind, np.int32)), pa.array(g.view(np.int64)), pa.array(c)], ["block", "kind", "key", "n"])

        for whole in batches:
            for block, data in zip(whole.column("block").to_pylist(), whole.column("data"), strict=True):
                if key is not None and key != block:
                    yield from out()
                key, batch = block, unpacked(data.as_py())
                strings = batch.column("text").to_pylist()
                learned = np.asarray(batch.column("learned").to_pylist(), bool)
                text, g = grams([text_bytes(t) for t in strings])
                own = learned[text]
                held[0] += [counted(g[own], 1), counted(g[~own], 0)]
                for weight in (0, 1):
                    some = [t for t, w in zip(strings, learned, strict=True) if w == weight]
                    held[1] += [counted(ids.of([w for t in some for w in space_words(t)]), weight), (np.array([END], np.uint64), np.array([weight * len(some)]))]
                for kind in (0, 1):
                    if len(held[kind]) > 6:
                        held[kind] = [merge(held[kind])]
        if key is not None:
            yield from out()

    return placed.mapInArrow(run, "block bigint, kind int, key bigint, n bigint")


END = 0x9E3779B97F4A7C15  # a text's end, as a token's hash


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed counts."""
    g, c = (np.concatenate(z) for z in zip(*parts, strict=True))
    order = np.argsort(g)
    g, c = g[order], c[order]
    at = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.empty(0, np.int64)
    return g[at], (np.add.reduceat(c, at) if len(at) else c).astype(np.int64)


def near_nodes(counts: DataFrame) -> DataFrame:
    """(context, node, zeros, ones, logw) of depth NEAR; counts is sorted by bucket and gram, each context in one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, c in by_bucket(batches, "gram", "n"):
            tree = Subtrees(g.view(np.uint64), c)
            keys = tree.keys[NEAR]
            yield pa.RecordBatch.from_arrays(
                [pa.array((keys >> np.uint64(8)).astype(np.int64)), pa.array((keys & np.uint64(0xFF)).astype(np.int32)), pa.array(tree.zeros[NEAR]), pa.array(tree.ones[NEAR]), pa.array(tree.logw[NEAR])],
                ["context", "node", "zeros", "ones", "logw"],
            )

    return counts.mapInArrow(run, "context bigint, node int, zeros double, ones double, logw double")


def by_bucket(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The columns of each bucket's rows, which come one after the other."""
    key, held = None, []
    for batch in batches:
        b = np.asarray(batch.column("bucket"))
        values = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        for begin, end in runs(b):
            if key is not None and key != b[begin]:
                yield tuple(np.concatenate(z) for z in zip(*held, strict=True))
                held = []
            key = b[begin]
            held.append(tuple(v[begin:end] for v in values))
    if held:
        yield tuple(np.concatenate(z) for z in zip(*held, strict=True))


def stirling(x):
    """log_gamma as a column."""
    y = x + 10
    z = 1 / (y * y)
    big = (y - 0.5) * F.log(y) - y + F.lit(0.9189385332046727) + (F.lit(1 / 12) - z * (F.lit(1 / 360) - z * (F.lit(1 / 1260) - z / 1680))) / y
    return big - sum((F.log(x + k) for k in range(1, 10)), F.log(x))


def kt(zeros, ones):
    return stirling(zeros + 0.5) + stirling(ones + 0.5) - F.lit(2 * 0.5723649429247001) - stirling(zeros + ones + 1)


def upper_levels(nodes: DataFrame) -> DataFrame:
    """(context, node, base, rest) of depth NEAR: what the depths below add to the probability of a one, and the weight they leave.

    nodes has depth NEAR; each level's nodes are the sums of the one below, and the mixture is then worked out from the top.
    """
    levels = [nodes.select("context", "node", "zeros", "ones", "logw")]
    for _ in range(NEAR):
        below = levels[-1]
        own = below.groupBy(F.shiftright("context", 8).alias("context"), "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("logw").alias("children"))
        own = own.withColumn("kt", kt(F.col("zeros"), F.col("ones")))
        own = own.withColumn("logw", F.greatest("kt", "children") + F.log1p(F.exp(-F.abs(F.col("kt") - F.col("children")))) - F.lit(LN2))
        levels.append(checkpoint(own.withColumn("stop", F.exp(F.least(F.col("kt") - F.lit(LN2) - F.col("logw"), F.lit(0.0)))).drop("kt", "children")))
    chance = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
    top = levels.pop()
    above = top.select("context", "node", (F.col("stop") * chance).alias("base"), (1 - F.col("stop")).alias("rest"))
    while len(levels) > 1:
        own = levels.pop()
        up = above.select(F.col("context").alias("up"), F.col("node").alias("un"), "base", "rest")
        both = own.join(up, (F.shiftright(own.context, 8) == F.col("up")) & (own.node == F.col("un")))
        above = both.select("context", "node", (F.col("base") + F.col("rest") * F.col("stop") * chance).alias("base"), (F.col("rest") * (1 - F.col("stop"))).alias("rest"))
    up = above.select(F.col("context").alias("up"), F.col("node").alias("un"), "base", "rest")
    own = levels.pop().select("context", "node")
    return own.join(up, (F.shiftright(own.context, 8) == F.col("up")) & (own.node == F.col("un"))).select("context", "node", "base", "rest")


def gram_scores(counts: DataFrame, buckets: int) -> DataFrame:
    """(gram, score): log10 of the probability of a gram's byte after its context; counts (gram, n) has every distinct gram once."""
    context = F.shiftrightunsigned("gram", 8 * (DEPTH + 1 - NEAR))
    keyed = counts.withColumn("bucket", F.pmod(F.xxhash64(context), F.lit(buckets)).cast("int"))
    placed = table(keyed.select("bucket", "gram", "n"), "counts")
    nodes = table(near_nodes(placed.repartition("bucket").sortWithinPartitions("bucket", "gram")), "nodes")
    ready = upper_levels(nodes).withColumn("bucket", F.pmod(F.xxhash64("context"), F.lit(buckets)).cast("int"))
    # both kinds of rows of a bucket come together, the nodes first, sorted as Subtrees has them
    zero = F.lit(0.0)
    rows = ready.select("bucket", F.lit(0).alias("kind"), (F.shiftleft("context", 8) + F.col("node")).alias("gram"), F.lit(0).cast("bigint").alias("n"), "base", "rest")
    rows = rows.union(placed.select("bucket", F.lit(1), "gram", "n", zero, zero)).repartition("bucket").sortWithinPartitions("bucket", "kind", "gram")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, g, n, base, rest in by_bucket(batches, "kind", "gram", "n", "base", "rest"):
            node = kind == 0
            tree = Subtrees(g[~node].view(np.uint64), n[~node])
            yield pa.RecordBatch.from_arrays([pa.array(g[~node]), pa.array(tree.scores(base[node], rest[node]))], ["gram", "score"])

    return rows.mapInArrow(run, "gram bigint, score double")


class Lookup:
    """Values of distinct 64-bit keys, sorted by the first bits of their hashes; keys that aren't there have 0."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.bits = max(4, len(key).bit_length())
        slot = self._slot(key)
        self.begins = np.zeros((1 << self.bits) + 1, np.int32)
        np.cumsum(np.bincount(slot, minlength=1 << self.bits), out=self.begins[1:])
        order = np.argsort(slot)
        del slot
        self.keys, self.values = key[order], value[order]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix64(key) >> np.uint64(64 - self.bits)).astype(np.int32 if self.bits < 32 else np.int64)

    def of(self, key: np.ndarray) -> np.ndarray:
        slot = self._slot(key)
        at, end = self.begins[slot], self.begins[slot + 1]
        out, left = np.zeros(len(key)), np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            hit = self.keys[at] == key[left]
            out[left[hit]] = self.values[at[hit]]
            at = at + 1
            on = ~hit & (at < end)
            left, at, end = left[on], at[on], end[on]
        return out


def in_packs(rows: DataFrame) -> DataFrame:
    """(block, kind, data): the rows (block, kind, key, value), a partition's of one block and kind together, as bytes of keys and then of values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def out():
            keys = list(held)
            data = [b"".join([*(k.tobytes() for k, _ in held[x]), *(v.tobytes() for _, v in held[x])]) for x in keys]
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int32()), pa.array(data, pa.binary())], ["block", "kind", "data"])

        n = 0
        for batch in batches:
            block, kind, key, value = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "kind", "key", "value"))
            order = np.lexsort((key, kind, block))
            block, kind, key, value = block[order], kind[order], key[order], value[order]
            for begin, end in runs(block, kind):
                held.setdefault((int(block[begin]), int(kind[begin])), []).append((key[begin:end], value[begin:end]))
            n += len(block)
            if n > 500_000:
                yield from out()
                n = 0
        if held:
            yield from out()

    return rows.mapInArrow(run, "block bigint, kind int, data binary")


def scored(placed: DataFrame, held: DataFrame, kept: dict[str, str], n: int, v: int) -> DataFrame:
    """The kept columns, with their types, and the scores of every row of placed; held has (block, kind, key, value) of all that each block holds.

    Values are a gram's score and a token's count; n and v are how many training tokens and distinct ones there are.
    """
    rows = in_packs(held).union(placed.select("block", F.lit(2), "data")).repartition("block").sortWithinPartitions("block", "kind")
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def scores_of(strings: list[str], tables: list[Lookup]) -> list[pa.Array]:
        text, g = grams([text_bytes(t) for t in strings])
        score = np.bincount(text, tables[0].of(g), len(strings))
        found = [space_words(t) for t in strings]
        size = np.array([len(f) + 1 for f in found], np.int64)
        tokens, inner = np.full(size.sum(), END, np.uint64), np.ones(size.sum(), bool)
        inner[np.cumsum(size) - 1] = False
        tokens[inner] = ids.of([w for f in found for w in f])
        c, doc = tables[1].of(tokens), np.repeat(np.arange(len(strings)), size)
        base = np.bincount(doc, np.log10((c + 1) / (n + v + 1)), len(strings))
        known = np.bincount(doc, c > 0, len(strings)).astype(np.int64)
        return [pa.array(size), pa.array(known), pa.array(np.full(len(strings), n, np.int64)), pa.array(base), pa.array(score)]

    ids = WordIds(100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, tables = None, {0: [], 1: []}, None
        for whole in batches:
            for block, kind, data in zip(whole.column("block").to_pylist(), whole.column("kind").to_pylist(), whole.column("data"), strict=True):
                if key != block:
                    key, parts, tables = block, {0: [], 1: []}, None
                if kind < 2:
                    both = np.frombuffer(data.as_py(), np.uint64).reshape(2, -1)
                    parts[kind].append((both[0], both[1].view(float)))
                    continue
                if tables is None:
                    none = (np.empty(0, np.uint64), np.empty(0))
                    tables = [Lookup(*(np.concatenate(z) for z in zip(none, *parts[k], strict=True))) for k in (0, 1)]
                    parts = {0: [], 1: []}
                batch = unpacked(data.as_py())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *scores_of(batch.column("text").to_pylist(), tables)], [*kept, *added])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in kept.items()), "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"]))


def lm_scores(docs: DataFrame, learned, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs' columns other than the text, and n_tokens, n_known, train_tokens, base_score and score of every row.

    `learned` is a condition on docs that chooses the training texts. score is log10 of the probability of the whole text
    under the context tree, 0 for null and empty texts. base_score is that of its tokens, words between white space
    with A-Z lower-cased and an end, under add-one smoothed counts. With nothing to learn from, every bit has a
    probability of one half. Repeated rows are each scored. Columns of these names are replaced.
    """
    kept = [c for c in docs.columns if c not in (text, "n_tokens", "n_known", "train_tokens", "base_score", "score")]
    names = {c: f"_k{i}" for i, c in enumerate(kept)}
    rows = docs.select(*(F.col(f"`{c}`").alias(names[c]) for c in kept), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(learned, F.lit(False)).alias("learned"))
    placed = table(blocked(rows, block_bytes), "blocks")
    held = table(gathered(placed), "held")
    counts = held.groupBy("kind", "key").agg(F.sum("n").alias("n"))
    tokens = table(counts.where("kind = 1").select("key", F.col("n").cast("double").alias("value")), "tokens")
    n, v = tokens.where("value > 0").agg(F.coalesce(F.sum("value"), F.lit(0.0)).cast("bigint"), F.count("*")).first()
    buckets = int(max(64, 1 + held.where("kind = 0").count() // BUCKET))
    scores = gram_scores(counts.where("kind = 0").select(F.col("key").alias("gram"), "n"), buckets)
    values = scores.select(F.lit(0).alias("kind"), F.col("gram").alias("key"), F.col("score").alias("value")).union(tokens.select(F.lit(1), "key", "value"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema if f.name not in ("text", "learned")}
    found = scored(placed, held.select("block", "kind", "key").join(values, ["kind", "key"]).select("block", "kind", "key", "value"), types, n, v)
    return found.withColumnsRenamed({v: k for k, v in names.items()})


def op3_lmscore(spark, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold("doc_id", 7) == 2)
    return lm_scores(docs, ~F.col("held_out"))

