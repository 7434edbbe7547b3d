"""N-gram Jaccard join by parity sketches.

Shingles are hashed to one of p parts of a sketch, p fixed in each size band, and a part holds the XOR of
its shingles' hashes. A shingle of the symmetric difference changes one part only, so the number of parts that
differ never exceeds the symmetric difference: at most 1/7 of the sum of sizes at a similarity of 0.75. Documents with an
equal part that isn't empty are candidates. Up to SINGLE shingles every shingle is a part of its own, and a similar
pair always has an equal part. Above, p is chosen such that a part is equal and not empty for a similar
pair with a probability of 0.42 at least where p > SKETCH, and SKETCH parts are compared: by the binomial distribution the chance that a pair has
none is under 1e-11, and that it has at most SPARED of them under 3e-9. (Where p is SKETCH, all parts are compared, and both are smaller still.)

Equal sets are one class from the start. A part shared by more than GROUP classes is crowded, and is left out only for a class
that has more other parts than can differ from any similar class, so that it meets each of them in one of those for certain, or for one that has
at most SPARED crowded parts: whichever these are, a similar class has more parts in common with it, but for the chance above, which
depends on the hash alone and not on what texts share.
The rest, as the members of a large group of near copies, are compared with the smallest class of the group.
Where a crowded group still has several components, those are compared by a second sketch in tiles of many tasks: BITS bits,
each the parity of the shingles hashed to it, whose Hamming distance is at most the symmetric difference. Only pairs of different
components that this bound allows are verified by their texts, and so are all other candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgrove.llm.common import WordIds, checkpoint, components, mix64, pieces, read, small, space_words, table

WORDS = 5
PERCENT = 75
SINGLE = 32  # shingles up to which each is a part of its own
SKETCH = 48  # parts of a larger document's sketch that are compared
SPARED = 2  # crowded parts that a class may be left out of, as every similar one has other parts in common with it
GROUP = 16  # classes with an equal part up to which all pairs are candidates
BITS = 1024
TILE = 2048  # classes of a crowded group that are compared with another such tile at once
HUB = 500  # members that a class' text is sent to at once, about

_SEED = np.uint64(0xD6E8FEB86659FD93)


def seed(n: int) -> np.uint64:
    return np.uint64(n * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)


def sets(texts: list[str | None], ids: WordIds, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of the distinct hashed shingles of texts, in order; a text of fewer than n words has one, of all of them."""
    found = [space_words(t) for t in texts]
    size = np.array([len(f) for f in found], np.int64)
    h = ids.of([w for f in found for w in f])
    doc = np.repeat(np.arange(len(texts)), size)
    rank = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    length = np.minimum(n, size)[doc]
    first = rank <= size[doc] - length
    out = length.astype(np.uint64) * seed(1)
    for k in range(n):
        word = np.zeros(len(h), np.uint64)
        word[: len(h) - k] = h[k:] if k else h
        out += np.where(k < length, mix64(word + seed(k + 2)) * (seed(3 * k + 5) | np.uint64(1)), np.uint64(0))
    doc, out = doc[first], mix64(out[first])
    order = np.lexsort((out, doc))
    doc, out = doc[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], out[new]


def split(doc: np.ndarray, h: np.ndarray, count: int) -> list[np.ndarray]:
    return np.split(h, np.searchsorted(doc, np.arange(1, count))) if count else []


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> tuple[bool, float]:
    """Whether two sorted sets are as similar as asked for, and their Jaccard distance."""
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    union = len(both) - common
    return 100 * common >= percent * union and union > 0, 1 - common / union if union else 0.0


def size_band(n: np.ndarray) -> np.ndarray:
    """The band of sets of n shingles: 0 up to SINGLE, and then that of the next power of two."""
    return np.where(n <= SINGLE, 0, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def parts_of(band: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The number of a band's parts: the most shingles that may differ in the middle of the band, over 0.46."""
    least = (100 - percent) / (100 + percent)  # of the sum of sizes
    return np.maximum(SKETCH, np.round(2 * 0.75 * np.exp2(band) * least / 0.46)).astype(np.uint64)


def sketch_keys(doc: np.ndarray, h: np.ndarray, count: int, percent: int = PERCENT) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For a set's own band and that of the largest similar set, if it is another: (band of each doc or -1, doc, key).

    Keys are the XORs of the sketch's compared parts that aren't empty, in the order of doc.
    """
    n = np.bincount(doc, minlength=count)
    own, next_band = size_band(n), size_band(100 * n // percent)
    out = []
    for band in (np.where(n > 0, own, -1), np.where((n > 0) & (next_band != own), next_band, -1)):
        b = band[doc]
        single = b == 0
        x = mix64(h + b.astype(np.uint64))
        part = (x >> np.uint64(32)) * parts_of(np.maximum(b, 0), percent) >> np.uint64(32)
        kept = (b > 0) & (part < SKETCH)
        group = doc[kept] * SKETCH + part[kept].astype(np.int64)
        order = np.argsort(group, kind="stable")
        group, x = group[order], mix64(x[kept])[order]
        at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.empty(0, np.int64)
        keys = mix64((np.bitwise_xor.reduceat(x, at) if len(at) else x) + (group[at] % SKETCH).astype(np.uint64) * seed(7) + band[group[at] // SKETCH].astype(np.uint64))
        owner = np.concatenate([doc[single], group[at] // SKETCH])
        keys = np.concatenate([mix64(h[single] ^ np.uint64(1)), keys])
        order = np.argsort(owner, kind="stable")
        out.append((band, owner[order], keys[order]))
    return out


def sketches(docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """(id, n, f1, f2, bits, band, keys, band2, keys2) of each row: its set's size, fingerprint and parities, and the keys of its bands; band2 is -1 for none."""
    docs = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))

    def lists(owner: np.ndarray, keys: np.ndarray, count: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(count + 1)), pa.int32()), pa.array(keys.view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for b in pieces(batches, "text", 1 << 20):
            count = b.num_rows
            doc, h = sets(b.column("text").to_pylist(), ids, n)
            size = np.bincount(doc, minlength=count)
            x = mix64(h ^ seed(11))
            f1, f2 = np.zeros(count, np.uint64), np.zeros(count, np.uint64)
            if len(h):
                some = np.flatnonzero(size)
                at = (np.cumsum(size) - size)[some]
                f1[some], f2[some] = np.bitwise_xor.reduceat(x, at), np.add.reduceat(mix64(x + np.uint64(1)), at)
            odd = np.bincount(doc * BITS + (mix64(h + seed(13)) >> np.uint64(32)).astype(np.int64) % BITS, minlength=count * BITS).astype(np.uint8) & 1
            bits = pa.FixedSizeListArray.from_arrays(pa.array(np.packbits(odd).view(np.int64)), BITS // 64).cast(pa.list_(pa.int64()))
            (band, o, k), (band2, o2, k2) = sketch_keys(doc, h, count, percent)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(size), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), bits, pa.array(band, pa.int32()), lists(o, k, count), pa.array(band2, pa.int32()), lists(o2, k2, count)],
                ["id", "n", "f1", "f2", "bits", "band", "keys", "band2", "keys2"],
            )

    return docs.mapInArrow(run, "id bigint, n bigint, f1 bigint, f2 bigint, bits array<bigint>, band int, keys array<bigint>, band2 int, keys2 array<bigint>")


def verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b, link, distance) of the pairs (a, b), by their whole texts (id, text).

    b's text is sent to groups of about HUB of its pairs, so that no group holds all members of a hot class.
    """
    load = pairs.groupBy("b").agg(F.count("*").alias("c"))
    spread = pairs.join(load, "b").select("a", "b", F.pmod(F.xxhash64("a"), 1 + F.expr(f"c div {HUB}")).alias("s"))
    members = spread.join(texts.withColumnRenamed("id", "a"), "a").select("a", "b", "s", "text")
    hubs = spread.select("b", "s").distinct().join(texts.withColumnRenamed("id", "b"), "b").select(F.lit(None).cast("bigint").alias("a"), "b", "s", "text")
    rows = members.union(hubs).repartition("b", "s").sortWithinPartitions("b", "s", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own = WordIds(), None
        for batch in pieces(batches, "text", 2 << 20):
            out = []
            own_sets = split(*sets(batch.column("text").to_pylist(), ids, n), batch.num_rows)
            for a, b, s in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), own_sets, strict=True):
                if a is None:
                    own = s
                else:
                    out.append((a, b, *similar(s, own, percent)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.float64()), strict=True)], ["a", "b", "link", "distance"])

    return rows.mapInArrow(run, "a bigint, b bigint, link boolean, distance double")


def fits(na: str, nb: str, percent: int):
    """Whether sets of these sizes can be similar."""
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def all_pairs(members: DataFrame) -> DataFrame:
    """(a, b, na, nb) with b < a of groups (k) of at most GROUP members (id, n); equal groups are taken once."""
    grouped = members.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("m")).select("m").distinct()
    first = grouped.select("m", F.posexplode("m").alias("p", "x")).where("p < size(m) - 1")
    pairs = first.select("x", F.explode(F.expr("slice(m, p + 2, size(m))")).alias("y"))
    return pairs.select(F.col("y.id").alias("a"), F.col("x.id").alias("b"), F.col("y.n").alias("na"), F.col("x.n").alias("nb"))


def with_hubs(members: DataFrame) -> DataFrame:
    """(k, id, n, hub, hub_n, c): each member of a group with the group's smallest one and its size; groups of one are left out.

    Groups of a ten-thousandth of all these members, 10,000 at most, are sent to every task, and their members spread by their own ids instead.
    """
    groups = members.groupBy("k").agg(F.min(F.struct("id", "n")).alias("h"), F.count("*").alias("c")).where("c > 1")
    groups = checkpoint(groups.select("k", F.col("h.id").alias("hub"), F.col("h.n").alias("hub_n"), "c"))
    total = groups.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    large = groups.where((F.col("c") > GROUP) & (F.col("c") * 10_000 >= total)).select(F.col("k").alias("lk"), F.col("hub").alias("lhub"), F.col("hub_n").alias("ln"), F.col("c").alias("lc"))
    rows = members.join(F.broadcast(large), members.k == F.col("lk"), "left").withColumn("at", F.when(F.col("lk").isNull(), F.col("k")).otherwise(F.xxhash64("id", "k")))
    rest = groups.select(F.col("k").alias("gk"), F.col("hub"), F.col("hub_n"), "c")
    rows = rows.join(rest, (F.col("at") == F.col("gk")) & F.col("lk").isNull(), "left").where("lk is not null or gk is not null")
    return rows.select(*members.columns, F.coalesce("lhub", "hub").alias("hub"), F.coalesce("ln", "hub_n").alias("hub_n"), F.coalesce("lc", "c").alias("c"))


def candidates(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of small groups, and each member of large ones with the hub that it shares most of them with."""
    star = members.where(F.col("c") > GROUP).where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"), F.col("n").alias("na"), F.col("hub_n").alias("nb"))
    star = star.where(fits("na", "nb", percent)).groupBy("a", "b").agg(F.count("*").alias("times"))
    star = star.groupBy("a").agg(F.max(F.struct("times", (-F.col("b")).alias("b"))).alias("m")).select("a", (-F.col("m.b")).alias("b"))
    few = all_pairs(members.where(F.col("c") <= GROUP)).where(fits("na", "nb", percent)).select("a", "b")
    return star.union(few).distinct()


def crowded(members: DataFrame, percent: int) -> DataFrame:
    """The members of large groups whose parts outside such groups may all differ from a similar class.

    Of a set's n shingles at most n * (1 - s) aren't in a similar set, and at most n * (1 / s - 1) are in one of the two only. Sets of more than
    SINGLE shingles may also lack SPARED parts, whichever they are.
    """
    hot = members.where(F.col("c") > GROUP)
    held = hot.groupBy("id", "band").agg(F.count("*").alias("hot"), F.first("parts").alias("parts"), F.first("n").alias("n"))
    short = held.where(F.expr(f"parts - hot <= n * {100 - percent} div if(band = 0, 100, {percent}) and (band = 0 or hot > {SPARED})")).select("id", "band")
    return hot.drop("hub", "hub_n", "c").join(short, ["id", "band"], "left_semi")


def allowed(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches' Hamming distance is at most the largest symmetric difference of similar sets."""
    own = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x"))
    other = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y"))
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, c: s + c)
    return pairs.join(own, "a").join(other, "b").where(apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select("a", "b")


def crossed(hot: DataFrame, found: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(a, b) of crowded groups (k, id, n): pairs of different components that the Hamming distance of their sketches allows."""
    named = found.select(F.col("node").alias("id"), F.col("component").alias("own"))
    rows = checkpoint(hot.join(named, "id", "left").withColumn("own", F.coalesce("own", "id")))
    mixed = rows.groupBy("k").agg(F.count("*").alias("c"), F.min("own").alias("x"), F.max("own").alias("y")).where("x < y").select("k", F.expr(f"cast(1 + (c - 1) div {TILE} as int)").alias("t"))
    rows = rows.join(mixed, "k").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("t")).cast("int"))
    first = rows.withColumns({"i": F.col("tile"), "j": F.explode(F.expr("sequence(tile, t - 1)"))})
    second = rows.where("tile > 0").withColumns({"i": F.explode(F.expr("sequence(0, tile - 1)")), "j": F.col("tile")})
    columns = ["k", "i", "j", "tile", "id", "n", "own"]
    both = first.select(*columns).union(second.select(*columns)).join(reps.select("id", "bits"), "id")
    both = both.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "id").select(*columns, "bits")

    def pairs_of(i: int, j: int, tile, ids, n, own, bits) -> tuple[np.ndarray, np.ndarray]:
        tile, ids, n, own, bits = np.array(tile), np.array(ids), np.array(n), np.array(own), np.array(bits, np.int64).view(np.uint64)
        out = []
        for begin in range(0, len(ids), 64):
            part = slice(begin, begin + 64)
            apart = np.bitwise_count(bits[part, None, :] ^ bits[None, :, :]).sum(axis=2, dtype=np.int64)
            good = apart * (100 + percent) <= (n[part, None] + n[None, :]) * (100 - percent)
            good &= (own[part, None] != own[None, :]) & (np.arange(begin, begin + len(ids[part]))[:, None] > np.arange(len(ids))[None, :])
            good &= (tile[part, None] != tile[None, :]) | (i == j)
            out.append(np.nonzero(good) + np.array([[begin], [0]]))
        a, b = np.concatenate(out, axis=1)
        return ids[a], ids[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done():
            if len(held) > 1:
                a, b = pairs_of(key[1], key[2], *zip(*held, strict=True))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for k, i, j, *rest in zip(*(batch.column(c).to_pylist() for c in [*columns, "bits"]), strict=True):
                if key != (k, i, j):
                    yield from done()
                    key, held = (k, i, j), []
                held.append(rest)
        yield from done()

    return both.mapInArrow(run, "a bigint, b bigint").distinct()


def similar_pairs(reps: DataFrame, docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """(node, component) of the sketched classes reps that link; every pair of classes that links is within a component."""
    both = F.array(F.struct("band", "keys"), F.struct(F.col("band2").alias("band"), F.col("keys2").alias("keys")))
    each = reps.select("id", "n", F.explode(both).alias("x")).where("x.band >= 0").select("id", "n", "x.band", F.size("x.keys").alias("parts"), F.explode("x.keys").alias("k"))
    members = table(with_hubs(each), "parts")
    again = table(with_hubs(crowded(members, percent)), "crowded")
    pairs = candidates(members.where(F.col("c") <= GROUP), percent).union(candidates(again, percent)).distinct()
    pairs = checkpoint(allowed(pairs, reps, percent))
    hot = again.where(F.col("c") > GROUP).select("k", "id", "n")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(hot.select("id")).distinct()
    texts = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).join(needed, "id", "left_semi").dropDuplicates(["id"])
    texts = table(texts, "texts")
    links = checkpoint(verify(pairs, texts, n, percent).where("link").select("a", "b"))
    found = components(links)
    if small(hot, 0):
        return found
    more = checkpoint(crossed(hot, found, reps, percent).join(pairs, ["a", "b"], "left_anti"))
    if small(more, 0):
        return found
    links = verify(more, texts, n, percent).where("link").select("a", "b")
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) of every row of docs.

    Words are cut at white space, A-Z lower-cased. Rows link when 100 * |intersection| >= percent * |union| of their
    sets of n-word shingles; null texts and texts without words have empty sets, which link with nothing.
    An id stands for one document: repeated rows are all returned, and of different texts under one id
    any may stand for it in comparisons. Rows with a null id link with nothing and have a null component.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    sizes = table(sketches(docs, key, text, n, percent), "sketches")
    filled = sizes.where("n > 0 and id is not null")
    classes = checkpoint(filled.groupBy("f1", "f2").agg(F.min("id").alias("rep")))
    reps = table(filled.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"]), "classes")
    found = similar_pairs(reps, docs, key, text, n, percent)
    named = classes.join(found, classes.rep == found.node, "left").select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    out = sizes.join(named, ["f1", "f2"], "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id")).alias("component_id"))


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return jaccard_join(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


_SETS = r"""
words_{t} AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM {docs}),
sh_{t} AS (
  SELECT DISTINCT doc_id, ARRAY_TO_STRING(w[s:s + 4], ' ') AS sh
  FROM (SELECT *, UNNEST(GENERATE_SERIES(1, GREATEST(1, LEN(w) - 4))) AS s FROM words_{t} WHERE LEN(w) > 0)
),
n_{t} AS (SELECT doc_id, COUNT(*) AS n FROM sh_{t} GROUP BY doc_id),
link_{t} AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM sh_{t} a JOIN sh_{t} b USING (sh) JOIN n_{t} na ON na.doc_id = a.doc_id JOIN n_{t} nb ON nb.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * COUNT(*) >= 75 * (na.n + nb.n - COUNT(*))
),
reach_{t} AS (SELECT x, y FROM link_{t} UNION SELECT r.x, l.y FROM reach_{t} r JOIN link_{t} l ON r.y = l.x),
comp_{t} AS (SELECT x AS doc_id, LEAST(x, MIN(y)) AS component_id FROM reach_{t} GROUP BY x)
"""


def components_sql(docs: str, name: str) -> str:
    """Common tables words_, sh_, n_, link_, reach_ and comp_ of a table of documents, for WITH RECURSIVE."""
    return _SETS.format(docs=docs, t=name)


SQL = f"""
WITH RECURSIVE {components_sql("documents", "d")}
SELECT doc_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_shingles, COALESCE(component_id, doc_id) AS component_id
FROM documents LEFT JOIN n_d USING (doc_id) LEFT JOIN comp_d USING (doc_id)
"""
