"""Benchmark decontamination by a distributed positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgrove.llm.common import pieces, read, table, words

WINDOW = 10
SEGMENT_BYTES = 4 << 20
GAP = 64  # positions between two documents of a segment, more than a window or a slop may span
BLOCK_BYTES = 4 << 20  # text of items that the driver turns into phrases at once, about 80 times as much memory

INDEX = "segment bigint, doc_ids array<bigint>, n_words array<bigint>, terms array<string>, counts array<int>, postings binary"


def build_index(docs: DataFrame, vocabulary: set[bytes] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A positional inverted index of whole texts, one row per segment of about 4 MB of text.

    A row holds its documents in order, its terms, how often each occurs, and the positions of
    all terms one after the other: 32-bit integers that run through the segment's documents with GAP free
    places between them. With a vocabulary, only its terms are stored. Null texts have no words.
    """
    docs = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    known = None if vocabulary is None else spark.sparkContext.broadcast({w: k for k, w in enumerate(sorted(vocabulary))})

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 32
        for batch in pieces(batches, "text", SEGMENT_BYTES):
            ids = dict(known.value) if known else {}
            lengths, codes, places, at = [], [], [], 0
            for text in batch.column("text").to_pylist():
                found = words(text)
                if known:
                    code = np.fromiter((ids.get(w, -1) for w in found), np.int32, len(found))
                else:
                    code = np.fromiter((ids.setdefault(w, len(ids)) for w in found), np.int32, len(found))
                place = np.flatnonzero(code >= 0)
                codes.append(code[place])
                places.append((place + at).astype(np.int32))
                lengths.append(len(found))
                at += len(found) + GAP
            code, place = np.concatenate(codes), np.concatenate(places)
            order = np.argsort(code, kind="stable")
            counts = np.bincount(code, minlength=len(ids))
            there = np.flatnonzero(counts)
            terms = list(ids)
            yield pa.RecordBatch.from_pydict(
                {
                    "segment": pa.array([segment], pa.int64()),
                    "doc_ids": pa.array([batch.column("id").to_pylist()], pa.list_(pa.int64())),
                    "n_words": pa.array([lengths], pa.list_(pa.int64())),
                    "terms": pa.array([[terms[k].decode("utf-8", "surrogatepass") for k in there]], pa.list_(pa.string())),
                    "counts": pa.array([counts[there].astype(np.int32)], pa.list_(pa.int32())),
                    "postings": pa.array([place[order].tobytes()], pa.binary()),
                }
            )
            segment += 1

    return table(docs.mapInArrow(index, INDEX), "index")


class Phrases:
    """Distinct phrases of a block of items, as term numbers, with the items that hold each."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.terms: dict[str, int] = {}
        found: dict[tuple[int, ...], dict[int, None]] = {}
        self.items = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            seq = [self.terms.setdefault(w.decode("utf-8", "surrogatepass"), len(self.terms)) for w in words(text)]
            for at in range(len(seq) - window + 1) if len(seq) >= window else range(bool(seq)):
                found.setdefault(tuple(seq[at : at + window]), {})[k] = None
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.codes = np.full((len(found), max([1, *self.lengths])), -1, np.int32)
        for k, p in enumerate(found):
            self.codes[k, : len(p)] = p
        owners = [list(x) for x in found.values()]
        self.owner_at = np.concatenate([[0], np.cumsum([len(x) for x in owners], dtype=np.int64)]).astype(np.int64)
        self.owners = np.array([i for x in owners for i in x], np.int64)


def phrase_matches(segment: dict, phrases: Phrases, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, start) of every exact occurrence in a segment.

    The offset-adjusted list of a phrase's rarest term gives the candidates, which are intersected
    with the lists of its other terms from rare to common.
    """
    counts = np.asarray(segment["counts"], np.int64)
    begins = np.cumsum(counts) - counts
    postings = np.frombuffer(segment["postings"], np.int32).astype(np.int64)
    local = np.full(len(phrases.terms) + 1, -1, np.int64)  # the last stands for padding
    for k, term in enumerate(segment["terms"]):
        if (t := phrases.terms.get(term)) is not None:
            local[t] = k
    here = local[phrases.codes]
    inside = phrases.codes >= 0
    live = np.flatnonzero(((here >= 0) | ~inside).all(axis=1) & (phrases.lengths > 0))
    none = np.empty(0, np.int64)
    if not len(live):
        return none, none
    here, inside = here[live], inside[live]
    sizes = np.where(inside, counts[here], np.iinfo(np.int64).max)
    order = np.argsort(sizes, axis=1, kind="stable")
    keys = np.repeat(np.arange(len(counts), dtype=np.int64), counts) << 32 | postings
    rarest = np.take_along_axis(here, order[:, :1], 1)[:, 0]
    total = np.cumsum(counts[rarest])
    out, begin = [], 0
    while begin < len(live):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most, "right")))
        n = counts[rarest[begin:end]]
        row = np.repeat(np.arange(begin, end), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = postings[np.repeat(begins[rarest[begin:end]], n) + within] - order[row, 0]
        for j in range(1, here.shape[1]):
            offset = order[row, j]
            real = inside[row, offset]
            key = here[row, offset] << 32 | np.maximum(start + offset, 0)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            kept = (~real | (keys[at] == key)) & (start >= 0)
            row, start = row[kept], start[kept]
            if not len(row):
                break
        out.append((live[row], start))
        begin = end
    return np.concatenate([r for r, _ in out]), np.concatenate([s for _, s in out])


def near_matches(segment: dict, terms: list[str], slop: int) -> np.ndarray:
    """(first, last) positions of the smallest stretches of a segment, at most slop words from first to last, in which all terms occur.

    A stretch is left out if a smaller one lies within it. The positions of the rarest term near which all others occur
    tell which parts of the other lists are looked at. Stretches don't pass from one document to the next, as GAP is more than a slop.
    """
    if slop >= GAP:
        raise ValueError(f"slop must be below {GAP}")
    counts = np.asarray(segment["counts"], np.int64)
    begins = np.cumsum(counts) - counts
    postings = np.frombuffer(segment["postings"], np.int32).astype(np.int64)
    at = {t: k for k, t in enumerate(segment["terms"])}
    if not terms or any(t not in at for t in terms):
        return np.empty((0, 2), np.int64)
    lists = sorted((postings[begins[at[t]] : begins[at[t]] + counts[at[t]]] for t in dict.fromkeys(terms)), key=len)
    rare = lists[0]
    for other in lists[1:]:
        rare = rare[np.searchsorted(other, rare + slop, "right") > np.searchsorted(other, rare - slop)]
    lists = [x[np.searchsorted(rare, x + slop, "right") > np.searchsorted(rare, x - slop)] for x in lists]
    last = np.unique(np.concatenate(lists))
    first = last.copy()
    for x in lists:  # where each term was seen last
        k = np.searchsorted(x, last, "right") - 1
        first = np.minimum(first, np.where(k >= 0, x[np.maximum(k, 0)], -GAP) if len(x) else -GAP)
    first, k = np.unique(first, return_index=True)
    last = last[k]
    good = (first >= 0) & (last - first <= slop)
    return np.stack([first[good], last[good]], axis=1)


def proximity(index: DataFrame, asked: list[tuple[object, str | None]], slop: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, ranges) of the documents of an index in which all words of an item occur, in any order, at most slop words apart.

    ranges are the smallest such stretches of words, as [start, end) in order. asked is a stated query set of (id, text), sent to the
    executors in blocks of block_bytes of text; null texts and those without words match nothing. The index must hold all words of the items.
    Documents that share an id have a row each.
    """
    if not 0 <= slop < GAP:
        raise ValueError(f"slop must be from 0 to {GAP - 1}")
    blocks: list[list[tuple[str, list[str]]]] = [[]]
    size = 0
    for item, text in asked:
        if size > block_bytes:
            blocks.append([])
            size = 0
        size += len(text or "")
        terms = [w.decode("utf-8", "surrogatepass") for w in dict.fromkeys(words(text))]
        if terms:
            blocks[-1].append((str(item), terms))

    def looked(block: list[tuple[str, list[str]]]) -> DataFrame:
        sent = index.sparkSession.sparkContext.broadcast(block)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    n = np.asarray(row["n_words"], np.int64)
                    firsts = np.cumsum(n + GAP) - n - GAP
                    there = set(row["terms"])
                    docs, items, ranges = [], [], []
                    for item, terms in sent.value:
                        if not there.issuperset(terms):
                            continue
                        found = near_matches(row, terms, slop)
                        doc = np.searchsorted(firsts, found[:, 0], "right") - 1
                        for d in np.unique(doc):
                            docs.append(row["doc_ids"][d])
                            items.append(item)
                            ranges.append([{"start": int(a - firsts[d]), "end": int(b - firsts[d] + 1)} for a, b in found[doc == d]])
                    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.string()), pa.array(ranges, kind)], ["doc_id", "item_id", "ranges"])

        return index.mapInArrow(look, "doc_id bigint, item_id string, ranges array<struct<start:int,end:int>>")

    return reduce(DataFrame.union, map(looked, blocks))


def search(index: DataFrame, phrases: Phrases) -> DataFrame:
    """(segment, ordinal, doc_id, n_words, hits, item_ids) of every document of the index.

    hits are the word ranges [start, end) that any occurrence covers, merged; item_ids the items
    with an occurring phrase, each once, as text.
    """
    block = index.sparkSession.sparkContext.broadcast(phrases)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = block.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() if c != "counts" else batch.column(c)[k].values.to_numpy() for c in batch.schema.names}
                n = np.asarray(row["n_words"], np.int64)
                firsts = np.cumsum(n + GAP) - n - GAP
                which, start = phrase_matches(row, phrases)
                order = np.argsort(start, kind="stable")
                which, start = which[order], start[order]
                doc = np.searchsorted(firsts, start, "right") - 1
                hits: list[list[dict]] = [[] for _ in n]
                items: list[list[str]] = [[] for _ in n]
                end = np.maximum.accumulate(start + phrases.lengths[which]) if len(start) else start
                new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]])) if len(start) else start
                for a, b in zip(new, np.append(new[1:], len(start)), strict=False):
                    hits[doc[a]].append({"start": int(start[a] - firsts[doc[a]]), "end": int(end[b - 1] - firsts[doc[a]])})
                pairs = np.unique(doc * (len(phrases.lengths) + 1) + which)
                for d, w in zip(*np.divmod(pairs, len(phrases.lengths) + 1), strict=True):
                    items[d].extend(str(phrases.items[i]) for i in phrases.owners[phrases.owner_at[w] : phrases.owner_at[w + 1]])
                yield pa.RecordBatch.from_pydict(
                    {
                        "segment": pa.array([row["segment"]] * len(n), pa.int64()),
                        "ordinal": pa.array(range(len(n)), pa.int32()),
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "n_words": pa.array(n, pa.int64()),
                        "hits": pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                        "item_ids": pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
                    }
                )

    return index.mapInArrow(look, "segment bigint, ordinal int, doc_id bigint, n_words bigint, hits array<struct<start:int,end:int>>, item_ids array<string>")


def merged(found: DataFrame) -> DataFrame:
    """Rows with hits, lists of ranges in any order, as sorted disjoint ranges that cover the same words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = []
            for hits in b.column("hits"):
                x = np.array([(h["start"], h["end"]) for h in hits.as_py() or []], np.int64).reshape(-1, 2)
                x = x[np.argsort(x[:, 0], kind="stable")]
                reach = np.maximum.accumulate(x[:, 1])
                first = np.flatnonzero(np.append(True, x[1:, 0] > reach[:-1])) if len(x) else np.empty(0, np.int64)
                last = np.append(first[1:], len(x))[: len(first)] - 1
                lists.append([{"start": int(s), "end": int(e)} for s, e in zip(x[first, 0], reach[last], strict=True)])
            at = b.schema.get_field_index("hits")
            yield b.set_column(at, b.schema.field(at), pa.array(lists, b.schema.field(at).type))

    return found.mapInArrow(run, found.schema)


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, hits, item_ids of every document, null texts and repeated ids included.

    The items are the query set. Those of up to block_bytes of text go to the executors at once, with an
    index of their words only; a larger set is taken in blocks of that size against an index
    of all words, and a document's findings are merged. Items without words match nothing.
    """
    if not 0 < window <= GAP:
        raise ValueError(f"window must be from 1 to {GAP}")
    items = items.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = 1 + size // block_bytes
    if blocks == 1:
        asked = [tuple(r) for r in items.collect()]
        index = build_index(docs, {w for _, t in asked for w in words(t)}, key, text)
        return search(index, Phrases(asked, window)).drop("segment", "ordinal")
    index = build_index(docs, None, key, text)
    blocked = items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(2 * blocks)))
    found = None
    for b in range(2 * blocks):
        asked = [tuple(r) for r in blocked.where(F.col("b") == b).select("i", "t").collect()]
        part = table(search(index, Phrases(asked, window)), "matches")
        found = part if found is None else found.union(part)
    found = found.groupBy("segment", "ordinal", "doc_id", "n_words").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    return merged(found.drop("segment", "ordinal"))


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(COALESCE({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="text")} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format(text="text")} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, LEAST(10, LEN(w)) AS n, ARRAY_TO_STRING(w[s:s + LEAST(10, LEN(w)) - 1], ' ') AS win
  FROM (SELECT *, UNNEST(GENERATE_SERIES(1, GREATEST(1, LEN(w) - 9))) AS s FROM i WHERE LEN(w) > 0)
),
dw AS (
  SELECT doc_id, n, s, ARRAY_TO_STRING(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, UNNEST(GENERATE_SERIES(1, LEN(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE LEN(w) >= n)
),
m AS (SELECT DISTINCT doc_id, s, n, item_id FROM dw JOIN iw USING (n, win)),
h AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, UNNEST(GENERATE_SERIES(s, s + n - 1)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, COUNT(DISTINCT item_id) AS n_items, SHA256(STRING_AGG(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS sha FROM m GROUP BY doc_id)
SELECT doc_id, CAST(LEN(w) AS BIGINT) AS n_words, CAST(COALESCE(n_hit, 0) AS BIGINT) AS n_hit, CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items,
  COALESCE(sha, SHA256('')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
