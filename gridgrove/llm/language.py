"""Language ID by n-gram Bloom filters whose slots hold one bit a language.

A language's filter holds every n-gram of its training documents, so that a lookup returns all languages that contain one. A second bit
tells the languages that an n-gram is typical of: those in which it is at least OWN_SHARE times as frequent as in any other. Popcounts of both kinds,
corrected for false positives, decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridgrove.llm.common import LETTER, fold, mix64, pieces, read

SIZES = (3, 5)  # bytes of an n-gram
MAX_TRAIN = 1500  # documents a language that its n-grams are counted in, chosen by hash of their id
OWN_SHARE = 0.4  # an n-gram much more frequent in another language isn't typical of a language
HELD = 0.05  # weight of an n-gram that a language holds, beside that of 1 of one that is typical of it
SLOT_BITS = (16, 24)  # slots are about six times the n-grams of a language, within these powers of two; fuller filters are corrected for
HASHES = 2
UNDETERMINED = "und"

# ASCII other than letters counts as white space.
_TABLE = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def codes(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram) of every n-gram of lower-case bytes within words and over their ends; digits and signs are white space."""
    clean = [b" " + b" ".join((t or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()) + b" " for t in texts]
    lengths = np.array([max(0, len(c) - size + 1) for c in clean], np.int64)
    all_bytes = np.frombuffer(b"".join(clean), np.uint8)
    ends = np.cumsum([len(c) for c in clean], dtype=np.int64)
    code = np.zeros(max(0, len(all_bytes) - size + 1), np.uint64)
    for k in range(size):
        code = code << np.uint64(8) | all_bytes[k : len(code) + k]
    inside = np.zeros(len(code), bool)
    for b, n in zip(ends - [len(c) for c in clean], lengths, strict=True):
        inside[b : b + n] = True
    return np.repeat(np.arange(len(texts)), lengths), code[inside]


class Filters:
    """Bloom filters of all languages side by side: a slot's first bits tell the languages that hold an n-gram, as many further ones those it is typical of."""

    def __init__(self, languages: list[str], grams: dict[int, list[np.ndarray]], prior: int = 0, own: dict[int, list[np.ndarray]] | None = None, hashes: int = HASHES):
        self.languages, self.prior, self.hashes = languages, prior, hashes
        self.width = max(1, -(-2 * len(languages) // 64))
        self.slots, self.slot_bits, self.false_rate = {}, {}, {}
        for n in SIZES:
            held = grams.get(n, [])
            planes = [*held, *((own or grams).get(n, []))]
            most = max([len(g) for g in held], default=0)
            self.slot_bits[n] = min(max(SLOT_BITS[0], (6 * most).bit_length()), SLOT_BITS[1])
            self.slots[n] = np.zeros((1 << self.slot_bits[n], self.width), np.uint64)
            for k, g in enumerate(planes):
                for at in self._slots(g, n):
                    self.slots[n][at, k // 64] |= np.uint64(1 << (k % 64))
            fill = [float((self.slots[n][:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean()) for k in range(2 * len(languages))]
            self.false_rate[n] = np.array(fill) ** hashes

    def _slots(self, grams: np.ndarray, size: int) -> Iterator[np.ndarray]:
        h = mix64(grams + np.uint64(size))
        for k in range(self.hashes):
            yield (h >> np.uint64(k * 24)).astype(np.int64) & ((1 << self.slot_bits[size]) - 1)

    def masks(self, grams: np.ndarray, size: int) -> np.ndarray:
        """The languages whose filters hold each n-gram, and those it is typical of, as bits."""
        out = None
        for at in self._slots(grams, size):
            out = self.slots[size][at] if out is None else out & self.slots[size][at]
        return out

    def hits(self, texts: list[str | None]) -> np.ndarray:
        """How many n-grams of each text are typical of each language, and in small part how many it holds, without the expected false ones."""
        out, count = np.zeros((len(texts), len(self.languages))), len(self.languages)
        for n in SIZES:
            doc, grams = codes(texts, n)
            masks, total = self.masks(grams, n), np.bincount(doc, minlength=len(texts))
            for k in range(count):
                sums = 0.0
                for plane, weight in ((k, HELD), (count + k, 1.0)):
                    bit = (masks[:, plane // 64] >> np.uint64(plane % 64)) & np.uint64(1)
                    wrong = self.false_rate[n][plane]
                    sums = sums + weight * np.maximum(0, np.bincount(doc, bit, len(texts)) - total * wrong) / max(1e-9, 1 - wrong)
                out[:, k] += sums
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, share of the hits); ties go to the first language, texts without hits to the most frequent one."""
        hits = self.hits(texts) if self.languages else np.zeros((len(texts), 1))
        best, total = hits.argmax(1), hits.sum(1)
        share = np.where(total > 0, hits[np.arange(len(texts)), best] / np.maximum(total, 1e-9), 0.0)
        best = np.where(total > 0, best, self.prior)
        known = [bool(t) and bool(self.languages) and LETTER.search(t) is not None for t in texts]
        return [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, known, strict=True)], np.where(known, np.clip(share, 0, 1), 0.0)


def own_grams(found: list[tuple[np.ndarray, np.ndarray]], least: float = OWN_SHARE) -> list[np.ndarray]:
    """Each language's n-grams that are at least `least` times as frequent in it as in any other language."""
    if not found:
        return []
    grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    rates = np.concatenate([c / max(1, c.sum()) for _, c in found])
    most = np.zeros(len(grams))
    np.maximum.at(most, at, rates)
    good, ends = rates >= least * most[at], np.cumsum([len(g) for g, _ in found])
    return [g[k] for (g, _), k in zip(found, np.split(good, ends[:-1]), strict=True)]


def train(docs: DataFrame, max_train: int = MAX_TRAIN, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Filters:
    """Filters from the n-grams of at most max_train documents of each language.

    Documents with a null language or text, or without a letter, are not learned from. Ranks by hash of the id choose
    the documents: ids alone are ranked, a language's smallest ones first within each partition. Their distinct n-grams and
    counts, in number bounded by those documents' texts, come to the driver as packed bytes.
    """
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    per = usable.groupBy(lang).agg(F.count("*").alias("n")).orderBy(lang).collect()
    languages = [r[0] for r in per]
    if not languages:
        return Filters([], {})
    bounds = {r[0]: min(1.0, 2 * max_train / r["n"]) for r in per}  # twice as many as asked for, on average
    unit = F.pmod(F.xxhash64(key), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.create_map(*(x for k, v in bounds.items() for x in (F.lit(k), F.lit(v))))
    ids = usable.where(unit <= F.element_at(share, F.col(lang))).select(key, F.col(lang).alias("_l"))
    window = Window.partitionBy("_l").orderBy(F.xxhash64(key), key)
    ids = ids.distinct().withColumn("_r", F.row_number().over(window)).where(F.col("_r") <= max_train).drop("_r")
    index = {v: k for k, v in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_t", 4 << 20):
            texts = b.column("_t").to_pylist()
            own = np.array([index[v] for v in b.column("_l").to_pylist()], np.int64)
            for n in SIZES:
                doc, grams = codes(texts, n)
                for k in np.unique(own):
                    g, c = np.unique(grams[own[doc] == k], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"size": pa.array([n] * len(g), pa.int32()), "lang": pa.array([k] * len(g), pa.int32()), "gram": pa.array(g.astype(np.int64)), "n": pa.array(c.astype(np.int64))})

    # at most max_train ids a language
    chosen = usable.select(F.col(key), F.col(text).alias("_t"), F.col(lang).alias("_l")).join(F.broadcast(ids), [key, "_l"]).select("_t", "_l")
    counts = chosen.mapInArrow(count, "size int, lang int, gram bigint, n bigint").groupBy("size", "lang", "gram").agg(F.sum("n").alias("n"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, own, gram, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("size", "lang", "gram", "n"))
            for s in SIZES:
                for k in np.unique(own[size == s]):
                    some = (size == s) & (own == k)
                    yield pa.RecordBatch.from_pydict({"size": pa.array([s], pa.int32()), "lang": pa.array([k], pa.int32()), "g": pa.array([gram[some].tobytes()], pa.binary()), "n": pa.array([n[some].astype(np.int32).tobytes()], pa.binary())})

    found: dict[tuple[int, int], list] = {}
    for r in counts.mapInArrow(packed, "size int, lang int, g binary, n binary").collect():
        found.setdefault((r["size"], r["lang"]), []).append((np.frombuffer(r["g"], np.int64).astype(np.uint64), np.frombuffer(r["n"], np.int32).astype(float)))
    none = [(np.empty(0, np.uint64), np.empty(0))]
    both = {n: [tuple(np.concatenate(z) for z in zip(*found.get((n, k), none), strict=True)) for k in range(len(languages))] for n in SIZES}
    grams, own = {n: [g for g, _ in x] for n, x in both.items()}, {n: own_grams(x) for n, x in both.items()}
    return Filters(languages, grams, max(range(len(per)), key=lambda k: per[k]["n"]), own)


def predict(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """docs with lang_pred and score of each whole text; `und` and 0 where it is null or has no letter.

    The filters, at most 2**24 slots a size and 32 languages, are broadcast. Columns of these names are replaced. Repeated rows are each predicted, and an
    empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)
    docs = docs.drop("lang_pred", "score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text, 2 << 20):
            found, score = sent.value.predict(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")


def op6_language(spark, sf_dir: str) -> DataFrame:
    """Language and score of every document."""
    docs = read(spark, sf_dir, "documents")
    filters = train(docs.where(fold("doc_id", 3) != 1))
    found = predict(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
